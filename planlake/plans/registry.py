"""Every query of the library by name, with its SQL for DuckDB."""

from __future__ import annotations

import importlib

MODULES = ("met", "evt", "txt", "bel", "more", "assembly", "segments", "streams")
_queries: dict = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return keep


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"planlake.plans.{m}")


def queries() -> dict:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
