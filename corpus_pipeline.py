"""A training corpus from `documents`, in five stages, each (name, function of spark, docs and sf_dir)."""

from planlake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
