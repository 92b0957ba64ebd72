"""Every query of the library against its SQL, and the entry point."""

import pytest

import __spark_entry__ as entry
from planlake.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    from tests.conftest import SF

    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_needs_no_llm(spark):
    """The library without its subpackage for training text."""
    import subprocess
    import sys
    import textwrap
    from pathlib import Path

    code = """
        import sys
        class No:
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("planlake.llm"):
                    raise ModuleNotFoundError(name)
        sys.meta_path.insert(0, No())
        import __spark_entry__ as e
        assert "m01_daily_cube" in e.queries() and not any(k.startswith("op") for k in e.queries())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=Path(__file__).resolve().parents[1], check=True)
