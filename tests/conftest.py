import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{base}/shared")
        .config("spark.sql.warehouse.dir", f"{base}/warehouse")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if len(v.isoformat()) == 10 or v.isoformat().endswith("T00:00:00") else v.isoformat()
    if type(v).__name__ == "Decimal":
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def rows_of(names, rows):
    """Rows as sorted text, columns by name."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([_plain(r[i]) if not isinstance(_plain(r[i]), int) or isinstance(_plain(r[i]), bool) else float(_plain(r[i])) for i in order]) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    def check(query, sql):
        df = query(spark, SF)
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(names)
        assert got == rows_of(names, cur.fetchall())

    return check
