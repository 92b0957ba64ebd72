"""What the operators share: scratch tables in the shared folder, and words and hashes of whole Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every contract here: space and U+0009 to U+000D, all single bytes in UTF-8.
WS_CHARS = "\t\n\x0b\x0c\r "
WS_RE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made since the innermost scratch() began; None outside of any.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that executors and driver share. A local one only where the session has no setting and no cluster (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "planlake-checkpoints")
    return f"{base.rstrip('/')}/planlake-{uuid.uuid4().hex}"


def removed(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes folders, and lets Spark's cleaner drop the shuffles that no plan refers to any more, which it does after a collection."""
    spark.sparkContext._jvm.System.gc()
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and lost executors cost no rework. Column `by` makes subfolders."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    made = _made.get()
    if made is not None:
        made.append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut within is removed at the end, so nothing that reads it may be used afterwards."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        removed(spark, made)


def sole(spark: SparkSession, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """The result of build() as a table; what was cut on the way to it is removed."""
    with scratch(spark):
        out = build()
        made = _made.get()
        _made.set([])
        try:
            out = cut(out, by)
        finally:
            own = _made.get()
            _made.set(made)
    if _made.get() is not None:
        _made.get().extend(own)
    return out


def settled(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query whose result is a table in the shared folder, and whose scratch tables are gone when it returns."""

    @wraps(build)
    def run(spark: SparkSession, *args) -> DataFrame:
        return sole(spark, lambda: build(spark, *args))

    return run


#: A key with at least 1 / HOT_SHARE of all rows is hot; there can be no more than HOT_SHARE of them.
HOT_SHARE = 1000


def join_on_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each key and in n how many rows of left hold it; total rows in all.

    Rows of hot keys stay where they are: the right rows of hot keys, HOT_SHARE at most, are sent to all tasks. The others
    shuffle by key, at every size: a small right side that Spark would broadcast hides how the join grows. left is read twice and should be a table.
    """
    hot = F.col(n) * HOT_SHARE >= total
    top = F.broadcast(right.where(hot))  # at most HOT_SHARE rows
    rest = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti")
    return left.join(top, keys, how).unionByName(rest.hint("merge").join(right.where(~hot), keys, how))


def numbered(rows: DataFrame, keys: list[str], per_task: int = 1_000_000) -> DataFrame:
    """rows with `number`, from 0 without a gap. rows is a table whose keys do not repeat."""
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // per_task))
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(parts)))
    counts = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())  # a row for per_task rows
    before = spark.createDataFrame([(p, sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)] or [(0, 0)], "__part bigint, before bigint")
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return dealt.withColumn("nth", nth).join(F.broadcast(before), "__part").select(*rows.columns, (F.col("before") + F.col("nth") - 1).alias("number"))


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_P = np.uint64(0x9E3779B97F4A7C15)
_IS_WS = np.zeros(256, bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def text_slices(col: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a string column of about `most` bytes and one row at least: first row, end row, bytes, offsets.

    Null counts as empty.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each row (one more entry than rows)."""
    solid = ~_IS_WS[buf]
    brk = np.ones(len(buf) + 1, bool)  # brk[i]: no word goes on from byte i - 1 to byte i
    brk[1:-1] = ~(solid[1:] & solid[:-1])
    brk[offs] = True
    starts = np.flatnonzero(solid & brk[:-1])
    ends = np.flatnonzero(solid & brk[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word's bytes, with A-Z read as a-z if asked for."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    at = np.arange(int(lens.sum())) - np.repeat(first, lens)
    powers = np.cumprod(np.full(int(lens.max()), _P, np.uint64))
    with np.errstate(over="ignore"):
        val = (_LOWER if lower else _BYTE)[buf[at + np.repeat(starts, lens)]] * powers[at]
        return mix(np.add.reduceat(val, first) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_WEIGHTS = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries of w; entry i covers w[i : i + k]."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(k), np.uint64)
        for j in range(k):
            out += w[j : j + n] * _WEIGHTS[j]
        return mix(out)


def as_int64(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def hash_pair(c) -> list:
    """Two independent 64-bit hashes of a string column."""
    return [F.xxhash64(c), F.xxhash64(F.lit(7), F.reverse(c))]


def shielded(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, dict[str, str]]:
    """docs with every column but `keep` under a name that no job uses, and the way back."""
    names = {f"__c{i}": c for i, c in enumerate(docs.columns) if c not in keep}
    return docs.withColumnsRenamed({c: n for n, c in names.items()}), names


def unshielded(df: DataFrame, names: dict[str, str], own: list[str], columns: list[str]) -> DataFrame:
    """The input's columns in their order, then the job's own; these replace input columns of their name."""
    back = {c: n for n, c in names.items()}
    return df.select(*(F.col(back.get(c, c)).alias(c) for c in columns if c not in own), *own)
