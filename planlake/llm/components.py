"""Connected components of a link table: large-star and small-star steps, over links that tasks have merged among themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planlake.llm.common import cut, sole

#: A task merges so many links at a time.
MERGED = 1_000_000


def _roots(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of the nodes 0 to n - 1 reaches by links x, y."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for at in (root[x], root[y]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _merged(links: DataFrame) -> DataFrame:
    """a, b with a > b: the nodes of every MERGED links of a task, each linked once, with the smallest that it reaches by them."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids, at = np.unique(np.concatenate([t.column(k).to_numpy() for k in ("a", "b")]), return_inverse=True)
        root = _roots(at[: t.num_rows], at[t.num_rows :], len(ids))
        leaf = root != np.arange(len(ids))
        return pa.record_batch([pa.array(ids[leaf], pa.int64()), pa.array(ids[root[leaf]], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= MERGED:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return links.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _least(e: DataFrame) -> DataFrame:
    """a, m, odd: each node's smallest neighbour or itself; odd, if it has several smaller neighbours, or smaller and larger ones.

    Without odd nodes each link leads to the smallest node of its component, which is then m. e has a > b.
    """
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = both.groupBy("a").agg(F.min("b").alias("low"), F.max(F.when(F.col("b") < F.col("a"), F.col("b"))).alias("high"), F.max("b").alias("top"))
    return ends.select("a", F.least("low", "a").alias("m"), F.expr("coalesce(low < high, false) or (low < a and top > a)").alias("odd"))


def _large_star(e: DataFrame, least: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour."""
    return e.join(least.select(F.col("a").alias("b"), "m"), "b").select("a", F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of them. e is merged, so a node has a row of each merge at most."""
    moved = e.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return moved.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node and component, its smallest reachable node, as a table; nodes without links have no row.

    Links and nodes stay in tables; the driver sees at most one row for each step, and drops what a step left behind.
    """
    spark = links.sparkSession
    e = cut(_merged(links))
    least = sole(spark, lambda: _least(e))
    while least.where("odd").take(1):
        e = sole(spark, lambda e=e, least=least: _small_star(cut(_merged(_large_star(e, least)))))
        least = sole(spark, lambda e=e: _least(e))
    return least.select(F.col("a").alias("node"), F.col("m").alias("component"))
