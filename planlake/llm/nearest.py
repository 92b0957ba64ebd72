"""Nearest neighbours by a block matrix join of a stated query set against all rows.

Vectors are dealt by hash into blocks of bounded size. Each query block meets each candidate block once, as one
tile: int8 codes of both give all products of the tile at once, and with the codes' largest rounding errors each
product is known to lie in an interval. A pair whose upper end is below the 20th best lower end of its query cannot
be among the nearest and goes; the others are computed again from the original vectors in double precision and
merged into the query's heap. A tile gives at most k rows for each query; the tiles' rows are merged by a top-k.
The result is exact.

Nearness is the inner product; equal products go to the smaller id. Null or zero vectors, and those with null or
non-finite components, take no part, nor do rows without id. Only vectors of equal length are compared. A query's
own row is every row with its id. Empty tables give an empty result; extra columns are ignored. A repeated row is one candidate more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlake.llm.common import cut, settled, table

CANDIDATES = 8192
QUERIES = 1024
#: A block's vectors take so many bytes on average; long vectors have fewer to a block.
BLOCK_BYTES = 1 << 25
STEP = 2048


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, dim)


def blocks(rows: DataFrame, at_most: int) -> DataFrame:
    """One row for each block: dim, block, ids and vectors as bytes, `at_most` rows and BLOCK_BYTES on average."""
    count, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    n = max(1, -(-count // max(1, min(at_most, BLOCK_BYTES // (8 * width)))))

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, v = group.column("vec_id").to_numpy(), _matrix(group.column("v").chunk(0), group.column("dim")[0].as_py())
        order = np.lexsort((*v.T[::-1], ids))
        row = {"dim": [v.shape[1]], "block": [group.column("block")[0].as_py()], "ids": [ids[order].astype("<i8").tobytes()], "vectors": [v[order].astype("<f8").tobytes()]}
        return pa.table(row, schema=pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(build, "dim int, block int, ids binary, vectors binary")


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, each row's step, and the sum of the absolute codes."""
    step = np.abs(v).max(1) / 127.0
    step[step == 0] = 1.0  # too small to divide by: all codes are 0, which the bounds allow for
    codes = np.rint(v / step[:, None]).astype(np.int8)
    return codes, step, np.abs(codes.astype(np.int32)).sum(1)


def exact_products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in the order of the components."""
    out = np.zeros(len(c))
    for j in range(c.shape[1]):
        out += c[:, j] * q[j]
    return out


def tile(q_ids: np.ndarray, qv: np.ndarray, c_ids: np.ndarray, cv: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """For each query its k nearest of the tile: query id, candidate id, product."""
    dim = qv.shape[1]
    qc, qs, q1 = quantise(qv)
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    for a in range(0, len(c_ids), STEP):
        ids, v = c_ids[a : a + STEP], cv[a : a + STEP]
        cc, cs, c1 = quantise(v)
        # products of int8 codes are whole numbers below 2**24 for up to 1,040 components: exact in float32
        kind = np.float32 if dim <= 1000 else np.float64
        near = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64)
        with np.errstate(over="ignore"):
            unit = qs[:, None] * cs[None, :]
        slack = unit * (0.5 * (q1[:, None] + c1[None, :]) + 0.25 * dim) * (1 + 1e-9) + 1e-12 * unit
        with np.errstate(invalid="ignore", over="ignore"):
            low, high = np.nan_to_num(near * unit - slack, nan=-np.inf, neginf=-np.inf), np.nan_to_num(near * unit + slack, nan=np.inf, posinf=np.inf)
        low[q_ids[:, None] == ids[None, :]] = -np.inf
        high[q_ids[:, None] == ids[None, :]] = -np.inf
        floor = np.full(len(q_ids), -np.inf)
        if len(ids) >= k:
            floor = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k]
        for i, heap in enumerate(heaps):
            least = max(floor[i], heap[0][0] if len(heap) == k else -np.inf)
            live = np.flatnonzero((high[i] >= least) & (high[i] > -np.inf))
            if not len(live):
                continue
            score = exact_products(v[live], qv[i])
            best = np.lexsort((ids[live], -score))[:k]
            for j in best:
                item = (float(score[j]), -int(ids[live[j]]))
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heappushpop(heap, item)
    for q, heap in zip(q_ids, heaps, strict=True):
        for score, minus in heap:
            yield int(q), -minus, score


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. Of several vectors with one query id the smallest, component by component, is searched for."""
    cand = cut(blocks(usable(vectors, id_col, vec_col), CANDIDATES))
    one = usable(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    ask = cut(blocks(one, QUERIES))
    spread = cand.select("dim", F.col("block").alias("c_block")).join(ask.select("dim", F.col("block").alias("q_block")), "dim")
    # the table of tiles has no vectors: (candidates / 8192) * (queries / 1024) short rows
    pairs = (
        spread.repartition("c_block", "q_block")
        .join(ask.withColumnsRenamed({"block": "q_block", "ids": "q_ids", "vectors": "q_vectors"}), ["dim", "q_block"])
        .join(cand.withColumnsRenamed({"block": "c_block", "ids": "c_ids", "vectors": "c_vectors"}), ["dim", "c_block"])
        .select("dim", "q_ids", "q_vectors", "c_ids", "c_vectors")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, qi, qv, ci, cv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = list(tile(np.frombuffer(qi, "<i8"), np.frombuffer(qv, "<f8").reshape(-1, dim), np.frombuffer(ci, "<i8"), np.frombuffer(cv, "<f8").reshape(-1, dim), k))
                q, c, s = zip(*got, strict=True) if got else ((), (), ())
                yield pa.record_batch([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows of each tile
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@settled
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


ORACLE = """
with v as (select vec_id, embedding::double[] as v from embeddings where len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
