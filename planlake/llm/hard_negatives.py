"""Hard negatives of anchors: rows of another label that score just below a positive, by segment summary filtering.

Components become whole numbers. Of each vector the mean and the deviation of its segments are stored, at the finest
level; halves of the number of segments follow from them. With segments of n components, means m and deviations d, the
product of two vectors lies within the sum of n * m * m' plus or minus d * d' over the segments (Cauchy-Schwarz on what is
left of the means). A stated set of anchors meets all rows in blocks. Pairs that the bounds of one segment cannot decide
are looked at with 2 segments, then 4 and so on, and only those that no level decides are scored exactly.

It runs twice. First each anchor's positives: the highest scores of its label. A pair goes whose upper bound is below the k-th
best lower bound of its anchor. Then, for each anchor and positive, the highest scores of other labels within the
positive's band: a pair also goes when its bounds lie outside of all bands of the anchor. A tile of two blocks gives k rows
for each anchor and band at most, and tiles are merged by a top-k, so hot labels and repeated rows need no group.

Rows with a null id, label or vector, or with null or non-finite components, take no part. Only vectors of equal length
meet. Of several rows with one anchor id the smallest vector, then label, is the anchor, and no row with its id is its
partner. A repeated row is one candidate more, and as a positive has negatives of its own. Equal scores: the smaller id
first. Scores beyond 64 bits are held at their ends. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlake.llm.common import cut, settled, table

POSITIVES = 5
NEGATIVES = 3
#: A negative's share of the positive's score, in percent.
BAND = (50, 95)
#: Rows of a block; long vectors have fewer, so that a block takes BLOCK_BYTES.
CANDIDATES = 8192
ANCHORS = 512
BLOCK_BYTES = 1 << 25
#: Candidates that are bounded at a time.
STEP = 2048
#: Segments at the finest level.
SEGMENTS = 16
#: Below this share of pairs left, pairs are looked at one by one instead of in whole matrices.
SPARSE = 0.05
_TOP = 2**63 - 1
#: Whole numbers up to here are exact as doubles.
_EXACT = 2.0**53

_BLOCK = pa.schema([("dim", pa.int32()), ("kind", pa.string()), *((c, pa.binary()) for c in ("ids", "labels", "vectors", "means", "devs", "low", "high"))])
_BLOCK_SQL = "dim int, kind string, ids binary, labels binary, vectors binary, means binary, devs binary, low binary, high binary"


def usable(vectors: DataFrame, label: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id, label, v (whole numbers as doubles), dim."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    # floor() of a double is a bigint, which large components exceed
    whole = F.transform("v", lambda x: F.when(F.abs(x * scale) < float(2**52), F.floor(x * scale).cast("double")).otherwise(x * scale))
    return rows.select("vec_id", "label", whole.alias("v"), F.size("v").alias("dim"))


def edges(dim: int, segments: int) -> np.ndarray:
    """Where segments begin and end; those of half as many segments begin and end there too."""
    return np.arange(segments + 1) * dim // segments


def finest(dim: int) -> int:
    n = 1
    while n < SEGMENTS and 4 * n <= dim:
        n *= 2
    return n


def summary(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (root of the summed squares around the mean) of the finest segments."""
    e = edges(v.shape[1], finest(v.shape[1]))
    n = np.maximum(np.diff(e), 1)
    means, devs = np.zeros((len(v), len(n))), np.zeros((len(v), len(n)))
    for s, (a, b) in enumerate(zip(e[:-1], e[1:], strict=True)):
        part = v[:, a:b]
        means[:, s] = part.sum(1) / n[s]
        with np.errstate(over="ignore", invalid="ignore"):
            devs[:, s] = np.sqrt(((part - means[:, s : s + 1]) ** 2).sum(1))
    return means, devs


def levels(means: np.ndarray, devs: np.ndarray, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, 4 ... segments: means times the root of the segment's size, and deviations."""
    n = np.diff(edges(dim, means.shape[1])).astype(float)
    out = []
    while True:
        out.append((means * np.sqrt(n), devs))
        if len(n) == 1:
            return out[::-1]
        a, b = n[::2], n[1::2]
        both = np.maximum(a + b, 1)
        with np.errstate(over="ignore", invalid="ignore"):
            devs = np.sqrt(devs[:, ::2] ** 2 + devs[:, 1::2] ** 2 + a * b / both * (means[:, ::2] - means[:, 1::2]) ** 2)
        means = (a * means[:, ::2] + b * means[:, 1::2]) / both
        n = a + b


def _stored(v: np.ndarray) -> tuple[str, bytes]:
    most = np.abs(v).max(initial=0.0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, v.astype(kind).tobytes()


def _row(dim: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    means, devs = summary(v)
    kind, data = _stored(v)
    row = [dim, kind, ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), data, means.astype("<f8").tobytes(), devs.astype("<f8").tobytes(), low.astype("<i8").tobytes(), high.astype("<i8").tobytes()]
    return pa.record_batch([pa.array([c], f.type) for c, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)


def blocks(rows: DataFrame, at_most: int) -> DataFrame:
    """vec_id, label, v, dim, low and high as blocks of one vector length, each from one partition, with a number; nothing is moved.

    low and high hold the bands of a row, the same number for all rows.
    """

    def columns(part: pa.RecordBatch, dim: int) -> list[np.ndarray]:
        n = len(part)
        flat = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1 if c != "v" else dim) if n and (c != "v" or dim) else np.zeros((n, 0))
        return [part.column("vec_id").to_numpy(), part.column("label").to_numpy(), flat("v"), flat("low"), flat("high")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        count: dict[int, int] = {}

        def block(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            del count[dim]
            return _row(dim, *(np.concatenate([p[i] for p in parts]) for i in range(5)))

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in map(int, np.unique(dims)):
                whole = columns(batch.filter(pa.array(dims == dim)), dim)
                most = max(1, min(at_most, BLOCK_BYTES // (8 * (dim + 1))))
                for a in range(0, len(whole[0]), most):
                    piece = [x[a : a + most] for x in whole]
                    if count.get(dim, 0) + len(piece[0]) > most:
                        yield block(dim)
                    held.setdefault(dim, []).append(piece)
                    count[dim] = count.get(dim, 0) + len(piece[0])
                while sum(8 * (d + 2) * n for d, n in count.items()) > 2 * BLOCK_BYTES:  # many lengths in one partition
                    yield block(max(count, key=lambda d: count[d] * (d + 2)))
        for dim in list(held):
            yield block(dim)

    return cut(rows.select("vec_id", "label", "v", "dim", "low", "high").mapInArrow(build, _BLOCK_SQL).withColumn("block", F.monotonically_increasing_id()))


class Block:
    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.v = np.frombuffer(row["vectors"], row["kind"]).reshape(len(self.ids), self.dim).astype(float)
        self.levels = levels(*(np.frombuffer(row[k], "<f8").reshape(len(self.ids), -1) for k in ("means", "devs")), self.dim)
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((self.v**2).sum(1))
        self.most = float(np.abs(self.v).max(initial=0.0))
        self.low, self.high = (np.frombuffer(row[k], "<i8").reshape(len(self.ids), -1) for k in ("low", "high"))


def bounds(q: Block, c: Block, cols: slice, level: int, i: np.ndarray | None, j: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the products of q's rows with rows `cols` of c: all of them, or the pairs (i, j)."""
    (qm, qd), (cm, cd) = q.levels[level], c.levels[level]
    cm, cd = cm[cols], cd[cols]
    # whole numbers: what rounding takes from the bounds stays far below one part in a thousand million of the norms
    with np.errstate(over="ignore", invalid="ignore"):
        if i is None:
            mid, slack = qm @ cm.T, qd @ cd.T + 1e-9 * np.outer(q.norm, c.norm[cols]) + 1e-6
        else:
            mid, slack = np.einsum("ps,ps->p", qm[i], cm[j]), np.einsum("ps,ps->p", qd[i], cd[j]) + 1e-9 * q.norm[i] * c.norm[cols][j] + 1e-6
        low, high = mid - slack, mid + slack
    return np.nan_to_num(low, nan=-np.inf, neginf=-np.inf), np.nan_to_num(high, nan=np.inf, posinf=np.inf)


def products(q: Block, c: Block, cols: slice, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact products of the pairs (i, j)."""
    cv = c.v[cols]
    if q.most * c.most * max(1, q.dim) < _EXACT:
        if len(i) > SPARSE * len(q.v) * len(cv):
            return (q.v @ cv.T)[i, j].astype(np.int64)
        return np.einsum("pd,pd->p", q.v[i], cv[j]).astype(np.int64)
    whole = [[int(x) for x in row] for row in q.v], [[int(x) for x in row] for row in cv]
    return np.array([max(-_TOP - 1, min(_TOP, sum(a * b for a, b in zip(whole[0][x], whole[1][y], strict=True)))) for x, y in zip(i, j, strict=True)], np.int64)


def kth_best(group: np.ndarray, value: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The k-th largest value of each group, minus infinity where there are fewer."""
    out = np.full(groups, -np.inf)
    order = np.lexsort((-value, group))
    g = group[order]
    first = np.searchsorted(g, np.arange(groups))
    enough = np.searchsorted(g, np.arange(groups), "right") - first >= k
    out[enough] = value[order[first[enough] + k - 1]]
    return out


def tile(q: Block, c: Block, k: int, same_label: bool) -> tuple[np.ndarray, ...]:
    """For each row of q and each of its bands the k best candidates of c within: rows of q, bands, ids, scores."""
    low, high = q.low, q.high
    n, n_bands = low.shape
    best: list[tuple[np.ndarray, ...]] = []
    floor = np.full((n, n_bands), -_TOP - 1)  # what the k-th best so far scores
    for a in range(0, len(c.ids), STEP):
        cols = slice(a, a + STEP)
        alive = ((q.labels[:, None] == c.labels[None, cols]) == same_label) & (q.ids[:, None] != c.ids[None, cols])
        i, j = np.nonzero(alive)
        for level in range(len(q.levels)):
            if not len(i):
                break
            lower, upper = bounds(q, c, cols, level, None, None) if len(i) > SPARSE * alive.size else bounds(q, c, cols, level, i, j)
            if lower.ndim == 2:
                lower, upper = lower[i, j], upper[i, j]
            open_ = np.zeros(len(i), bool)
            for b in range(n_bands):
                lo, hi = low[i, b], high[i, b]
                sure = (lower >= lo) & (upper <= hi)
                least = np.maximum(floor[:, b], kth_best(i[sure], lower[sure], k, n))
                open_ |= (upper >= lo) & (lower <= hi) & (upper >= least[i])
            i, j = i[open_], j[open_]
        if not len(i):
            continue
        score = products(q, c, cols, i, j)
        ids = c.ids[cols][j]
        for b in range(n_bands):
            inside = (score >= low[i, b]) & (score <= high[i, b]) & (score >= floor[i, b])
            best.append((i[inside], np.full(int(inside.sum()), b), ids[inside], score[inside]))
        row, band, ids, score = (np.concatenate(x) for x in zip(*best, strict=True))
        order = np.lexsort((ids, ~score, band, row))  # ~score falls as score rises, over all 64 bits
        group = (row * n_bands + band)[order]
        start = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
        nth = np.arange(len(group)) - np.maximum.accumulate(np.where(start, np.arange(len(group)), 0)) if len(group) else np.zeros(0, int)
        order = order[nth < k]
        best = [(row[order], band[order], ids[order], score[order])]
        full = nth == k - 1
        floor[np.unravel_index(group[full], floor.shape)] = score[order][np.flatnonzero(full[nth < k])]
    return best[0] if best else tuple(np.zeros(0, np.int64) for _ in range(4))


def best_in_bands(anchors: DataFrame, rows: DataFrame, k: int, same_label: bool) -> DataFrame:
    """anchor_id, band, vec_id, score: the k best of each anchor and band, with `nth` from 1. anchors and rows are tables of blocks."""
    places = rows.select("dim", F.col("block").alias("c_block")).join(anchors.select("dim", F.col("block").alias("q_block")), "dim")
    # the table of tiles has no vectors: (rows / 8192) * (anchors / 512) short rows
    pairs = (
        places.repartition("c_block", "q_block")
        .join(anchors.select("dim", F.col("block").alias("q_block"), F.struct(*anchors.columns).alias("q")), ["dim", "q_block"])
        .join(rows.select("dim", F.col("block").alias("c_block"), F.struct(*rows.columns).alias("c")), ["dim", "c_block"])
        .select("q", "c")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, c in zip(batch.column("q"), batch.column("c"), strict=True):
                q = Block(a.as_py())
                row, band, ids, score = tile(q, Block(c.as_py()), k, same_label)
                yield pa.record_batch([pa.array(q.ids[row], pa.int64()), pa.array(band, pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["anchor_id", "band", "vec_id", "score"])

    found = pairs.mapInArrow(run, "anchor_id bigint, band int, vec_id bigint, score bigint")
    w = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "vec_id")  # k rows of each tile at most
    return found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def _bands(low: Column, high: Column) -> list[Column]:
    return [low.cast("array<bigint>").alias("low"), high.cast("array<bigint>").alias("high")]


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND,
    scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    is_anchor and label are expressions over the columns of vectors; components become floor(scale * x).
    """
    rows = usable(vectors, label, id_col, vec_col, scale)
    ask = usable(vectors.where(is_anchor), label, id_col, vec_col, scale)
    ask = cut(ask.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("x")).select("vec_id", "x.label", "x.v", F.size("x.v").alias("dim")))
    n_blocks = max(1, -(-ask.count() // ANCHORS))
    none, least, most = F.array().cast("array<bigint>"), F.lit(-_TOP - 1), F.lit(_TOP)
    stored = blocks(rows.select("*", none.alias("low"), none.alias("high")), CANDIDATES)

    open_ = ask.repartition(n_blocks).select("*", *_bands(F.array(least), F.array(most)))
    own = best_in_bands(blocks(open_, ANCHORS), stored, positives, same_label=True)
    own = cut(own.select("anchor_id", F.col("nth").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # 100 * negative >= band[0] * positive, and 100 * negative <= band[1] * positive, in whole numbers
    p = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(p * band[0] / 100), F.floor(p * band[1] / 100)
    kept = own.select("anchor_id", F.struct("positive_rank", low.cast("bigint").alias("low"), high.cast("bigint").alias("high")).alias("b"))
    lists = kept.groupBy("anchor_id").agg(F.sort_array(F.collect_list("b")).alias("b"))  # `positives` at most
    # an anchor with fewer positives has bands that hold nothing in the place of the others
    fill = lambda name, v: F.concat(F.transform("b", lambda x: x[name]), F.array_repeat(v, F.lit(positives) - F.size("b")))
    asked = ask.join(lists.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("vec_id", "label", "v", "dim", *_bands(fill("low", most), fill("high", least)))
    found = best_in_bands(blocks(cut(asked).repartition(n_blocks), ANCHORS), stored, negatives, same_label=False)
    found = found.select("anchor_id", (F.col("band") + 1).alias("positive_rank"), F.col("nth").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(own, ["anchor_id", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


@settled
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, noisy).drop("positive_rank")


ORACLE = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), p as (
  select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same
), n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score, row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score where k <= 5
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
