"""Quality classifier by co-training of a text-content view and a page-metadata view.

The content view sees statistics of the whole text and hashed word frequencies; the metadata view sees source, language and
stored length. Both are logistic regressions. In each of ROUNDS rounds either classifier hands its most confident
predictions on unlabelled documents, as many of each class as the labels' share asks for, to the other one's training set. Then
each view's log-odds are calibrated on labelled rows kept out of training, and the calibrated views are combined by a
small logistic regression on the same rows. All documents are scored.

Labelled rows are a bounded sample of LABELLED distinct documents by hash of doc_id (a quarter of them kept out for calibration). The
pool of pseudo-labels is every unlabelled document: features of all documents are computed once on executors and kept in the shared
folder, one row for each doc_id. In a round executors score the whole pool; histograms of the log-odds give the bounds that select each view's
share, and selected documents enter the fit as sums (gradient and Hessian of each Newton step). What earlier rounds selected is worked out
again from their models and bounds, so the driver holds labelled rows and sums only. Scoring reads all rows and whole texts.

Null and empty text has zero content features; null metadata is a value of its own. Labels other than 0 and 1 and rows with null ids
count as unlabelled; of contradicting labels of a document the smaller counts, and of differing rows of one doc_id the fit sees one. Without labels of both classes every score is 0.5. Repeated rows are scored each; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlake.llm.common import cut, mix, settled, table, text_slices, word_hashes, word_spans

LABELLED = 6000
ROUNDS = 4
SHARE = 0.05
WORD_BUCKETS = 128
SOURCES, LANGS = 64, 16
N_STATS = 14
#: Histogram of log-odds: BINS bins, PER_UNIT in a unit, the outer ones open.
BINS, PER_UNIT = 2400, 40
STEPS = 12

_KIND = np.zeros(256, np.int64)  # 1 letter, 2 digit, 3 capital, 4 white space, 5 line end, 6 other sign
_KIND[33:127] = 6
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[[9, 11, 12, 13, 32]] = 4
_KIND[10] = 5


def content_features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """N_STATS statistics and WORD_BUCKETS frequencies for each text."""
    n = len(offs) - 1
    out = np.zeros((n, N_STATS + WORD_BUCKETS), np.float32)
    starts, ends, first = word_spans(buf, offs)
    h = word_hashes(buf, starts, ends, lower=True)
    size = np.diff(offs)
    kinds = np.bincount(np.repeat(np.arange(n), size) * 7 + _KIND[buf], minlength=n * 7).reshape(n, 7)
    out[:, 0] = np.log1p(size)
    out[:, 1:8] = kinds / np.maximum(size, 1)[:, None]
    words = np.diff(first)
    length = ends - starts
    bucket = (h >> np.uint64(57)).astype(np.int64) if WORD_BUCKETS == 128 else (h % np.uint64(WORD_BUCKETS)).astype(np.int64)
    text = np.repeat(np.arange(n), words)
    freq = np.bincount(text * WORD_BUCKETS + bucket, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
    out[:, N_STATS:] = np.sqrt(freq / np.maximum(words, 1)[:, None])
    total = np.bincount(text, weights=length, minlength=n)
    out[:, 8] = np.log1p(total / np.maximum(words, 1))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    out[:, 9] = np.bincount(text, weights=again, minlength=n) / np.maximum(words, 1)
    for i in range(n):
        w = h[first[i] : first[i + 1]]
        if len(w):
            _, c = np.unique(w, return_counts=True)
            out[i, 10] = len(c) / len(w)
            out[i, 11] = c.max() / len(w)
            p = c / len(w)
            out[i, 12] = -(p * np.log(p)).sum() / np.log1p(len(w))
            out[i, 13] = length[first[i] : first[i + 1]].std() / 10
    return out


def metadata_columns() -> list:
    h = lambda c, n: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(n)).cast("int")
    return [h("source", SOURCES).alias("m_source"), h("lang", LANGS).alias("m_lang"), F.log1p(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("m_size")]


def metadata_features(source: np.ndarray, lang: np.ndarray, size: np.ndarray) -> np.ndarray:
    bins = np.clip((size * 2).astype(int), 0, 31)
    out = np.zeros((len(source), SOURCES + LANGS + 34), np.float32)
    at = np.arange(len(source))
    out[at, source] = out[at, SOURCES + lang] = out[at, SOURCES + LANGS + bins] = 1
    out[:, -2], out[:, -1] = size / 10, (size / 10) ** 2
    return out


class Logistic:
    """Ridge logistic regression on standardised columns, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        x = x.astype(np.float64)
        self.scale(x.mean(0), x.std(0), ridge)
        for _ in range(STEPS):
            if self.step(*self.sums(x, y)) < 1e-6:
                break

    def scale(self, mean: np.ndarray, sd: np.ndarray, ridge: float = 1.0) -> None:
        self.mean, self.sd = mean, np.maximum(sd, 1e-3)
        self.reg = np.full(len(mean) + 1, ridge)
        self.reg[-1] = 1e-6
        self.w = np.zeros(len(mean) + 1)

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hessian and gradient of these rows, which add up over parts of the rows."""
        z = np.hstack([(x - self.mean) / self.sd, np.ones((len(x), 1))])
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        return (z * (p * (1 - p) + 1e-6)[:, None]).T @ z, z.T @ (p - y)

    def step(self, hessian: np.ndarray, gradient: np.ndarray) -> float:
        step = np.linalg.solve(hessian + np.diag(self.reg), gradient + self.reg * self.w)
        self.w = self.w - step
        return float(np.abs(step).max())

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.sd) @ self.w[:-1] + self.w[-1]


def _scaled(mean: np.ndarray, sd: np.ndarray, w: np.ndarray | None = None) -> Logistic:
    model = Logistic.__new__(Logistic)
    model.scale(mean, sd)
    if w is not None:
        model.w = w
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offs in text_slices(batch.column("text")):
            rows = [r.tobytes() for r in content_features(buf, offs)]
            yield pa.record_batch([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "m_source", "m_lang", "m_size")), pa.array(rows, pa.binary())], names=["doc_id", "m_source", "m_lang", "m_size", "x"])


def featured(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """doc_id, h, quality, m_source, m_lang, m_size, x: one row for each document. Texts are read once, and none moves."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *metadata_columns())
    rows = rows.mapInArrow(_features, "doc_id bigint, m_source int, m_lang int, m_size double, x binary")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("x", "m_source", "m_lang", "m_size")).alias("r")).select("doc_id", "r.*")
    return cut(one.join(tags, "doc_id", "left").withColumn("h", F.xxhash64("doc_id")))


def _matrices(x: list, source: np.ndarray, lang: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both views of some rows."""
    return np.frombuffer(b"".join(x), np.float32).reshape(-1, N_STATS + WORD_BUCKETS).astype(np.float64), metadata_features(source, lang, size).astype(np.float64)


def _summed(pool: DataFrame, vector: Callable) -> np.ndarray | None:
    """The sum of vector(views, h) over batches of the pool: by partition, by group of partitions, then here; None for an empty pool."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                views = _matrices(batch.column("x").to_pylist(), *(batch.column(c).to_numpy() for c in ("m_source", "m_lang", "m_size")))
                v = vector(views, batch.column("h").to_numpy().view(np.uint64))
                total = v if total is None else total + v
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column("v"):
                v = np.frombuffer(v.as_py(), np.float64)
                total = v if total is None else total + v
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["v"])

    parts = pool.select("h", "m_source", "m_lang", "m_size", "x").mapInArrow(run, "v binary").repartition(8).mapInArrow(add, "v binary").collect()
    return np.sum([np.frombuffer(r["v"], np.float64) for r in parts], axis=0) if parts else None


def _bins(s: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(s * PER_UNIT).astype(np.int64) + BINS // 2, 0, BINS - 1)


def _bound(counts: np.ndarray, n: int) -> tuple[int, float]:
    """The first n of rows counted by bin: all of the bins before the first number, and the second's share of that bin."""
    through = np.cumsum(counts)
    if through[-1] <= n:
        return len(counts), 0.0
    k = int(np.searchsorted(through, n))
    return k, float((n - (through[k] - counts[k])) / counts[k])


def _share(h: np.ndarray, turn: int) -> np.ndarray:
    """A number from 0 to 1 for each row, other in each turn: decides within a bin."""
    with np.errstate(over="ignore"):
        return (mix(h + np.uint64(2 * turn + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / 2.0**53


def pseudo_labels(views: tuple, h: np.ndarray, history: list) -> list[np.ndarray]:
    """For view 0 and view 1 the label that the other one has given each row, -1 without. history: of each round the models and bounds."""
    given = [np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)]
    for turn, (models, bounds) in enumerate(history):
        for v in (0, 1):  # view v teaches the other one
            s, to = models[v].logit(views[v]), given[1 - v]
            k, u, (low, low_share), (high, high_share) = _bins(s), _share(h, 2 * turn + v), *bounds[v]
            back = BINS - 1 - k
            free = to < 0
            to[free & (s < -1.0) & ((k < low) | (k == low) & (u < low_share))] = 0  # confident ones only
            to[free & (s > 1.0) & ((back < high) | (back == high) & (u < high_share))] = 1
    return given


def _histograms(pool: DataFrame, models: list, history: list) -> np.ndarray:
    """Counts of what each view is confident about and has not handed on: view, class, bin (from the sure end)."""

    def vector(views: tuple, h: np.ndarray) -> np.ndarray:
        given, out = pseudo_labels(views, h, history), np.zeros((2, 2, BINS))
        for v in (0, 1):
            s = models[v].logit(views[v])[given[1 - v] < 0]
            out[v, 0] = np.bincount(_bins(s[s < -1.0]), minlength=BINS)
            out[v, 1] = np.bincount(BINS - 1 - _bins(s[s > 1.0]), minlength=BINS)
        return out.ravel()

    return _summed(pool, vector).reshape(2, 2, BINS)


def _fit(known: list, y: np.ndarray, scales: list, start: list | None, pool: DataFrame | None, history: list) -> list:
    """Both views on the labelled rows and on what the pool's documents were given, by Newton steps on summed rows."""
    models = [_scaled(*scales[v], start[v].w if start else None) for v in (0, 1)]

    def vector(views: tuple, h: np.ndarray) -> np.ndarray:
        given, out = pseudo_labels(views, h, history), []
        for v in (0, 1):
            own = given[v] >= 0
            hessian, gradient = models[v].sums(views[v][own], given[v][own])
            out += [hessian.ravel(), gradient]
        return np.concatenate(out)

    for _ in range(STEPS):
        far, rest = 0.0, _summed(pool, vector) if history else None
        for v in (0, 1):
            hessian, gradient = models[v].sums(known[v], y)
            if rest is not None:
                n = len(gradient)
                hessian, gradient, rest = hessian + rest[: n * n].reshape(n, n), gradient + rest[n * n : n * n + n], rest[n * n + n :]
            far = max(far, models[v].step(hessian, gradient))
        if far < 1e-3:
            break
    return models


def cotrain(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> dict | None:
    tags = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    rows = featured(docs, tags)
    got = rows.where("quality is not null").orderBy("h", "doc_id").limit(labelled).collect()
    y = np.array([r["quality"] for r in got], float)
    if len(y) < 8 or not 0 < y[::4].mean() < 1 or not 0 < np.delete(y, np.s_[::4]).mean() < 1:
        return None
    known = _matrices([r["x"] for r in got], *(np.array([r[c] for r in got], t) for c, t in (("m_source", int), ("m_lang", int), ("m_size", float))))
    held = np.arange(len(y)) % 4 == 0
    own = [v[~held] for v in known]
    pool = rows.where("quality is null")
    moments = lambda views, h=None: np.concatenate([[len(views[0])], *(m for v in views for m in (v.sum(0), (v * v).sum(0)))])
    total, others = moments(own), _summed(pool, moments)
    n_pool = 0 if others is None else int(others[0])
    total = total if others is None else total + others
    at = np.cumsum([1, *(own[v].shape[1] for v in (0, 0, 1, 1))])
    first, square = [total[at[2 * v] : at[2 * v + 1]] / total[0] for v in (0, 1)], [total[at[2 * v + 1] : at[2 * v + 2]] / total[0] for v in (0, 1)]
    scales = [(first[v], np.sqrt(np.maximum(square[v] - first[v] ** 2, 0))) for v in (0, 1)]
    good_share, n = y.mean(), max(2, int(SHARE * n_pool))
    most = max(1, int(n * (1 - good_share))), max(1, int(n * good_share))
    history: list = []
    final = _fit(own, y[~held], scales, None, None, history)
    for _ in range(rounds if n_pool else 0):
        counts = _histograms(pool, final, history)
        history = [*history, (final, [tuple(_bound(counts[v, c], most[c]) for c in (0, 1)) for v in (0, 1)])]
        final = _fit(own, y[~held], scales, final, pool, history)
    z = [final[v].logit(known[v][held]) for v in (0, 1)]
    calibrated = [Logistic(s[:, None], y[held], 0.01) for s in z]
    both = np.column_stack([calibrated[v].logit(z[v][:, None]) for v in (0, 1)])
    return {"views": final, "calibration": calibrated, "combine": Logistic(both, y[held], 0.1)}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, p_content, p_metadata, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        for batch in batches:
            meta = metadata_features(*(batch.column(c).to_numpy() for c in ("m_source", "m_lang", "m_size")))
            for a, b, buf, offs in text_slices(batch.column("text")):
                n = b - a
                if model is None:
                    out = [np.full(n, 0.5)] * 3
                else:
                    x = content_features(buf, offs), meta[a:b]
                    z = [model["calibration"][v].logit(model["views"][v].logit(x[v])[:, None]) for v in (0, 1)]
                    out = [p(z[0]), p(z[1]), p(model["combine"].logit(np.column_stack(z)))]
                yield pa.record_batch([batch.column("doc_id").slice(a, n), *(pa.array(o, pa.float64()) for o in out)], names=["doc_id", "p_content", "p_metadata", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *metadata_columns())
    return rows.mapInArrow(run, "doc_id bigint, p_content double, p_metadata double, score double")


@settled
def op2_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, cotrain(docs, table(spark, sf_dir, "labels")))
