"""Language ID with a blended-spectrum presence kernel, Nystrom landmarks and one-versus-rest kernel ridge regression.

k(x, z) = |grams(x) & grams(z)| / sqrt(|grams(x)| |grams(z)|), over the set of byte n-grams (n from 1 to 4) of the
whole text, with A-Z read as a-z and the set kept as bits of a hashed table. Landmarks are training texts; with
K_mm = U S U', features are K_nm U S^-1/2, and ridge regression of +1 / -1 targets gives one column of weights
for each language. Scoring is X Z' A for batches of presence rows X.

The model is fitted on a bounded sample: `per_lang` rows of each language (fewer if there are many languages:
`max_rows` in all), taken by a hash of doc_id and text; of equal rows each counts. Everything else reads all rows and whole texts.

Null text and text without a letter is `und` with score 0; so is every text if nothing can be learned (an empty
table, no languages). Score: the winner's share of the clipped one-versus-rest outputs. Equal outputs go to the
language that sorts first. Repeated rows stay; extra columns are ignored or, named in `keep`, passed on; kept columns named
lang_pred or score are not allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlake.llm.common import table, text_slices

BITS = 14
GRAMS = (1, 2, 3, 4)
LANDMARKS = 160
PER_LANG = 300
MAX_ROWS = 6000
RIDGE = 1e-3
ROWS_AT_ONCE = 64
SLICE_BITS = 20

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[48:58] = 48
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def presence(buf: np.ndarray, offs: np.ndarray, bits: int = BITS) -> np.ndarray:
    """One row of 2**bits booleans for each text: which n-grams it has."""
    n, width = len(offs) - 1, (1 << bits) + 1  # the last column takes grams that would cross two texts
    out = np.zeros((n, width), bool)
    flat = out.reshape(-1)
    folded = _FOLD[buf]
    base = np.repeat(np.arange(n, dtype=np.int64) * width, np.diff(offs))
    code = np.zeros(len(buf), np.uint32)
    for k in GRAMS:
        m = len(buf) - k + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + folded[k - 1 : k - 1 + m]
        at = ((code + np.uint32(k)) * _MULT[k - 1]) ^ (code >> np.uint32(15))
        at = (at * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        same = base[:m] == base[k - 1 :]
        flat[base[:m] + np.where(same, at, np.uint32(width - 1)).astype(np.int64)] = True
    return out[:, :-1]


def has_letter(text: str | None) -> bool:
    """Whether a character is of a letter category, which str.isalpha() says and \\p{L} does."""
    return any(map(str.isalpha, text or ""))


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0)
        for a, b, buf, offs in text_slices(batch.column(1), 1 << 18):
            rows = np.packbits(presence(buf, offs), axis=1)
            yield pa.record_batch([langs.slice(a, b - a), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "grams"])


def _chosen(train: DataFrame, id_col: str, each: int, n_langs: int | None = None) -> DataFrame:
    """lang, text of the `each` rows of a language whose id and text have the smallest hashes.

    A histogram of the hashes gives each language a bound that at least `each` rows stay below, so that the window sorts little
    more than these and no language is gathered in a task. Bounds, one row for each of `n_langs` languages, are sent to all tasks, so
    that texts beyond them never move; with more than MAX_ROWS languages, or an unknown number, the same join shuffles.
    """
    h = F.xxhash64(id_col, "text")
    rows = train.where(F.col(id_col).isNotNull()).select("lang", "text", h.alias("h"), F.shiftrightunsigned(h, 64 - SLICE_BITS).alias("slice"))
    before = Window.partitionBy("lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # of 2**SLICE_BITS counts at most
    bounds = rows.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bounds = bounds.where(F.col("before") < each).groupBy("lang").agg(F.max("slice").alias("last")).select(F.col("lang").alias("of"), "last")
    if n_langs is not None and n_langs <= MAX_ROWS:
        bounds = F.broadcast(bounds)
    few = rows.join(bounds, (F.col("lang") == F.col("of")) & (F.col("slice") <= F.col("last")))
    w = Window.partitionBy("lang").orderBy("h", "text")
    return few.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= each).select("lang", "text")


def fit(train: DataFrame, id_col: str = "doc_id", per_lang: int = PER_LANG, max_rows: int = MAX_ROWS, landmarks: int = LANDMARKS) -> dict:
    """train: id, text and non-null lang. The fit is small: at most per_lang rows of each language and max_rows in all, of 2**BITS bits."""
    n_langs = train.select(F.count_distinct("lang")).first()[0]
    if not n_langs:
        return {"langs": []}
    each = max(1, min(per_lang, max_rows // n_langs))
    got = _chosen(train, id_col, each, n_langs).mapInArrow(_grams_of, "lang string, grams binary").collect()
    got = sorted(got, key=lambda r: (r["lang"], bytes(r["grams"])))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return {"langs": []}
    x = np.unpackbits(np.array([np.frombuffer(r["grams"], np.uint8) for r in got]), axis=1)
    y = np.array([langs.index(r["lang"]) for r in got])
    share = max(1, landmarks // len(langs))
    rng = np.random.default_rng(1)
    picked = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:share] for k in range(len(langs))])
    z = x[picked].astype(np.float32)
    z = z / np.sqrt(np.maximum(z.sum(1, keepdims=True), 1))
    xf = x.astype(np.float32)
    xf /= np.sqrt(np.maximum(xf.sum(1, keepdims=True), 1))
    k_nm = (xf @ z.T).astype(np.float64)
    s, u = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = s > 1e-6 * max(s[-1], 1e-12)
    root = u[:, good] / np.sqrt(s[good])
    f = np.hstack([k_nm @ root, np.ones((len(k_nm), 1))])
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    size = np.bincount(y, minlength=len(langs))
    weight = (1.0 / size[y])[:, None]
    reg = RIDGE * np.eye(f.shape[1])
    reg[-1, -1] = 1e-9
    coef = np.linalg.solve(f.T @ (f * weight) + reg, f.T @ (target * weight))
    return {"langs": langs, "landmarks": np.packbits(x[picked], axis=1), "alpha": (root @ coef[:-1]).astype(np.float32), "bias": coef[-1].astype(np.float32)}


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred and score."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = model["langs"]
        names = np.array([*langs, "und"], object)
        if langs:
            z = np.unpackbits(model["landmarks"], axis=1).astype(np.float32)
            zt = np.ascontiguousarray((z / np.sqrt(np.maximum(z.sum(1, keepdims=True), 1))).T)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            lettered = np.fromiter((has_letter(t.as_py()) for t in texts), bool, len(texts))
            best, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
            if langs:
                for a, b, buf, offs in text_slices(texts, 1 << 18):
                    for c in range(a, b, ROWS_AT_ONCE):
                        d = min(b, c + ROWS_AT_ONCE)
                        lo, hi = offs[c - a], offs[d - a]
                        x = presence(buf[lo:hi], offs[c - a : d - a + 1] - lo).astype(np.float32)
                        k = (x @ zt) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
                        out = k @ model["alpha"] + model["bias"]
                        best[c:d] = out.argmax(1)
                        share = np.clip((out.astype(np.float64) + 1) / 2, 1e-6, 1)
                        score[c:d] = share.max(1) / share.sum(1)
            best[~lettered], score[~lettered] = len(langs), 0.0
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*cols, pa.array(names[best], pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text_col).alias("__scored")).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def fold(id_col):
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where((fold(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
