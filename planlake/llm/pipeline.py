"""A training corpus from `documents`, in five stages: the functions behind corpus_pipeline.py.

Every stage reads all rows that its predecessor wrote and returns the columns of `documents`, the last one the packed
pieces. Null text counts as empty, rows without doc_id stay (near-dedup leaves them alone), and an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlake.llm import language_id, line_dedup, near_dedup, packing, substring_dedup
from planlake.llm.common import cut, numbered, settled, shielded, sole, table, unshielded


def _with_text(rows: DataFrame, text, changed, columns: list[str]) -> DataFrame:
    """rows with the new text where it changed, and n_chars to match."""
    new = rows.withColumn("__text", F.when(changed, text).otherwise(F.col("text")))
    if "n_chars" in columns:
        new = new.withColumn("n_chars", F.when(changed, F.char_length("__text").cast("bigint")).otherwise(F.col("n_chars")))
    return new.drop("text").withColumnRenamed("__text", "text").select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, or not one letter) go; a missing lang is filled in."""
    model = language_id.fit(language_id.training_rows(docs))
    safe, names = shielded(docs, ("doc_id", "text", "lang"))
    known = language_id.predict(safe, model, keep=tuple(safe.columns))
    kept = known.where((F.col("lang_pred") != "und") | F.lit(not model["langs"]) & F.col("text").rlike(r"\p{L}"))
    return unshielded(kept.withColumn("lang", F.coalesce("lang", F.nullif("lang_pred", F.lit("und")))), names, [], docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(docs)
    return _with_text(out, F.col("text"), F.col("n_dropped") > 0, docs.columns)


#: The stage takes near copies from 80 percent on. Of a pair at 0.80, more than 29 of 64 symbols differ with probability 1.2e-6.
NEAR = {"percent": 80, "errors": 29, "chunks": 15}


def _texts_of_repeated_ids(spark: SparkSession, rows: DataFrame) -> DataFrame | None:
    """did, th, own: for ids with several texts, an id of their own for all texts but the first. None if there are none. rows: did, th."""
    per = rows.distinct()
    ids = per.groupBy("did").agg(F.count(F.lit(1)).alias("texts"), F.min("th").alias("first")).where("texts > 1")
    more = cut(per.join(ids, "did").where("th <> first").select("did", "th"))
    n = more.count()
    if not n:
        return None
    low, high = rows.agg(F.min("did"), F.max("did")).first()
    if max(-low, high) > 2**62:
        raise ValueError("ids with several texts need free numbers beside doc_id")
    return cut(numbered(more, ["did", "th"]).select("did", "th", (F.col("number") + F.lit(high + 1)).alias("own")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id.

    Rows of one doc_id with equal texts are copies, of which one stays; those with different texts are documents of their own.
    """
    columns = docs.columns
    safe, names = shielded(docs)
    keyed = safe.withColumns({"did": F.col("doc_id").cast("bigint"), "th": F.xxhash64(F.coalesce("text", F.lit("")))})
    rows = cut(keyed.where("did is not null").select("did", "th"))
    more = _texts_of_repeated_ids(spark, rows)
    if more is None:
        gone = near_dedup.clusters(docs.select("doc_id", "text"), **NEAR).where("doc_id is not null and not kept").select(F.col("doc_id").alias("did")).distinct()
        left = keyed.join(gone, "did", "left_anti")
    else:
        texts = keyed.join(more, ["did", "th"], "left").select(F.coalesce("own", "did").alias("doc_id"), "text")
        gone = near_dedup.clusters(texts, **NEAR).where("doc_id is not null and not kept").select(F.col("doc_id").alias("own")).distinct()
        left = keyed.join(more, ["did", "th"], "left").withColumn("own", F.coalesce("own", "did")).join(gone, "own", "left_anti").drop("own")
    again = cut(rows.groupBy("did", "th").count().where("count > 1").select("did", "th"))
    if again.take(1):
        nth = F.row_number().over(Window.partitionBy("did", "th").orderBy(F.xxhash64(*safe.columns)))
        one = left.join(again, ["did", "th"], "left_semi").withColumn("__nth", nth).where("__nth = 1").drop("__nth")
        left = left.join(again, ["did", "th"], "left_anti").unionByName(one)
    return unshielded(left, names, [], columns)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(docs)
    return _with_text(out, F.col("kept"), F.col("kept").isNotNull(), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("best_fit_packing", pack),
]

#: Language models and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


@settled
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = sole(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
