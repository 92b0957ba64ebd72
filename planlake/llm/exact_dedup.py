"""Exact dedup by skew-safe combining.

Rows are combined three times, each time by digest *and* the full normalised text, so that two texts are
never taken as equal because of a digest alone: within each input partition (the map side of the first
aggregation), per salted digest group, and over the salt winners. Hot groups shrink to one row per
partition before the first shuffle and to one row per salt before the second.

The winners then go back to their rows: those of hot digests to all tasks, the others by digest.

Null text counts as empty. Equal texts: identical once white space is deleted. Of a group stays the row
with the most code points, then the smallest doc_id (a null one last). Repeated rows stay rows of their own,
one of which is kept. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlake.llm.common import WS_CHARS, cut, join_on_counted, settled, table

SALTS = 8
#: Longest text first, then smallest id, a null id last, as one number: fixed width keeps the aggregation in hash maps.
_ORDER = "decimal(38,0)"
_ID_SPAN = "36893488147419103232"  # 2**65: one room for each id, and 0 for none
_TOP_ID = "9223372036854775807"


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), WS_CHARS, "")


def _order_key(n_chars, doc_id):
    room = F.lit(_TOP_ID).cast("decimal(20,0)") - doc_id.cast("bigint").cast("decimal(20,0)") + F.lit(1)
    return (n_chars.cast("decimal(10,0)") * F.lit(_ID_SPAN).cast("decimal(20,0)") + F.coalesce(room, F.lit(0))).cast(_ORDER)


def _id_of(key):
    room = key % F.lit(_ID_SPAN).cast("decimal(20,0)")
    return F.when(room > 0, (F.lit(_TOP_ID).cast("decimal(20,0)") - room + F.lit(1)).cast("bigint"))


def winners(docs: DataFrame, id_col: str, text_col: str, salts: int = SALTS) -> DataFrame:
    """One row for each distinct normalised text: digest, norm, keep_id, group_size."""
    norm = normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        norm.alias("norm"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"),
    ).select(
        F.sha2("norm", 256).alias("digest"),
        "norm",
        _order_key(F.col("n"), F.col("doc_id")).alias("best"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
    )
    salted = rows.groupBy("digest", "norm", "salt").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n"))
    return (
        salted.groupBy("digest", "norm")
        .agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
        .select("digest", "norm", _id_of(F.col("best")).alias("keep_id"), "group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is null where only rows without doc_id hold the longest text.
    """
    best = winners(docs, id_col, text_col, salts)
    # winners() compared full contents: a digest with one winner stands for one content. Only digests
    # with several (a collision) need the content again, so contents are not kept.
    light = cut(
        best.groupBy("digest").agg(
            F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.count(F.lit(1)).alias("contents")
        )
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        normalised(F.col(text_col)).alias("norm"),
        F.char_length(text).alias("n"),
        F.xxhash64(text).alias("text_hash"),
    ).withColumn("digest", F.sha2("norm", 256))
    cols = ["doc_id", "digest", "n", "text_hash"]
    small = cut(rows.select(*cols))
    single = light.where("contents = 1").drop("contents")
    out = join_on_counted(small, single, ["digest"], "group_size", small.count()).select(*cols, "keep_id", "group_size")
    clash = light.where("contents > 1").select("digest")
    if clash.take(1):
        several = rows.join(clash, "digest", "left_semi").join(best, ["digest", "norm"])
        out = out.unionByName(several.select(*out.columns))
    # the winning doc_id more than once in a group: the longest text's row stays, one of equal rows
    is_best = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    w = Window.partitionBy("doc_id", "digest").orderBy(F.desc("n"), "text_hash")
    first = out.where(is_best).withColumn("kept", F.row_number().over(w) == 1)
    rest = out.where(~is_best).withColumn("kept", F.lit(False))
    return first.unionByName(rest).select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


@settled
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
with t as (select doc_id, coalesce(text,'') as text, regexp_replace(coalesce(text,''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
r as (select *, row_number() over (partition by norm order by length(text) desc, doc_id) as rn, count(*) over (partition by norm) as n,
      first_value(doc_id) over (partition by norm order by length(text) desc, doc_id) as keep_id from t)
select doc_id, keep_id, n as group_size, rn = 1 as kept, sha256(norm) as text_sha256 from r
"""
