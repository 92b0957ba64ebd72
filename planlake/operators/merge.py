"""Keyed merges of a stored table with changes; results are whole tables to write back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, key: list[str], now: str) -> DataFrame:
    """Changed rows replace or join the current ones by a null-safe key; created_at of a row stays."""
    on = None
    for k in key:
        cond = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = cond if on is None else on & cond
    a, b = current.withColumn("has_a", F.lit(True)).alias("a"), changes.withColumn("has_b", F.lit(True)).alias("b")
    is_b = F.col("b.has_b").isNotNull()
    values = [F.when(is_b, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in changes.columns]
    t = F.lit(now).cast("timestamp")
    return a.join(b, on, "full").select(*values, F.when(F.col("a.has_a").isNotNull(), F.col("a.created_at")).otherwise(t).alias("created_at"), F.when(is_b, t).otherwise(F.col("a.updated_at")).alias("updated_at"))


def write_days(df: DataFrame, path: str, day: str = "date_utc") -> None:
    """Replaces the days that df has and no others."""
    df.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def latest_decisions(current: DataFrame, changes: DataFrame, key: tuple[str, ...] = ("note_id", "suggestion_key")) -> DataFrame:
    """The last action of each key; an applied row has no dismiss reason, a dismissed one no initiative."""
    rows = current.unionByName(changes, allowMissingColumns=True)
    best = F.max_by(F.struct(*(c for c in rows.columns if c not in key)), F.struct("updated_at", "status")).alias("r")
    out = rows.groupBy(*key).agg(best).select(*key, "r.*")
    applied = F.col("status") == "applied"
    return out.withColumns({"initiative_id": F.when(applied, F.col("initiative_id")), "dismiss_reason": F.when(~applied, F.col("dismiss_reason"))})


def append_numbered(log: DataFrame, events: DataFrame, key: str, order: list[str], buckets: int = 64) -> DataFrame:
    """events with the next `sequence` of their key and the next `global_sequence`.

    The global number comes from a range partition of the order columns: counts of each partition, their running sum (one short row
    for each partition), and the place within the partition. No task sees all events.
    """
    last = log.groupBy(key).agg(F.max("sequence").alias("last"))
    top = log.agg(F.coalesce(F.max("global_sequence"), F.lit(0)).alias("top"))
    own = Window.partitionBy(key).orderBy(*order)
    e = events.join(last, key, "left").withColumn("sequence", (F.coalesce("last", F.lit(0)) + F.row_number().over(own)).cast("bigint")).drop("last")
    edges = e.agg(F.percentile_approx(F.unix_micros(F.col(order[0]).cast("timestamp")), [i / buckets for i in range(1, buckets)], 10000).alias("edges"))
    e = e.crossJoin(F.broadcast(edges)).withColumn("part", F.size(F.filter("edges", lambda x: x < F.unix_micros(F.col(order[0]).cast("timestamp"))))).drop("edges")
    counts = e.groupBy("part").count()
    before = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # at most `buckets` rows
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    out = e.join(F.broadcast(before), "part").crossJoin(top)
    return out.withColumn("global_sequence", F.col("top") + F.col("before") + nth).drop("part", "before", "top")


def within_size(df: DataFrame, most: int = 512 * 1024) -> DataFrame:
    """Rows whose JSON form is at most so many UTF-8 bytes."""
    return df.withColumn("payload_bytes", F.octet_length(F.to_json(F.struct(*df.columns)))).where(F.col("payload_bytes") <= most)


def unexpired(runs: DataFrame, now: str, days: int = 14) -> DataFrame:
    return runs.withColumn("expires_at", F.col("created_at") + F.expr(f"interval {days} days")).where(F.col("expires_at") >= F.lit(now).cast("timestamp"))
