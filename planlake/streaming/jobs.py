"""The log jobs as Structured Streaming queries. State is bounded by watermarks; late rows beyond them are repaired by the batch jobs."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from planlake.operators import eventlog as ev
from planlake.operators import metrics as m


def daily_metrics(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Counts by UTC day and dimensions, updated as events come."""
    e = m.exclude_flagged(events, "exclude_from_metrics").withWatermark("created_at", delay)
    day = F.window("created_at", "1 day")
    g = e.groupBy(day, F.nullif("team_id", F.lit("")).alias("team_id"), F.nullif("ui_surface", F.lit("")).alias("surface"), "suggestion_family")
    return g.agg(*(F.count_if(F.col("event_type") == k).alias(v) for k, v in m.COUNTED.items())).withColumn("date_utc", F.to_date("window.start")).drop("window")


def rolling_rules(events: DataFrame, days: int = 30, delay: str = "2 days") -> DataFrame:
    """Counts of each rule and family over the last `days` days, for every day."""
    e = m.exclude_flagged(events, "exclude_from_metrics").where("rule_or_prompt_id <> ''").withWatermark("created_at", delay)
    g = e.groupBy(F.window("created_at", f"{days} days", "1 day"), "rule_or_prompt_id", F.coalesce(F.nullif("suggestion_family", F.lit("")), F.lit("general")).alias("suggestion_family"))
    return g.agg(*(F.count_if(F.col("event_type") == k).alias(v) for k, v in m.COUNTED.items())).withColumn("window_end", F.col("window.end")).drop("window")


def once_shown(events: DataFrame, delay: str = "2 days") -> DataFrame:
    return events.where("event_type = 'shown'").withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["suggestion_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    g = events.withWatermark("created_at", delay).groupBy("note_id", F.session_window("created_at", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n_events")).select("note_id", F.col("w.start").alias("session_start"), "n_events")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share. A local one only where the session has no setting and no cluster (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "planlake-checkpoints")
    return f"{base.rstrip('/')}/{name}"


def state_view(log: DataFrame, path: str):
    """A foreachBatch function that keeps the state table at `path`: it folds only initiatives with new events.

    Each batch has a folder of its own, so one that is run again after a failure replaces its rows.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        changed = batch.select("initiative_id").distinct()
        fresh = ev.fold(log.join(changed, "initiative_id", "left_semi"))
        fresh.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return merge


def current_view(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each initiative of a state table."""
    rows = spark.read.parquet(path)
    return rows.groupBy("initiative_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "initiative_id")), "epoch").alias("r")).select("initiative_id", "r.*").drop("epoch")


def run_limiter(runs: DataFrame, delay: str = "1 day") -> DataFrame:
    """note_id, event_id, blocked: a run within an hour after an allowed or blocked one. State: the last run of a note, forgotten after an hour of event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["created_at", "event_id"])
        last = state.get[0] if state.exists else None
        blocked = []
        for t in rows["created_at"]:
            us = int(t.value // 1000)
            blocked.append(last is not None and us - last < 3_600_000_000)
            last = us
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"note_id": key[0], "event_id": rows["event_id"].to_numpy(), "blocked": blocked})

    g = runs.withWatermark("created_at", delay).groupBy("note_id")
    return g.applyInPandasWithState(step, "note_id string, event_id long, blocked boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now and gives its result table, which executors write to the shared folder.

    Each batch has a folder of its own: in append mode all of them make up the result, in complete mode the last one is it.
    """
    spark = stream.sparkSession
    path, done = shared_folder(spark, name), []

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{epoch}")
        done.append(epoch)

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", path + "-log").start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/batch-{'*' if mode == 'append' else max(done)}")
