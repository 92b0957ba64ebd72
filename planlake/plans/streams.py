"""Streaming queries, run over the given event table as a stream and held against the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planlake.plans.fixture_sql import over
from planlake.plans.registry import query
from planlake.sources import fixtures as fx
from planlake.streaming import jobs

OK = "not coalesce(exclude_from_metrics, false)"


class _Stream:
    """Reads tables of a folder as streams, so that derived tables are streams as well."""

    def __init__(self, spark):
        self.read = self
        self._spark = spark

    def parquet(self, path):
        schema = self._spark.read.parquet(path).schema
        return self._spark.readStream.schema(schema).option("pathGlobFilter", path.rsplit("/", 1)[1]).parquet(path.rsplit("/", 1)[0])


def _events(spark, d):
    e = fx.suggestion_events(_Stream(spark), d)
    return e.withColumn("created_at", F.col("created_at").cast("timestamp"))


def _run(stream, mode):
    return jobs.drained(stream, f"q_{uuid.uuid4().hex}", mode)


@query("r01_stream_daily", over("suggestion_events", f"select created_at::date as date_utc, sum((event_type = 'generated')::int) as suggestions_generated, sum((event_type = 'applied')::int) as suggestions_applied from suggestion_events where {OK} group by 1"))
def _(spark, d):
    out = _run(jobs.daily_metrics(_events(spark, d)), "complete")
    return out.groupBy("date_utc").agg(F.sum("suggestions_generated").alias("suggestions_generated"), F.sum("suggestions_applied").alias("suggestions_applied"))


@query("r02_stream_rules", over("suggestion_events", f"select rule_or_prompt_id, coalesce(nullif(suggestion_family, ''), 'general') as suggestion_family, timestamp '2024-01-31' as window_end, count(*) filter (where event_type = 'generated') as suggestions_generated from suggestion_events where {OK} and rule_or_prompt_id <> '' and created_at >= timestamp '2024-01-01' and created_at < timestamp '2024-01-31' group by 1, 2"))
def _(spark, d):
    out = _run(jobs.rolling_rules(_events(spark, d)), "complete")
    return out.where("window_end = timestamp'2024-01-31'").select("rule_or_prompt_id", "suggestion_family", "window_end", "suggestions_generated")


@query("r03_stream_once", over("suggestion_events", "select distinct suggestion_id from suggestion_events where event_type = 'shown'"))
def _(spark, d):
    return _run(jobs.once_shown(_events(spark, d), "60 days"), "append").select("suggestion_id")


@query("r05_stream_sessions", over("suggestion_events", "select note_id, min(created_at) as session_start, count(*) as n_events from (select *, sum(case when p is null or created_at >= p + interval 30 minute then 1 else 0 end) over (partition by note_id order by created_at, event_id rows unbounded preceding) as s from (select *, lag(created_at) over (partition by note_id order by created_at, event_id) as p from suggestion_events)) group by note_id, s"))
def _(spark, d):
    return _run(jobs.sessions(_events(spark, d), delay="60 days"), "complete")


@query("r06_stream_limiter", over("suggestion_events", "select note_id, event_id, coalesce(created_at - p < interval 1 hour, false) as blocked from (select *, lag(created_at) over (partition by note_id order by created_at, event_id) as p from suggestion_events)"))
def _(spark, d):
    return _run(jobs.run_limiter(_events(spark, d)), "append")
