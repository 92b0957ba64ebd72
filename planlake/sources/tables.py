"""Typed loads: explicit schemas, millisecond times, enum checks with a quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Enums of the tables.
ENUMS = {
    "event_type": ["generated", "viewed", "shown", "applied", "dismissed", "regenerated", "clarification_requested", "clarification_answered"],
    "clarification_state": ["none", "suggested", "requested", "answered"],
    "dismiss_reason": ["not_relevant", "incorrect_or_low_quality", "too_risky_or_disruptive", "already_done_or_in_progress", "needs_more_clarification", "wrong_scope_or_target", "too_generic", "other"],
    "suggestion_status": ["new", "applied", "dismissed"],
    "note_source": ["manual", "granola_manual"],
    "initiative_status": ["draft", "proposed", "approved", "in_progress", "blocked", "released", "completed", "cancelled", "archived"],
    "priority": ["p0", "p1", "p2", "p3"],
    "risk_level": ["low", "medium", "high"],
    "event_origin": ["ui", "api", "system", "import"],
}
SCHEMAS = {
    "suggestion_events": "event_id bigint, note_id string, suggestion_id string, event_type string, created_at bigint, team_id string, ui_surface string, suggestion_family string, rule_or_prompt_id string, exclude_from_metrics boolean, dismiss_reason string, time_to_event_seconds bigint",
    "notes": "note_id string, title string, body string, created_at bigint, updated_at bigint, is_deleted boolean, source string",
    "initiative_events": "initiative_id string, sequence bigint, global_sequence bigint, type string, payload string, occurred_at bigint, actor_user_id string, origin string, command_id string, correlation_id string, suggestion_id string",
    "rule_quality_scores": "rule_or_prompt_id string, suggestion_family string, quality_score double, apply_rate double, dismiss_rate double, nhi double, total_generated bigint",
    "decisions": "note_id string, suggestion_key string, status string, updated_at bigint, initiative_id string, dismiss_reason string",
}
TIMES = ("created_at", "updated_at", "occurred_at")


def load(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A table with its schema; millisecond columns become timestamps."""
    df = spark.read.schema(SCHEMAS[name]).format(fmt).load(path)
    return df.withColumns({c: F.timestamp_millis(c) for c in TIMES if c in df.columns})


def checked(df: DataFrame, enums: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose columns are in their enums, and the others. Missing values are allowed. enums: column -> name."""
    good = F.lit(True)
    for column, name in enums.items():
        good = good & (F.col(column).isNull() | F.col(column).isin(ENUMS[name]))
    return df.where(good), df.where(~good)


def note_corpus(notes: DataFrame) -> DataFrame:
    """Notes in the form that the text jobs take."""
    return notes.select("note_id", F.col("body").alias("raw_markdown"), F.col("created_at").alias("authored_at"), "title")
