"""Suggestion event log to metrics, funnels, quality scores and reports. Every job is over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlake.functions.compat import js_or_str, js_round, percent, rate

COUNTED = {"generated": "suggestions_generated", "applied": "suggestions_applied", "dismissed": "suggestions_dismissed", "clarification_requested": "clarification_requests"}
GRAIN = ["team_id", "surface", "suggestion_family"]


def exclude_flagged(df: DataFrame, flag: str, include: bool = False) -> DataFrame:
    """Rows whose flag is not true; a missing flag keeps the row."""
    return df if include else df.where(~F.coalesce(F.col(flag), F.lit(False)))


def cascade_deletes(suggestions: DataFrame, events: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suggestions of deleted notes become invalid, their events leave the metrics."""
    gone = notes.where("is_deleted").select("note_id", F.lit(True).alias("gone")).distinct()
    s = suggestions.join(gone, "note_id", "left").withColumn("invalidated_by_note_deletion", F.when(F.col("gone"), True).otherwise(F.col("invalidated_by_note_deletion")))
    e = events.join(gone, "note_id", "left").withColumn("exclude_from_metrics", F.when(F.col("gone"), True).otherwise(F.col("exclude_from_metrics")))
    return s.drop("gone"), e.drop("gone")


def purge_notes(df: DataFrame, gone: DataFrame) -> DataFrame:
    return df.join(gone.select("note_id").distinct(), "note_id", "left_anti")


def daily_counts(events: DataFrame) -> DataFrame:
    """One row for each day and full set of dimensions: the only pass over the log. '' and, for teams, 'global' mean none."""
    e = exclude_flagged(events, "exclude_from_metrics")
    keys = [
        F.to_date("created_at").alias("date_utc"),
        F.nullif(F.nullif("team_id", F.lit("")), F.lit("global")).alias("team_id"),
        F.nullif("ui_surface", F.lit("")).alias("surface"),
        F.nullif("suggestion_family", F.lit("")).alias("suggestion_family"),
    ]
    return e.groupBy(*keys).agg(*(F.count_if(F.col("event_type") == k).alias(v) for k, v in COUNTED.items()))


def with_rates(m: DataFrame) -> DataFrame:
    g = F.col("suggestions_generated")
    return m.withColumns(
        {
            "apply_rate": rate(F.col("suggestions_applied"), g),
            "dismiss_rate": rate(F.col("suggestions_dismissed"), g),
            "clarification_rate": rate(F.col("clarification_requests"), g),
            "nhi": F.when(g > 0, F.col("suggestions_applied") / g - F.col("suggestions_dismissed") / g).otherwise(F.lit(0.0)),
        }
    )


def daily_cube(events: DataFrame, compat: bool = False) -> DataFrame:
    """Daily counts and rates at all eight grains of team, surface and family.

    A missing dimension is not a grain of its own: it equals the coarser grain, which counts it already. With
    compat=True an event counts once for each of its eight dimension entries, also where entries share a key.
    """
    base = daily_counts(events)
    sums = [F.sum(c).alias(c) for c in COUNTED.values()]
    if compat:
        entries = [F.struct(*(F.col(c).alias(c) if i >> k & 1 else F.lit(None).cast("string").alias(c) for k, c in enumerate(GRAIN))) for i in range(8)]
        rows = base.select("date_utc", *COUNTED.values(), F.explode(F.array(*entries)).alias("g"))
        return with_rates(rows.groupBy("date_utc", *(F.col(f"g.{c}").alias(c) for c in GRAIN)).agg(*sums))
    sets = [["date_utc", *(c for k, c in enumerate(GRAIN) if i >> k & 1)] for i in range(8)]
    cube = base.groupingSets([[F.col(c) for c in s] for s in sets], F.col("date_utc"), *(F.col(c) for c in GRAIN)).agg(*sums, *(F.grouping(c).alias(f"g_{c}") for c in GRAIN))
    own = [(F.col(f"g_{c}") == 1) | F.col(c).isNotNull() for c in GRAIN]
    return with_rates(cube.where(own[0] & own[1] & own[2]).drop(*(f"g_{c}" for c in GRAIN)))


def metric_range(daily: DataFrame, start: str, end: str, team: str | None = None, surface: str | None = None, family: str | None = None) -> DataFrame:
    """Rows of a closed range of days, newest first; a filter that is not given is not applied."""
    out = daily.where(F.col("date_utc").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    for c, v in zip(GRAIN, (team, surface, family), strict=True):
        if v:
            out = out.where(F.col(c) == v)
    return out.orderBy(F.desc("date_utc"), *GRAIN)


def enrich_envelope(events: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Family, rule and clarification state of the suggestion, where the event lacks them."""
    s = suggestions.select("suggestion_id", F.col("suggestion_family").alias("s_family"), F.col("rule_or_prompt_id").alias("s_rule"), "clarification_state")
    out = events.join(s, "suggestion_id", "left")
    return out.withColumns({"suggestion_family": F.coalesce("suggestion_family", "s_family"), "rule_or_prompt_id": F.coalesce("rule_or_prompt_id", "s_rule")}).drop("s_family", "s_rule")


def daily_report(daily: DataFrame, date: str) -> DataFrame:
    """The global row, the rows by family and the rows by surface of one day."""
    d = daily.where((F.col("date_utc") == F.lit(date).cast("date")) & F.col("team_id").isNull())
    bare, surface, family = F.col("surface").isNull() & F.col("suggestion_family").isNull(), F.col("suggestion_family").isNull(), F.col("surface").isNull()
    section = F.when(bare, "global").when(family, "by_family").when(surface, "by_surface")
    return d.withColumn("section", section).where("section is not null")


def overall_metrics(suggestions: DataFrame, events: DataFrame, include_deleted: bool = False) -> DataFrame:
    s = exclude_flagged(suggestions, "invalidated_by_note_deletion", include_deleted)
    e = exclude_flagged(events, "exclude_from_metrics", include_deleted)
    count = lambda c, v: F.count_if(F.col(c) == v)
    a = s.agg(
        F.count(F.lit(1)).alias("total_suggestions"), count("status", "applied").alias("applied_suggestions"), count("status", "dismissed").alias("dismissed_suggestions"),
        count("status", "new").alias("new_suggestions"), F.count_if("regenerated").alias("regenerated_suggestions"),
    )
    b = e.agg(*(count("event_type", k).alias(f"{k}_events") for k in ("shown", "applied", "dismissed")))
    pct = lambda c: F.when(F.col("total_suggestions") > 0, js_round(F.col(c) / F.col("total_suggestions") * 100.0, 2)).otherwise(F.lit(0.0))
    return a.crossJoin(b).withColumns({"acceptance_rate": pct("applied_suggestions"), "dismissal_rate": pct("dismissed_suggestions")})  # two 1-row tables


def of_notes(facts: DataFrame, notes: DataFrame) -> DataFrame:
    return facts.join(notes.select("note_id"), "note_id", "left_semi")


def notes_between(notes: DataFrame, start: str, end: str) -> DataFrame:
    return notes.where(F.col("created_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def range_header(notes: DataFrame, suggestions: DataFrame, events: DataFrame) -> DataFrame:
    e = of_notes(events, notes).agg(*(F.count_if(F.col("event_type") == k).alias(f"suggestions_{k}") for k in ("shown", "applied", "dismissed")))
    n = notes.agg(F.count(F.lit(1)).alias("notes_created"))
    s = of_notes(suggestions, notes).agg(F.count(F.lit(1)).alias("suggestions_generated"))
    return n.crossJoin(s).crossJoin(e).withColumn("apply_rate", percent(F.col("suggestions_applied"), F.col("suggestions_shown")))  # 1-row tables


def dismiss_reasons(events: DataFrame) -> DataFrame:
    d = events.where("event_type = 'dismissed'").groupBy(js_or_str(F.col("dismiss_reason"), "unknown").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    total = d.agg(F.sum("n").alias("total"))
    return d.crossJoin(total).select("reason", "n", percent(F.col("n"), F.col("total")).alias("share_pct"))  # a handful of reasons and one row


def apply_times(events: DataFrame) -> DataFrame:
    """Mean seconds to apply and mean self-reported minutes, over events that have them."""
    a = events.where("event_type = 'applied'")
    return a.agg(
        F.floor(F.avg("time_to_event_seconds") + 0.5).cast("bigint").alias("avg_time_to_apply_seconds"),
        F.floor(F.avg("self_reported_time_saved_minutes") + 0.5).cast("bigint").alias("avg_time_saved_minutes"),
        F.count("self_reported_time_saved_minutes").alias("time_saved_response_count"),
    )


def note_breakdown(notes: DataFrame, suggestions: DataFrame, events: DataFrame) -> DataFrame:
    """Facts are counted by note before they meet the notes."""
    s = suggestions.groupBy("note_id").agg(F.count(F.lit(1)).alias("s"))
    e = events.groupBy("note_id").agg(*(F.count_if(F.col("event_type") == k).alias(f"e_{k}") for k in ("shown", "applied", "dismissed")))
    preview = F.concat(F.substring("body", 1, 50), F.when(F.char_length("body") > 50, "...").otherwise(""))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = notes.join(s, "note_id", "left").join(e, "note_id", "left")
    return out.select(
        "note_id", F.coalesce(F.nullif("title", F.lit("")), preview).alias("title"), "created_at", zero("s").alias("total_suggestions"),
        *(zero(f"e_{k}").alias(k) for k in ("shown", "applied", "dismissed")), percent(zero("e_applied"), zero("e_shown")).alias("apply_rate"),
    )


def initiative_rates(suggestions: DataFrame) -> DataFrame:
    applied = F.col("status") == "applied"
    a = suggestions.agg(F.count_if(applied).alias("total_applied_count"), F.count_if(applied & F.col("initiative_id").isNotNull()).alias("applied_with_initiative_count"))
    per = suggestions.where("initiative_id is not null").groupBy("initiative_id").agg(F.count(F.lit(1)).alias("n"))
    b = per.agg((F.floor(F.avg("n") * 10 + 0.5) / 10).alias("avg_suggestions_per_initiative"), F.count(F.lit(1)).alias("initiatives_with_suggestions_count"))
    return a.crossJoin(b).withColumn("applied_to_initiative_rate", percent(F.col("applied_with_initiative_count"), F.col("total_applied_count")))  # 1-row tables


def rule_quality(events: DataFrame, as_of: str, window_days: int = 30, min_generated: int = 5) -> DataFrame:
    """Scores of (rule, family) over the days up to as_of. 0 days means the default of 30."""
    window_days = window_days or 30
    end = F.lit(as_of).cast("timestamp")
    e = exclude_flagged(events, "exclude_from_metrics").where(F.col("created_at").between(end - F.expr(f"interval {window_days} days"), end))
    e = e.where((F.col("rule_or_prompt_id").isNotNull()) & (F.col("rule_or_prompt_id") != ""))
    g = e.groupBy("rule_or_prompt_id", js_or_str(F.col("suggestion_family"), "general").alias("suggestion_family"))
    c = g.agg(*(F.count_if(F.col("event_type") == k).alias(v) for k, v in COUNTED.items())).where(F.col("suggestions_generated") >= min_generated)
    c = with_rates(c)
    return c.withColumns(
        {
            "quality_score": F.col("nhi") * F.least(F.lit(1.0), F.col("suggestions_generated") / 50),
            "window_start_date": F.to_date(end - F.expr(f"interval {window_days} days")),
            "window_end_date": F.to_date(end),
        }
    )


def filter_scores(scores: DataFrame, rule: str | None = None, family: str | None = None, min_score: float | None = None) -> DataFrame:
    for c, v in (("rule_or_prompt_id", rule), ("suggestion_family", family)):
        if v:
            scores = scores.where(F.col(c) == v)
    return scores if min_score is None else scores.where(F.col("quality_score") >= min_score)


def show_by_quality(scores: DataFrame) -> DataFrame:
    """A clearly bad rule with more than ten samples is hidden."""
    return scores.withColumn("show", ~((F.col("quality_score") < -0.3) & (F.col("suggestions_generated") > 10)))


def top_rules(scores: DataFrame, limit: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("quality_score"), "rule_or_prompt_id", "suggestion_family").limit(limit or 10)


def worst_rules(scores: DataFrame, limit: int = 10, at_most: float = -0.2) -> DataFrame:
    return scores.where(F.col("quality_score") <= at_most).orderBy("quality_score", "rule_or_prompt_id", "suggestion_family").limit(limit or 10)


def recent_events(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)


def _ms_between(a: str, b: str) -> Column:
    us = [F.unix_micros(F.col(c).cast("timestamp")) for c in (a, b)]
    return F.floor((us[1] - us[0]) / 1000).cast("bigint")


def first_shown_latency(events: DataFrame, shown: tuple[str, ...] = ("shown",)) -> DataFrame:
    """Applied, dismissed and requested events with the time since the suggestion was first shown.

    The first time is one aggregate by suggestion, joined back; no event meets another one.
    """
    first = events.where(F.col("event_type").isin(*shown)).groupBy("suggestion_id").agg(F.min("created_at").alias("first_shown_at"))
    acts = events.where(F.col("event_type").isin("applied", "dismissed", "clarification_requested"))
    ms = _ms_between("first_shown_at", "created_at")
    return acts.join(first, "suggestion_id", "left").withColumn("latency_ms", ms).withColumn("latency_seconds", F.floor(ms / 1000).cast("bigint"))


def answer_latency(events: DataFrame) -> DataFrame:
    """Answers with the latest request before them."""
    w = Window.partitionBy("suggestion_id").orderBy("created_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "clarification_requested", F.col("created_at")), ignorenulls=True).over(w)
    kinds = events.where(F.col("event_type").isin("clarification_requested", "clarification_answered"))
    a = kinds.withColumn("requested_at", last).where("event_type = 'clarification_answered'")
    return a.withColumn("response_ms", _ms_between("requested_at", "created_at"))


def funnel(events: DataFrame) -> DataFrame:
    """Events of each type and first times for each suggestion."""
    kinds = ("generated", "shown", "clarification_requested", "clarification_answered", "applied", "dismissed")
    is_ = lambda k: F.col("event_type") == k
    counts = [F.count_if(is_(k)).alias(f"n_{k}") for k in kinds]
    firsts = [F.min(F.when(is_(k), F.col("created_at"))).alias(f"first_{k}_at") for k in ("shown", "clarification_requested", "clarification_answered", "applied")]
    return events.groupBy("suggestion_id").agg(*counts, *firsts)


def once_shown(events: DataFrame) -> DataFrame:
    """The first shown event of each suggestion."""
    first = F.min_by(F.struct("event_id", "note_id", "created_at"), F.struct("created_at", "event_id")).alias("r")
    return events.where("event_type = 'shown'").groupBy("suggestion_id").agg(first).select("suggestion_id", "r.event_id", "r.note_id", "r.created_at")


def scored(suggestions: DataFrame, scores: DataFrame) -> DataFrame:
    """Suggestions with their rule's score, 0 without one. Scores go to all tasks: one row for each rule and family."""
    s = scores.select(F.col("rule_or_prompt_id").alias("rule_key"), F.col("suggestion_family").alias("family_key"), "quality_score", "apply_rate", "dismiss_rate", "nhi", "clarification_rate")
    ids = ["rule_or_prompt_id", "model_version"] if "model_version" in suggestions.columns else ["rule_or_prompt_id"]
    rule, family = F.coalesce(*(F.nullif(c, F.lit("")) for c in ids), F.lit("unknown")), js_or_str(F.col("suggestion_family"), "general")
    out = suggestions.withColumns({"rule_key": rule, "family_key": family}).join(s, ["rule_key", "family_key"], "left")
    return out.fillna(0.0, ["quality_score", "apply_rate", "dismiss_rate", "nhi", "clarification_rate"])


def confidence(c: Column) -> Column:
    return F.when(c.isNull() | (c == 0), F.lit(0.5)).otherwise(c)


def rank_suggestions(suggestions: DataFrame, scores: DataFrame) -> DataFrame:
    """New suggestions by note, best first; rules below -0.3 are left out."""
    s = scored(suggestions.where("status = 'new'"), scores).where("quality_score >= -0.3")
    state = F.col("clarification_state")
    factor = F.when(state == "suggested", 0.7).when(state == "requested", 0.8).when(state == "answered", 1.1).otherwise(1.0)
    s = s.withColumn("ranking_score", F.col("quality_score") * (F.lit(0.5) + confidence(F.col("model_confidence_score")) * 0.5) * factor)
    w = Window.partitionBy("note_id").orderBy(F.desc("ranking_score"), "suggestion_id")
    return s.withColumn("rank", F.row_number().over(w))


def auto_apply(quality: Column, state: Column, conf: Column) -> Column:
    return (quality > 0.5) & (state.isNull() | state.isin("", "none", "answered")) & (conf > 0.8)


def needs_clarification(conf: Column, clarification_rate: Column) -> Column:
    return (conf < 0.6) | (F.coalesce(clarification_rate, F.lit(0.0)) > 0.3)


def rolled_out(note_id: Column, percent_on: int) -> Column:
    """Always the same notes for a percentage, and more of them for a larger one."""
    return F.pmod(F.xxhash64(note_id), F.lit(100)) < percent_on
