"""Queries over the suggestion event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.operators import merge as mg
from planlake.operators import metrics as m
from planlake.plans.fixture_sql import over
from planlake.plans.registry import query
from planlake.sources import fixtures as fx

AS_OF, DAYS = "2024-01-28 00:00:00", 20
ok = "not coalesce(exclude_from_metrics, false)"
COUNTS = """count(*) filter (where event_type = 'generated') as suggestions_generated, count(*) filter (where event_type = 'applied') as suggestions_applied,
 count(*) filter (where event_type = 'dismissed') as suggestions_dismissed, count(*) filter (where event_type = 'clarification_requested') as clarification_requests"""
RATES = """case when suggestions_generated > 0 then suggestions_applied / suggestions_generated else 0.0 end as apply_rate, case when suggestions_generated > 0 then suggestions_dismissed / suggestions_generated else 0.0 end as dismiss_rate,
 case when suggestions_generated > 0 then clarification_requests / suggestions_generated else 0.0 end as clarification_rate,
 case when suggestions_generated > 0 then suggestions_applied / suggestions_generated - suggestions_dismissed / suggestions_generated else 0.0 end as nhi"""
DAY = f"""select created_at::date as date_utc, nullif(nullif(team_id, ''), 'global') as team_id, nullif(ui_surface, '') as surface, nullif(suggestion_family, '') as suggestion_family, event_type from suggestion_events where {ok}"""
CUBE = f"""select date_utc, team_id, surface, suggestion_family, suggestions_generated, suggestions_applied, suggestions_dismissed, clarification_requests, {RATES} from (
 select date_utc, team_id, surface, suggestion_family, grouping(team_id) as gt, grouping(surface) as gs, grouping(suggestion_family) as gf, {COUNTS} from ({DAY}) group by date_utc, cube (team_id, surface, suggestion_family))
 where (gt = 1 or team_id is not null) and (gs = 1 or surface is not null) and (gf = 1 or suggestion_family is not null)"""
SCORES = f"""select *, nhi * least(1.0, suggestions_generated / 50) as quality_score, date '2024-01-08' as window_start_date, date '2024-01-28' as window_end_date from (select *, {RATES} from (
 select rule_or_prompt_id, coalesce(nullif(suggestion_family, ''), 'general') as suggestion_family, {COUNTS} from suggestion_events
 where {ok} and rule_or_prompt_id <> '' and created_at between timestamp '2024-01-08' and timestamp '2024-01-28' group by all having count(*) filter (where event_type = 'generated') >= 5))"""
PCT = "case when {b} > 0 then floor({a} * 100.0 / {b} + 0.5)::bigint else 0 end"


def _scores(spark, d):
    return m.rule_quality(fx.suggestion_events(spark, d), AS_OF, DAYS)


@query("m01_daily_cube", over("suggestion_events", CUBE))
def _(spark, d):
    return m.daily_cube(fx.suggestion_events(spark, d))


@query(
    "m02_daily_cube_compat",
    over(
        "suggestion_events",
        f"select *, {RATES} from (select date_utc, t as team_id, s as surface, f as suggestion_family, {COUNTS} from x group by all)",
        x=f"select date_utc, event_type, case when i & 1 > 0 then team_id end as t, case when i & 2 > 0 then surface end as s, case when i & 4 > 0 then suggestion_family end as f from ({DAY}), (select unnest(range(0, 8)) as i)",
    ),
)
def _(spark, d):
    return m.daily_cube(fx.suggestion_events(spark, d), compat=True)


@query("m03_daily_global_rates", over("suggestion_events", f"select date_utc, {RATES} from (select date_utc, {COUNTS} from ({DAY}) group by 1)"))
def _(spark, d):
    daily = m.daily_counts(fx.suggestion_events(spark, d)).groupBy("date_utc").agg(*(F.sum(c).alias(c) for c in m.COUNTED.values()))
    return m.with_rates(daily).select("date_utc", "apply_rate", "dismiss_rate", "clarification_rate", "nhi")


@query("f01_metric_events", over("suggestion_events", f"select event_id, event_type from suggestion_events where {ok}"))
def _(spark, d):
    return m.exclude_flagged(fx.suggestion_events(spark, d), "exclude_from_metrics").select("event_id", "event_type")


@query(
    "f02_delete_cascade",
    over(
        "suggestions event_notes",
        "select 'suggestion' as kind, suggestion_id as id, note_id in (select note_id from gone) or coalesce(invalidated_by_note_deletion, false) as flagged from suggestions union all select 'event', event_id::varchar, note_id in (select note_id from gone) or coalesce(exclude_from_metrics, false) from suggestion_events",
        gone="select note_id from event_notes where is_deleted",
    ),
)
def _(spark, d):
    s, e = m.cascade_deletes(fx.suggestions(spark, d), fx.suggestion_events(spark, d), fx.event_notes(spark, d))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias("flagged")
    a = s.select(F.lit("suggestion").alias("kind"), F.col("suggestion_id").alias("id"), flag("invalidated_by_note_deletion"))
    return a.unionByName(e.select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("id"), flag("exclude_from_metrics")))


@query("f03_purge", over("suggestion_events event_notes", "select event_id, note_id from suggestion_events where note_id not in (select note_id from event_notes where is_deleted)"))
def _(spark, d):
    return m.purge_notes(fx.suggestion_events(spark, d), fx.event_notes(spark, d).where("is_deleted")).select("event_id", "note_id")


@query("f04_metric_range", over("suggestion_events", f"select * from ({CUBE}) where date_utc between date '2024-01-05' and date '2024-01-12' and suggestion_family = 'risk'"))
def _(spark, d):
    return m.metric_range(m.daily_cube(fx.suggestion_events(spark, d)), "2024-01-05", "2024-01-12", family="risk")


@query("f05_rule_score_filter", over("suggestion_events", f"select * from ({SCORES}) where suggestion_family = 'idea' and quality_score >= -0.5"))
def _(spark, d):
    return m.filter_scores(_scores(spark, d), family="idea", min_score=-0.5)


@query(
    "f11_f12_predicates",
    over(
        "suggestions",
        "select suggestion_id, quality_score > 0.5 and clarification_state in ('none', 'answered') and confidence > 0.8 as auto_apply, confidence < 0.6 or clarification_rate > 0.3 as needs_clarification from (select suggestion_id, clarification_state, coalesce(s.quality_score, 0) as quality_score, coalesce(s.clarification_rate, 0) as clarification_rate, case when coalesce(model_confidence_score, 0) = 0 then 0.5 else model_confidence_score end as confidence from suggestions x left join scores s on coalesce(nullif(x.rule_or_prompt_id, ''), 'unknown') = s.rule_or_prompt_id and coalesce(nullif(x.suggestion_family, ''), 'general') = s.suggestion_family)",
        scores=SCORES,
    ),
)
def _(spark, d):
    s = m.scored(fx.suggestions(spark, d), _scores(spark, d)).withColumn("c", m.confidence(F.col("model_confidence_score")))
    return s.select("suggestion_id", m.auto_apply(F.col("quality_score"), F.col("clarification_state"), F.col("c")).alias("auto_apply"), m.needs_clarification(F.col("c"), F.col("clarification_rate")).alias("needs_clarification"))


@query("f13_rollout")
def _(spark, d):
    return fx.notes(spark, d).select("note_id", *(m.rolled_out(F.col("note_id"), p).alias(f"on_at_{p}") for p in (5, 25, 100)))


@query("j01_notes_in_range", over("suggestions event_notes", "select suggestion_id, note_id from suggestions where note_id in (select note_id from event_notes where created_at between timestamp '2024-01-05' and timestamp '2024-01-20')"))
def _(spark, d):
    notes = m.notes_between(fx.event_notes(spark, d), "2024-01-05", "2024-01-20")
    return m.of_notes(fx.suggestions(spark, d), notes).select("suggestion_id", "note_id")


JOINED = "select x.suggestion_id, coalesce(s.quality_score, 0) as quality_score, coalesce(s.apply_rate, 0) as apply_rate, coalesce(s.nhi, 0) as nhi from suggestions x left join scores s on coalesce(nullif(x.rule_or_prompt_id, ''), 'unknown') = s.rule_or_prompt_id and coalesce(nullif(x.suggestion_family, ''), 'general') = s.suggestion_family"


@query("j02_suggestion_scores", over("suggestions", JOINED, scores=SCORES))
def _(spark, d):
    return m.scored(fx.suggestions(spark, d), _scores(spark, d)).select("suggestion_id", "quality_score", "apply_rate", "nhi")


@query("j02_model_fallback", over("suggestions", JOINED.replace("coalesce(nullif(x.rule_or_prompt_id, ''), 'unknown')", "coalesce(nullif(x.rule_or_prompt_id, ''), 'rule' || (substr(x.note_id, 2)::bigint % 20))"), scores=SCORES))
def _(spark, d):
    """Suggestions without a rule take the scores of the model version that made them."""
    s = fx.suggestions(spark, d).withColumn("model_version", F.concat(F.lit("rule"), (F.substring("note_id", 2, 20).cast("bigint") % 20).cast("string")))
    return m.scored(s, _scores(spark, d)).select("suggestion_id", "quality_score", "apply_rate", "nhi")


@query(
    "j06_first_shown_latency",
    over(
        "suggestion_events",
        "select event_id, e.suggestion_id, event_type, floor((epoch_us(created_at) - epoch_us(t)) / 1000)::bigint as latency_ms, floor(floor((epoch_us(created_at) - epoch_us(t)) / 1000) / 1000)::bigint as latency_seconds from suggestion_events e left join f on e.suggestion_id = f.suggestion_id where event_type in ('applied', 'dismissed', 'clarification_requested')",
        f="select suggestion_id, min(created_at) as t from suggestion_events where event_type = 'shown' group by 1",
    ),
)
def _(spark, d):
    return m.first_shown_latency(fx.suggestion_events(spark, d)).select("event_id", "suggestion_id", "event_type", "latency_ms", "latency_seconds")


@query(
    "j07_answer_latency",
    over(
        "suggestion_events",
        "select event_id, suggestion_id, floor((epoch_us(created_at) - epoch_us(r)) / 1000)::bigint as response_ms from (select *, last_value(case when event_type = 'clarification_requested' then created_at end ignore nulls) over (partition by suggestion_id order by created_at, event_id rows between unbounded preceding and 1 preceding) as r from suggestion_events where event_type in ('clarification_requested', 'clarification_answered')) where event_type = 'clarification_answered'",
    ),
)
def _(spark, d):
    return m.answer_latency(fx.suggestion_events(spark, d)).select("event_id", "suggestion_id", "response_ms")


@query("m04_envelope", over("suggestions", "select event_id, coalesce(e.suggestion_family, s.suggestion_family) as suggestion_family, coalesce(e.rule_or_prompt_id, s.rule_or_prompt_id) as rule_or_prompt_id, clarification_state from suggestion_events e left join suggestions s using (suggestion_id)"))
def _(spark, d):
    return m.enrich_envelope(fx.suggestion_events(spark, d), fx.suggestions(spark, d)).select("event_id", "suggestion_family", "rule_or_prompt_id", "clarification_state")


@query("m05_daily_report", over("suggestion_events", f"select *, case when surface is null and suggestion_family is null then 'global' when surface is null then 'by_family' else 'by_surface' end as section from ({CUBE}) where date_utc = date '2024-01-10' and team_id is null and (surface is null or suggestion_family is null)"))
def _(spark, d):
    return m.daily_report(m.daily_cube(fx.suggestion_events(spark, d)), "2024-01-10")


OVERALL = """select *, floor(applied_suggestions / total_suggestions * 100 * 100 + 0.5) / 100 as acceptance_rate, floor(dismissed_suggestions / total_suggestions * 100 * 100 + 0.5) / 100 as dismissal_rate from
 (select count(*) as total_suggestions, count(*) filter (where status = 'applied') as applied_suggestions, count(*) filter (where status = 'dismissed') as dismissed_suggestions, count(*) filter (where status = 'new') as new_suggestions, count(*) filter (where regenerated) as regenerated_suggestions from suggestions where not coalesce(invalidated_by_note_deletion, false)),
 (select count(*) filter (where event_type = 'shown') as shown_events, count(*) filter (where event_type = 'applied') as applied_events, count(*) filter (where event_type = 'dismissed') as dismissed_events from suggestion_events where not coalesce(exclude_from_metrics, false))"""


@query("m06_overall_metrics", over("suggestions", OVERALL))
def _(spark, d):
    return m.overall_metrics(fx.suggestions(spark, d), fx.suggestion_events(spark, d))


IN = "note_id in (select note_id from event_notes where created_at between timestamp '2024-01-05' and timestamp '2024-01-20')"


@query(
    "m07_range_header",
    over(
        "suggestions event_notes",
        f"select *, {PCT.format(a='suggestions_applied', b='suggestions_shown')} as apply_rate from (select count(*) as notes_created from event_notes where {IN}), (select count(*) as suggestions_generated from suggestions where {IN}), (select count(*) filter (where event_type = 'shown') as suggestions_shown, count(*) filter (where event_type = 'applied') as suggestions_applied, count(*) filter (where event_type = 'dismissed') as suggestions_dismissed from suggestion_events where {IN})",
    ),
)
def _(spark, d):
    return m.range_header(m.notes_between(fx.event_notes(spark, d), "2024-01-05", "2024-01-20"), fx.suggestions(spark, d), fx.suggestion_events(spark, d))


@query("m08_dismiss_reasons", over("suggestion_events", "select reason, n, floor(n * 100.0 / sum(n) over () + 0.5)::bigint as share_pct from (select coalesce(nullif(dismiss_reason, ''), 'unknown') as reason, count(*) as n from suggestion_events where event_type = 'dismissed' group by 1)"))
def _(spark, d):
    return m.dismiss_reasons(fx.suggestion_events(spark, d))


@query("m09_apply_times", over("suggestion_events", "select floor(avg(time_to_event_seconds) + 0.5)::bigint as avg_time_to_apply_seconds, floor(avg(self_reported_time_saved_minutes) + 0.5)::bigint as avg_time_saved_minutes, count(self_reported_time_saved_minutes) as time_saved_response_count from suggestion_events where event_type = 'applied'"))
def _(spark, d):
    return m.apply_times(fx.suggestion_events(spark, d))


@query(
    "m10_note_breakdown",
    over(
        "suggestions event_notes",
        f"select n.note_id, coalesce(nullif(title, ''), substr(body, 1, 50) || case when length(body) > 50 then '...' else '' end) as title, created_at, coalesce(s, 0) as total_suggestions, coalesce(shown, 0) as shown, coalesce(applied, 0) as applied, coalesce(dismissed, 0) as dismissed, {PCT.format(a='applied', b='shown')} as apply_rate from event_notes n left join (select note_id, count(*) as s from suggestions group by 1) using (note_id) left join (select note_id, count(*) filter (where event_type = 'shown') as shown, count(*) filter (where event_type = 'applied') as applied, count(*) filter (where event_type = 'dismissed') as dismissed from suggestion_events group by 1) using (note_id)",
    ),
)
def _(spark, d):
    return m.note_breakdown(fx.event_notes(spark, d), fx.suggestions(spark, d), fx.suggestion_events(spark, d))


@query(
    "m11_initiative_rates",
    over(
        "suggestions",
        f"select *, {PCT.format(a='applied_with_initiative_count', b='total_applied_count')} as applied_to_initiative_rate from (select count(*) filter (where status = 'applied') as total_applied_count, count(*) filter (where status = 'applied' and initiative_id is not null) as applied_with_initiative_count from suggestions), (select floor(avg(n) * 10 + 0.5) / 10 as avg_suggestions_per_initiative, count(*) as initiatives_with_suggestions_count from (select count(*) as n from suggestions where initiative_id is not null group by initiative_id))",
    ),
)
def _(spark, d):
    return m.initiative_rates(fx.suggestions(spark, d))


@query("m12_rule_quality", over("suggestion_events", SCORES))
def _(spark, d):
    return _scores(spark, d)


@query("m18_show_by_quality", over("suggestion_events", f"select rule_or_prompt_id, suggestion_family, quality_score, not (quality_score < -0.3 and suggestions_generated > 10) as show from ({SCORES})"))
def _(spark, d):
    return m.show_by_quality(_scores(spark, d)).select("rule_or_prompt_id", "suggestion_family", "quality_score", "show")


@query(
    "m28_funnel",
    over(
        "suggestion_events",
        "select suggestion_id, " + ", ".join(f"count(*) filter (where event_type = '{k}') as n_{k}" for k in ("generated", "shown", "clarification_requested", "clarification_answered", "applied", "dismissed")) + ", " + ", ".join(f"min(created_at) filter (where event_type = '{k}') as first_{k}_at" for k in ("shown", "clarification_requested", "clarification_answered", "applied")) + " from suggestion_events group by 1",
    ),
)
def _(spark, d):
    return m.funnel(fx.suggestion_events(spark, d))


@query(
    "w01_rank_suggestions",
    over(
        "suggestions",
        "select note_id, suggestion_id, ranking_score, row_number() over (partition by note_id order by ranking_score desc, suggestion_id) as rank from (select note_id, x.suggestion_id, q * (0.5 + (case when coalesce(model_confidence_score, 0) = 0 then 0.5 else model_confidence_score end) * 0.5) * (case clarification_state when 'suggested' then 0.7 when 'requested' then 0.8 when 'answered' then 1.1 else 1.0 end)::double as ranking_score from (select x.*, coalesce(s.quality_score, 0)::double as q from suggestions x left join scores s on coalesce(nullif(x.rule_or_prompt_id, ''), 'unknown') = s.rule_or_prompt_id and coalesce(nullif(x.suggestion_family, ''), 'general') = s.suggestion_family) x where status = 'new' and q >= -0.3)",
        scores=SCORES,
    ),
)
def _(spark, d):
    return m.rank_suggestions(fx.suggestions(spark, d), _scores(spark, d)).select("note_id", "suggestion_id", "ranking_score", "rank")


@query("w02_once_shown", over("suggestion_events", "select suggestion_id, event_id, note_id, created_at from (select *, row_number() over (partition by suggestion_id order by created_at, event_id) as r from suggestion_events where event_type = 'shown') where r = 1"))
def _(spark, d):
    return m.once_shown(fx.suggestion_events(spark, d))


@query("k01_top_rules", over("suggestion_events", f"select rule_or_prompt_id, suggestion_family, quality_score from ({SCORES}) order by quality_score desc, rule_or_prompt_id, suggestion_family limit 10"))
def _(spark, d):
    return m.top_rules(_scores(spark, d)).select("rule_or_prompt_id", "suggestion_family", "quality_score")


@query("k01_worst_rules", over("suggestion_events", f"select rule_or_prompt_id, suggestion_family, quality_score from ({SCORES}) where quality_score <= -0.2 order by quality_score, rule_or_prompt_id, suggestion_family limit 10"))
def _(spark, d):
    return m.worst_rules(_scores(spark, d)).select("rule_or_prompt_id", "suggestion_family", "quality_score")


@query("k02_recent_events", over("suggestion_events", "select event_id, event_type, created_at from suggestion_events order by created_at desc, event_id desc limit 50"))
def _(spark, d):
    return m.recent_events(fx.suggestion_events(spark, d), 50).select("event_id", "event_type", "created_at")


FIRST = "created_at < timestamp '2024-01-16'"
UPSERT = f"select date_utc, coalesce(b.n, a.n) as n, case when a.date_utc is not null then timestamp '2024-02-01' else timestamp '2024-02-02' end as created_at, case when b.date_utc is not null then timestamp '2024-02-02' else timestamp '2024-02-01' end as updated_at from a full join b using (date_utc)"


@query(
    "s03_daily_upsert",
    over("suggestion_events", UPSERT, a=f"select created_at::date as date_utc, count(*) as n from suggestion_events where {FIRST} group by 1", b="select created_at::date as date_utc, count(*) as n from suggestion_events where created_at >= timestamp '2024-01-10' group by 1"),
)
def _(spark, d):
    """Days stored in a first run, and a later run that corrects some and adds others."""
    e = fx.suggestion_events(spark, d)
    per_day = lambda cond: e.where(cond).groupBy(F.to_date("created_at").alias("date_utc")).agg(F.count(F.lit(1)).alias("n"))
    t = F.lit("2024-02-01").cast("timestamp")
    current = per_day("created_at < timestamp'2024-01-16'").withColumns({"created_at": t, "updated_at": t})
    return mg.upsert(current, per_day("created_at >= timestamp'2024-01-10'"), ["date_utc"], "2024-02-02")


@query(
    "s04_score_upsert",
    over(
        "suggestion_events",
        "select coalesce(b.rule_or_prompt_id, a.rule_or_prompt_id) as rule_or_prompt_id, coalesce(b.suggestion_family, a.suggestion_family) as suggestion_family, coalesce(b.quality_score, a.quality_score) as quality_score, case when a.rule_or_prompt_id is not null then timestamp '2024-02-01' else timestamp '2024-02-02' end as created_at, case when b.rule_or_prompt_id is not null then timestamp '2024-02-02' else timestamp '2024-02-01' end as updated_at from a full join b on a.rule_or_prompt_id = b.rule_or_prompt_id and a.suggestion_family = b.suggestion_family",
        a=SCORES.replace("2024-01-08", "2024-01-01").replace("2024-01-28", "2024-01-15"),
        b=SCORES,
    ),
)
def _(spark, d):
    cols = ["rule_or_prompt_id", "suggestion_family", "quality_score"]
    t = F.lit("2024-02-01").cast("timestamp")
    current = m.rule_quality(fx.suggestion_events(spark, d), "2024-01-15", 14).select(*cols).withColumns({"created_at": t, "updated_at": t})
    return mg.upsert(current, _scores(spark, d).select(*cols), cols[:2], "2024-02-02")


@query(
    "s05_latest_decisions",
    over("decisions", "select note_id, suggestion_key, status, updated_at, case when status = 'applied' then initiative_id end as initiative_id, case when status <> 'applied' then dismiss_reason end as dismiss_reason from (select *, row_number() over (partition by note_id, suggestion_key order by updated_at desc, status desc) as r from decisions) where r = 1"),
)
def _(spark, d):
    """Decisions up to the middle of January are the table, and later ones are merged into it."""
    all_ = fx.decisions(spark, d)
    old = mg.latest_decisions(all_.limit(0), all_.where("updated_at < timestamp'2024-01-15 00:00:00'"))
    return mg.latest_decisions(old, all_.where("updated_at >= timestamp'2024-01-15 00:00:00'"))


@query("s07_payload_gate", over("suggestion_events", "select event_id from suggestion_events where event_id >= 0"))
def _(spark, d):
    return mg.within_size(fx.suggestion_events(spark, d)).select("event_id")


@query("s08_retention", over("suggestion_events", "select event_id, created_at + interval 14 day as expires_at from suggestion_events where created_at + interval 14 day >= timestamp '2024-01-25'"))
def _(spark, d):
    return mg.unexpired(fx.suggestion_events(spark, d), "2024-01-25").select("event_id", "expires_at")


@query(
    "j04_undecided",
    over("decisions", "select suggestion_id from suggestions s where not exists (select 1 from decisions x where x.note_id = s.note_id and x.suggestion_key = s.suggestion_id)"),
)
def _(spark, d):
    decided = fx.decisions(spark, d).select("note_id", F.col("suggestion_key").alias("suggestion_id")).distinct()
    return fx.suggestions(spark, d).join(decided, ["note_id", "suggestion_id"], "left_anti").select("suggestion_id")


@query(
    "m13_feedback_stats",
    over("suggestion_events", "select count(*) filter (where event_type = 'shown') as shown, count(*) filter (where event_type = 'applied') as accepted, count(*) filter (where event_type = 'dismissed') as dismissed, case when count(*) filter (where event_type = 'shown') > 0 then count(*) filter (where event_type = 'applied') / count(*) filter (where event_type = 'shown') else 0 end as accept_rate, case when count(*) filter (where event_type = 'shown') > 0 then count(*) filter (where event_type = 'dismissed') / count(*) filter (where event_type = 'shown') else 0 end as dismiss_rate from suggestion_events"),
)
def _(spark, d):
    n = lambda k: F.count_if(F.col("event_type") == k)
    e = fx.suggestion_events(spark, d).agg(n("shown").alias("shown"), n("applied").alias("accepted"), n("dismissed").alias("dismissed"))
    from planlake.functions.compat import rate

    return e.withColumns({"accept_rate": rate(F.col("accepted"), F.col("shown")), "dismiss_rate": rate(F.col("dismissed"), F.col("shown"))})


@query("r_session_batch", over("suggestion_events", "select note_id, min(created_at) as session_start, count(*) as n_events from (select *, sum(case when p is null or created_at >= p + interval 30 minute then 1 else 0 end) over (partition by note_id order by created_at, event_id rows unbounded preceding) as s from (select *, lag(created_at) over (partition by note_id order by created_at, event_id) as p from suggestion_events)) group by note_id, s"))
def _(spark, d):
    g = fx.suggestion_events(spark, d).groupBy("note_id", F.session_window("created_at", "30 minutes").alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n_events")).select("note_id", F.col("w.start").alias("session_start"), "n_events")
