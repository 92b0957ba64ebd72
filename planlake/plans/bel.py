"""Queries over meetings, beliefs and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.functions import lexicon as lx
from planlake.operators import beliefs as bl
from planlake.operators.cuts import cut
from planlake.plans.fixture_sql import over
from planlake.plans.registry import query
from planlake.plans.txt import SPLIT
from planlake.sources import fixtures as fx

UTT = f"select meeting_id, trim(unnest({SPLIT.format('line')})) as text from (select meeting_id, unnest(string_split(raw_markdown, chr(10))) as line from meetings)"


def _has(words: str) -> str:
    return rf"regexp_matches(t, '\b({words})\b')"


DIM = "case " + " ".join(f"when {_has(w)} then '{n}'" for n, w, _, _, _ in lx.DIMENSIONS[::-1]) + f" when {_has(lx.OTHER_CHANGE)} then 'other' end"
LAB = "case " + " ".join(f"when {_has(w)} then '{lab}'" for _, w, _, lab, _ in lx.DIMENSIONS[::-1]) + f" when {_has(lx.OTHER_CHANGE)} then 'plan_change' else 'noise' end"
CONF = "case " + " ".join(f"when {_has(w)} then {c}" for _, w, _, _, c in lx.DIMENSIONS[::-1]) + f" when {_has(lx.OTHER_CHANGE)} then 0.5 else 0.3 end"
ROLE = f"case when label = 'plan_change' and dimension <> 'other' and {_has(lx.BEFORE)} then 'before' when label = 'plan_change' and dimension <> 'other' and {_has(lx.AFTER)} then 'after' else 'none' end"
CLASS = f"select meeting_id, text, t, label, dimension, {ROLE} as change_role, c from (select *, lower(text) as t, {DIM.replace('(t,', '(lower(text),')} as dimension, {LAB.replace('(t,', '(lower(text),')} as label, ({CONF.replace('(t,', '(lower(text),')})::double as c from u where text <> '')"


def _classes(spark, d):
    return bl.classified(bl.utterances(fx.meetings(spark, d)))


@query("b01_utterance_classes", over("meetings", f"select label, dimension, change_role, round(least(c + case when change_role <> 'none' then 0.1 else 0 end, 1.0), 6) as local_confidence, count(*) as n from ({CLASS}) group by all", u=UTT))
def _(spark, d):
    c = _classes(spark, d)
    return c.groupBy("label", "dimension", "change_role", "local_confidence").agg(F.count(F.lit(1)).alias("n"))


@query("t09_utterances")
def _(spark, d):
    return bl.utterances(fx.meetings(spark, d))


@query("b02_threads")
def _(spark, d):
    return bl.threads(_classes(spark, d))


def _beliefs(spark, d):
    return bl.with_confidence(bl.beliefs(bl.threads(_classes(spark, d))))


@query("b03_b04_b05_beliefs")
def _(spark, d):
    return _beliefs(spark, d)


@query("b09_decisions")
def _(spark, d):
    return bl.decisions(_beliefs(spark, d))


@query("b10_clusters")
def _(spark, d):
    return bl.clusters(_beliefs(spark, d))


@query("b11_invariants")
def _(spark, d):
    b = cut(_beliefs(spark, d))
    return bl.invariants(b, bl.decisions(b))


CAPPED = """select *, row_number() over (partition by meeting_id, initiative_id, action order by priority desc, suggestion_id) as rank, case action when 'comment' then 3 when 'mutate_release_date' then 1 else 5 end as most from (
 select 'm' || (u % 20) as meeting_id, case when k = 6 then 'unscoped' else 'i' || (u % 3) end as initiative_id, (['comment', 'mutate_release_date', 'flag'])[k % 3 + 1] as action, suggestion_id, ((u * 7 + k * 3) % 20) / 20 as priority,
  case when u % 5 = 0 then 'Multiple meetings' else 'Body ' || suggestion_id end as body, ['b' || (u % 4), suggestion_id] as ids, u % 5 as start_char from (select suggestion_id, substr(note_id, 2)::bigint as u, split_part(suggestion_id, '_', 2)::bigint as k from suggestions))"""
W06 = """select r.meeting_id, r.initiative_id, r.action, r.suggestion_id, r.rank::int as rank, round(case when o.n > 0 then least(1.0, r.priority + 0.05 * o.n) else r.priority end, 6)::double as priority,
 case when r.action = 'comment' and not contains(r.body, 'Multiple meetings') then repeat('Ongoing: ', coalesce(o.n, 0)::bigint) else '' end || r.body as body,
 array_to_string(list_sort(case when o.n > 0 then list_distinct(list_concat(r.ids, o.ids)) else r.ids end), ',') as belief_ids, case when o.n > 0 then len(list_distinct(list_concat([r.start_char], o.starts))) else 1 end::int as n_spans
 from r left join (select meeting_id, initiative_id, action, count(*) as n, flatten(list(ids)) as ids, list(start_char) as starts from r where rank > most group by 1, 2, 3) o on r.rank = 1 and r.meeting_id = o.meeting_id and r.initiative_id = o.initiative_id and r.action = o.action where r.rank <= r.most"""


@query("w06_rate_caps", over("suggestions", W06, r=CAPPED))
def _(spark, d):
    u, k = F.substring("note_id", 2, 20).cast("bigint"), F.element_at(F.split("suggestion_id", "_"), 2).cast("bigint")
    c = F.col("u") % 5
    s = fx.suggestions(spark, d).select("suggestion_id", u.alias("u"), k.alias("k")).select(
        F.concat(F.lit("m"), (F.col("u") % 20).cast("string")).alias("meeting_id"), F.when(F.col("k") != 6, F.concat(F.lit("i"), (F.col("u") % 3).cast("string"))).alias("initiative_id"),
        F.element_at(F.array(*map(F.lit, ("comment", "mutate_release_date", "flag"))), (F.col("k") % 3 + 1).cast("int")).alias("action"), "suggestion_id",
        ((F.col("u") * 7 + F.col("k") * 3) % 20 / 20).alias("priority"), F.when(c == 0, "Multiple meetings").otherwise(F.concat(F.lit("Body "), "suggestion_id")).alias("body"),
        F.array(F.concat(F.lit("b"), (F.col("u") % 4).cast("string")), F.col("suggestion_id")).alias("belief_ids"), F.array(F.struct(c.alias("start_char"))).alias("spans"),
    )
    out = bl.capped_suggestions(s, {"comment": 3, "mutate_release_date": 1})
    return out.select("meeting_id", "initiative_id", "action", "suggestion_id", "rank", F.round("priority", 6).alias("priority"), "body", F.array_join(F.array_sort("belief_ids"), ",").alias("belief_ids"), F.size("spans").alias("n_spans"))


@query("j12_initiative_mapping", "select vec_id, case when a >= 0.7 and a - b >= 0.2 then 'x' when b >= 0.7 and b - a >= 0.2 then 'y' end as initiative_id from (select vec_id, (vec_id % 10) / 10 as a, (vec_id % 7) / 10 as b from embeddings)")
def _(spark, d):
    v = fx.table(spark, d, "embeddings").select("vec_id")
    scores = F.create_map(F.lit("x"), F.col("vec_id") % 10 / 10, F.lit("y"), F.col("vec_id") % 7 / 10)
    return v.select("vec_id", bl.mapped_initiative(scores).alias("initiative_id"))


@query("m14_feedback_stats", over("feedback_events", "select count(*) as total, round(count(*) filter (where action = 'accepted') / count(*), 6) as accept_rate, round(count(*) filter (where action = 'dismissed') / count(*), 6) as dismiss_rate, round(count(*) filter (where action = 'edited') / count(*), 6) as edit_rate, round(avg(time_to_action_seconds), 6) as mean_seconds from feedback_events"))
def _(spark, d):
    return bl.feedback_stats(fx.feedback_events(spark, d))


@query("j15_feedback_by_status", over("feedback_events suggestions", "select clarification_state, count(*) as n, round(count(*) filter (where action = 'accepted') / count(*), 6) as accept_rate from feedback_events join suggestions using (suggestion_id) group by 1"))
def _(spark, d):
    return bl.feedback_by_status(fx.feedback_events(spark, d), fx.suggestions(spark, d))


SPAM_TEXT = "select suggestion_id, 'the ' || suggestion_family || ' proposal of ' || rule_or_prompt_id as text from suggestions where suggestion_family is not null and rule_or_prompt_id is not null"


@query(
    "m23_spam_tokens",
    over("feedback_events suggestions", "select token, n, round(least(0.9, n / docs), 6) as confidence from (select token, count(*) as n from (select suggestion_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: length(w) >= 4))) as token from s) group by 1), (select count(*) as docs from s) where docs >= 3 and n >= 2",
         s=f"select * from ({SPAM_TEXT}) where suggestion_id in (select suggestion_id from feedback_events where action = 'dismissed' and dismiss_reason = 'spam')"),
)
def _(spark, d):
    s = fx.suggestions(spark, d).where("suggestion_family is not null and rule_or_prompt_id is not null")
    texts = s.select("suggestion_id", F.concat(F.lit("the "), "suggestion_family", F.lit(" proposal of "), "rule_or_prompt_id").alias("text"))
    return bl.spam_tokens(fx.feedback_events(spark, d), texts)


@query("m24_quick_accepts", over("feedback_events", "select count(*) as quick, count(*) >= 3 as signal from feedback_events where action = 'accepted' and time_to_action_seconds <= 60"))
def _(spark, d):
    return bl.quick_accepts(fx.feedback_events(spark, d))


#: Feedback and suggestions with the columns of the feedback jobs: half of the dismissals of a rule share one reason.
FB = """select suggestion_id, action as event_action, time_to_action_seconds as t, case when action = 'dismissed' then case when event_id % 2 = 0 then (['wrong_initiative', 'too_ambiguous', 'spam', 'other'])[split_part(suggestion_id, '_', 2)::int % 4 + 1] else 'duplicate' end end as reason from feedback_events"""
SG = """select suggestion_id, coalesce(rule_or_prompt_id, 'unknown') as rule, split_part(suggestion_id, '_', 2) as part, case suggestion_family when 'project_update' then 'mutate_release_date' else 'comment' end as action,
 case clarification_state when 'none' then 'suggested' when 'answered' then 'answered' else 'needs_clarification' end as status from suggestions"""
STATS = "select rule, part, count(*) as total_suggestions, " + ", ".join(f"sum({a})::bigint as total_{a}" for a in ("accepted", "dismissed", "edited")) + """, sum(accepted) / count(*) as acceptance_rate, sum(dismissed) / count(*) as dismissal_rate, sum(edited) / count(*) as edit_rate, coalesce(sum(seconds) / nullif(sum(timed), 0), 0) as mean_seconds,
 """ + ", ".join(f"coalesce(sum(accepted) filter (where {c} = '{v}') / nullif(count(*) filter (where {c} = '{v}'), 0), 0) as {n}_acceptance_rate" for c, v, n in (("action", "comment", "comment"), ("action", "mutate_release_date", "release_date"), ("status", "suggested", "suggested"), ("status", "needs_clarification", "needs_clarification"))) + ", " + ", ".join(f"sum({r})::bigint as {r}" for r in bl.REASONS) + """
 from (select sg.*, """ + ", ".join(f"coalesce({c}, 0) as {c}" for c in ("accepted", "dismissed", "edited", "seconds", "timed", *bl.REASONS)) + " from sg left join (select suggestion_id, " + ", ".join(f"count(*) filter (where event_action = '{a}') as {a}" for a in ("accepted", "dismissed", "edited")) + ", sum(t) as seconds, count(t) as timed, " + ", ".join(f"count(*) filter (where reason = '{r}') as {r}" for r in bl.REASONS) + " from fb group by 1) e using (suggestion_id)) group by 1, 2"
_T = {k: f"{v}::double" for k, v in bl.THRESHOLDS.items()}
_COMMENTS = "max_comment_suggestions_per_initiative_per_meeting"
_RULES = [
    ("dismissal_rate > 0.4 and wrong_initiative > total_dismissed * 0.3", "min_initiative_match_score", "least(0.85, {0} + 0.05)", 0.8),
    ("dismissal_rate > 0.4 and wrong_initiative > total_dismissed * 0.3", "min_match_gap", "least(0.3, {0} + 0.05)", 0.7),
    ("dismissal_rate > 0.4 and too_ambiguous > total_dismissed * 0.3", "min_belief_confidence", "least(0.75, {0} + 0.05)", 0.75),
    ("spam > total_dismissed * 0.2", _COMMENTS, "greatest(1, {0} - 1)", 0.65),
    ("acceptance_rate > 0.8 and total_suggestions >= 20", "min_belief_confidence", "greatest(0.5, {0} - 0.05)", 0.6),
    ("needs_clarification_acceptance_rate > 0 and abs(needs_clarification_acceptance_rate - suggested_acceptance_rate) < 0.1 and total_suggestions >= 20", "ambiguous_match_threshold", "greatest(0.3, {0} - 0.05)", 0.55),
]
RECOMMENDED = " union all ".join(f"select {{by}}, {i} as place, '{n}' as threshold, {_T[n]} as current_value, round({to.format(_T[n])}, 6)::double as recommended_value, {sure}::double as confidence from st where {test}" for i, (test, n, to, sure) in enumerate(_RULES, 1))


def _feedback(spark, d, by):
    part = F.element_at(F.split("suggestion_id", "_"), 2)
    reasons = F.array(*map(F.lit, ("wrong_initiative", "too_ambiguous", "spam", "other")))
    reason = F.when(F.col("event_id") % 2 == 0, F.element_at(reasons, part.cast("int") % 4 + 1)).otherwise("duplicate")
    fb = fx.feedback_events(spark, d).withColumn("dismiss_reason", F.when(F.col("action") == "dismissed", reason))
    state = F.col("clarification_state")
    s = fx.suggestions(spark, d).select(
        "suggestion_id", F.coalesce("rule_or_prompt_id", F.lit("unknown")).alias("rule"), part.alias("part"), F.when(F.col("suggestion_family") == "project_update", "mutate_release_date").otherwise("comment").alias("action"),
        F.when(state == "none", "suggested").when(state == "answered", "answered").otherwise("needs_clarification").alias("status"),
    )
    return bl.feedback_breakdown(fb, s, by)


def _thresholds(spark):
    return spark.createDataFrame([tuple(bl.THRESHOLDS.values())], list(bl.THRESHOLDS))


_RATES = ["acceptance_rate", "dismissal_rate", "edit_rate", "mean_seconds", "comment_acceptance_rate", "release_date_acceptance_rate", "suggested_acceptance_rate", "needs_clarification_acceptance_rate"]
_COUNTS = ["total_suggestions", "total_accepted", "total_dismissed", "total_edited", *bl.REASONS]


@query("m14_feedback_breakdown", over("feedback_events suggestions", "select rule, part, " + ", ".join(_COUNTS) + ", " + ", ".join(f"round({c}, 6)::double as {c}" for c in _RATES) + " from st", fb=FB, sg=SG, st=STATS))
def _(spark, d):
    return _feedback(spark, d, ["rule", "part"]).select("rule", "part", *_COUNTS, *(F.round(c, 6).alias(c) for c in _RATES))


_PART = STATS.replace("select rule, part, count", "select part, count").replace("group by 1, 2", "group by 1")


@query("m25_recommendations", over("feedback_events suggestions", RECOMMENDED.format(by="part"), fb=FB, sg=SG, st=_PART))
def _(spark, d):
    return bl.recommendations(_feedback(spark, d, ["part"]), _thresholds(spark), ["part"])


@query("m25_adjusted_thresholds", over("feedback_events suggestions", "select part, threshold, arg_max(recommended_value, place) as new_value from r where confidence >= 0.6 group by 1, 2", fb=FB, sg=SG, st=_PART, r=RECOMMENDED.format(by="part")))
def _(spark, d):
    return bl.adjusted(bl.recommendations(_feedback(spark, d, ["part"]), _thresholds(spark), ["part"]), ["part"])
