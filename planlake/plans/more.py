"""Queries over section intent, matching, guards, implications and typed loads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planlake.functions import lexicon as lx
from planlake.functions import textcols as tc
from planlake.operators import corpus as cp
from planlake.operators import cues
from planlake.operators import intent as it
from planlake.operators.cuts import cut
from planlake.plans import txt
from planlake.plans.evt import SHOWN, fold_sql
from planlake.plans.fixture_sql import over
from planlake.plans.registry import query
from planlake.plans.txt import HASH, SENT, any_of, has
from planlake.sources import fixtures as fx
from planlake.sources import tables
from planlake.streaming import jobs


def _holds(c, phrases):
    return "(" + " or ".join(f"contains({c}, '{txt._q(p)}')" for p in phrases) + ")"


def _word(c, words):
    return has(c, rf"\b({'|'.join(words)})\b")


def _marked(c, markers):
    many, one = [m for m in markers if " " in m], [m for m in markers if " " not in m]
    return "(" + " or ".join(([_holds(c, many)] if many else []) + ([_word(c, one)] if one else [])) + ")"


def _after(p):
    return f"string_split(l, '{p}')[-1]"


VERB = _word("l", lx.ACTION_VERBS)
PM = " or ".join([_holds("l", lx.PM_REQUESTS), f"(contains(l, 'request to') and {_word(_after('request to'), lx.ACTION_VERBS)})"] + [f"(contains(l, '{p}') and ({_word(_after(p), lx.ACTION_VERBS)} or {_word(_after(p), lx.PRODUCT_NOUNS)}))" for p in ("requests a ", "requests an ", "requests for ", "requests that ")])
V = lambda cond, x: f"case when {cond} then {x} else 0.0 end"
PLAIN = "greatest(" + ", ".join([V(f"{_holds('l', lx.REQUEST_STEMS)} and {VERB}", 1.0), V(has("l", f"^({'|'.join(lx.ACTION_VERBS)})\\b"), 0.9), V(_holds("l", lx.CHANGE_OPERATORS), 0.8), V(_holds("l", lx.STATUS_MARKERS), 0.7), V(_holds("l", lx.TASK_MARKERS), 0.8), V(_holds("l", lx.ROLES), 0.85), V(_holds("l", lx.DECISIONS), 0.7), V(f"({PM})", 0.76)]) + ")"
SCORE = f"select note_id, s, case when {_holds('l', lx.NEGATIONS)} and {VERB} then 0.0 else least(1.0, h + case when h >= 0.6 and {_holds('l', lx.PRODUCT_NOUNS)} then 0.2 else 0.0 end) end::double as score, (case when {_marked('l', lx.CALENDAR)} or {_marked('l', lx.COMMUNICATION)} then 0.6 when {_marked('l', lx.MICRO_TASKS)} then 0.4 else 0.0 end)::double as oos from (select *, greatest({PLAIN}, {V(_holds('l', lx.HEDGED), 0.9)}) as h from (select note_id, s, lower(s) as l from x))"


@query("c04_sentence_scores", over("notes", SCORE, x=SENT))
def _(spark, d):
    x = txt._lines(spark, d).select("note_id", "s", it.line_scores(F.col("s")).alias("x"))
    return x.select("note_id", "s", "x.score", "x.oos")


def _sections(spark, d):
    return cp.sections(fx.notes(spark, d))


@query("c07_topic_parts")
def _(spark, d):
    return it.topic_parts(_sections(spark, d))


def _count(words):
    return "(" + " + ".join(f"{has('lower(s)', chr(92) + 'b' + w + chr(92) + 'b')}::int" for w in words) + ")"


CON = "(" + " + ".join(f"contains(lower(s), '{w}')::int" for w in lx.CONSTRUCTS) + ")"


@query("c10_idea_tokens", over("notes", f"select note_id, a + b + c * 2 as total, a + b + c * 2 >= 2 and (a > 0 or c > 0) and (b > 0 or c > 0) as passes from (select note_id, {_count(lx.STRATEGY)} as a, {_count(lx.MECHANISMS)} as b, {CON} as c from x)", x=SENT))
def _(spark, d):
    c = it.idea_tokens(F.col("s"))
    return txt._lines(spark, d).select("note_id", c["total"].alias("total"), c["passes"].alias("passes"))


@query("c11_structural_ideas")
def _(spark, d):
    """All sections of a note as one, so that bullets add up; covered are those of every third note."""
    s = _sections(spark, d).groupBy("note_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", "raw_text")))["raw_text"], "\n").alias("raw_text"), F.sum("num_list_items").alias("num_list_items"))
    s = s.select(F.col("note_id").alias("section_id"), F.lit("All").alias("heading_text"), F.lit(2).alias("heading_level"), (F.col("num_list_items") + 1).alias("num_list_items"), "raw_text")
    return it.structural_ideas(s, s.where(F.substring("section_id", 2, 20).cast("bigint") % 3 == 0))


@query("t17_modality", over("notes", "select note_id, round(greatest(-1.0, least(1.0, 0.4 * (" + " + ".join(f"{has('s', p)}::int" for p in lx.ASSERTIVE) + ") - 0.5 * (" + " + ".join(f"{has('s', p)}::int" for p in lx.SPECULATIVE) + "))), 6)::double as modality from x", x=SENT))
def _(spark, d):
    return txt._lines(spark, d).select("note_id", it.modality(F.col("s")).alias("modality"))


@query("w05_ranking_delta", over("notes", f"select note_id, round({V(has('s', lx.ARTIFACTS), 0.15)} + {V(has('s', lx.BUILD_VERBS), 0.1)} - {V(has('s', lx.MARKETING), 0.15)}, 6)::double as delta from x", x=SENT))
def _(spark, d):
    return txt._lines(spark, d).select("note_id", it.ranking_delta(F.col("s")).alias("delta"))


@query("t24_blended_scores", over("notes", "select note_id as section_id, round(case when c < 0.3 then r else 0.9 * least(0.8, c) + r * (1 - least(0.8, c)) end, 6)::double as plan_change from (select note_id, (doc_id % 10) / 10 as c, (doc_id % 7) / 10 as r from notes)"))
def _(spark, d):
    n = fx.notes(spark, d).withColumn("section_id", F.col("note_id"))
    rules = n.select("section_id", (F.col("doc_id") % 7 / 10).alias("plan_change"))
    model = n.select("section_id", (F.col("doc_id") % 10 / 10).alias("confidence"), F.lit(0.9).alias("plan_change"))
    return it.blended(model, rules, ["plan_change"])


#: Items and sentences of notes, and what they name.
_ITEM_SQL = "list_transform(list_filter(ls, lambda x: regexp_matches(x, '{0}')), lambda x: trim(regexp_extract(x, '{0}', 1)))"
SEG0 = r"select note_id, doc_id, string_split(coalesce(body, ''), chr(10)) as ls, list_filter(list_transform(string_split(regexp_replace(coalesce(body, ''), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) > 10) as ss from minutes"
SEG1 = "select note_id, 0 as kind, unnest(range(0, len(i))) as pos, unnest(i) as text from (select note_id, list_concat(" + ", ".join(_ITEM_SQL.format(p) for p in cues._BULLETS) + ") as i from seg0) union all select note_id, 1, unnest(range(0, len(ss))), unnest(ss) from seg0"
SEG2 = "select * from (select *, row_number() over (partition by note_id, lower(text) order by kind, pos) as nth from seg1 where text <> '') where kind = 0 or nth = 1"
SEG3 = "select note_id, i as index, note_id || '#' || i as segment_id, text from (select *, row_number() over (partition by note_id order by kind, pos) - 1 as i from seg2)"
_SEG = dict(seg0=SEG0, seg1=SEG1, seg2=SEG2, seg=SEG3)
_W3 = r"list_filter(string_split_regex({0}, '\s+'), lambda w: length(w) >= 3)"
TITLED = f"""select segment_id, initiative_id from (select segment_id, initiative_id, x, y, len(list_filter(b, lambda w: list_contains(a, w))) as k, len(b) as n from
  (select segment_id, trim(lower(text)) as x, {_W3.format('trim(lower(text))')} as a from seg), (select initiative_id, trim(lower(title)) as y, {_W3.format('trim(lower(title))')} as b from minute_initiatives))
  where (y <> '' and contains(x, y)) or k >= 2 or (n > 0 and k / n >= 0.6)"""


def _extracted(p, any_case):
    return f"regexp_extract_all(text, '{txt._q(p)}', 1{', ' + chr(39) + 'i' + chr(39) if any_case else ''})"


NAMED = f"select distinct segment_id, name from (select segment_id, trim(unnest(list_concat({', '.join(_extracted(p, c) for p, c in cues.NAMES)}))) as name from seg) where name <> ''"
NAME_MATCHES = "select distinct segment_id, initiative_id from named join (select name, min(initiative_id) as initiative_id from (select distinct name from named) join minute_initiatives on initiative_id = name or contains(title, name) group by name) using (name)"
_OFF = " or ".join(any_of("trim(lower(text))", [p for p in ps if "(?!" not in p]) for ps in lx.OFF_TOPIC.values())
_ASIDE = r"regexp_matches(regexp_replace(trim(lower(text)), '\b(follow up|touch base|check in)\s+(on|about|regarding)\s+\w+\s+(initiative|project|work)', '', 'g'), '\b(follow up|touch base|check in)\b')"
_MODALITY = "(0.4 * (" + " + ".join(f"{has('text', p)}::int" for p in lx.ASSERTIVE) + ") - 0.5 * (" + " + ".join(f"{has('text', p)}::int" for p in lx.SPECULATIVE) + "))"
MENTIONED = "select segment_id, list(distinct initiative_id order by initiative_id) as ids from (select * from titled union all select * from name_matches) group by 1"
SEEN = f"select segment_id, text, coalesce(ids, []) as ids, {_MODALITY} >= 0 as sure from seg left join mentioned using (segment_id) where not (({_OFF} or {_ASIDE}) and not {has('trim(lower(text))', lx.CONCRETE)})"
CUES = " union all ".join(
    [f"select segment_id, ids, '{n}' as cue_type, {b}::double as boost from seen where len(ids) = 1 and {any_of('text', ps)}" for n, b, ps in lx.CHANGE_CUES]
    + [f"select segment_id, ids, '{n}', {b}::double from seen where {any_of('text', ps)}" + (" and sure" if n in ("new_initiative", "decision") else "") for n, b, ps in lx.NEW_CUES]
)


@query("j08_title_matches", over("minutes minute_initiatives", TITLED, **_SEG))
def _(spark, d):
    return cues.title_matches(cues.segments(fx.minutes(spark, d)), fx.minute_initiatives(spark, d))


@query("j09_id_matches", over("minutes minute_initiatives", NAME_MATCHES, **_SEG, named=NAMED))
def _(spark, d):
    return cues.name_matches(cues.segments(fx.minutes(spark, d)), fx.minute_initiatives(spark, d))


def _cued(spark, d, most=None, keep=()):
    """Cues of the segments that can have one; only what these mention is looked for, where they lie."""
    segs = cues.segments(fx.minutes(spark, d)).where(cues.any_cue(F.col("text")))
    return cues.cue_signals(segs, lambda x: cues.with_mentions(x, fx.minute_initiatives(spark, d), most), keep)


@query("c16_cue_signals", over("minutes minute_initiatives", f"select segment_id, array_to_string(ids, ',') as initiative_ids, cue_type, max(boost) as boost from ({CUES}) group by all", **_SEG, titled=TITLED, named=NAMED, name_matches=NAME_MATCHES, mentioned=MENTIONED, seen=SEEN))
def _(spark, d):
    return _cued(spark, d).withColumn("initiative_ids", F.array_join("initiative_ids", ","))


#: Cues are suggestions: those of notes with even numbers are open, the others new.
SUGGESTED = f"select segment_id || '/' || cue_type as id, cue_type as action, case when len(ids) = 1 then ids[1] end as initiative_id, text as t, doc_id % 2 = 0 as is_open, doc_id from (select distinct segment_id, ids, cue_type from ({CUES})) join seg using (segment_id) join (select note_id, doc_id from minutes) using (note_id)"
SETS = r"select *, list_distinct(list_filter(string_split_regex(lower(t), '\s+'), lambda w: w <> '')) as w from suggested"
ALIKE = """select a.id, b.id as other, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) as s, row_number() over (partition by a.id order by b.doc_id, b.id) as nth
  from sets a join sets b on not a.is_open and b.is_open and a.action = b.action and a.initiative_id is not distinct from b.initiative_id and len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.8"""
_DUP = dict(**_SEG, titled=TITLED, named=NAMED, name_matches=NAME_MATCHES, mentioned=MENTIONED, seen=SEEN, suggested=SUGGESTED, sets=SETS, alike=ALIKE)


def _suggested(spark, d):
    s = _cued(spark, d, 2, ("note_id", "text"))
    doc = F.substring("note_id", 2, 20).cast("bigint")
    one = F.when(F.size("initiative_ids") == 1, F.col("initiative_ids")[0])
    s = s.select(F.concat("segment_id", F.lit("/"), "cue_type").alias("id"), F.col("cue_type").alias("action"), one.alias("initiative_id"), "text", doc.alias("position"))
    s = cut(s).withColumn("evidence", F.col("text"))
    return s.where("position % 2 = 1"), s.where("position % 2 = 0")


@query("u07_merged_duplicates", over("minutes minute_initiatives", "select s.id, other as duplicate_of, round(s, 6) as similarity from (select id from suggested where not is_open) s left join (select * from alike where nth = 1) using (id)", **_DUP))
def _(spark, d):
    return cp.merged_duplicates(*_suggested(spark, d))


@query("u07_merged_evidence", over("minutes minute_initiatives", "select distinct id, evidence from (select id, t as evidence from suggested where is_open union all select other, t from alike join suggested using (id) where nth = 1)", **_DUP))
def _(spark, d):
    new, old = _suggested(spark, d)
    return cp.merged_evidence(cp.merged_duplicates(new, old), new, old)


OLD = "select note_id, suggestion_id, status, note_version_at_creation, note_updated_at, coalesce(suggestion_family, 'none') as fingerprint from suggestions"


@query("j05_regeneration_guard", over("suggestions", "select n.note_id, n.fingerprint from (select distinct note_id, unnest(['idea', 'risk', 'bug', 'none', 'fresh']) as fingerprint from e) n where not exists (select 1 from e where e.note_id = n.note_id and e.fingerprint = n.fingerprint and e.status = 'dismissed') or exists (select 1 from e where e.note_id = n.note_id and coalesce(note_version_at_creation, 0) <> 0 and note_version_at_creation <> note_updated_at)", e=OLD))
def _(spark, d):
    old = fx.suggestions(spark, d).withColumn("fingerprint", F.coalesce("suggestion_family", F.lit("none")))
    fresh = old.select("note_id", F.explode(F.array(*map(F.lit, ("idea", "risk", "bug", "none", "fresh")))).alias("fingerprint")).distinct()
    return it.guarded(fresh, old)


@query("j03_initiative_details", over("suggestions event_notes", "select i.initiative_id, i.title, s.suggestion_id, s.note_id, n.title as note_title, substr(n.body, 1, 200) || case when length(n.body) > 200 then '...' else '' end as note_preview from (select 'i' || x as initiative_id, 'Initiative ' || x as title from (select unnest(range(0, 12)) as x)) i left join suggestions s on s.initiative_id = i.initiative_id left join event_notes n on n.note_id = s.note_id"))
def _(spark, d):
    ini = spark.range(12).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("initiative_id"), F.concat(F.lit("Initiative "), F.col("id").cast("string")).alias("title"))
    return it.initiative_details(ini, fx.suggestions(spark, d), fx.event_notes(spark, d))


LIKE = "case doc_id % 4 when 0 then null when 1 then 0.2 when 2 then 0.5 else 0.9 end"
KIND = f"case when dim <> 'timeline' then 'pure_commentary' when k < 0.4 then 'timeline_risk' when k > 0.8 and pos then 'timeline_pull_in' when k between 0.4 and 0.6 then 'timeline_uncertain' when {any_of('lower(s)', lx.TIMELINE_UNCERTAIN)} then 'timeline_uncertain' when {any_of('lower(s)', lx.TIMELINE_PULL_IN)} then 'timeline_pull_in' when {any_of('lower(s)', lx.TIMELINE_RISK)} then 'timeline_risk' when dated then 'timeline_risk' else 'pure_commentary' end"
BEL = f"select note_id as belief_id, s, doc_id, {KIND} as kind from (select *, case when doc_id % 5 = 0 then 'scope' else 'timeline' end as dim, {LIKE} as k, doc_id % 2 = 1 as pos, doc_id % 6 = 0 as dated from x)"


def _beliefs(spark, d):
    i = F.col("doc_id")
    like = F.when(i % 4 == 1, 0.2).when(i % 4 == 2, 0.5).when(i % 4 == 3, 0.9)
    kind = it.implication(F.col("s"), F.when(i % 5 == 0, "scope").otherwise("timeline"), like, i % 2 == 1, i % 6 == 0)
    return txt._lines(spark, d).select(F.col("note_id").alias("belief_id"), "s", "doc_id", kind.alias("kind"))


@query("b06_implications", over("notes", "select belief_id, s, kind from b", x=SENT, b=BEL))
def _(spark, d):
    return _beliefs(spark, d).select("belief_id", "s", "kind")


@query("b07_fan_out", over("notes", "select belief_id, 'comment' as action, null::int as delta_days, false as needs_clarification from b union all select belief_id, 'change_date', case when doc_id % 3 = 0 then null else (doc_id % 200)::int end, coalesce(case when doc_id % 3 = 0 then null else doc_id % 200 end > 90, true) from b where kind in ('timeline_risk', 'timeline_pull_in') and doc_id % 7 <> 0", x=SENT, b=BEL))
def _(spark, d):
    i = F.col("doc_id")
    b = _beliefs(spark, d).withColumns({"refers_to_date": i % 7 != 0, "delta_days": F.when(i % 3 != 0, i % 200)})
    return it.fan_out(b)


@query("b08_scores", over("notes", "select belief_id, s, round(least(1.0, case when c < 0.6 then 0.3 else 0 end + case when imp = 'low' then 0.2 else 0 end + case when length(s) < 20 then 0.2 else 0 end + case when kind = 'timeline_uncertain' then 0.15 else 0 end), 6)::double as spam, round(least(1.0, (case imp when 'low' then 0.2 when 'high' then 0.8 when 'critical' then 1.0 else 0.5 end + c * 0.5 + 0.2) / 1.7), 6)::double as priority from (select *, (doc_id % 10) / 10 as c, (['low', 'medium', 'high', 'critical'])[doc_id % 4 + 1] as imp from b)", x=SENT, b=BEL))
def _(spark, d):
    c, imp = F.col("doc_id") % 10 / 10, fx.pick(["low", "medium", "high", "critical"], F.col("doc_id") % 4)
    return _beliefs(spark, d).select("belief_id", "s", it.spam_score(c, imp, F.col("s"), F.col("kind")).alias("spam"), it.priority_score(c, imp).alias("priority"))


@query("w07_priority_order", over("notes", "select belief_id, s, row_number() over (partition by initiative order by p desc, spam, s, belief_id) as place from (select *, doc_id // 20 as initiative, (doc_id % 10) as p, doc_id % 3 as spam from b)", x=SENT, b=BEL))
def _(spark, d):
    """The beliefs of each initiative in display order: the best priority first, less spam first among equals."""
    from pyspark.sql import Window

    i = F.col("doc_id")
    order = Window.partitionBy(F.floor(i / 20)).orderBy(F.desc(i % 10), i % 3, "s", "belief_id")
    return _beliefs(spark, d).select("belief_id", "s", F.row_number().over(order).alias("place"))


@query("m15_version_counts", over("suggestions", "select v as version, count(distinct note_id) as notes, count(*) as suggestions, round(count(*) / count(distinct note_id), 6) as per_note, round(count(*) filter (where status = 'applied') / count(*), 6) as acceptance_rate, count(*) filter (where clarification_state in ('suggested', 'requested')) as needs_clarification from (select *, 'v' || (note_version_at_creation % 2 + 1) as v from suggestions) group by 1"))
def _(spark, d):
    s = fx.suggestions(spark, d).withColumn("version", F.concat(F.lit("v"), (F.col("note_version_at_creation") % 2 + 1).cast("string")))
    n, notes = F.count(F.lit(1)), F.count_distinct("note_id")
    return s.groupBy("version").agg(notes.alias("notes"), n.alias("suggestions"), F.round(n / notes, 6).alias("per_note"), F.round(F.count_if(F.col("status") == "applied") / n, 6).alias("acceptance_rate"), F.count_if(F.col("clarification_state").isin("suggested", "requested")).alias("needs_clarification"))


FINGER = HASH.format(r"substr(trim(regexp_replace(regexp_replace(lower('idea::' || s || '::'), '\s+', ' ', 'g'), '[^A-Za-z0-9_ :]', '', 'g')), 1, 200)", 31, 0)


@query("u06_fingerprint_duplicates", over("notes", f"select h, count(*) as n from (select case when v >= 2147483648 then v - 4294967296 else v end as h from (select {FINGER} as v from x)) group by 1 having count(*) > 1", x=SENT))
def _(spark, d):
    """Fingerprints of several lines, as numbers: DuckDB has no base-36 text of negative ones."""
    f = tc.fingerprint(F.lit("idea"), F.col("s"), F.lit(""))
    number = F.conv(F.replace(f, F.lit("-"), F.lit("")), 36, 10).cast("bigint")
    h = F.when(F.startswith(f, F.lit("-")), -number).otherwise(number)
    return txt._lines(spark, d).groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_STRUCTURE = "select suggestion_id, note_id, case when k % 2 = 0 then 'mutation:' || coalesce(initiative_id, '') || ':' || coalesce(suggestion_family, '') || ':' || status else 'artifact:' || lower(trim(' Title ' || (u % 9) || ' ')) || ':' || coalesce(nullif(rule_or_prompt_id, ''), 'unknown') || ':' || coalesce(suggestion_family, '') end as structure_key, coalesce(model_confidence_score, 0.5)::double as confidence from (select *, substr(note_id, 2)::bigint as u, split_part(suggestion_id, '_', 2)::bigint as k from suggestions)"


def _structured(spark, d):
    u, k = F.substring("note_id", 2, 20).cast("bigint"), F.element_at(F.split("suggestion_id", "_"), 2).cast("bigint")
    return fx.suggestions(spark, d).select(
        "suggestion_id", "note_id", F.when(k % 2 == 0, "PLAN_MUTATION").otherwise("EXECUTION_ARTIFACT").alias("type"), F.col("initiative_id").alias("target_id"), F.col("suggestion_family").alias("change_type"), F.col("status").alias("after"),
        F.concat(F.lit(" Title "), (u % 9).cast("string"), F.lit(" ")).alias("title"), F.lit("").alias("owner_id"), F.col("rule_or_prompt_id").alias("owner_name"), F.col("suggestion_family").alias("artifact_kind"),
        F.coalesce("model_confidence_score", F.lit(0.5)).alias("confidence"), F.col("suggestion_id").alias("position"),
    )


@query("u05_best_by_structure", over("suggestions", "select structure_key, suggestion_id, confidence from (select *, row_number() over (partition by structure_key order by confidence desc, suggestion_id) as r from x) where r = 1", x=_STRUCTURE))
def _(spark, d):
    return cp.best_by_structure(_structured(spark, d)).select("structure_key", "suggestion_id", "confidence")


@query("k05_confident_capped", over("suggestions", "select note_id, suggestion_id, confidence, rank::int as rank from (select *, row_number() over (partition by note_id order by confidence desc, suggestion_id) as rank from x where confidence >= 0.5) where rank <= 3", x=_STRUCTURE))
def _(spark, d):
    return cp.confident(_structured(spark, d), 0.5, 3, ["note_id"]).select("note_id", "suggestion_id", "confidence", "rank")


@query("s01_typed_load", over("suggestion_events", "select event_id, event_type in ('generated', 'shown', 'applied', 'dismissed', 'clarification_requested', 'clarification_answered') and coalesce(dismiss_reason <> 'too_generic', true) as good from suggestion_events"))
def _(spark, d):
    """Rows with reasons outside a narrowed enum go to quarantine."""
    e = fx.suggestion_events(spark, d).withColumn("dismiss_reason", F.when(F.col("dismiss_reason") == "too_generic", "nonsense").otherwise(F.col("dismiss_reason")))
    good, bad = tables.checked(e, {"event_type": "event_type", "dismiss_reason": "dismiss_reason"})
    return good.select("event_id", F.lit(True).alias("good")).unionByName(bad.select("event_id", F.lit(False).alias("good")))


@query("s02_note_corpus", over("notes", "select note_id, md5(body) as h, created_at as authored_at, title from notes"))
def _(spark, d):
    return tables.note_corpus(fx.notes(spark, d)).select("note_id", F.md5("raw_markdown").alias("h"), "authored_at", "title")


@query("r04_state_view", over("initiative_events", fold_sql("initiative_id in (select 'i' || o_custkey from orders)")))
def _(spark, d):
    """The order table as a stream of changed initiatives; the view keeps their folded state."""
    from planlake.plans.streams import _Stream

    path = jobs.shared_folder(spark, f"view-{uuid.uuid4().hex}")
    changed = fx.table(_Stream(spark), d, "orders").select(F.concat(F.lit("i"), F.col("o_custkey").cast("string")).alias("initiative_id"))
    q = changed.writeStream.foreachBatch(jobs.state_view(fx.initiative_events(spark, d), path)).trigger(availableNow=True).option("checkpointLocation", path + "-log").start()
    q.awaitTermination()
    return jobs.current_view(spark, path).select("initiative_id", *SHOWN, "currentVersion")
