"""Queries over note corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.functions import lexicon as lx
from planlake.functions import textcols as tc
from planlake.functions.compat import djb2
from planlake.operators import corpus as cp
from planlake.operators import routing
from planlake.plans.fixture_sql import over
from planlake.plans.registry import query
from planlake.sources import fixtures as fx


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{_q(pattern)}', 'i')"


def any_of(c: str, patterns: list[str]) -> str:
    return "(" + " or ".join(has(c, p) for p in patterns) + ")"


TITLE = r"substr(trim(regexp_replace(regexp_replace(trim(lower({0})), '[^A-Za-z0-9_\s]', '', 'g'), '\s+', ' ', 'g')), 1, 120)"
HASH = "list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint), lambda h, c: (h * {1} + c) & 4294967295, {2}::bigint)"
#: Each line of the whole body that is not empty, without list marks.
LINES = "unnest(list_transform(list_filter(string_split(body, chr(10)), lambda x: x <> ''), lambda x: regexp_replace(x, '^- ', '')))"


def _lines(spark, d):
    """note_id and each line of the whole body that is not empty, without list marks."""
    lines = F.filter(F.split("body", "\n"), lambda x: x != "")
    return fx.notes(spark, d).select("note_id", "doc_id", F.explode(F.transform(lines, lambda x: F.regexp_replace(x, "^- ", ""))).alias("s"))


SENT = f"select note_id, doc_id, {LINES} as s from notes"


@query("t01_newlines", over("notes", r"select note_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '^(?:[ \t]*\n)+', ''), '\s+$', '')) as h from notes"))
def _(spark, d):
    return fx.notes(spark, d).select("note_id", F.md5(tc.normalised_newlines(F.col("body"))).alias("h"))


@query("t02_comparison_form", over("notes", r"select note_id, trim(regexp_replace(regexp_replace(lower(s), '\s+', ' ', 'g'), '[^A-Za-z0-9_ ]', '', 'g')) as form from x", x=SENT))
def _(spark, d):
    return _lines(spark, d).select("note_id", tc.comparison_form(F.col("s")).alias("form"))


@query("t03_suggestion_key", over("notes", f"select note_id, {TITLE.format('s')} as title_form, sha1(note_id || '|sec|idea|' || {TITLE.format('s')}) as suggestion_key from x", x=SENT))
def _(spark, d):
    return _lines(spark, d).select("note_id", tc.title_form(F.col("s")).alias("title_form"), tc.suggestion_key(F.col("note_id"), F.lit("sec"), F.lit("idea"), F.col("s")).alias("suggestion_key"))


NORM = r"substr(trim(regexp_replace(regexp_replace(lower('idea::' || s || '::' || note_id), '\s+', ' ', 'g'), '[^A-Za-z0-9_ :]', '', 'g')), 1, 200)"


@query("t04_fingerprint", over("notes", "select note_id, h from (select note_id, case when v >= 2147483648 then v - 4294967296 else v end as h from (select note_id, " + HASH.format(NORM, 31, 0) + " as v from x))", x=SENT))
def _(spark, d):
    """Held against SQL in base 10; DuckDB has no base-36 text of negative numbers."""
    f = tc.fingerprint(F.lit("idea"), F.col("s"), F.col("note_id"))
    number = F.conv(F.replace(f, F.lit("-"), F.lit("")), 36, 10).cast("bigint")
    return _lines(spark, d).select("note_id", F.when(F.startswith(f, F.lit("-")), -number).otherwise(number).alias("h"))


@query("t05_djb2", over("notes", f"select note_id, lpad(lower(to_hex({HASH.format('s', 33, 5381)})), 8, '0') as h from x", x=SENT))
def _(spark, d):
    return _lines(spark, d).select("note_id", djb2(F.col("s")).alias("h"))


RED = "s"
for _p, _l in lx.REDACTION:
    RED = f"regexp_replace({RED}, '{_p}', '{_l}', 'g')"


@query("t06_redaction", over("notes", f"select note_id, {RED} as redacted, case when length({RED}) <= 20 then {RED} else substr({RED}, 1, 20) || '…' end as preview from x", x=SENT))
def _(spark, d):
    return _lines(spark, d).select("note_id", tc.redacted(F.col("s")).alias("redacted"), tc.preview(F.col("s"), 20).alias("preview"))


#: Sentences of a text: cut after . ! ? and white space, but where one character of it and a lower-case letter follow.
SPLIT = r"string_split(regexp_replace(regexp_replace({0}, '([.!?])(\s+)', '\1' || chr(1) || '\2', 'g'), chr(1) || '(\s[a-z])', '\1', 'g'), chr(1))"


@query("t07_sentences", f"select doc_id, count(*) as n, sum(length(x))::bigint as chars from (select doc_id, trim(regexp_replace(regexp_replace(unnest({SPLIT.format('text')}), '^\\s+', ''), '\\s+$', '')) as x from documents) where x <> '' group by 1")
def _(spark, d):
    s = fx.table(spark, d, "documents").select("doc_id", F.explode(tc.sentences(F.col("text"))).alias("x"))
    s = s.withColumn("x", F.regexp_replace("x", r"^\s+|\s+$", ""))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("x")).alias("chars"))


@query("t08_bullet_sentences", r"select doc_id, count(*) as n, sum(length(x))::bigint as chars from (select doc_id, trim(unnest(string_split(y, chr(10)))) as x from (select doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as y from documents)) where x <> '' group by 1")
def _(spark, d):
    s = fx.table(spark, d, "documents").select("doc_id", F.explode(tc.bullet_sentences(F.col("text"))).alias("x"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("x")).alias("chars"))


@query("t10_line_types", over("notes", r"select kind, count(*) as n from (select case when t = '' then 'blank' when regexp_matches(t, '^#{1,6}\s') then 'heading' when regexp_matches(t, '^>\s') then 'quote' when regexp_matches(t, '^[-*+•]\s|^\d+[.)]\s') then 'list_item' else 'paragraph' end as kind from (select trim(unnest(string_split(body, chr(10)))) as t from notes)) group by 1"))
def _(spark, d):
    lines = fx.notes(spark, d).select(F.explode(F.split("body", "\n")).alias("line"))
    return lines.groupBy(tc.line_type(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("t11_structure", over("notes", f"select note_id, {has('b', lx.DATES)} as has_dates, {has('b', lx.METRICS)} as has_metrics, {has('b', lx.QUARTERS)} as has_quarter_refs, {has('b', lx.VERSIONS)} as has_version_refs, {has('b', lx.LAUNCH_WORDS)} as has_launch_keywords from (select note_id, lower(s) as b from x)", x=SENT))
def _(spark, d):
    c = tc.structure(F.col("s"))
    return _lines(spark, d).select("note_id", *(c[k].alias(k) for k in ("has_dates", "has_metrics", "has_quarter_refs", "has_version_refs", "has_launch_keywords")))


def _words(ws):
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


TOK = r"list_filter(string_split_regex(regexp_replace(lower(s), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > {0})"


@query("t12_generic", over("notes", f"select note_id, case when len(t) = 0 then 0 else len(list_filter(t, lambda w: list_contains({_words(lx.GENERIC)}, w))) / len(t) end as generic_ratio, len(list_distinct(list_filter(u, lambda w: not list_contains({_words([*lx.GENERIC, *lx.COMMON])}, w)))) as n_domain_nouns from (select note_id, {TOK.format(2)} as t, {TOK.format(3)} as u from x)", x=SENT))
def _(spark, d):
    return _lines(spark, d).select("note_id", tc.generic_ratio(F.col("s")).alias("generic_ratio"), F.size(tc.domain_nouns(F.col("s"))).alias("n_domain_nouns"))


SPEC = f"({has('h', lx.SPEC_HEADING)} or ({' + '.join(has('s', p) + '::int' for p in lx.SPEC_TOKENS)}) >= 2) and not {has('b', lx.SPEC_EXCLUSIONS)} and not {has('b', lx.CONCRETE_DELTA)} and not {has('b', lx.SCHEDULE_EVENT)}"


@query("t13_section_predicates", over("notes", f"select note_id, {has('s', lx.CONCRETE_DELTA)} as delta, {has('s', lx.SCHEDULE_EVENT)} as schedule, {SPEC} as spec from (select *, 'Scoring Framework' as h, 'Scoring Framework ' || s as b from x)", x=SENT))
def _(spark, d):
    s = F.col("s")
    return _lines(spark, d).select("note_id", tc.concrete_delta(s).alias("delta"), tc.schedule_event(s).alias("schedule"), tc.spec_section(s, F.lit("Scoring Framework")).alias("spec"))


NOISE = f"({any_of('s', lx.NOISE)} and not {any_of('s', lx.OWNERSHIP)})"


@query("t14_process_noise", over("notes", f"select note_id, {NOISE} as noise from x", x=SENT))
def _(spark, d):
    return _lines(spark, d).select("note_id", tc.process_noise(F.col("s")).alias("noise"))


@query("t18_durations", over("notes", r"select note_id, try_cast(regexp_extract(s, '(?i)\b(\d+)[\s-]*(day|week|month|quarter)s?\b', 1) as bigint) * case lower(regexp_extract(s, '(?i)\b(\d+)[\s-]*(day|week|month|quarter)s?\b', 2)) when 'day' then 1 when 'week' then 7 when 'month' then 30 when 'quarter' then 90 end as days from x", x=SENT))
def _(spark, d):
    return _lines(spark, d).select("note_id", tc.duration_days(F.col("s")).alias("days"))


@query("t19_jaccard", over("notes", f"select note_id, len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) as similarity from (select note_id, {TOK.format(2)} as t, {TOK.format(3)} as u from x) where len(t) > 0", x=SENT))
def _(spark, d):
    s = F.col("s")
    # a line has such a word where the pattern of one is found, which ends at the first
    return _lines(spark, d).where(F.lower(s).rlike("[a-z0-9]{3}")).select("note_id", tc.jaccard(tc.tokens(s, 2), tc.tokens(s, 3)).alias("similarity"))


@query("t20_cosine", "select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as similarity from embeddings")
def _(spark, d):
    v = fx.table(spark, d, "embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("first"))  # one row
    return v.crossJoin(F.broadcast(one)).select("vec_id", F.round(tc.cosine(F.col("embedding"), F.col("first")), 6).alias("similarity"))


DEMAND = f"{has('s', lx.EXTERNAL_ACTORS)} and {has('s', lx.DESIRE_VERBS)}"
PLAN = f"{has('s', lx.TIME_MILESTONE)} and {has('s', lx.SHIFT_VERBS)} and not {has('s', lx.PLAN_CONDITIONAL)}"
DIRECT = f"({has('s', lx.ACTIONABLE_CONDITIONAL)} or ({has('s', lx.RISK_CONDITIONAL)} and {has('s', lx.CONSEQUENCES)}))"
TOPIC = f"({has('s', lx.RISK_TOKENS)} and not ({has('s', lx.SHIFT_VERBS)} and {has('s', lx.TIME_UNITS)}) and not {has('s', lx.FEATURE_ASK)})"
RISK = f"not {has('trim(s)', lx.SUBJECTIVE_CONCERN)} and ({DIRECT} or {TOPIC})"
BUG = f"{has('s', lx.BUG_TOKENS)} and not {has('s', lx.BUG_CONDITIONAL)}"
SIGNALS = f"""select note_id, s as sentence, 'FEATURE_DEMAND' as signal, case when {has('s', lx.AMPLIFIERS)} then 0.75 else 0.65 end as confidence from x where {DEMAND}
 union all select note_id, s, 'PLAN_CHANGE', 0.75 from x where {PLAN}
 union all select note_id, s, 'SCOPE_RISK', case when not {DIRECT} and {has('s', lx.PII)} and {has('s', lx.PII_PARTNERS)} then 0.85 else 0.7 end from x where {RISK}
 union all select note_id, s, 'BUG', 0.7 from x where {BUG}"""


@query("c03_signals", over("notes", SIGNALS, x=SENT))
def _(spark, d):
    return _lines(spark, d).select("note_id", F.col("s").alias("sentence"), F.explode(tc.signals(F.col("s"))).alias("x")).select("note_id", "sentence", "x.signal", "x.confidence")


SECTION = r"""select note_id, heading_text, num_lines, num_list_items from (select note_id, regexp_replace(string_split(part, chr(10))[1], '^## ', '') as heading_text, len(string_split(part, chr(10))) - 1 as num_lines,
 len(list_filter(string_split(part, chr(10)), lambda x: x like '- %')) as num_list_items from (select note_id, '## ' || string_split(body, chr(10) || chr(10) || '## ')[-1] as part from notes))"""


@query("c01_last_sections", over("notes", SECTION))
def _(spark, d):
    """The section that each note ends with: those before it need the sequential helper and are held by unit tests."""
    s = cp.sections(fx.notes(spark, d))
    last = s.groupBy("note_id").agg(F.max_by(F.struct("heading_text", "num_lines", "num_list_items"), "ordinal").alias("s"))
    leaf = F.trim(F.element_at(F.split("s.heading_text", ">"), -1))
    return last.select("note_id", leaf.alias("heading_text"), "s.num_lines", "s.num_list_items")


@query("c08_candidates")
def _(spark, d):
    return cp.candidates(fx.notes(spark, d))


@query("c17_note_suggestions")
def _(spark, d):
    return cp.suggestions_of(fx.notes(spark, d))


LABEL = "case signal when 'FEATURE_DEMAND' then 'idea' when 'PLAN_CHANGE' then 'project_update' when 'SCOPE_RISK' then 'risk' else 'bug' end"


def _signals(spark, d):
    s = _lines(spark, d).select("note_id", F.col("s").alias("sentence"), F.explode(tc.signals(F.col("s"))).alias("x"))
    return s.select("note_id", "sentence", "x.signal", "x.label", "x.confidence", F.col("note_id").alias("section_id"), F.hash("sentence").alias("sentence_index"))


@query("m21_threshold_sweep", over("notes", "select threshold, n, case when p > 0 then round((p - n) * 100.0 / p, 6) else 0.0 end as drop_pct from (select threshold, n, lag(n) over (order by threshold) as p from (select t as threshold, count(*) filter (where confidence >= t) as n from g, (select unnest([0.5, 0.7, 0.72, 0.8]::double[]) as t) group by 1))", x=SENT, g=SIGNALS))
def _(spark, d):
    return cp.threshold_sweep(_signals(spark, d), [0.5, 0.7, 0.72, 0.8])


@query("m22_label_counts", over("notes", f"select {LABEL} as label, 'emitted' as stage, count(*) as n from g group by 1", x=SENT, g=SIGNALS))
def _(spark, d):
    return cp.drop_report(_signals(spark, d).withColumn("drop_reason", F.lit(None).cast("string")))


@query("m20_evaluation", over("notes", "select count(*) as notes, sum(n)::bigint as suggestions, round(avg(n), 6) as mean_per_note, round(count(*) filter (where n = 0) * 100.0 / count(*), 6) as zero_pct, round(sum(c) / sum(n), 6) as mean_confidence from (select note_id, coalesce(n, 0) as n, c from notes left join (select note_id, count(*) as n, sum(confidence)::double as c from g group by 1) using (note_id))", x=SENT, g=SIGNALS))
def _(spark, d):
    return cp.evaluation(fx.notes(spark, d), _signals(spark, d))


@query("w04_buckets", over("notes", f"select note_id, {LABEL} as bucket, least(count(*), 2) as shown, greatest(count(*) - 2, 0) as hidden from g group by 1, 2", x=SENT, g=SIGNALS))
def _(spark, d):
    b = cp.buckets(_signals(spark, d), 2)
    return b.groupBy("note_id", "bucket").agg(F.count(F.lit(1)).alias("shown"), F.max("hidden").alias("hidden"))


TF = r"select {0}, token, count(*) as tf from (select {0}, unnest(list_filter(string_split_regex(regexp_replace(lower({1}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 3)) as token from {2}) group by 1, 2"
ROUTE = f"""select item_id, coalesce(similarity, 0) as similarity, case when similarity >= 0.8 then 'attach' else 'create_new' end as route, case when similarity >= 0.8 then initiative_id end as initiative_id from (select note_id as item_id from notes) left join
 (select item_id, round(dot / (na * nb), 6) as similarity, initiative_id, row_number() over (partition by item_id order by round(dot / (na * nb), 6) desc, initiative_id) as r from dots join (select item_id, sqrt(sum(tf * tf)) as na from a group by 1) using (item_id) join (select initiative_id, sqrt(sum(tf * tf)) as nb from b group by 1) using (initiative_id)) s using (item_id) where coalesce(r, 1) = 1"""
_ROUTE = dict(a=TF.format("item_id", "text", "(select note_id as item_id, body as text from notes)"), b=TF.format("initiative_id", "title || ' ' || description", "initiatives"), dots="select item_id, initiative_id, sum(a.tf * b.tf) as dot from a join b using (token) group by 1, 2")


def _routed(spark, d):
    items = fx.notes(spark, d).select(F.col("note_id").alias("item_id"), F.col("body").alias("text"))
    return routing.route(items, fx.initiatives(spark, d))


@query("j10_token_routing", over("initiatives", ROUTE, **_ROUTE))
def _(spark, d):
    return _routed(spark, d)


@query("m19_route_stats", over("initiatives", f"select count(*) filter (where route = 'attach') as attached, count(*) filter (where route = 'create_new') as create_new, round(avg(similarity), 6) as mean_similarity from ({ROUTE})", **_ROUTE))
def _(spark, d):
    return cp.route_stats(_routed(spark, d))


ND = "select x.id as new_id, y.id as open_id, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) as similarity from w x join w y on x.block = y.block and x.id <> y.id where len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.8"


@query("u07_near_duplicates", rf"with w as (select item_id as id, item_id % 4 as block, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> '')) as w from (select item_id, text from benchmark union all select item_id + 100000, text || ' extra' from benchmark)) {ND}")
def _(spark, d):
    """Benchmark items, each with a copy of one word more."""
    b = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    b = b.unionByName(b.select((F.col("id") + 100000).alias("id"), F.concat("text", F.lit(" extra")).alias("text")))
    b = b.withColumn("block", F.col("id") % 4)
    return cp.near_duplicates(b, b)


@query("m26_centroids", "select label, pos, round(avg(v), 6) as mean from (select label, unnest(range(0, len(embedding))) as pos, unnest(embedding)::double as v from embeddings) group by 1, 2")
def _(spark, d):
    c = cp.centroids(fx.table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("mean"))


@query("j11_vector_routing", "with c as (select label as candidate, list(m order by pos) as centroid from (select label, pos, avg(v) as m from (select label, unnest(range(0, len(embedding))) as pos, unnest(embedding)::double as v from embeddings) group by 1, 2) group by 1) select vec_id, similarity, candidate, case when similarity >= 0.3 then 'attach' else 'create_new' end as route from (select vec_id, candidate, round(list_cosine_similarity(embedding::double[], centroid), 6) as similarity, row_number() over (partition by vec_id order by round(list_cosine_similarity(embedding::double[], centroid), 6) desc, candidate) as r from embeddings, c) where r = 1")
def _(spark, d):
    v = fx.table(spark, d, "embeddings")
    return cp.nearest_centroid(v, cp.centroids(v, "label", "embedding"), "vec_id", "embedding", "label", 0.3)
