"""Queries over candidates put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.operators import assemble as asm
from planlake.operators import corpus as cp
from planlake.plans import txt
from planlake.plans.fixture_sql import over
from planlake.plans.registry import query
from planlake.plans.txt import LABEL, SENT, SIGNALS
from planlake.sources import fixtures as fx


def _sections(spark, d):
    return cp.sections(fx.notes(spark, d))


def _signals(spark, d):
    return txt._signals(spark, d).withColumn("section_id", F.col("note_id"))


@query("u01_u02_coverage", over("notes", f"select note_id, sentence, label, source_order from (select *, row_number() over (partition by note_id, sentence, label = 'risk' order by source_order, label) as nth, max(label = 'project_update') over (partition by note_id, sentence) as upd from (select note_id, sentence, {LABEL} as label, case when confidence >= 0.75 then 0 else 1 end as source_order from g)) where nth = 1 and not (label = 'risk' and upd)", x=SENT, g=SIGNALS))
def _(spark, d):
    s = _signals(spark, d).select("note_id", "section_id", "sentence", "label", "confidence")
    c = asm.in_order(s.where("confidence >= 0.75"), s.where("confidence < 0.75"))
    return asm.uncovered(c).select("note_id", "sentence", "label", "source_order")


@query("u03_best_signals", over("notes", f"select note_id, sentence, {LABEL} as label, max(confidence) as confidence from g group by 1, 2, 3", x=SENT, g=SIGNALS))
def _(spark, d):
    return cp.best_signals(_signals(spark, d)).select("note_id", "sentence", "label", "confidence")


@query("u08_derivative_sections")
def _(spark, d):
    s = _sections(spark, d)
    ev = cp.signal_rows(cp.sentence_rows(s)).join(s.select("section_id", "ordinal"), "section_id")
    return asm.derivative(s, ev)


@query("u09_same_decisions", over("notes", r"select a.note_id, a.i as first, b.i as second from f a join f b on a.note_id = b.note_id and a.i < b.i where a.form <> '' and b.form <> '' and (a.form = b.form or (length(a.form) >= 15 and contains(b.form, a.form)) or (length(b.form) >= 15 and contains(a.form, b.form)))",
    f=r"select note_id, i, trim(regexp_replace(regexp_replace(lower(line), '\s+', ' ', 'g'), '[^A-Za-z0-9_ ]', '', 'g')) as form from (select note_id, unnest(string_split(body, chr(10))) as line, unnest(range(0, len(string_split(body, chr(10))))) as i from notes)"))
def _(spark, d):
    return asm.same_decisions(fx.notes(spark, d))


@query("u10_consolidated")
def _(spark, d):
    s = _sections(spark, d).withColumns({"num_list_items": F.lit(3), "heading_level": F.lit(2)})
    sig = cp.signal_rows(cp.sentence_rows(_sections(spark, d))).withColumn("label", F.lit("idea"))
    return asm.consolidated(sig, s)


@query("c18_evidence_spans", over("notes", r"select note_id as section_id, min(i) as start_line, max(i) as end_line, string_agg(line, chr(10) order by i) as text from (select *, row_number() over (partition by note_id order by i) as nth from (select note_id, unnest(string_split(body, chr(10))) as line, unnest(range(0, len(string_split(body, chr(10))))) as i from notes) where line like '- %') where nth <= 3 group by 1"))
def _(spark, d):
    from planlake.functions import textcols as tc

    lines = fx.notes(spark, d).select(F.col("note_id").alias("section_id"), F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    return asm.evidence_spans(lines.withColumn("line_type", tc.line_type(F.col("line")))).select("section_id", "start_line", "end_line", "text")


@query("t16_display_titles", over("notes", r"select note_id, case when length(t) <= 30 then t else regexp_replace(substr(t, 1, 29), '\s+\S*$', '') || '…' end as title from (select note_id, upper(substr(c, 1, 1)) || substr(c, 2) as t from (select note_id, regexp_replace(regexp_replace(trim('Idea: ' || s), '(?i)^(new idea|idea|project update|update|risk|bug)\s*:\s*', ''), '[.!?]+$', '') as c from x))", x=SENT))
def _(spark, d):
    return txt._lines(spark, d).select("note_id", asm.display_title(F.concat(F.lit("Idea: "), "s"), 30).alias("title"))


@query("k03_capped", over("notes", f"select note_id, least(count(*), 2) as shown, count(*) > 2 as trimmed from g group by 1", x=SENT, g=SIGNALS))
def _(spark, d):
    return cp.capped(_signals(spark, d), 2).groupBy("note_id").agg(F.count(F.lit(1)).alias("shown"), F.max("trimmed").alias("trimmed"))
