"""Intent of sections: what a section asks for, scored by sentence and rolled up."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from planlake.functions import lexicon as lx
from planlake.functions import textcols as tc


def starts(words: list[str]) -> str:
    """A pattern of places where one of the words can begin; most places fail at the first letter."""
    return f"(?=[{''.join(sorted({w[0] for w in words}))}])(?<![A-Za-z0-9_])"


def _phrases(phrases: list[str]) -> str:
    """Any phrase as a substring."""
    return "|".join(re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", p) for p in phrases)


def _words(words: list[str]) -> str:
    """Any of the words, all of which begin and end with a letter."""
    return rf"\b(?:{'|'.join(words)})\b"


def _markers(markers: list[str]) -> str:
    """Markers of several words as substrings, single ones as words."""
    many, one = [m for m in markers if " " in m], [m for m in markers if " " not in m]
    return "|".join([_phrases(many)] * bool(many) + [_words(one)] * bool(one))


# Found in Arrow arrays of plain lines or sentences, which are in lower case.
_SPACE = r"[ \t\n\x0b\f\r]"
_REQUESTS = [("request to", _words(lx.ACTION_VERBS))] + [(p, f"{_words(lx.ACTION_VERBS)}|{_words(lx.PRODUCT_NOUNS)}") for p in ("requests a ", "requests an ", "requests for ", "requests that ")]
_OF_LINE = {"calendar": _markers(lx.CALENDAR), "communication": _markers(lx.COMMUNICATION), "micro": _markers(lx.MICRO_TASKS)}
_OF_SENTENCE = {
    "verb": _words(lx.ACTION_VERBS), "first_verb": rf"^(?:{'|'.join(lx.ACTION_VERBS)})\b", "request": _phrases(lx.REQUEST_STEMS), "change": _phrases(lx.CHANGE_OPERATORS), "status": _phrases(lx.STATUS_MARKERS),
    "task": _phrases(lx.TASK_MARKERS), "role": _phrases(lx.ROLES), "decision": _phrases(lx.DECISIONS), "pm": _phrases(lx.PM_REQUESTS), "hedge": _phrases(lx.HEDGED), "noun": _phrases(lx.PRODUCT_NOUNS), "negated": _phrases(lx.NEGATIONS),
}


def _plain(lines: pa.Array) -> pa.Array:
    """Lines in lower case: without list mark, single spaces, straight quotes."""
    for curly, straight in zip("‘’“”", "''\"\"", strict=True):
        lines = pc.replace_substring(lines, curly, straight)
    lines = pc.utf8_trim(lines, " ")
    for pattern, by in ((f"^{_SPACE}*[-*+•]{_SPACE}+", ""), (rf"^{_SPACE}*\d+[.)]{_SPACE}+", ""), (f"{_SPACE}+", " ")):
        lines = pc.replace_substring_regex(lines, pattern, by)
    return lines


def _found(x: pa.Array, patterns: dict[str, str]) -> dict[str, np.ndarray]:
    return {k: np.asarray(pc.fill_null(pc.match_substring_regex(x, p), False)) for k, p in patterns.items()}


def _scored_lines(x: pa.Array) -> dict[str, np.ndarray]:
    f = _found(x, _OF_LINE)
    return f | {"oos": np.where(f["calendar"] | f["communication"], 0.6, np.where(f["micro"], 0.4, 0.0))}


def _scored_sentences(x: pa.Array) -> dict[str, np.ndarray]:
    f = _found(x, _OF_SENTENCE)
    for p, after in _REQUESTS:
        at = np.flatnonzero(pc.fill_null(pc.match_substring(x, p), False))
        if len(at):
            rest = pc.replace_substring_regex(x.take(pa.array(at)), f"(?s)^.*{p}", "")
            f["pm"] = f["pm"].copy()
            f["pm"][at] |= np.asarray(pc.match_substring_regex(rest, after))
    kinds = ((f["request"] & f["verb"], 1.0), (f["first_verb"], 0.9), (f["change"], 0.8), (f["status"], 0.7), (f["task"], 0.8), (f["role"], 0.85), (f["decision"], 0.7), (f["pm"], 0.76))
    plain = reduce(np.maximum, (np.where(c, v, 0.0) for c, v in kinds))
    hedged = np.maximum(plain, np.where(f["hedge"], 0.9, 0.0))
    score = np.where(f["negated"] & f["verb"], 0.0, np.minimum(1.0, hedged + np.where((hedged >= 0.6) & f["noun"], 0.2, 0.0)))
    return {"score": score, "plain": plain} | {k: f[k] for k in ("change", "task", "role", "decision")}


def _pieces(texts: pa.Array, row: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of texts between line ends that have five letters, and their rows."""
    lists = pc.split_pattern(texts, "\n")
    row, x = row[np.asarray(pc.list_parent_indices(lists))], pc.list_flatten(lists)
    return x, row


def _long(x: pa.Array, row: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    keep = pc.greater_equal(pc.utf8_length(x), 5)
    return x.filter(keep), row[np.asarray(keep)]


def _most(found: dict[str, np.ndarray], row: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """The greatest value of each row; 0 or false without any."""
    out = {k: np.zeros(n, v.dtype) for k, v in found.items()}
    for k, v in found.items():
        np.maximum.at(out[k], row, v)
    return out


_LINE = {"score": "double", "oos": "double"}
_SECTION = {"oos": "double", "calendar": "boolean", "communication": "boolean", "micro": "boolean", "score": "double", "plain": "double", "change": "boolean", "task": "boolean", "role": "boolean", "decision": "boolean"}
_type = lambda fields: StructType([StructField(k, DoubleType() if t == "double" else BooleanType()) for k, t in fields.items()])
_struct = lambda found, fields: pa.StructArray.from_arrays([pa.array(found[k]) for k in fields], list(fields))


@F.arrow_udf(_type(_LINE))
def _line_scores(lines: pa.Array) -> pa.Array:
    x = _plain(lines)
    return _struct(_scored_sentences(x) | _scored_lines(x), _LINE)


@F.arrow_udf(_type(_SECTION))
def _section_scores(texts: pa.Array) -> pa.Array:
    n = len(texts)
    x, row = _pieces(pc.fill_null(texts, ""), np.arange(n))
    lines, row = _long(_plain(x), row)
    # white space is single spaces here, so a sentence ends where one follows a stop
    sents, of = _long(*_pieces(pc.replace_substring_regex(lines, "([.!?]) ", "\\1\n"), row))
    return _struct(_most(_scored_lines(lines), row, n) | _most(_scored_sentences(sents), of, n), _SECTION)


def line_scores(line: Column) -> Column:
    """score and oos (out of scope) of a line taken as one sentence."""
    return _line_scores(F.lower(line))


def section_intent(sections: DataFrame, *keep: str) -> DataFrame:
    """section_id, six scores and the flags behind them, from each section's lines and sentences in whole Arrow batches, without a shuffle;
    and the columns to keep.

    Implicit ideas without any marker are not scored.
    """
    low = sections.withColumn("low", F.lower("raw_text"))
    verbs = F.array_distinct(F.regexp_extract_all("low", F.lit(rf"{starts(lx.ACTIONABILITY_VERBS)}({'|'.join(lx.ACTIONABILITY_VERBS)})(?=\s+[A-Za-z0-9_])"), F.lit(1)))
    s = low.select("section_id", "num_lines", *(c for c in keep if c not in ("section_id", "num_lines")), (F.size(verbs) >= 2).alias("many_verbs"), _section_scores("low").alias("x"))
    s = s.select(*(c for c in s.columns if c != "x"), *(F.col("x")[k].alias(k) for k in _SECTION))
    lift = F.col("many_verbs") & (F.col("oos") < 0.4)
    s = s.withColumns({"score": F.when(lift, F.greatest("score", F.lit(0.8))).otherwise(F.col("score")), "plain": F.when(lift, F.greatest("plain", F.lit(0.8))).otherwise(F.col("plain"))})
    calm = F.col("change") | F.col("many_verbs") | ((F.col("plain") >= 0.8) & (F.col("num_lines") >= 5))
    s = s.withColumn("oos", F.when(calm, F.least(F.lit(0.3), F.col("oos"))).otherwise(F.col("oos")))
    planned = F.col("change") | F.col("task") | F.col("decision") | F.col("role")
    zero = lambda flag: F.when(flag, F.col("oos")).otherwise(0.0)
    r = lambda c: F.round(c, 6)
    return s.select(
        "section_id", *(c for c in keep if c != "section_id"), r(F.when(planned, F.col("score")).otherwise(F.col("score") * 0.4)).alias("plan_change"), r(F.when(planned, F.col("score") * 0.4).otherwise(F.col("score"))).alias("new_workstream"),
        r(F.greatest(F.lit(0.0), F.lit(0.5) - F.col("score") + F.col("oos") * 0.3)).alias("status_informational"), zero(F.col("calendar")).alias("calendar"), zero(F.col("communication")).alias("communication"), zero(F.col("micro")).alias("micro_tasks"),
        F.col("role").alias("force_role"), F.col("decision").alias("force_decision"),
    )


def actionability(intent: DataFrame, at_least: float = 0.5, dominance: float = 0.75, gap: float = 0.2) -> DataFrame:
    """Whether a section goes on, and why. A leading plan change always does; strong out-of-scope scores stop a section."""
    act, oos = F.greatest("plan_change", "new_workstream"), F.greatest("calendar", "communication", "micro_tasks")
    top = F.greatest("plan_change", "new_workstream", "status_informational", "calendar", "communication", "micro_tasks")
    reason = (
        F.when(F.col("plan_change") == top, "plan_change").when((oos >= dominance) & (oos - act >= gap), "out_of_scope").when(act >= at_least, "actionable").otherwise("below_threshold")
    )
    return intent.withColumns({"reason": reason, "actionable": reason.isin("plan_change", "actionable")}).withColumn("type_label", F.when(F.col("plan_change") > F.col("new_workstream"), "project_update").otherwise("idea"))


def blended(model: DataFrame, rules: DataFrame, names: list[str]) -> DataFrame:
    """Model scores (section_id, confidence, names) and rule scores, weighted by the model's confidence: at most 0.8, none below 0.3."""
    m = model.select("section_id", "confidence", *(F.col(n).alias(f"m_{n}") for n in names))
    j = rules.join(m, "section_id", "left")
    w = F.when(F.coalesce("confidence", F.lit(0.0)) < 0.3, 0.0).otherwise(F.least(F.lit(0.8), F.col("confidence")))
    mix = lambda n: F.when(w > 0, F.col(f"m_{n}") * w + F.col(n) * (F.lit(1.0) - w)).otherwise(F.col(n))
    return j.select("section_id", *(F.round(mix(n), 6).alias(n) for n in names))


def modality(c: Column) -> Column:
    """From -1 (speculative) to 1 (assertive)."""
    hits = lambda ps: sum((tc.has(c, p).cast("int") for p in ps), F.lit(0))
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), hits(lx.ASSERTIVE) * 0.4 - hits(lx.SPECULATIVE) * 0.5)), 6)


def ranking_delta(c: Column) -> Column:
    v = lambda p, x: F.when(tc.has(c, p), x).otherwise(0.0)
    return F.round(v(lx.ARTIFACTS, 0.15) + v(lx.BUILD_VERBS, 0.1) - v(lx.MARKETING, 0.15), 6)


def idea_tokens(c: Column) -> Column:
    """total and passes."""
    n = lambda low, ws: F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(f"{starts(ws)}({'|'.join(ws)})(?![A-Za-z0-9_])"), F.lit(1))))
    named = lambda low: F.struct(n(low, lx.STRATEGY).alias("s"), n(low, lx.MECHANISMS).alias("m"), sum((F.contains(low, F.lit(x)).cast("int") for x in lx.CONSTRUCTS), F.lit(0)).alias("c"))
    total = lambda t: t["s"] + t["m"] + t["c"] * 2
    passes = lambda t: (total(t) >= 2) & ((t["s"] > 0) | (t["c"] > 0)) & ((t["m"] > 0) | (t["c"] > 0))
    return tc.let(tc.let(F.lower(c), named), lambda t: F.struct(total(t).alias("total"), passes(t).alias("passes")))


def semantic_ideas(sections: DataFrame) -> DataFrame:
    """Sections that name a strategy and a mechanism, each with its best sentence (the first of equals)."""
    c = idea_tokens(F.col("raw_text"))
    s = sections.where(c["passes"]).select("section_id", F.posexplode(F.split("raw_text", r"(?<=[.!?])\s+|\n")).alias("i", "sentence")).where(F.char_length(F.trim("sentence")) >= 10)
    best = F.max_by(F.trim("sentence"), F.struct(idea_tokens(F.col("sentence"))["total"].alias("n"), -F.col("i")))
    return s.groupBy("section_id").agg(best.alias("sentence"))


def dense_paragraphs(sections: DataFrame) -> DataFrame:
    """Sections without bullets that are one line or at least 250 letters, and have no topic anchors."""
    anchors = F.exists(F.transform(F.split("raw_text", "\n"), lambda x: F.lower(F.trim(x))), lambda x: sum_any([F.startswith(x, F.lit(a)) for a in lx.TOPIC_ANCHORS]))
    return sections.where((F.col("num_list_items") == 0) & ((F.col("num_lines") <= 1) | (F.char_length("raw_text") >= 250)) & ~anchors)


def sum_any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def structural_ideas(sections: DataFrame, covered: DataFrame) -> DataFrame:
    """Uncovered sections with at least three bullets and 150 letters and no date movement; their first four bullets."""
    s = sections.where((F.col("heading_level") <= 3) & (F.col("num_list_items") >= 3) & (F.char_length("raw_text") >= 150) & ~tc.concrete_delta(F.col("raw_text")))
    bullets = F.filter(F.split("raw_text", "\n"), lambda x: F.trim(x).rlike(r"^[-*+•]\s|^\d+[.)]\s"))
    return s.join(covered.select("section_id").distinct(), "section_id", "left_anti").select("section_id", "heading_text", F.array_join(F.slice(bullets, 1, 4), "\n").alias("evidence"))


def topic_parts(sections: DataFrame) -> DataFrame:
    """Sections split at lines that start with a topic anchor."""
    from pyspark.sql import Window

    lines = sections.select("section_id", F.posexplode(F.split("raw_text", "\n")).alias("i", "line"))
    starts = sum_any([F.startswith(F.lower(F.trim("line")), F.lit(a)) for a in lx.TOPIC_ANCHORS]).cast("int")
    lines = lines.withColumn("part", F.sum(starts).over(Window.partitionBy("section_id").orderBy("i")))
    return lines.groupBy("section_id", "part").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "line")))["line"], "\n").alias("text")).where(F.trim("text") != "")


def guarded(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Fresh suggestions without those whose fingerprint was dismissed, unless the note has changed since."""
    changed = (F.coalesce("note_version_at_creation", F.lit(0)) != 0) & (F.col("note_version_at_creation") != F.col("note_updated_at"))
    notes = existing.groupBy("note_id").agg(F.max(changed).alias("changed"))
    gone = existing.where("status = 'dismissed' and fingerprint is not null").join(notes.where("not changed"), "note_id", "left_semi")
    return fresh.join(gone.select("note_id", "fingerprint").distinct(), ["note_id", "fingerprint"], "left_anti")


def initiative_details(initiatives: DataFrame, suggestions: DataFrame, notes: DataFrame) -> DataFrame:
    """Linked suggestions of each initiative with the title or a preview of their notes."""
    preview = F.concat(F.substring("body", 1, 200), F.when(F.char_length("body") > 200, "...").otherwise(""))
    s = suggestions.where("initiative_id is not null").join(notes.select("note_id", F.col("title").alias("note_title"), preview.alias("note_preview")), "note_id", "left")
    return initiatives.select("initiative_id", "title").join(s.select("initiative_id", "suggestion_id", "note_id", "note_title", "note_preview"), "initiative_id", "left")


def implication(summary: Column, dimension: Column, likelihood: Column, positive: Column, dated: Column) -> Column:
    """Kind of a belief: bands of the likelihood first, patterns then. dated: a date or a delta is mentioned."""
    hit = lambda ps: tc.any_of(F.lower(summary), ps)
    return (
        F.when(dimension != "timeline", "pure_commentary").when(likelihood < 0.4, "timeline_risk").when((likelihood > 0.8) & positive, "timeline_pull_in")
        .when(likelihood.between(0.4, 0.6), "timeline_uncertain").when(hit(lx.TIMELINE_UNCERTAIN), "timeline_uncertain").when(hit(lx.TIMELINE_PULL_IN), "timeline_pull_in")
        .when(hit(lx.TIMELINE_RISK), "timeline_risk").when(dated, "timeline_risk").otherwise("pure_commentary")
    )


def fan_out(beliefs: DataFrame) -> DataFrame:
    """One comment for each belief, and a date change where a timeline risk or pull-in refers to a date. Over 90 days needs a question."""
    comment = F.struct(F.lit("comment").alias("action"), F.lit(None).cast("int").alias("delta_days"), F.lit(False).alias("needs_clarification"))
    moves = F.col("kind").isin("timeline_risk", "timeline_pull_in") & F.col("refers_to_date")
    change = F.struct(F.lit("change_date").alias("action"), F.col("delta_days").cast("int").alias("delta_days"), F.coalesce(F.abs("delta_days") > 90, F.lit(True)).alias("needs_clarification"))
    return beliefs.select("belief_id", F.explode(F.array_compact(F.array(comment, F.when(moves, change)))).alias("x")).select("belief_id", "x.*")


def spam_score(conf: Column, impact: Column, summary: Column, kind: Column) -> Column:
    v = lambda cond, x: F.when(cond, x).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), v(conf < 0.6, 0.3) + v(impact == "low", 0.2) + v(F.char_length(summary) < 20, 0.2) + v(kind == "timeline_uncertain", 0.15)), 6)


def priority_score(conf: Column, impact: Column) -> Column:
    level = F.when(impact == "low", 0.2).when(impact == "high", 0.8).when(impact == "critical", 1.0).otherwise(0.5)
    return F.round(F.least(F.lit(1.0), (level + conf * 0.5 + 0.2) / 1.7), 6)
