"""Scores of candidates and what they decide, as columns over a candidate and its section."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from planlake.functions import lexicon as lx
from planlake.functions import textcols as tc
from planlake.operators import intent as it

# Thresholds, and the actionability that marks an implicit idea.
OVERALL_MIN = 0.65
SECTION_MIN = 0.6
IMPLICIT = 0.61
#: Sources that score their candidates themselves where the section is not actionable.
OWN_SCORES = ("idea-semantic", "structural-idea-bypass")
KEPT_TYPES = ("project_update", "bug", "risk")
_OWNER = r"\b(owner|lead|responsible)\s*:\s*\w+"
_DATE = r"\b(by|due|deadline)\s*:\s*\d+"


def decided(rules: list[tuple[Column, Column | str]], otherwise: Column | None = None) -> Column:
    """An ordered decision table: the value of the first rule that holds."""
    out = otherwise if otherwise is not None else F.lit(None)
    for when, value in reversed(rules):
        out = F.when(when, value).otherwise(out)
    return out


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _add(when: Column, value: float) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), value).otherwise(0.0)


def actionability() -> Column:
    act = F.greatest("plan_change", "new_workstream")
    other = F.greatest("communication", "research", "calendar", "micro_tasks")
    dated = F.col("has_quarter_refs") | F.col("has_version_refs")
    return _unit(act - other * 0.3 + _add(dated, 0.1) + _add(F.col("has_launch_keywords"), 0.15) - _add(F.col("num_lines") <= 2, 0.15))


def type_confidence() -> Column:
    margin, most = F.abs(F.col("plan_change") - F.col("new_workstream")), F.greatest("plan_change", "new_workstream")
    return _unit(F.lit(0.5) + margin * 0.5 - _add(most < 0.3, 0.2) - _add(margin < 0.1, 0.15) + _add((most > 0.7) & (margin > 0.3), 0.1))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.char_length(w) > 3)


@F.arrow_udf(IntegerType())
def held(own: pa.Array, source: pa.Array) -> pa.Array:
    """How many of the words in the array `own` (each as often as it stands there) the array `source` holds."""
    both = pa.concat_arrays([pc.list_flatten(own), pc.list_flatten(source)]).dictionary_encode()
    row = np.concatenate([np.asarray(pc.list_parent_indices(own)), np.asarray(pc.list_parent_indices(source))]).astype(np.int64)
    key = row * (len(both.dictionary) + 1) + np.asarray(both.indices)
    n = len(key) - int(np.sum(np.asarray(pc.fill_null(pc.list_value_length(source), 0))))
    return pa.array(np.bincount(row[:n][np.isin(key[:n], key[n:])], minlength=len(own)).astype(np.int32))


def coverage(own: Column, source: Column) -> Column:
    """The share of the words in the array `own` (each counted as often as it stands there) that the array `source` holds."""
    return F.when(F.size(own) > 0, held(own, source) / F.size(own)).otherwise(0.0)


def section_coverage(candidates: DataFrame, sections: DataFrame, key: list[str]) -> DataFrame:
    """key and in_section: the share of a candidate's words that stand in its section.

    Words of candidates meet the distinct words of sections by (section, word), so neither is held against all of the other.
    """
    own = candidates.select(*key, F.explode(said_words()).alias("word")).groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"))
    there = sections.select("section_id", F.explode(F.array_distinct(words(F.col("raw_text")))).alias("word"), F.lit(True).alias("there"))
    return own.join(there, ["section_id", "word"], "left").groupBy(*key).agg((F.sum(F.when(F.col("there"), F.col("n")).otherwise(0)) / F.sum("n")).alias("in_section"))


def said() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))


def said_words() -> Column:
    return words(said())


def synthesis() -> Column:
    """How far title and description rest on the section and the evidence."""
    in_evidence = coverage(F.col("own"), words(F.coalesce("evidence", F.lit(""))))
    overlap = F.when(F.col("in_section") > 0.5, 0.15).when(F.col("in_section") < 0.2, -0.2).otherwise(0.0)
    made_up = lambda p, there: tc.has(F.col("said"), p) & ~F.col(there)
    return _unit(F.lit(0.7) + overlap - _add(made_up(_OWNER, "names_owner"), 0.1) - _add(made_up(_DATE, "names_date"), 0.1) - _add(in_evidence < 0.2, 0.15))


def overall(a: Column, t: Column, s: Column) -> Column:
    return F.when(F.abs(a - IMPLICIT) < 0.001, a * 0.5 + t * 0.25 + s * 0.25).otherwise(F.least(a, t, s))


def section_flags(sections: DataFrame) -> DataFrame:
    """Adds what a section's text says, found once a section."""
    x = sections.withColumn("low", F.lower("raw_text")).withColumn("flat", F.replace("low", F.lit("\n"), F.lit(" ")))
    of_flat = (("has_quarter_refs", lx.QUARTERS), ("has_version_refs", lx.VERSIONS), ("has_launch_keywords", lx.LAUNCH_WORDS))
    return x.withColumns({c: tc.has(F.col(t), p) for t, pairs in (("flat", of_flat), ("low", (("names_owner", _OWNER), ("names_date", _DATE)))) for c, p in pairs}).drop("low", "flat")


def scored(candidates: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds the scores, whether a candidate goes on, and why not.

    A candidate has section_id, position, type, source, title, description, evidence, v3_failed, drop_reason and own_score; a
    section the six intents with research, num_lines, raw_text and is_actionable.
    """
    of_section = section_flags(sections).select(
        "section_id", "plan_change", "new_workstream", "communication", "research", "calendar", "micro_tasks", "num_lines", "is_actionable",
        "has_quarter_refs", "has_version_refs", "has_launch_keywords", "names_owner", "names_date",
    )
    key = ["section_id", "position"]
    return scored_rows(candidates.join(of_section, "section_id").join(section_coverage(candidates, sections, key), key, "left").fillna(0.0, ["in_section"]))


def scored_rows(candidates: DataFrame) -> DataFrame:
    """The scores of candidates that have the columns of their section, its flags and in_section beside their own; no shuffle.

    Only ideas of sections that are not actionable can be dropped. A badge asks for clarification where a candidate goes on
    though its evidence failed or a reason to drop it is known.
    """
    own = ~F.col("is_actionable") & F.col("source").isin(*OWN_SCORES)
    r = lambda c: F.round(c, 6)
    c = candidates.withColumn("said", said()).withColumn("own", words(F.col("said"))).withColumns({
        "section_actionability": r(F.when(own, F.col("own_score")).otherwise(actionability())),
        "type_choice_confidence": r(F.when(own, F.col("own_score")).otherwise(type_confidence())),
        "synthesis_confidence": r(F.when(own, F.col("own_score")).otherwise(synthesis())),
    }).drop("said", "own")
    c = c.withColumn("overall", r(F.when(own, F.col("own_score")).otherwise(overall(F.col("section_actionability"), F.col("type_choice_confidence"), F.col("synthesis_confidence")))))
    safe = F.col("is_actionable") | F.col("type").isin(*KEPT_TYPES)
    low_overall, low_section = F.col("overall") < OVERALL_MIN, F.col("section_actionability") < SECTION_MIN
    reason = decided([(safe, F.lit(None).cast("string")), (low_overall, "overall"), (low_section, "section_actionability")])
    badge = safe & (F.coalesce("v3_failed", F.lit(False)) | F.col("drop_reason").isNotNull())
    why = F.array_compact(F.array(F.when(low_section, "low_actionability_score"), F.when(low_overall, "low_overall_score")))
    c = c.withColumns({"threshold_reason": reason, "is_high_confidence": ~low_overall & ~low_section, "needs_clarification": badge, "clarification_reasons": F.when(badge, why).otherwise(F.array().cast("array<string>"))})
    return c.withColumn("ranking_score", r(F.col("overall") + it.ranking_delta(F.coalesce("evidence", F.lit("")))))
