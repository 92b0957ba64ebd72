"""Meetings to utterances, belief threads, beliefs and decisions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from planlake.functions import lexicon as lx
from planlake.functions import textcols as tc


def utterances(meetings: DataFrame) -> DataFrame:
    """Sentences of each meeting in order."""
    lines = F.transform(F.split("raw_markdown", "\n"), lambda x: tc.sentences(x))
    return meetings.select("meeting_id", F.posexplode(F.flatten(lines)).alias("utterance_index", "text"))


def _word(alternatives: str) -> str:
    return rf"\b({alternatives})\b"


def _subject(text: Column, before: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, tc.java(rf"\b([A-Za-z0-9_\s]{{2,30}}?)\s+({before})", False), 1)), F.lit(""))


def classified(utts: DataFrame) -> DataFrame:
    """label, dimension, change_role, subject_handle and local_confidence. The last dimension that matches wins; a later match
    replaces the subject only where its own pattern finds one."""
    t = F.lower("text")
    hit = [tc.has(t, _word(words)) for _, words, _, _, _ in lx.DIMENSIONS]
    last_first = list(zip(lx.DIMENSIONS, hit, strict=True))[::-1]
    pick = lambda k: F.coalesce(*(F.when(h, F.lit(d[k])) for d, h in last_first))
    dimension, label, conf = pick(0), pick(3), pick(4)
    subject = F.coalesce(*(F.when(h, _subject(t, d[2])) for d, h in last_first))
    other = dimension.isNull() & tc.has(t, _word(lx.OTHER_CHANGE))
    u = utts.withColumns({"dimension": F.when(other, "other").otherwise(dimension), "label": F.when(other, "plan_change").otherwise(F.coalesce(label, F.lit("noise"))), "conf": F.when(other, 0.5).otherwise(F.coalesce(conf, F.lit(0.3))), "subject": subject, "other": other})
    change = (F.col("label") == "plan_change") & ~F.col("other")
    role = F.when(change & tc.has(t, _word(lx.BEFORE)), "before").when(change & tc.has(t, _word(lx.AFTER)), "after").otherwise("none")
    opening = F.nullif(F.trim(F.regexp_extract(t, r"^(the |a |an )?([A-Za-z0-9_\s]{3,40}?)(\s+is|\s+was|\s+will|\s+should)", 2)), F.lit(""))
    handle = F.when(F.col("label") == "noise", None).otherwise(F.coalesce("subject", F.when(F.col("label") == "plan_change", opening)))
    u = u.withColumns({"change_role": role, "handle": handle})
    return u.select(
        "meeting_id", "utterance_index", "text", "label", "dimension", "change_role", F.regexp_replace("handle", r"^(the|a|an)\s+", "").alias("subject_handle"),
        F.round(F.least(F.col("conf") + F.when(F.col("change_role") != "none", 0.1).otherwise(0.0), F.lit(1.0)), 6).alias("local_confidence"),
    )


def _leaders(texts: list[str | None], at_least: float) -> list[int]:
    """Greedy groups in order: a text joins the first group whose first text is alike by its words."""
    heads: list[set[str]] = []
    own = []
    for text in texts:
        words = set((text or "").split())
        at = next((i for i, h in enumerate(heads) if (h or words) and len(h & words) / len(h | words) >= at_least), None)
        if at is None:
            at = len(heads)
            heads.append(words)
        own.append(at)
    return own


@F.arrow_udf(ArrayType(IntegerType()))
def _groups(texts: pa.Array, at_least: pa.Array) -> pa.Array:
    return pa.array([_leaders(x, k) for x, k in zip(texts.to_pylist(), at_least.to_pylist(), strict=True)], pa.list_(pa.int32()))


@F.arrow_udf(ArrayType(IntegerType()))
def _lower_groups(texts: pa.Array, at_least: pa.Array) -> pa.Array:
    return pa.array([_leaders([t.lower() for t in x], k) for x, k in zip(texts.to_pylist(), at_least.to_pylist(), strict=True)], pa.list_(pa.int32()))


def _grouped(rows: DataFrame, order: list[Column], text: str, groups, at_least: float, name: str) -> DataFrame:
    """Rows with the group of their text within their (meeting, dimension), which is one row on the way, so that many small ones share a batch."""
    g = rows.groupBy("meeting_id", "dimension").agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*(c for c in rows.columns if c not in ("meeting_id", "dimension"))).alias("x"))))["x"].alias("x"))
    g = g.withColumn("own", groups(F.col("x")[text], F.lit(at_least)))
    return g.select("meeting_id", "dimension", F.explode(F.arrays_zip("x", "own")).alias("z")).select("meeting_id", "dimension", "z.x.*", F.col("z.own").alias(name))


def threads(classes: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Greedy threads of a (meeting, dimension): an utterance joins the first thread whose first handle is alike."""
    rows = classes.where("label = 'plan_change'").select("meeting_id", "dimension", "utterance_index", "change_role", "subject_handle", "local_confidence", "text")
    return _grouped(rows, [F.col("utterance_index")], "subject_handle", _groups, at_least, "thread")


def beliefs(threaded: DataFrame) -> DataFrame:
    """One belief for each thread: commonest handle (the first seen of equals), states from spans by role, source type, score."""
    of = lambda role: F.array_sort(F.collect_list(F.when(F.col("change_role") == role, F.struct("utterance_index", "text"))))["text"]
    key = ["meeting_id", "dimension", "thread"]
    g = threaded.groupBy(*key).agg(F.count(F.lit(1)).alias("n_spans"), F.max("local_confidence").alias("candidate_score"), of("before").alias("before"), of("after").alias("after"), of("none").alias("supporting"), F.min("utterance_index").alias("first_index"))
    handles = threaded.where("subject_handle is not null").groupBy(*key, "subject_handle").agg(F.count(F.lit(1)).alias("n"), F.min("utterance_index").alias("at"))
    best = handles.groupBy(*key).agg(F.max_by("subject_handle", F.struct("n", -F.col("at"))).alias("subject_handle"))
    b = g.join(best, key, "left").withColumn("subject_handle", F.coalesce("subject_handle", F.lit("unspecified")))
    none = F.size("before") == 0
    before = F.when(none, F.concat(F.lit("Previous plan for "), "subject_handle", F.lit(" (unspecified in this meeting)"))).otherwise(F.array_join("before", " "))
    after = F.when(F.size("after") > 0, F.array_join("after", " ")).when(F.size("supporting") > 0, F.array_join("supporting", " ")).otherwise(F.concat(F.lit("Updated plan for "), "subject_handle", F.lit(" (details unclear)")))
    source = F.when(~none & (F.size("after") > 0), "explicit").when(none & (F.size("after") > 0), "external").otherwise("implicit")
    return b.withColumns({"before_state": before, "after_state": after, "source_type": source, "n_before": F.size("before"), "n_after": F.size("after")}).drop("before", "after", "supporting")


def with_confidence(b: DataFrame) -> DataFrame:
    weight = F.when(F.col("source_type") == "explicit", 1.0).when(F.col("source_type") == "implicit", 0.7).otherwise(0.4)
    bonus = 0.1 * ((F.col("n_before") > 0).cast("int") + (F.col("n_after") > 0).cast("int"))
    score = F.col("candidate_score") * weight + 0.1 * F.least(F.log(F.col("n_spans") + 1.0), F.lit(3.0)) + bonus
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)
    b = b.withColumn("confidence_score", score)
    band = F.when(F.col("confidence_score") >= 0.75, "high").otherwise("uncertain")
    low = (F.col("confidence_score") < 0.75) & (F.col("confidence_score") <= 0.6)
    reasons = F.array_compact(F.array(F.when(low, F.lit("low_model_confidence")), F.when(F.col("source_type") == "external", F.lit("depends_on_external_context"))))
    return b.withColumns({"confidence_band": band, "clarification_reasons": F.array_join(reasons, ","), "needs_clarification": F.size(reasons) > 0})


def mapped_initiative(scores: Column, at_least: float = 0.7, gap: float = 0.2) -> Column:
    """The best id of a map of match scores, if it is good and clearly ahead of the second."""
    top = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("id"))))
    first, second = F.get(top, F.lit(0)), F.get(top, F.lit(1))
    sure = (-first["s"] >= at_least) & (second["s"].isNull() | (second["s"] - first["s"] >= gap))
    return F.when(sure, first["id"])


def clusters(b: DataFrame, at_least: float = 0.7) -> DataFrame:
    """Greedy leader clusters of a (meeting, dimension) by word-Jaccard of the new states; the highest score leads."""
    rows = b.select("meeting_id", "dimension", "thread", "after_state", "confidence_score")
    return _grouped(rows, [-F.col("confidence_score"), F.col("thread")], "after_state", _lower_groups, at_least, "cluster").select("meeting_id", "dimension", "thread", "cluster")


def decisions(b: DataFrame) -> DataFrame:
    """One row for each belief but pure status: action, clarification below 0.85, and whether it can be executed."""
    d = b.where("dimension <> 'status'")
    action = F.when(F.col("dimension") == "timeline", "change_date").when(F.col("dimension") == "risk", "flag_risk").otherwise("comment")
    ask = (F.col("confidence_score") < 0.85) | F.col("needs_clarification")
    return d.select("meeting_id", "dimension", "thread", "confidence_score", action.alias("action"), ask.alias("needs_clarification"), (~ask).alias("executable"))


def invariants(b: DataFrame, d: DataFrame) -> DataFrame:
    """Beliefs, decisions, and beliefs that should have a decision and have none."""
    key = ["meeting_id", "dimension", "thread"]
    lost = b.where("dimension <> 'status'").join(d.select(*key), key, "left_anti").agg(F.count(F.lit(1)).alias("undecided"))
    return b.agg(F.count(F.lit(1)).alias("beliefs")).crossJoin(d.agg(F.count(F.lit(1)).alias("decisions"))).crossJoin(lost)  # 1-row tables


def capped_suggestions(d: DataFrame, limits: dict[str, int], other: int = 5) -> DataFrame:
    """At most so many suggestions of an action for an initiative in a meeting, best priority first; the rest merges into the first one.

    d: meeting_id, initiative_id (null: unscoped), action, suggestion_id, priority, body, belief_ids, spans. Each merged row brings its
    beliefs and spans, 0.05 of priority up to 1, and marks a comment's body as ongoing, unless that says that it is of several meetings.
    """
    from pyspark.sql import Window

    key = ["meeting_id", "initiative_id", "action"]
    d = d.withColumn("initiative_id", F.coalesce("initiative_id", F.lit("unscoped")))
    most = F.lit(other)
    for a, n in limits.items():
        most = F.when(F.col("action") == a, n).otherwise(most)
    r = d.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("priority"), "suggestion_id")))
    over = r.where(F.col("rank") > most).groupBy(*key).agg(
        F.count(F.lit(1)).alias("merged"), F.array_sort(F.collect_list(F.struct("rank", "belief_ids", "spans"))).alias("o")
    )
    over = over.withColumn("rank", F.lit(1)).select(*key, "rank", "merged", F.flatten("o.belief_ids").alias("more_ids"), F.flatten("o.spans").alias("more_spans"))
    out = r.where(F.col("rank") <= most).join(over, [*key, "rank"], "left").fillna(0, ["merged"])
    joined = lambda own, more: F.when(F.col("merged") > 0, F.array_distinct(F.concat(own, more))).otherwise(F.col(own))
    ongoing = (F.col("action") == "comment") & ~F.contains("body", F.lit("Multiple meetings"))
    return out.withColumns(
        {
            "belief_ids": joined("belief_ids", "more_ids"),
            "spans": joined("spans", "more_spans"),
            "priority": F.when(F.col("merged") > 0, F.least(F.lit(1.0), F.col("priority") + F.col("merged") * 0.05)).otherwise(F.col("priority")),
            "body": F.when(ongoing, F.concat(F.repeat(F.lit("Ongoing: "), F.col("merged").cast("int")), "body")).otherwise(F.col("body")),
        }
    ).drop("more_ids", "more_spans")


def feedback_stats(fb: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    share = lambda a: F.round(F.count_if(F.col("action") == a) / n, 6)
    return fb.agg(n.alias("total"), share("accepted").alias("accept_rate"), share("dismissed").alias("dismiss_rate"), share("edited").alias("edit_rate"), F.round(F.avg("time_to_action_seconds"), 6).alias("mean_seconds"))


def feedback_by_status(fb: DataFrame, suggestions: DataFrame) -> DataFrame:
    s = suggestions.select("suggestion_id", "clarification_state")
    return fb.join(s, "suggestion_id").groupBy("clarification_state").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("action") == "accepted") / F.count(F.lit(1)), 6).alias("accept_rate"))


def spam_tokens(fb: DataFrame, texts: DataFrame, min_docs: int = 3, min_count: int = 2) -> DataFrame:
    """Words of at least four letters in texts dismissed as spam. texts: suggestion_id, text."""
    spam = texts.join(fb.where("action = 'dismissed' and dismiss_reason = 'spam'").select("suggestion_id").distinct(), "suggestion_id", "left_semi")
    docs = spam.agg(F.count(F.lit(1)).alias("docs"))
    t = spam.select(F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.char_length(w) >= 4))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return t.crossJoin(docs).where((F.col("docs") >= min_docs) & (F.col("n") >= min_count)).select("token", "n", F.round(F.least(F.lit(0.9), F.col("n") / F.col("docs")), 6).alias("confidence"))


def quick_accepts(fb: DataFrame, seconds: int = 60, least: int = 3) -> DataFrame:
    """How many suggestions were accepted quickly, and whether that is a signal."""
    return fb.where((F.col("action") == "accepted") & (F.col("time_to_action_seconds") <= seconds)).agg(F.count(F.lit(1)).alias("quick")).withColumn("signal", F.col("quick") >= least)


#: The reasons that are counted, and the thresholds at the start.
REASONS = ["wrong_initiative", "not_real_decision", "too_ambiguous", "wrong_value", "spam", "duplicate", "other"]
THRESHOLDS = {"min_initiative_match_score": 0.7, "min_match_gap": 0.2, "ambiguous_match_threshold": 0.4, "min_belief_confidence": 0.6, "max_comment_suggestions_per_initiative_per_meeting": 3.0}


def feedback_breakdown(fb: DataFrame, suggestions: DataFrame, by: list[str]) -> DataFrame:
    """Rates per suggestion, by action, by status, and reasons of dismissal for each value of `by`. suggestions: suggestion_id, action, status.

    Events are counted by suggestion first, so facts are never joined with facts. Rates without suggestions are 0.
    """
    hit = lambda a: F.col("event_action") == a
    e = fb.withColumnRenamed("action", "event_action").groupBy("suggestion_id").agg(
        *(F.count_if(hit(a)).alias(a) for a in ("accepted", "dismissed", "edited")), F.sum("time_to_action_seconds").alias("seconds"), F.count("time_to_action_seconds").alias("timed"),
        *(F.count_if(hit("dismissed") & (F.col("dismiss_reason") == r)).alias(r) for r in REASONS),
    )
    s = suggestions.select("suggestion_id", "action", "status", *by).join(e, "suggestion_id", "left").fillna(0)
    share = lambda part, whole: F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))
    n = F.count(F.lit(1))
    within = lambda c, v: share(F.sum(F.when(F.col(c) == v, F.col("accepted")).otherwise(0)), F.count_if(F.col(c) == v))
    return s.groupBy(*by).agg(
        n.alias("total_suggestions"), *(F.sum(a).alias(f"total_{a}") for a in ("accepted", "dismissed", "edited")),
        share(F.sum("accepted"), n).alias("acceptance_rate"), share(F.sum("dismissed"), n).alias("dismissal_rate"), share(F.sum("edited"), n).alias("edit_rate"),
        share(F.sum("seconds"), F.sum("timed")).alias("mean_seconds"),
        within("action", "comment").alias("comment_acceptance_rate"), within("action", "mutate_release_date").alias("release_date_acceptance_rate"),
        within("status", "suggested").alias("suggested_acceptance_rate"), within("status", "needs_clarification").alias("needs_clarification_acceptance_rate"),
        *(F.sum(r).alias(r) for r in REASONS),
    )


def recommendations(stats: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """A row for each threshold that a rule wants changed: its place in order, current and recommended value, confidence. thresholds: one row."""
    c = F.col
    s = stats.crossJoin(F.broadcast(thresholds.limit(1)))
    many = c("total_suggestions") >= 20
    of_dismissed = lambda reason, part: c(reason) > c("total_dismissed") * part
    match = (c("dismissal_rate") > 0.4) & of_dismissed("wrong_initiative", 0.3)
    parity = (c("needs_clarification_acceptance_rate") > 0) & (F.abs(c("needs_clarification_acceptance_rate") - c("suggested_acceptance_rate")) < 0.1)
    up = lambda name, step, most: F.least(F.lit(most), c(name) + step)
    down = lambda name, step, least: F.greatest(F.lit(least), c(name) - step)
    rules = [
        (match, "min_initiative_match_score", up("min_initiative_match_score", 0.05, 0.85), 0.8),
        (match, "min_match_gap", up("min_match_gap", 0.05, 0.3), 0.7),
        ((c("dismissal_rate") > 0.4) & of_dismissed("too_ambiguous", 0.3), "min_belief_confidence", up("min_belief_confidence", 0.05, 0.75), 0.75),
        (of_dismissed("spam", 0.2), "max_comment_suggestions_per_initiative_per_meeting", down("max_comment_suggestions_per_initiative_per_meeting", 1.0, 1.0), 0.65),
        ((c("acceptance_rate") > 0.8) & many, "min_belief_confidence", down("min_belief_confidence", 0.05, 0.5), 0.6),
        (parity & many, "ambiguous_match_threshold", down("ambiguous_match_threshold", 0.05, 0.3), 0.55),
    ]
    rows = [
        F.when(test, F.struct(F.lit(i).alias("place"), F.lit(name).alias("threshold"), c(name).alias("current_value"), F.round(to, 6).alias("recommended_value"), F.lit(sure).alias("confidence")))
        for i, (test, name, to, sure) in enumerate(rules, 1)
    ]
    return s.select(*by, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(*by, "r.*")


def adjusted(recommended: DataFrame, by: list[str], at_least: float = 0.6) -> DataFrame:
    """The new value of each threshold: of the recommendations that are sure enough the last one counts."""
    sure = recommended.where(F.col("confidence") >= at_least)
    return sure.groupBy(*by, "threshold").agg(F.max_by("recommended_value", "place").alias("new_value"))
