"""Planning tables derived from the given tables by plain expressions, the same ones that the SQL side uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DISMISS_REASONS = ["not_relevant", "incorrect_or_low_quality", "too_risky_or_disruptive", "already_done_or_in_progress", "needs_more_clarification", "wrong_scope_or_target", "too_generic", "other"]
STATUSES = ["draft", "proposed", "approved", "in_progress", "blocked", "released", "completed", "cancelled", "archived"]
HEADINGS = ["Roadmap", "Next Steps", "Scoring Framework", "Implementation Timeline", "Discussion", "Security Considerations", "Upload Automation", "Summary"]
SENTENCES = [
    "Users need a faster export command.",
    "We are delaying the launch by 3 weeks.",
    "If we don't fix login the release is at risk.",
    "The sync job is failing with a timeout error.",
    "Add inline alerts to the dashboard.",
    "Please send the recap email on Friday.",
    "PM to document the rollout plan.",
    "It was decided to revisit pricing.",
    "Who owns the final sign-off is unclear.",
    "We should introduce a scoring system and automate parsing.",
    "PII appears in logging output for user IDs.",
    "Move the beta from Q2 to Q3.",
    "Do not add new fields to the API.",
    "The workflow is confusing and slow.",
    "Contact ana@example.com or 555-123-4567.",
    "Status is on track and work is in progress.",
]
#: What lines of `minutes` are put between, by a hash of the line; of the first few lines only the beginning is taken.
CUT_TO = 24
PLANTED = [
    ("# ", ""), ("## ", ":"), ("1. ", ""), ("", ""), ("## General\n", ""), ("Timeline: ", ""), ("Phase 2 ", ""), ("#### Goals\n\n", ""),
    ("- ", "\n- and another one"), ("```\n", "\n```"), ("~~~\n", "\n~~~"), ("> ", ""), ("\n\n", "\n"), ("* ", "\n\n  2. deeper\n3. third"), ("  1. ", ""), ("• ", ""),
    *((f"{x} ", "") for x in SENTENCES),
    ("", " Can you add a cache for the schema? Owner: ana"), ("Users struggle with ", ""), ("We should build an integration, due: 12, for ", ""), ("", " was moved to Q3 and version 2.1."), ("Send the email about ", " next week."),
    ("", " We will launch the dashboard."), ("Maybe we could explore ", ""), ("Introduce a scoring system to automate ", "."), ("", " The release is delayed by 2 weeks, lead: bo."), ("Fix typo in ", ""), ("- [ ] update ", ""), ("PM to verify ", "."),
    ("We agreed to create an initiative for ", ", see INI-1"), ("", " as INI-2 and INI-3 say; Ana will own it"), ("INI-2 is now top priority, and bo will lead ", ""), ("Maybe we will start a project for ", " INI-4"),
    ("INI-1: cut the scope of ", ", the checklist for launch is done"), ("Team decided to build ", ""), ("File a ticket to track ", " by end of Q3, INI-5"), ("Initiative: ", " "), ("Requirement to implement ", " by spring"), ("Request to add ", ". Risk that we need the rest"), ("The team asks for ", ". We should discuss it with all"), ("This will require ", ". If we delay it, we should remove the rest"), ("", ""), ("", ""),
]
BELIEF_SENTENCES = [
    "The mobile release deadline was March.",
    "The mobile release deadline will be moving to May.",
    "The billing feature is now in scope.",
    "Search owner will be the platform team.",
    "The export is blocked by legal.",
    "Checkout status is on track.",
    "We agreed the pricing decision is final.",
    "Maybe the sync risk is unclear.",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], i):
    """values[i] for a column i from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def suggestion_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    n, user, k = F.col("event_id"), F.col("user_id"), F.col("k")
    kind = (
        F.when(F.col("event_type") == "signup", "generated")
        .when(F.col("event_type") == "view", "shown")
        .when(F.col("event_type") == "purchase", "applied")
        .when(F.col("event_type") == "error", "dismissed")
        .when(n % 3 == 0, "clarification_answered")
        .otherwise("clarification_requested")
    )
    s = lambda c: c.cast("string")
    return e.withColumn("kind", kind).select(
        "event_id",
        F.concat(F.lit("n"), s(user)).alias("note_id"),
        F.concat(F.lit("s"), s(user), F.lit("_"), s(k % 7)).alias("suggestion_id"),
        F.col("kind").alias("event_type"),
        F.col("ts").alias("created_at"),
        F.when(user % 5 != 0, F.concat(F.lit("t"), s(user % 5))).alias("team_id"),
        F.when(n % 4 == 0, None).when(n % 97 == 0, "").otherwise(F.concat(F.lit("surface"), s(n % 4))).alias("ui_surface"),
        F.when(k % 5 == 1, "idea").when(k % 5 == 2, "project_update").when(k % 5 == 3, "risk").when(k % 5 == 4, "bug").alias("suggestion_family"),
        F.when(k % 11 != 0, F.concat(F.lit("rule"), s(k % 20))).alias("rule_or_prompt_id"),
        F.when(n % 17 == 0, True).when(n % 17 == 1, False).alias("exclude_from_metrics"),
        F.when((F.col("kind") == "dismissed") & (n % 9 != 0), pick(DISMISS_REASONS, F.greatest(n % 9 - 1, F.lit(0)))).alias("dismiss_reason"),
        F.when((F.col("kind") == "applied") & (n % 2 == 0), F.col("value")).alias("self_reported_time_saved_minutes"),
        F.when(F.col("kind").isin("applied", "dismissed") & (n % 5 != 0), n % 600).alias("time_to_event_seconds"),
    )


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = suggestion_events(spark, sf_dir)
    at = F.struct("created_at", "event_id")
    done = F.col("event_type").isin("applied", "dismissed")
    g = e.groupBy("suggestion_id", "note_id").agg(
        F.min("created_at").alias("created_at"),
        F.max_by(F.when(done, F.col("event_type")), F.when(done, at)).alias("status"),
        F.min_by("rule_or_prompt_id", at).alias("rule_or_prompt_id"),
        F.min_by("suggestion_family", at).alias("suggestion_family"),
        F.min("event_id").alias("m"),
    )
    m, user = F.col("m"), F.substring("note_id", 2, 20).cast("bigint")
    return g.select(
        "suggestion_id",
        "note_id",
        "created_at",
        F.coalesce("status", F.lit("new")).alias("status"),
        "rule_or_prompt_id",
        "suggestion_family",
        F.when(m % 6 == 0, None).when(m % 6 == 1, 0.0).otherwise((m % 100) / 100.0).alias("model_confidence_score"),
        pick(["none", "suggested", "requested", "answered"], m % 4).alias("clarification_state"),
        (m % 10 == 0).alias("regenerated"),
        F.when(user % 23 == 0, True).alias("invalidated_by_note_deletion"),
        F.when((F.col("status") == "applied") & (user % 3 != 0), F.concat(F.lit("i"), (user % 12).cast("string"))).alias("initiative_id"),
        (m % 3).alias("note_version_at_creation"),
        (user % 3).alias("note_updated_at"),
    )


def event_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note for each user of the event log."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    user = F.col("user_id")
    return u.select(
        F.concat(F.lit("n"), user.cast("string")).alias("note_id"),
        F.when(user % 2 == 1, F.concat(F.lit("Note "), user.cast("string"))).alias("title"),
        F.concat(F.lit("Notes of the weekly planning meeting of group "), user.cast("string")).alias("body"),
        F.expr("timestampadd(DAY, cast(user_id % 30 as int), timestamp'2024-01-01 00:00:00')").alias("created_at"),
        F.when(user % 29 == 0, True).alias("is_deleted"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    body = F.concat(
        F.col("text"), F.lit("\n\n## "), pick(HEADINGS, i % 8), F.lit("\n"), pick(SENTENCES, i % 16),
        F.lit("\n- "), pick(SENTENCES, (i + 5) % 16), F.lit("\n- "), pick(SENTENCES, (i + 9) % 16),
    )
    return d.select(
        F.concat(F.lit("d"), i.cast("string")).alias("note_id"),
        F.when(i % 2 != 0, F.substring("text", 1, 40)).alias("title"),
        body.alias("body"),
        F.expr("timestampadd(DAY, cast(doc_id % 30 as int), timestamp'2024-01-01 00:00:00')").alias("created_at"),
        F.when(i % 29 == 0, True).alias("is_deleted"),
        "doc_id",
    )


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose running text holds headings, lists, fences and the phrases of rules, between and within its own lines."""

    def line(x, i):
        h = ((F.col("doc_id") * 7 + i * 13 + F.char_length(x)) % len(PLANTED)).cast("int")
        part = F.when(h < 8, F.substring(x, 1, CUT_TO)).otherwise(x)
        return F.concat(pick([a for a, _ in PLANTED], h), part, pick([b for _, b in PLANTED], h))

    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("note_id"), body.alias("body"), "doc_id")


def minute_initiatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each fiftieth document, with the beginning of its text as title, of one to forty characters."""
    i = F.col("doc_id")
    title = F.expr("substring(text, 1, cast(1 + doc_id div 50 * 7 % 40 as int))")
    return table(spark, sf_dir, "documents").where(i % 50 == 0).select(F.concat(F.lit("INI-"), F.expr("doc_id div 50 + 1").cast("string")).alias("initiative_id"), title.alias("title"))


def initiatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each fiftieth note."""
    n = notes(spark, sf_dir).where("doc_id % 50 = 0")
    return n.select(
        F.concat(F.lit("i"), (F.col("doc_id") / 50 + 1).cast("bigint").cast("string")).alias("initiative_id"),
        F.substring("body", 1, 40).alias("title"),
        F.col("body").alias("description"),
        pick(["draft", "active", "done"], F.col("doc_id") % 3).alias("status"),
        "created_at",
    )


def initiative_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("bigint")
    s = lambda c: c.cast("string")
    kind = (
        F.when(F.col("sequence") == 1, "InitiativeCreated").when(key % 6 < 2, "InitiativeFieldUpdated").when(key % 6 == 2, "InitiativeStatusChanged")
        .when(key % 6 == 3, "ReleaseDateChanged").when(key % 6 == 4, "SuggestionApplied").otherwise("InitiativeCommentAdded")
    )
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    payload = (
        F.when(F.col("type") == "InitiativeCreated", F.concat(F.lit('{"slug":"s'), s(cust), F.lit('","title":"Title '), s(cust), F.lit('","description":"About '), s(cust), F.lit('","status":"draft"}')))
        .when(F.col("type") == "InitiativeFieldUpdated", F.concat(F.lit('{"field":"'), pick(["title", "priority", "scope"], key % 3), F.lit('","oldValue":null,"newValue":'),
              F.when(key % 13 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))), F.lit("}")))
        .when(F.col("type") == "InitiativeStatusChanged", F.concat(F.lit('{"newStatus":"'), pick(STATUSES, key % 9), F.lit('"}')))
        .when(F.col("type") == "ReleaseDateChanged", F.concat(F.lit('{"dateType":"'), pick(["target", "windowStart", "windowEnd"], key % 3), F.lit('","newDate":'), F.when(key % 5 == 0, F.lit("null")).otherwise(s(ms)), F.lit("}")))
        .otherwise(F.lit("{}"))
    )
    return (
        o.withColumn("sequence", seq)
        .withColumn("type", kind)
        .select(
            F.concat(F.lit("i"), s(cust)).alias("initiative_id"),
            "sequence",
            "type",
            payload.alias("payload"),
            F.col("o_orderdate").cast("timestamp").alias("occurred_at"),
            F.when(key % 7 != 0, F.col("o_orderpriority")).alias("actor_user_id"),
            F.lit("ui").alias("origin"),
            F.concat(F.lit("c"), s(key)).alias("command_id"),
            F.concat(F.lit("w"), s(cust)).alias("correlation_id"),
            F.when(F.col("type") == "SuggestionApplied", F.concat(F.lit("is"), s(key))).alias("suggestion_id"),
            key.alias("order_key"),
        )
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of decisions: the first action, and a second, later one for suggestions that end in _3."""
    s = suggestions(spark, sf_dir).where("status <> 'new'")
    first = s.select("note_id", F.col("suggestion_id").alias("suggestion_key"), "status", "created_at", "initiative_id")
    flip = F.when(F.col("status") == "applied", "dismissed").otherwise("applied")
    later = first.where("suggestion_key like '%\\\\_3'").withColumns({"status": flip, "created_at": F.expr("created_at + interval 1 hour"), "initiative_id": F.lit("i99")})
    return first.unionByName(later).withColumnRenamed("created_at", "updated_at").withColumn("dismiss_reason", F.lit("not_relevant"))


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.regexp_replace("text", r"\s+", " "), F.lit(" "), pick(BELIEF_SENTENCES, (F.col("conv_id") + F.col("turn")) % 8))
    g = c.select("conv_id", F.struct("turn", line.alias("line")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return g.select(F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("meeting_id"), F.array_join("t.line", "\n").alias("raw_markdown"))


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = suggestion_events(spark, sf_dir)
    act = F.when(F.col("event_type") == "applied", "accepted").when(F.col("event_type") == "dismissed", "dismissed").when(F.col("event_type") == "clarification_answered", "edited")
    reasons = ["not_relevant", "wrong_initiative", "too_speculative", "already_handled", "spam", "duplicate", "other"]
    return e.withColumn("action", act).where("action is not null").select(
        "suggestion_id", "action", F.col("created_at").alias("timestamp"), F.when(F.col("action") == "dismissed", pick(reasons, F.col("event_id") % 7)).alias("dismiss_reason"),
        F.col("time_to_event_seconds").alias("time_to_action_seconds"), "event_id",
    )
