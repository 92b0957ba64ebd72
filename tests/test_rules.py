"""Literal cases of single rules."""

import pytest
from pyspark.sql import functions as F

from planlake.functions import compat
from planlake.functions import textcols as tc
from planlake.operators import beliefs as bl
from planlake.operators import corpus as cp
from planlake.operators import eventlog as ev
from planlake.operators import merge as mg
from planlake.operators import metrics as m
from planlake.operators import segment
from planlake.plans import registry
from planlake.streaming import jobs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, want", [(None, 0.5), (0.0, 0.5), (float("nan"), 0.5), (0.2, 0.2)])
def test_falsy_numbers(spark, value, want):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(compat.js_or(F.col("v"), 0.5).alias("x")).first()["x"] == want


@pytest.mark.parametrize("value, want", [(2.5, 3), (-2.5, -2), (0.49, 0)])
def test_rounding(spark, value, want):
    assert one(spark, compat.js_round(F.col("v")), v=value) == want


def test_ascii_boundary(spark):
    assert one(spark, tc.has(F.col("v"), r"\badd\b"), v="éadd it")
    assert not one(spark, tc.has(F.col("v"), r"\badd\b"), v="ladd it")


@pytest.mark.parametrize(
    "text, want",
    [
        ("Users need a faster export command.", [("FEATURE_DEMAND", 0.65)]),
        ("Customers want a fix for this blocker.", [("FEATURE_DEMAND", 0.75), ("SCOPE_RISK", 0.7)]),
        ("We are delaying the launch by 3 weeks.", [("PLAN_CHANGE", 0.75)]),
        ("If we don't fix login the release is at risk.", [("SCOPE_RISK", 0.7)]),
        ("PII appears in logging output.", [("SCOPE_RISK", 0.85)]),
        ("Some concern that the plan is late.", []),
        ("The sync job is failing.", [("BUG", 0.7)]),
        ("The sync job might be failing.", []),
        ("", []),
    ],
)
def test_signals(spark, text, want):
    assert [(s["signal"], s["confidence"]) for s in one(spark, tc.signals(F.col("v")), v=text)] == want


@pytest.mark.parametrize("title, want", [("  Add  Search! ", "add search"), ("", ""), ("?!", ""), ("x" * 130, "x" * 120)])
def test_title_form(spark, title, want):
    assert one(spark, tc.title_form(F.col("v")), v=title) == want


def test_hashes(spark):
    assert one(spark, compat.djb2(F.col("v")), v="hello") == "0f923099"


def test_redaction(spark):
    text = "Mail ana@example.com, 123-45-6789, 1234 5678 1234 5678 or 555-123-4567."
    assert one(spark, tc.redacted(F.col("v")), v=text) == "Mail [email], [ssn], [card] or [phone]."


def test_sentences(spark):
    assert one(spark, tc.sentences(F.col("v")), v="One. two Three! Four?") == ["One. two Three!", "Four?"]


def test_process_noise(spark):
    assert one(spark, tc.process_noise(F.col("v")), v="Who owns the final sign-off is unclear.")
    assert not one(spark, tc.process_noise(F.col("v")), v="Owner: Ana, final QA")


def test_sections(spark):
    def sections_of(body):
        df = spark.createDataFrame([("n", body)], "note_id string, body string")
        return [(r["heading_text"], r["heading_level"], r["start_line"], r["end_line"], r["raw_text"], r["num_lines"], r["num_list_items"]) for r in segment.sections(df).orderBy("ordinal").collect()]

    body = "intro line here that is long enough to be no heading at all.\n\n# Plan\n## Steps\n- a\n- b\n```\n# no heading\n```\n## Empty\n\n## Last\n1. x"
    got = [(h, level, text) for h, level, _, _, text, _, _ in sections_of(body)]
    assert got == [
        ("General", 1, "intro line here that is long enough to be no heading at all.\n"),
        ("Steps", 2, "- a\n- b\n```\n# no heading\n```"),
        ("Empty > Last", 2, "1. x"),
    ]
    assert sections_of("") == [] and sections_of("\n\n") == []
    assert [s[0] for s in sections_of("Goals:\nship it.\nthen rest.")] == ["Goals"]


def _log(spark, rows):
    return spark.createDataFrame(
        [("i1", n, t, p, None, "u", f"c{n}", None) for n, t, p in rows],
        "initiative_id string, sequence long, type string, payload string, occurred_at timestamp, actor_user_id string, command_id string, suggestion_id string",
    ).withColumn("occurred_at", F.timestamp_seconds(F.col("sequence")))


LOG = [
    (1, "InitiativeCreated", '{"slug":"s","title":"a","description":"d","status":"draft"}'),
    (2, "InitiativeFieldUpdated", '{"field":"goal","newValue":"g"}'),
    (3, "InitiativeStatusChanged", '{"newStatus":"approved"}'),
    (4, "ReleaseDateChanged", '{"dateType":"target","newDate":5}'),
    (5, "ReleaseDateChanged", '{"dateType":"target","newDate":0}'),
    (6, "Unknown", "{}"),
]


def test_fold(spark):
    s = ev.fold(_log(spark, LOG)).first()
    assert (s["title"], s["goal"], s["status"], s["approvedAt"], s["releaseTargetDate"], s["currentVersion"]) == ("a", "g", "approved", "3000", None, 5)
    again = [*LOG, (7, "InitiativeCreated", '{"slug":"s","title":"b","description":"d","status":"draft"}')]
    s = ev.fold(_log(spark, again)).first()
    assert (s["title"], s["goal"], s["status"], s["approvedAt"]) == ("b", None, "draft", None)
    assert ev.fold(_log(spark, LOG[1:])).count() == 0


def test_fold_of_prefix_is_snapshot(spark):
    log = _log(spark, LOG)
    fields = ["title", "goal", "status", "releaseTargetDate"]
    for v in range(1, 6):
        want = ev.state_as_of(log, version=v).select(*fields).first()
        got = ev.snapshots(log, 1, fields).where(F.col("version") == v).select(*fields).first()
        assert tuple(want) == tuple(got)
        snap = ev.snapshots(log, 1, fields).where(F.col("version") == v)
        assert tuple(ev.fold_from(snap, log, fields).select(*fields).first()) == tuple(ev.fold(log).select(*fields).first())


def test_diff_with_itself_is_empty(spark):
    assert ev.version_diff(_log(spark, LOG), 3, 3).count() == 0


def test_undo(spark):
    log = _log(spark, [*LOG[:2], (3, "InitiativeFieldUpdated", '{"field":"goal","oldValue":"g","newValue":null,"undoOfEventId":2}')])
    assert [(r["undoes"], r["new_value"]) for r in ev.undo_events(log).collect()] == [(3, "g")]


def test_transitions(spark):
    assert one(spark, ev.valid_transition(F.lit("draft"), F.lit("proposed")))
    assert not one(spark, ev.valid_transition(F.lit("archived"), F.lit("draft")))
    assert not one(spark, ev.valid_transition(F.lit("nonsense"), F.lit("draft")))


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, event_type string, team_id string, ui_surface string, suggestion_family string, exclude_from_metrics boolean").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))


def test_cube_counts_each_event_once_at_a_grain(spark):
    e = _events(spark, [(1, "generated", None, "", None, None), (2, "applied", "t", "s", "f", False), (3, "applied", "t", "s", "f", True)])
    rows = {(r["team_id"], r["surface"], r["suggestion_family"]): (r["suggestions_generated"], r["suggestions_applied"]) for r in m.daily_cube(e).collect()}
    assert rows[None, None, None] == (1, 1) and rows["t", "s", "f"] == (0, 1) and len(rows) == 8
    compat = {(r["team_id"], r["surface"], r["suggestion_family"]): r["suggestions_generated"] for r in m.daily_cube(e, compat=True).collect()}
    assert compat[None, None, None] == 8


def test_empty_log(spark):
    e = _events(spark, []).withColumns({"rule_or_prompt_id": F.lit("r"), "suggestion_id": F.lit("s")})
    assert m.daily_cube(e).count() == 0 and m.rule_quality(e, "2024-01-02").count() == 0 and m.funnel(e).count() == 0


def test_upsert_is_idempotent(spark):
    changes = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, l string, n int")
    empty = changes.limit(0).withColumns({"created_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")})
    first = mg.upsert(empty, changes, ["k", "l"], "2024-01-01")
    again = mg.upsert(first, changes, ["k", "l"], "2024-01-02")
    assert again.count() == 2 and {r["created_at"].day for r in again.collect()} == {1}


def test_numbers_go_on(spark):
    old = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "k string, sequence long, global_sequence long")
    new = spark.createDataFrame([("a", 10), ("b", 11), ("a", 12)], "k string, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {(r["k"], r["s"]): (r["sequence"], r["global_sequence"]) for r in mg.append_numbered(old, new, "k", ["at"]).collect()}
    assert got == {("a", 10): (3, 3), ("b", 11): (1, 4), ("a", 12): (4, 5)}


def test_write_days_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "daily")
    day = lambda rows: spark.createDataFrame(rows, "date_utc string, n int")
    mg.write_days(day([("2024-01-01", 1), ("2024-01-02", 2)]), path)
    mg.write_days(day([("2024-01-02", 3)]), path)
    assert sorted((str(r["date_utc"]), r["n"]) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 1), ("2024-01-02", 3)]


def test_utterance_classes(spark):
    u = spark.createDataFrame([("m", 0, "The mobile release deadline was March."), ("m", 1, "Checkout status is on track."), ("m", 2, "Hello there.")], "meeting_id string, utterance_index int, text string")
    got = {r["utterance_index"]: (r["label"], r["dimension"], r["change_role"], r["local_confidence"]) for r in bl.classified(u).collect()}
    assert got == {0: ("plan_change", "timeline", "before", 0.8), 1: ("status", "status", "none", 0.8), 2: ("noise", None, "none", 0.3)}


def test_initiative_mapping(spark):
    f = lambda d: one(spark, bl.mapped_initiative(F.create_map(*[F.lit(x) for kv in d.items() for x in kv])))
    assert f({"a": 0.9, "b": 0.5}) == "a" and f({"a": 0.75, "b": 0.7}) is None and f({"a": 0.8}) == "a"


def test_near_duplicates_match_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i, i % 2, " ".join(rng.sample("abcdefghij", rng.randint(4, 10)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, block long, text string")
    got = {(r["new_id"], r["open_id"]) for r in cp.near_duplicates(df, df).collect()}
    words = {i: (b, set(t.split())) for i, b, t in rows}
    want = {(i, j) for i, (a, x) in words.items() for j, (b, y) in words.items() if i != j and a == b and len(x & y) / len(x | y) >= 0.8}
    assert got == want


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_streams_leave_results_in_the_shared_folder(spark, tmp_path, mode):
    """Files of executors, not a table that the driver holds; a complete result is that of the last batch."""
    for k in range(2):
        spark.createDataFrame([(i, k) for i in range(10)], "n long, k long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("n long, k long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.drained(rows if mode == "append" else rows.groupBy("n").count(), f"t_{mode}_{tmp_path.name}", mode)
    assert out.inputFiles() and all(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") in f for f in out.inputFiles())
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted([(i, k) for i in range(10) for k in range(2)] if mode == "append" else [(i, 2) for i in range(10)])


def test_whole_bodies_are_read(spark, tmp_path):
    """A sentence in the middle of a note is redacted, gives its signal and is counted."""
    text = "Intro\nThe sync job is failing with a crash error.\n- Write to bo@example.org\nEnd"
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert ("The sync job is failing with a crash error.", "BUG") in {(r["sentence"], r["signal"]) for r in run("c03_signals")}
    assert len(run("t06_redaction")) == 8
    assert not any("bo@example.org" in r["redacted"] for r in run("t06_redaction"))


def test_replayed_batch_replaces_its_rows(spark):
    from planlake.sources import fixtures as fx
    from tests.conftest import SF

    log = fx.initiative_events(spark, SF)
    changed = log.select("initiative_id").distinct().limit(5)
    path = jobs.shared_folder(spark, "replayed-view")
    merge = jobs.state_view(log, path)
    merge(changed, 0)
    merge(changed, 0)
    assert spark.read.parquet(path).count() == 5
    assert jobs.current_view(spark, path).count() == 5


@pytest.mark.parametrize(("text", "title"), [
    ("Idea: ends here.\r", "Ends here.\r"), ("Idea: ends here.\u2028", "Ends here.\u2028"), ("\u00a0Idea: spaced.\u3000", "Spaced"), ("Idea: \x0bvt", "\x0bvt"),
    ("Idea: ßz", "ẞz"), ("Idea: ŉz", "ŉz"), ("Idea: \u1fb3z", "\u1fbcz"), ("Idea: éa", "Éa"), ("ri\u017fk : long s", "Long s"), ("Idea: " + "a b\x0b" + "c" * 40, "A…"), ("Idea: " + "a" * 20 + " \u00a0bbb" + "c" * 40, "A" + "a" * 19 + "…"), ("", ""),
])
def test_display_title_as_sql(spark, duck, text, title):
    """Line ends, spaces and capitals as SQL has them."""
    from planlake.operators import assemble as asm

    sql = r"""select case when length(t) <= 30 then t else regexp_replace(substr(t, 1, 29), '\s+\S*$', '') || '…' end from (select upper(substr(c, 1, 1)) || substr(c, 2) as t
      from (select regexp_replace(regexp_replace(trim(?), '(?i)^(new idea|idea|project update|update|risk|bug)\s*:\s*', ''), '[.!?]+$', '') as c))"""
    assert one(spark, asm.display_title(F.col("v"), 30), v=text) == title == duck.execute(sql, [text]).fetchall()[0][0]


@pytest.mark.parametrize("text", ["who\x0bowns it", "who owns it", "WHO  OWN it", "éwho owns", "_who owns", "", "who\nowns"])
def test_patterns_as_sql(spark, duck, text):
    """White space and word boundaries of patterns are those of SQL, where Java's white space holds one more."""
    assert one(spark, tc.has(F.col("v"), r"\bwho\s+owns?\b"), v=text) == duck.execute(r"select regexp_matches(?, '\bwho\s+owns?\b', 'i')", [text]).fetchall()[0][0]


def test_words_and_redaction_in_one_pass(spark):
    """F8, F16: a line's words are found by one pattern; F20: white space within numbers is that of SQL's patterns."""
    v = F.col("v")
    df = spark.createDataFrame([("Improve the-sync, improve IT; to x1y2",)], "v string").select(tc.tokens(v, 2).alias("t"), tc.generic_ratio(v).alias("g"), tc.domain_nouns(v).alias("n"), tc.jaccard(tc.tokens(v, 2), tc.tokens(v, 3)).alias("j"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "regexp_replace(" not in plan
    assert tuple(df.first()) == (["improve", "the", "sync", "improve", "x1y2"], 0.4, ["sync", "x1y2"], 0.75)
    card = "4111\x0b1111 1111 1111"
    assert one(spark, tc.redacted(v), v=card) == card and one(spark, tc.redacted(v), v=card.replace("\x0b", "\t")) == "[card]"
