"""Blocks, sections, utterances, cues, routes, duplicates, asks and scores against plain versions and literal cases."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planlake.operators import asks, corpus, cues, routing, scoring, segment
from tests import plain_notes as plain

LINES = ["# Head", "## General", "General", "General:", "Short one", "A sentence that ends.", "- item", "- ", "1. num", "  2. sub", "", "   ", "```", "~~~", "```py", "> quote", "Plan: x", "Q3 2025", "### ", "long line " * 8, "* star", "#nohash", "text", "12. ", "• dot", "é ü."]


@pytest.fixture(scope="module")
def bodies():
    rng = random.Random(1)
    return ["\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 14))) for _ in range(600)] + [None, "", "\n", "x" * 100_000, "\n".join(["- a", "b"] * 3000)]


@pytest.fixture(scope="module")
def notes(spark, bodies):
    return spark.createDataFrame([(f"n{i}", b) for i, b in enumerate(bodies)], "note_id string, body string")


def by_note(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["note_id"], []).append(tuple(r)[1:])
    return {k: sorted(v, key=lambda x: x[:2]) for k, v in out.items()}


def test_blocks(notes, bodies):
    got = by_note(segment.blocks(notes))
    for i, b in enumerate(bodies):
        assert got.get(f"n{i}", []) == plain.blocks(b), b


def test_sections(notes, bodies):
    got = by_note(segment.sections(notes))
    for i, b in enumerate(bodies):
        assert got.get(f"n{i}", []) == [(k, *s) for k, s in enumerate(plain.sections_of(b or ""))], b


@pytest.mark.parametrize("job", [segment.sections, lambda n: segment.utterances(segment.blocks(n))])
def test_tasks_hold_a_share_of_bounded_bytes(spark, monkeypatch, job):
    monkeypatch.setattr(segment, "TASK_BYTES", 500)
    notes = spark.createDataFrame([(f"n{i}", "# Head\n- an item\nA sentence that ends.\n" * 3) for i in range(100)], "note_id string, body string")
    rows = job(notes).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.countDistinct("note_id").alias("n")).collect()
    assert len(rows) > 8
    assert sum(r["n"] for r in rows) == 100


def test_utterances(spark):
    body = "Dr. No came. Yes!  Really?! e.g. this one, etc. and more\nnext line. End\n\n- first item. two\n  1. second \n- \n\n# Head. line\n```\ncode. here\n```\nété. Ça va? oui"
    notes = spark.createDataFrame([("n", body)], "note_id string, body string")
    got = sorted(tuple(r)[1:] for r in segment.utterances(segment.blocks(notes)).collect())
    assert [x[2] for x in got] == ["Dr. No came.", "Yes!", "Really?!", "e.g. this one, etc. and more\nnext line.", "End", "first item. two", "second", "-", "été.", "Ça va?", "oui"]
    assert all(body[a:b] == text for _, _, text, a, b in got)


def test_contained(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    patterns = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["a", "ab", "b a", "zzzz", "", "ab"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    p = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")
    got = {tuple(r) for r in cues.contained(t, p).collect()}
    assert got == {(i, j) for i, x in enumerate(texts) for j, y in enumerate(patterns) if y and y in x}
    assert cues.contained(t, p.where("pattern = ''")).count() == 0


def test_title_matches(spark):
    rng = random.Random(6)
    words = ["launch", "beta", "the", "app", "of", "sync", "é", "api", "new", "plan"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 7))) + rng.choice(["", ".", " X"]) for _ in range(80)]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(40)] + ["the the", "Beta", "ap", "launch the the", "unheard"]
    s = spark.createDataFrame(list(enumerate(texts)), "segment_id long, text string")
    t = spark.createDataFrame(list(enumerate(titles)), "initiative_id long, title string")
    got = [tuple(r) for r in cues.title_matches(s, t).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, x in enumerate(texts) for j, y in enumerate(titles) if plain.title_match(x, y)}


def test_segments_and_cues(spark):
    body = "- Move the launch to Q3, says INI-1\n- Move the launch to Q3, says INI-1 and INI-2\n1) We agreed to create an initiative\n2) Maybe we agreed to create a project\nSend the summary notes to everyone. Send the summary notes to everyone, due by May. short.\nb) Move the launch to Q3, says INI-1"
    notes = spark.createDataFrame([("n", body), ("m", None), ("k", "")], "note_id string, body string")
    segs = cues.segments(notes)
    texts = [r["text"] for r in segs.orderBy("index").collect()]
    assert texts[:5] == ["Move the launch to Q3, says INI-1", "Move the launch to Q3, says INI-1 and INI-2", "We agreed to create an initiative", "Maybe we agreed to create a project", "Move the launch to Q3, says INI-1"]
    assert "short." not in texts and "- Move the launch to Q3, says INI-1" in texts
    inis = spark.createDataFrame([("INI-1", "Alpha"), ("INI-2", "Beta thing")], "initiative_id string, title string")
    got = {(r["segment_id"], r["cue_type"]): (r["initiative_ids"], r["boost"]) for r in cues.cue_signals(segs, cues.mentions(segs, inis)).collect()}
    assert got["n#0", "mutation_timeline"] == (["INI-1"], 0.2) and ("n#1", "mutation_timeline") not in got
    assert got["n#2", "new_initiative"] == ([], 0.3) and ("n#3", "new_initiative") not in got
    named = segs.limit(0).select("segment_id", "note_id", "index", "text")
    acts = named.unionByName(spark.createDataFrame([("a", "n", 0, "Write the report"), ("b", "n", 1, "Perhaps write the report")], "segment_id string, note_id string, index int, text string")).withColumn("section", F.lit("actions"))
    none = cues.mentions(acts, inis)
    assert [(r["segment_id"], r["cue_type"], r["boost"]) for r in cues.cue_signals(acts, none).collect()] == [("a", "backlog_item", 0.1)]
    links = spark.createDataFrame([("n", "INI-2"), ("n", "unknown")], "note_id string, initiative_id string")
    assert {r["segment_id"]: r["initiative_ids"] for r in cues.mentions(acts, inis, links).collect()} == {"a": ["INI-2"], "b": ["INI-2"]}


def cosine(a, b):
    dot = sum(n * b[w] for w, n in a.items())
    return dot / math.sqrt(sum(n * n for n in a.values())) / math.sqrt(sum(n * n for n in b.values())) if dot else 0.0


def test_route(spark, monkeypatch):
    monkeypatch.setattr(routing, "ITEMS", 7)
    monkeypatch.setattr(routing, "INITIATIVES", 5)
    monkeypatch.setattr(routing, "BLOCK_TOKENS", 60)
    monkeypatch.setattr(routing, "ROUND_BYTES", 2000)
    monkeypatch.setattr(routing, "STEP", 16)
    monkeypatch.setattr(routing, "CELLS", 20)
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(30)] + ["common"] * 20
    make = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))
    items = [(i, make()) for i in range(40)] + [(40, None), (41, ""), (42, "a an the"), (43, "word1 " * 500)]
    inis = [(f"i{i:02}", make(), make()) for i in range(23)] + [("i90", "word1", None), ("i05b", "common", "common word2"), ("i05a", "common", "word2 common")]
    got = {r["item_id"]: (r["similarity"], r["route"], r["initiative_id"]) for r in routing.route(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(inis, "initiative_id string, title string, description string"), 0.5).collect()}
    count = lambda x: Counter(w for w in (x or "").lower().split() if len(w) > 3)
    for i, text in items:
        best = min(((-round(cosine(count(text), count(f"{a or ''} {b or ''}")), 6), k) for k, a, b in inis), default=(0, None))
        assert got[i] == (-best[0] + 0.0, "attach" if -best[0] >= 0.5 else "create_new", best[1] if -best[0] >= 0.5 else None)
    empty = spark.createDataFrame([], "initiative_id string, title string, description string")
    assert {r["route"] for r in routing.route(spark.createDataFrame(items, "item_id long, text string"), empty).collect()} == {"create_new"}


def test_only_near_bests_are_rounded(monkeypatch):
    rng = random.Random(5)
    block = lambda n: routing.Block(routing._packed([f"x{rng.random()}" for _ in range(n)], [pa.array([[f"word{rng.randrange(40)}" for _ in range(20)] for _ in range(n)])]))
    a, b, seen, rounded = block(60), block(50), [], routing._rounded
    monkeypatch.setattr(routing, "_rounded", lambda x: seen.append(x.size) or rounded(x))
    row, best, score = routing.best_of(a, b)
    assert sum(seen) < 60 * 50 / 10
    full = [np.zeros((len(x.ids), 40)) for x in (a, b)]
    for m, x in zip(full, (a, b), strict=True):
        m[x.row, [int(w.as_py()[4:]) for w in x.words.take(pa.array(x.word))]] = x.tf
    cosines = np.round(full[0] @ full[1].T / np.outer(a.norm, b.norm), 6)
    assert [(b.ids[j], round(s / 1e6, 6)) for j, s in zip(best, score, strict=True)] == [min(((k, c) for k, c in zip(b.ids, r, strict=True)), key=lambda x: (-x[1], x[0])) for r in cosines.tolist()]
    assert row.tolist() == list(range(60))


def test_merged_duplicates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
    rows = [(f"s{i:03}", rng.choice("ab"), rng.choice(["i1", "i2", None]), text(), i) for i in range(160)] + [(f"c{i}", "a", None, "same words in all of these", 500 + i) for i in range(40)] + [("z", None, None, None, 900), ("y", None, None, "", 901)]
    schema = "id string, action string, initiative_id string, text string, position long"
    new, old = [r for r in rows if r[4] % 2], [r for r in rows if r[4] % 2 == 0]
    got = {r["id"]: (r["duplicate_of"], r["similarity"]) for r in corpus.merged_duplicates(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()}
    for i, action, ini, x, _ in new:
        alike = [(p, k, plain.similar(x or "", y or "")) for k, a, b, y, p in old if (a, b) == (action, ini) and plain.similar(x or "", y or "") >= 0.8]
        assert got[i] == ((min(alike)[1], round(min(alike)[2], 6)) if alike else (None, None)), i


def test_asks(spark):
    text = "- We need to review this with all. The team asks for dark mode. Requirement to implement SSO! Request to add export? The team asks for dark mode. If we delay, we should remove the launch. Concern that we should wait. It is top priority for us, we should see."
    ask = lambda n: [tuple(x) for x in spark.range(1).select(asks.ranked_asks(F.lit(text), n).alias("a")).first()["a"]]
    assert ask(2) == [(1, "Requirement to implement SSO"), (2, "Request to add export")]
    assert ask(9) == [(1, "Requirement to implement SSO"), (2, "Request to add export"), (4, "The team asks for dark mode"), (9, "If we delay, we should remove the launch")]
    assert spark.range(1).select(asks.ranked_asks(F.lit(None).cast("string")).alias("a")).first()["a"] == []


def test_scores(spark):
    section = ("s", 0.9, 0.1, 0.2, 0.0, 0.0, 0.0, 5, "We ship the new export command in Q3.\nowner: ana\nMore lines of text here", True)
    quiet = ("q", 0.1, 0.2, 0.0, 0.0, 0.0, 0.0, 1, "Nothing to see in this text", False)
    implicit = ("i", 0.2, 0.76, 0.0, 0.0, 0.0, 0.0, 2, "Users struggle with the slow export command", False)
    secs = spark.createDataFrame([section, quiet, implicit], "section_id string, plan_change double, new_workstream double, communication double, research double, calendar double, micro_tasks double, num_lines int, raw_text string, is_actionable boolean")
    rows = [
        ("s", 0, "idea", "b-signal", "Ship the export command", "", "ship the export command", False, None, 0.0),
        ("s", 1, "idea", "b-signal", "Unrelated words entirely", "due: 12 lead: bo", "none", True, None, 0.0),
        ("q", 0, "idea", "b-signal", "Nothing", "", "nothing to see", False, None, 0.0),
        ("q", 1, "risk", "b-signal", "Nothing", "", "nothing to see", False, "known", 0.0),
        ("q", 2, "idea", "idea-semantic", "Anything", None, None, False, None, 0.7),
        ("i", 0, "idea", "b-signal", "export command", "", "slow export command", False, None, 0.0),
    ]
    cand = spark.createDataFrame(rows, "section_id string, position int, type string, source string, title string, description string, evidence string, v3_failed boolean, drop_reason string, own_score double")
    got = {(r["section_id"], r["position"]): r for r in scoring.scored(cand, secs).collect()}
    a = got["s", 0]
    assert (a["section_actionability"], a["type_choice_confidence"], a["synthesis_confidence"], a["overall"]) == (1.0, 1.0, 0.85, 0.85)
    assert a["is_high_confidence"] and not a["needs_clarification"] and a["threshold_reason"] is None and a["ranking_score"] == 1.0
    b = got["s", 1]
    assert b["synthesis_confidence"] == 0.25 and b["needs_clarification"] and b["clarification_reasons"] == ["low_overall_score"] and b["threshold_reason"] is None
    c = got["q", 0]
    assert (c["section_actionability"], c["type_choice_confidence"], c["threshold_reason"], c["needs_clarification"]) == (0.05, 0.35, "overall", False)
    assert got["q", 1]["threshold_reason"] is None and got["q", 1]["clarification_reasons"] == ["low_actionability_score", "low_overall_score"]
    assert got["q", 2]["overall"] == 0.7 and got["q", 2]["threshold_reason"] is None
    d = got["i", 0]
    assert d["section_actionability"] == 0.61 and d["overall"] == round(0.61 * 0.5 + d["type_choice_confidence"] * 0.25 + d["synthesis_confidence"] * 0.25, 6)


def test_same_decisions(spark):
    """Pairs of lines against all pairs, with few lines and with more than are searched for one by one; nothing is stored on the way."""
    from itertools import combinations

    from planlake.operators import assemble as asm

    long = ["we will move the launch to may", "So: we will MOVE the launch to May!", "the launch to m", "launch to may", "", "  ", "the launch to m"]
    many = [f"decision number {i % 1500} of the steering group" for i in range(1600)] + ["number 1499 of the s", "decision number 15 of the steering group, again"]
    notes = spark.createDataFrame([("a", "\n".join(long)), ("b", "\n".join(many)), ("c", None), ("d", "one line")], "note_id string, body string")
    df = asm.same_decisions(notes)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in df.collect())
    form = lambda x: "".join(c for c in " ".join(x.lower().split()) if c.isalnum() or c in "_ ").strip()
    like = lambda x, y: x and y and (x == y or (len(x) >= 15 and x in y) or (len(y) >= 15 and y in x))
    want = sorted((n, i, j) for n, ls in (("a", long), ("b", many)) for (i, x), (j, y) in combinations(enumerate(map(form, ls)), 2) if like(x, y))
    assert got == want and len(want) > 100


def test_scores_without_joins(spark):
    """F2: candidates are scored beside the columns of their section; words of candidates and sections are not shuffled to meet."""
    from planlake.plans import registry
    from tests.conftest import SF

    plan = registry.queries()["c14_scores"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    rows = spark.createDataFrame([(["a", "b", "a", "c"], ["a", "x"]), ([], ["a"]), (["b"], []), (["a", "a"], ["a"])], "own array<string>, source array<string>")
    assert [r["n"] for r in rows.select(scoring.held("own", "source").alias("n")).collect()] == [2, 0, 0, 2]


def test_line_scores(spark):
    """a request after its last mark, plain lines and phrases by whole batches; the plan has no phrase searched row by row."""
    from planlake.operators import intent

    lines = ["- We request to ADD a thing", "we add, request to wait", "requests a\tnew  dashboard", "1) maybe we need  an api", "do not remove it", "Fix typo on Monday", None, ""]
    df = spark.createDataFrame([(x,) for x in lines], "s string").select(intent.line_scores(F.col("s")).alias("x")).select("x.*")
    assert "Contains" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r["score"], r["oos"]) for r in df.collect()] == [(0.76, 0.0), (0.0, 0.0), (0.96, 0.0), (1.0, 0.0), (0.0, 0.0), (0.9, 0.6), (0.0, 0.0), (0.0, 0.0)]


def test_titles_without_shuffles(spark, monkeypatch):
    """segments and their titles are found where the notes lie, in rounds, with the pairs in batches; F5, F6: two ids tell that there is more than one."""
    monkeypatch.setattr(cues, "ROUND", 3)
    monkeypatch.setattr(cues, "PAIRS", 2)
    notes = spark.createDataFrame([("n", "- launch the beta\n- Launch the beta\nLaunch the BETA\nNothing at all here\n- a"), ("m", None), ("k", "one line of launch and beta")], "note_id string, body string")
    inis = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(["beta", "launch beta", "a", "", "the of", "zzz", None, "beta beta"])], "initiative_id string, title string")
    segs = cues.segments(notes)
    df = cues.title_matches(segs, inis)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got, texts = [tuple(r) for r in df.collect()], {r["segment_id"]: r["text"] for r in segs.collect()}
    titles = {r["initiative_id"]: r["title"] for r in inis.collect()}
    assert len(got) == len(set(got)) and set(got) == {(s, i) for s, x in texts.items() for i, t in titles.items() if t is not None and plain.title_match(x, t)}
    every, two = ({r["segment_id"]: r["initiative_ids"] for r in cues.mentions(segs, inis, most=most).collect()} for most in (None, 1 + 1))
    assert every == {s: sorted(i for x, i in got if x == s) for s, _ in got}
    assert {s: (len(x) == 1, x if len(x) == 1 else None) for s, x in every.items()} == {s: (len(x) == 1, x if len(x) == 1 else None) for s, x in two.items()}


def test_belief_groups_share_batches(spark):
    """small groups are rows of a batch, not a frame each; beliefs of the invariants are made once."""
    from planlake.operators import beliefs
    from planlake.plans import registry
    from tests.conftest import SF

    rows = [("m", "scope", i, x, 0.5) for i, x in enumerate(["a b", "B a", "c", "", " ", "a b c"])] + [("k", "scope", 0, "c", 0.9)]
    b = spark.createDataFrame(rows, "meeting_id string, dimension string, thread int, after_state string, confidence_score double")
    got = {(r["meeting_id"], r["thread"]): r["cluster"] for r in beliefs.clusters(b, 0.6).collect()}
    assert got == {("m", 0): 0, ("m", 1): 0, ("m", 2): 1, ("m", 3): 2, ("m", 4): 3, ("m", 5): 0, ("k", 0): 0}
    plan = lambda name: registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan("b10_clusters") and "conversations" not in plan("b11_invariants")


def test_titles_in_batches(spark, monkeypatch):
    """titles are found in whole batches of texts, in parts and rounds of any size, long titles and texts of many words too; a title of many initiatives leaves a task once for its segments."""
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "abé" for b in "xyz" for c in ("", "o", "oo", "ö")]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    titles = list(dict.fromkeys([make(rng.randint(0, 5)) for _ in range(150)] + ["a", "y", "xo a", "axo  axo", "axo", "𝄞", make(60), " ".join(words), "a\nb", "\t"]))
    texts = [make(rng.randint(0, 12)) for _ in range(120)] + [" ".join(words[:n]) for n in (10, 30, 36)] + ["", "𝄞 a\nb", "axo", "aXO", "\t"]
    plainly = lambda x: [i for i, t in enumerate(titles) if (lambda own, ws: (t != "" and t in x) or sum(w in own for w in ws) >= (1 if len(ws) == 1 else 2))({w for w in x.split() if len(w) >= 3}, [w for w in t.split() if len(w) >= 3])]
    for pairs, letters, many, cells in ((1 << 20, 1 << 17, 48, 1 << 22), (3, 40, 4, 100)):
        for name, value in (("PAIRS", pairs), ("LETTERS", letters), ("MANY", many), ("CELLS", cells)):
            monkeypatch.setattr(cues, name, value)
        got = {}
        for at, _n, row, title in cues._Titles(titles).within(pa.array(texts)):
            for r, t in zip(row.tolist(), title.tolist(), strict=True):
                got.setdefault(at + r, set()).add(t)
        assert [sorted(got.get(i, ())) for i in range(len(texts))] == [plainly(x) for x in texts]
    monkeypatch.setattr(cues, "ABREAST", (3, 2))
    s = spark.createDataFrame([(i, "Launch") for i in range(7)] + [(7, None)], "segment_id long, text string").coalesce(1)
    t = spark.createDataFrame([(i, "launch") for i in range(20)] + [(20, None)], "initiative_id long, title string")
    df = cues.title_matches(s, t)
    assert sorted(map(tuple, df.collect())) == [(i, j) for i in range(7) for j in range(20)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 2 and "Exchange" not in plan


def test_mentions_where_segments_lie(spark, monkeypatch):
    """names and titles are found in rounds without a shuffle, the first id of a name counts, and cues need no grouping of lists."""
    from planlake.plans import registry
    from tests.conftest import SF

    inis = spark.createDataFrame([("i3", "The Big Plan"), ("i1", "Other"), ("i2", "A Big Plan"), ("INI-9", None), ("i4", "INI-9 again"), ("i2", "second title"), (None, "Big Plan"), ("i5", "with, comma"), ("i0", "")], "initiative_id string, title string")
    texts = ["project: Big Plan", "Project: big plan", "initiative: INI-9", "see INI-9 and INI-8", "initiative: Absent Plan", None, "no cue", "project: comma", "project: i3", "second title"]
    segs = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(texts)], "segment_id string, text string").coalesce(2)
    expected = {0: ["i2", "i3"], 1: ["i2", "i3"], 2: ["INI-9"], 3: ["INI-9"], 7: ["i5"], 8: ["i3"], 9: ["i2"]}
    for rounds, pairs in ((1 << 16, 1 << 20), (1, 1), (2, 1)):
        monkeypatch.setattr(cues, "ROUND", rounds)
        monkeypatch.setattr(cues, "PAIRS", pairs)
        df = cues.with_mentions(segs, inis)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r["segment_id"]: r["initiative_ids"] for r in df.collect()} == {f"s{i}": expected.get(i, []) for i in range(len(texts))}
        assert {r["segment_id"]: r["initiative_ids"] for r in cues.with_mentions(segs, inis.limit(0)).collect()} == {f"s{i}": [] for i in range(len(texts))}
    plan = registry.queries()["c16_cue_signals"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ExistingRDD" not in plan


def test_pairs_of_sets_are_not_stored(spark, monkeypatch):
    """sets that meet in a common word are compared where they meet; no pair is shuffled, and any order of words gives the same rows."""
    for name, value in (("FREQUENT_WORDS", 5), ("CROWDED_WORDS", 2), ("SHARES", 3)):
        monkeypatch.setattr(corpus, name, value, raising=False)
    rng = random.Random(8)
    text = lambda: "File a ticket to track by end of " + " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 3)))
    rows = [(f"s{i:03}", "file", None if i % 3 else "i1", text(), i // 4) for i in range(200)]
    schema = "id string, action string, initiative_id string, text string, position long"
    new, old = rows[::2], rows[1::2]
    df = corpus.merged_duplicates(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("hashpartitioning(")[1:] if "open_set" in x.split(")")[0]]
    got = {r["id"]: (r["duplicate_of"], r["similarity"]) for r in df.collect()}
    for i, _, ini, x, _ in new:
        alike = [(p, k, plain.similar(x, y)) for k, _, b, y, p in old if b == ini and plain.similar(x, y) >= 0.8]
        assert got[i] == ((min(alike)[1], round(min(alike)[2], 6)) if alike else (None, None)), i
