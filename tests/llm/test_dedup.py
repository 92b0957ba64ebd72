import random

import pytest
from pyspark.sql import functions as F

from planlake.llm import components, exact_dedup, line_dedup, near_dedup, substring_dedup
from tests.llm import brute

ID_TEXT = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ID_TEXT)


@pytest.fixture(scope="module")
def corpus():
    """Null, empty and very long texts, exact and near copies, shared passages, runs of one word."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeÄéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = text(60), text(150).split(" ")
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One  TWO"), (5, "a " * 200), (6, "a " * 90)]
    for i in range(7, 30):
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = rng.choice(vocab)
        rows.append((i, rng.choice([" ", "\n"]).join(near)))
    for i in range(30, 45):
        rows.append((i, f"{text(rng.randint(0, 40))} {passage} {text(rng.randint(0, 40))}"))
    rows += [(i, text(rng.randint(1, 80))) for i in range(45, 70)]
    rows += [(70, text(20_000)), (71, rows[60][1]), (72, rows[60][1].replace(" ", "  "))]
    return rows


def test_near_copies(spark, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.clusters(frame(spark, corpus)).collect()}
    assert got == brute.near(corpus)


def test_family_without_a_centre(spark):
    """A chain of texts, each near the next one only, and a family of many pairs just below the threshold."""
    rng = random.Random(3)
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[i * 8 : i * 8 + 200])) for i in range(20)]
    base = [f"v{i}" for i in range(120)]
    for i in range(100, 160):
        x = list(base)
        for k in rng.sample(range(0, 120, 6), 3):
            x[k] = f"z{i}_{k}"
        rows.append((i, " ".join(x)))
    rows.append((500, " ".join(base)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.clusters(frame(spark, rows)).collect()}
    assert got == brute.near(rows)


def test_near_dedup_edges(spark):
    assert near_dedup.clusters(frame(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None)]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.clusters(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, False), (3, 3, True)], key=str)


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    comp = {x: x for ab in links for x in ab}
    for _ in comp:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == {k: v for k, v in comp.items() if any(k in ab and ab[0] != ab[1] for ab in links)}


def test_settled_links_take_no_step(spark, monkeypatch):
    made = []
    cut = components.cut
    monkeypatch.setattr(components, "cut", lambda df: made.append(1) or cut(df))
    links = [(i, 0) for i in range(1, 6)] + [(8, 7), (7, 8)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert dict(map(tuple, got.collect())) == {**dict.fromkeys(range(6), 0), 7: 7, 8: 7}
    assert len(made) == 1  # the links themselves


def test_links_of_a_task_take_no_step(spark, monkeypatch):
    """A path lies in one task, which merges its links before any step."""
    made = []
    cut = components.cut
    monkeypatch.setattr(components, "cut", lambda df: made.append(1) or cut(df))
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long").coalesce(1)
    assert dict(map(tuple, components.components(links).collect())) == dict.fromkeys(range(201), 0)
    assert len(made) == 1


def test_components_of_links_merged_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(components, "MERGED", 3)
    nodes = [random.Random(5).sample(range(60 * i, 60 * i + 60), 60) for i in range(2)]
    links = [x for n in nodes for x in zip(n, n[1:], strict=False)]
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(12)).collect()
    assert sorted(map(tuple, got)) == [(i, i // 60 * 60) for i in range(120)]


def test_units_are_joined_with_their_groups_once(spark):
    """What several jobs read is a table, not a join that each of them makes again."""
    once = spark.createDataFrame([(1, 1, 1, 2, 3, 0, 27), (2, 1, 1, 1, 3, 0, 27), (3, 1, 1, 9, 9, 0, 27)], "core long, q1 long, q2 long, weight long, n int, low int, high int")
    small, large = substring_dedup._sized(once, 40, 35)
    assert [[r["core"] for r in x.collect()] for x in (small, large)] == [[1], [3]]
    assert "Join" not in small._jdf.queryExecution().toString()


@pytest.mark.parametrize("shard_words, broadcast_bytes, rounds", [(20_000, 1 << 26, 16), (100, 20_000, 100), (40, 1, 0)])
def test_passages(spark, corpus, shard_words, broadcast_bytes, rounds):
    """All in one shard; groups that are split, in many rounds; all groups split to the end and shuffled instead of broadcast."""
    out = substring_dedup.substring_dedup(frame(spark, corpus), shard_words=shard_words, broadcast_bytes=broadcast_bytes, rounds=rounds)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()}
    want = brute.repeats(corpus)
    assert got == {i: x for (i, _), x in zip(corpus, want, strict=True)}


def test_passages_beyond_the_broadcast_bound(spark, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_IDS", 0)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(frame(spark, corpus)).collect()}
    assert got == {i: x for (i, _), x in zip(corpus, brute.repeats(corpus), strict=True)}


def test_passage_edges(spark):
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0
    w = " ".join(f"w{i}" for i in range(40))
    rows = [(1, w), (1, w), (None, w + " tail"), (2, "short")]
    df = frame(spark, rows).withColumn("kept", F.lit("clash"))
    out = substring_dedup.substring_dedup(df).collect()
    assert sorted((r["n_removed"], r["kept"] or "") for r in out) == [(0, ""), (40, ""), (40, ""), (40, "tail")]


def test_lines(spark):
    rng = random.Random(2)
    pool = ["Short line", *("Shared line number %d with Enough characters to count" % i for i in range(8))]
    rows = [(i, "\n".join(rng.choice([*pool, f"  own line {i} of some length, at least forty characters\t"]) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, pool[1].upper() + "\r\n" + pool[1]), (43, pool[1]), (None, pool[1] + "\n" + pool[2])]
    out = line_dedup.line_dedup(frame(spark, rows).withColumn("n_lines", F.lit("clash"))).collect()
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"] or "") for r in out)
    assert got == sorted((str(i), *x) for (i, _), x in zip(rows, brute.lines(rows), strict=True))


def test_line_edges(spark):
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0
    rows = [(i, "the very same line in all of the documents here") for i in range(6)]
    out = line_dedup.line_dedup(frame(spark, rows), batches=3).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(i, "") for i in range(5)] + [rows[5]]


def test_line_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, buckets=4, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(100 - k, 1, 1), (100 - k, 10 + k, 0)], "doc_id long, h1 long, h2 long"))
    assert max(map(len, runs.levels)) <= 1
    got = {r["h1"]: (r["n_docs"], r["holder"]) for r in runs.counts().collect()}
    assert got == {1: (5, 100)} | {10 + k: (1, 100 - k) for k in range(5)}


def test_exact_copies(spark, corpus):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(frame(spark, corpus)).collect()}
    assert got == brute.exact(corpus)


def test_exact_edges(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    rows = [(5, "a b"), (5, "a  b"), (4, "ab"), (None, "a b"), (6, None), (7, ""), (-3, "a  b"), (None, "z"), (8, "x"), (8, "x")]
    out = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in out)
    assert got == sorted(
        [("5", "-3", 5, False), ("5", "-3", 5, False), ("4", "-3", 5, False), ("None", "-3", 5, False), ("-3", "-3", 5, True)]
        + [("6", "6", 2, True), ("7", "6", 2, False), ("None", "None", 1, True), ("8", "8", 2, True), ("8", "8", 2, False)]
    )


def test_near_copies_from_80_percent_on(spark):
    """Texts of 196 shingles with 46 or 52 more: similarities of 0.810 and 0.790. At 0.80, 29 errors are exceeded with probability 1.2e-6."""
    w, rows = [f"w{i}" for i in range(200)], []
    for n in range(40):
        rows += [(4 * n, " ".join(f"{n}_{x}" for x in w)), (4 * n + 1, " ".join([*(f"{n}_{x}" for x in w), *(f"x{n}_{i}" for i in range(46))]))]
        rows += [(4 * n + 2, " ".join(f"u{n}_{i}" for i in range(200))), (4 * n + 3, " ".join(f"u{n}_{i}" for i in range(252)))]
    got = near_dedup.clusters(frame(spark, rows), percent=80, errors=29, chunks=15).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.near(rows, percent=80)
    assert {r["doc_id"] for r in got if r["kept"]} == {i for i, _ in rows if i % 4 != 1}
    with pytest.raises(ValueError):
        near_dedup.clusters(frame(spark, rows), percent=80, errors=29)


def test_a_common_passage_in_ever_new_surroundings(spark):
    """One group of pieces far too large for a shard is split by longer cores until each window is decided."""
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(45)]
    rows = [(i, " ".join([f"a{i}_{k}" for k in range(rng.randint(0, 30))] + passage[rng.randint(0, 3) :] + [f"b{i}_{k}" for k in range(rng.randint(0, 30))])) for i in range(120)]
    out = substring_dedup.substring_dedup(frame(spark, rows), shard_words=400)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()}
    assert got == {i: x for (i, _), x in zip(rows, brute.repeats(rows), strict=True)}


def test_automata_decide(spark, corpus, monkeypatch):
    """Without what the automata say nothing is removed."""
    import pyarrow as pa

    def silent(window):
        def run(batches):
            for batch in batches:
                for units in batch.column("units"):
                    units = units.values
                    yield pa.record_batch([*(units.field(c) for c in ("core", "q1", "q2")), pa.array([0] * len(units), pa.int64())], names=["core", "q1", "q2", "mask"])

        return run

    monkeypatch.setattr(substring_dedup, "_matched", silent)
    assert {r["n_removed"] for r in substring_dedup.substring_dedup(frame(spark, corpus)).collect()} == {0}


def test_the_anti_join_decides_the_holder(spark):
    """With batches that do not meet the runs, a later batch would take over the lines of an earlier one."""

    class Careless(line_dedup.LineRuns):
        def add(self, batch):
            held, self.levels = self.levels, []
            super().add(batch)
            self.levels = [[*(t for level in held for t in level), *self.levels[0]]]

    got = {}
    for kind in (line_dedup.LineRuns, Careless):
        runs = kind(spark, buckets=2, fanout=9)
        for k in range(3):
            runs.add(spark.createDataFrame([(100 - k, 1, 1)], "doc_id long, h1 long, h2 long"))
        got[kind] = [tuple(r) for r in runs.counts().select("n_docs", "holder").collect()]
        runs.close()
    assert got[line_dedup.LineRuns] == [(3, 100)] and got[Careless] == [(3, 98)]


def test_long_texts_and_clashing_columns(spark):
    long_line = "x" * 200_000
    rows = [(i, f"{long_line}\nown {i}") for i in range(6)]
    clash = {c: F.lit("c") for c in ("th", "pos", "h1", "holder", "digest", "keep_id", "n_shingles", "rep", "comp", "n_docs")}
    df = frame(spark, rows).withColumns(clash)
    assert sorted((r["doc_id"], r["n_dropped"], r["text"]) for r in line_dedup.line_dedup(df).collect()) == [(i, 1, f"own {i}") for i in range(5)] + [(5, 0, rows[5][1])]
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(df.withColumn("text", F.lit(long_line))).collect()} == {0}
    assert {r["component_id"] for r in near_dedup.clusters(df.withColumn("text", F.lit("a b c d e f"))).collect()} == {0}


def test_one_id_with_two_texts(spark):
    """An id is one document: each of its texts links it."""
    a, b = "a b c d e f g", "k l m n o p q"
    rows = [(1, a), (1, b), (2, a), (3, b), (4, "z z z z z z")]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.clusters(frame(spark, rows)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]
    top = 2**63 - 1
    out = exact_dedup.exact_dedup(frame(spark, [(top, "same"), (None, "same"), (None, "other")])).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["kept"]) for r in out), key=str) == sorted([(top, top, True), (None, top, False), (None, None, True)], key=str)
