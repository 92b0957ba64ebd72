import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlake.llm import language_id, quality


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    parts = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["sch", "ung", "ei", "ver"], "cc": ["tion", "é", "eau", "que"]}
    rows = []
    for i in range(240):
        lang = "abc"[i % 3] * 2
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randint(1, 60)))
        rows.append((i, text, lang if i % 10 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages(spark, texts):
    model = language_id.fit(language_id.training_rows(texts), per_lang=40, landmarks=24)
    odd = spark.createDataFrame([(1000, None), (1001, "123 !?"), (1002, ""), (1003, "KALO miru"), (1003, "KALO miru"), (None, "schung verei")], "doc_id long, text string")
    got = language_id.predict(texts, model, keep=("doc_id", "lang")).where("doc_id % 3 = 1 or lang is null").collect()
    want = {i: "abc"[i % 3] * 2 for i in range(240)}
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict(odd, model).collect()]
    assert got == [(1000, "und"), (1001, "und"), (1002, "und"), (1003, "aa"), (1003, "aa"), (None, "bb")]


def test_nothing_to_learn(spark, texts):
    model = language_id.fit(language_id.training_rows(texts.limit(0)))
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(texts, model).collect()} == {("und", 0.0)}
    assert language_id.predict(texts.limit(0), model).count() == 0


def test_presence_of_grams_stays_within_a_text():
    buf = np.frombuffer(b"abcabx", np.uint8)
    alone = language_id.presence(buf[:3], np.array([0, 3]))
    both = language_id.presence(buf, np.array([0, 3, 3, 6]))
    assert (alone[0] == both[0]).all() and not both[1].any()


def test_kernel_is_the_share_of_common_grams():
    x = language_id.presence(np.frombuffer(b"ab", np.uint8), np.array([0, 2]), bits=14)
    assert x.sum() == 3  # a, b, ab


def test_quality(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        text = " ".join(rng.choice(["plan", "the", "result", "shows", "a", "useful", "idea"]) if good else "spam" for _ in range(rng.randint(5, 40)))
        rows.append((i, text, "en", "s1" if good or i % 3 == 0 else "s2", len(text)))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    tags = spark.createDataFrame([*labels, (0, None, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.cotrain(docs, tags)
    out = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert np.mean([(out[i] > 0.5) == (i % 4 != 0) for i in range(1, 400, 2)]) > 0.95
    odd = docs.limit(0).unionByName(spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s1", -5)], docs.schema))
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd.withColumn("score", F.lit(3)), model).collect())
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.cotrain(docs, tags.limit(0)) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}


def _pages(spark, rows):
    docs = spark.createDataFrame([(i, text, "en", source, len(text)) for i, text, source in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs


def test_all_unlabelled_documents_can_teach(spark, monkeypatch):
    """Each row of a large pool counts: the documents that bring in a new source are found wherever their hashes fall."""
    rng = random.Random(9)
    good, bad = ["plan", "result", "useful", "idea"], ["spam", "win", "cash", "click"]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(12)), "s1" if i % 2 else "s2") for i in range(7600)]
    tags = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    sizes = []
    bound = quality._bound
    monkeypatch.setattr(quality, "_bound", lambda counts, n: sizes.append((int(counts.sum()), n)) or bound(counts, n))
    assert quality.cotrain(_pages(spark, rows), tags, rounds=1) is not None
    assert sizes[0][0] + sizes[1][0] == 7500  # view 0 is sure of every unlabelled document
    assert sizes[0][1] + sizes[1][1] in (374, 375)


def test_one_id_of_many_rows_does_not_fill_the_sample(spark):
    first = min(range(60), key=lambda i: spark.range(i, i + 1).select(F.xxhash64("id")).first()[0])
    rows = [(i, "plan result" if i % 2 else "spam cash", "s1") for i in range(60)] + [(first, f"copy {k}", "s1") for k in range(300)]
    tags = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert quality.cotrain(_pages(spark, rows), tags, labelled=40, rounds=1) is not None


def test_pseudo_labels_follow_bounds():
    views = np.linspace(-3, 3, 601)[:, None], np.zeros((601, 1))
    one = quality._scaled(np.zeros(1), np.ones(1), np.array([1.0, 0.0]))
    none = quality._scaled(np.zeros(1), np.ones(1))
    h = np.arange(601, dtype=np.uint64)
    s = one.logit(views[0])
    low = quality._bound(np.bincount(quality._bins(s[s < -1]), minlength=quality.BINS), 50)
    to_0, to_1 = quality.pseudo_labels(views, h, [([one, none], [(low, (quality.BINS, 0.0)), ((0, 0.0), (0, 0.0))])])
    assert (to_0 == -1).all() and set(np.flatnonzero(to_1 == 1)) == set(np.flatnonzero(s > 1))
    assert abs((to_1 == 0).sum() - 50) <= 4 and (to_1[:40] == 0).all() and (to_1[60:] != 0).all()


def test_languages_against_a_dense_kernel_ridge(spark, texts):
    """All training rows as landmarks: the Nystrom features then span the whole kernel, which plain sets and one solve give too."""
    model = language_id.fit(language_id.training_rows(texts), per_lang=1000, landmarks=10_000)
    rows = [tuple(r) for r in language_id.training_rows(texts).collect()]
    grams = lambda t: {b[i : i + n] for b in [t.lower().encode()] for n in (1, 2, 3, 4) for i in range(len(b) - n + 1)}
    kernel = lambda x, z: np.array([[len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1)) for b in z] for a in x])
    sets, y = [grams(t) for _, t, _ in rows], np.array([lang for _, _, lang in rows])
    langs = sorted(set(y))
    target = np.where(y[:, None] == np.array(langs), 1.0, -1.0)
    w = np.array([1 / (y == v).sum() for v in y])[:, None]
    k = kernel(sets, sets)
    ones = np.ones((len(k), 1))
    left = np.block([[k @ (w * k) + language_id.RIDGE * k, k @ (w * ones)], [(w * ones).T @ k, (w * ones).T @ ones]])
    coef = np.linalg.lstsq(left, np.vstack([k @ (w * target), (w * ones).T @ target]), rcond=1e-10)[0]
    asked = [(r["doc_id"], r["text"]) for r in texts.collect()]
    out = kernel([grams(t) for _, t in asked], sets) @ coef[:-1] + coef[-1]
    share = np.clip((out + 1) / 2, 1e-6, 1)
    want = {i: (langs[k], s) for (i, _), k, s in zip(asked, out.argmax(1), share.max(1) / share.sum(1), strict=True)}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(texts, model).collect()}
    assert np.mean([got[i][0] == want[i][0] for i in want]) > 0.98
    assert np.mean([abs(got[i][1] - want[i][1]) for i in want]) < 0.03  # grams share places of the hashed table


def test_the_fit_takes_a_bounded_number_of_rows(spark):
    rows = [(7, f"kalo {i}", "aa") for i in range(400)] + [(i, "schung", "bb") for i in range(30)] + [(8, "kalo 1", "aa")] * 50
    train = language_id.training_rows(spark.createDataFrame([*rows, (None, "kalo", "aa")], "doc_id long, text string, lang string"))
    got = [r["lang"] for r in language_id._chosen(train, "doc_id", 20).collect()]
    n = train.where("lang = 'bb'").count()
    assert (got.count("aa"), got.count("bb")) == (20, min(20, n))
    sent = language_id._chosen(train, "doc_id", 20, 2)
    assert sorted(r["lang"] for r in sent.collect()) == sorted(got)


def test_only_letters_make_a_language(spark, texts):
    model = language_id.fit(language_id.training_rows(texts), per_lang=40, landmarks=24)
    odd = spark.createDataFrame([(1, "\u00bd \u00b2\u00b3"), (2, "\u2163 \u2460"), (3, "\u00aa"), (4, "kalo " * 50_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(odd, model).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und" and got[4] == "aa"
    assert language_id.training_rows(odd.selectExpr("doc_id + 2 as doc_id", "text", "'aa' as lang")).where("doc_id < 5").count() == 0


def test_the_exchange_teaches_the_content_view(spark):
    """Words that no labelled text has are learnt from the metadata view's pseudo-labels, and judge texts of a source without labels."""
    rng = random.Random(12)
    words = {"labelled": (["plan", "result"], ["spam", "cash"]), "new": (["useful", "idea"], ["click", "win"])}
    rows, tags = [], []
    for i in range(3000):
        good = i % 2 == 1
        kind = "labelled" if i < 300 else "new"
        text = " ".join(rng.choice(words[kind][0 if good else 1]) for _ in range(10))
        rows.append((i, text, "s3" if i >= 2600 else "s1" if good else "s2"))
        if i < 300:
            tags.append((i, int(good), 0))
    tags = spark.createDataFrame(tags, "doc_id long, quality int, toxic int")
    docs = _pages(spark, rows)
    right = {}
    for rounds in (0, 3):
        out = quality.score(docs.where("doc_id >= 2600"), quality.cotrain(docs, tags, rounds=rounds)).collect()
        right[rounds] = np.mean([(r["p_content"] > 0.5) == (r["doc_id"] % 2 == 1) for r in out])
    assert right[0] < 0.8 and right[3] > 0.95, right


def test_summed_newton_steps_are_those_of_all_rows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    whole, parts = (quality._scaled(x.mean(0), x.std(0)) for _ in range(2))
    for _ in range(8):
        whole.step(*whole.sums(x, y))
        sums = [parts.sums(x[a : a + 30], y[a : a + 30]) for a in range(0, 200, 30)]
        parts.step(sum(h for h, _ in sums), sum(g for _, g in sums))
    assert np.allclose(whole.w, parts.w)
    p = 1 / (1 + np.exp(-whole.logit(x)))
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((200, 1))])
    assert np.abs(z.T @ (p - y) + whole.reg * whole.w).max() < 1e-4  # the gradient of the penalised loss is 0
