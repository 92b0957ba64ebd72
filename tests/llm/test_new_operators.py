"""Merkle manifest, hard negatives and page text against plain versions."""

import hashlib
import math
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from planlake.llm import hard_negatives, html_extract, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(part, (doc_id, source, lang, n_chars, text))))


def plain_manifest(docs):
    """Rows of (doc_id, leaf, subroot, root, proof, folded, verified)."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    sources = {}
    for d in docs:
        i, text, lang, source, n = d
        lost = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        now = leaf_of(i, text.replace("\n", "") if lost and text is not None else text, lang, source, n)
        sources.setdefault(source, []).append(((i is not None, i or 0), leaf_of(*d), now, i))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf for _, leaf, _, _ in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for t, s in enumerate(order):
        for p, (_, leaf, now, i) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            proof, folded = "", now
            for nodes, at in ((trees[s], p), (top, t)):
                for row in nodes[:-1]:
                    run = row[at // 3 * 3 : at // 3 * 3 + 3]
                    before, after = "".join(run[: at % 3]), "".join(run[at % 3 + 1 :])
                    proof, folded, at = proof + before + after, sha(before + folded + after), at // 3
            out.append((i, leaf, trees[s][-1][0], top[-1][0], sha(proof), folded, folded == top[-1][0]))
    return out


def manifest(spark, docs, monkeypatch=None):
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "'clash' as leaf", "'clash' as row", "'clash' as tree", "'clash' as n")
    lost = F.crc32(F.col("__doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.manifest(df, {"text": F.when(lost, F.translate("__text", "\n", "")).otherwise(F.col("__text"))})
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in got.select(*cols).collect()]


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def test_manifest(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 20)
    rng = random.Random(3)
    docs = [(i, rng.choice(["a\nb", "plain", "", None, "ü\n日本" * 50, "x" * 100_000 + "\n"]), rng.choice(["en", None]), rng.choice(["hot", "hot", "b", "é", "Z", "", None]), rng.choice([None, 5])) for i in range(90)]
    docs += [(None, "no id\n", None, "hot", 1), (7, "again\n", None, "hot", 1), (7, "again\n", None, "hot", 1), (7, "again\n", None, "hot", 1), (200, "alone\n", "en", "single", 3)]
    assert same(manifest(spark, docs), plain_manifest(docs))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10])
def test_small_manifests(spark, n):
    docs = [(i, f"t\n{i}", "en", "s", i) for i in range(n)]
    assert same(manifest(spark, docs), plain_manifest(docs))
    each = [(i, f"t\n{i}", "en", f"s{i}", i) for i in range(n)]
    if n in (1, 4):
        assert same(manifest(spark, each), plain_manifest(each))


def test_any_change_is_found(spark):
    docs = [(i, "text", "en", f"s{i % 3}", i) for i in range(30)]
    df = spark.createDataFrame(docs, SCHEMA)
    for name, new in (("text", F.lit("texts")), ("n_chars", F.lit(None).cast("long")), ("lang", F.lit("")), ("doc_id", F.col("__doc_id") + 1)):
        changed = F.when(F.col("__doc_id") == 11, new).otherwise(F.col(f"__{name}"))
        got = {r["doc_id"]: r["verified"] for r in merkle.manifest(df, {name: changed}).collect()}
        assert got == {i: i != 11 for i in range(30)}


def plain_negatives(rows, is_anchor, positives=5, negatives=3):
    """rows: (id, label, vector)."""
    live = [(i, lb, [math.floor(256 * x) for x in v]) for i, lb, v in rows if i is not None and lb is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    held = lambda x: max(-(2**63), min(2**63 - 1, x))
    anchors = {}
    for i, lb, v in live:
        if is_anchor(i) and (i not in anchors or (v, lb) < anchors[i]):
            anchors[i] = v, lb
    out = []
    for a, (v, lb) in anchors.items():
        scored = sorted((-held(sum(x * y for x, y in zip(v, w, strict=True))), i, other == lb) for i, other, w in live if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            found = [(n, i) for n, i, own in scored if not own and -50 * s <= -100 * n <= -95 * s][:negatives]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(found)]
    return out


def negatives(spark, rows, every=10):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "'c' as v", "'c' as dim", "'c' as low", "'c' as block", "'c' as score")
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % every == 0, F.col("label"))
    return [tuple(r)[:6] for r in got.collect()]


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 50)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "STEP", 30)
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(4)]
    rows = [(i, rng.randrange(4), [x + rng.gauss(0, 0.6) for x in base[rng.randrange(4)]]) for i in range(260)]
    rows += [(i, 1, rows[3][2]) for i in range(260, 300)]  # ties
    rows += [(11, 2, rows[11][2])] * 3 + [(20, 0, rows[5][2]), (20, 3, rows[6][2])]  # repeated rows, and an anchor's id again
    rows += [(None, 1, rows[0][2]), (301, None, rows[0][2]), (302, 1, None), (303, 1, [None] * 24), (304, 1, [float("nan")] * 24), (305, 1, [float("inf")] * 24)]
    rows += [(310, 1, [1.0, 2.0]), (311, 1, [1.5, 2.0]), (312, 2, [1.0, 1.5]), (320, 2, []), (321, 2, []), (322, 3, []), (330, 1, [0.0] * 24)]
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 100
    assert same(negatives(spark, rows), want)


def test_scores_of_any_size(spark):
    rows = [(0, 1, [1e8, 3.0]), (1, 1, [1e8, 1.0]), (2, 2, [7e7, 5.0]), (3, 2, [6e7, 0.1]), (4, 2, [1e8, 0.0]), (10, 1, [1e30, 1.0]), (12, 1, [1e-30, 1.0]), (13, 3, [1e-30, 0.7]), (14, 3, [1e300, -1e300])]
    assert same(negatives(spark, rows), plain_negatives(rows, lambda i: i % 10 == 0))
    assert negatives(spark, []) == []


def test_segment_bounds_hold_and_decide(monkeypatch):
    """Bounds enclose the products at each level, get narrower, and leave few pairs of segments that are near constant."""
    import numpy as np

    rng = np.random.default_rng(2)
    v = np.floor(256 * (np.repeat(rng.normal(size=(400, 16)), 4, axis=1) + 0.05 * rng.normal(size=(400, 64))))
    kind, data = hard_negatives._stored(v)
    means, devs = hard_negatives.summary(v)
    row = {"dim": 64, "kind": kind, "ids": np.arange(400).tobytes(), "labels": (np.arange(400) % 4).tobytes(), "vectors": data, "means": means.tobytes(), "devs": devs.tobytes()}
    row |= {"low": np.full(400, -(2**63)).tobytes(), "high": np.full(400, 2**63 - 1).tobytes()}
    block = hard_negatives.Block(row)
    exact, width = v @ v.T, np.inf
    for level in range(len(block.levels)):
        low, high = hard_negatives.bounds(block, block, slice(None), level, None, None)
        assert (low <= exact).all() and (exact <= high).all()
        assert (high - low).mean() < width
        width = (high - low).mean()
    scored = []
    products = hard_negatives.products
    monkeypatch.setattr(hard_negatives, "products", lambda q, c, cols, i, j: (scored.append(len(i)), products(q, c, cols, i, j))[1])
    hard_negatives.tile(block, block, 5, same_label=True)
    assert sum(scored) < 0.15 * 400 * 100


PROSE = "It was the best of times and it was the worst of times, and this is the long text that we have all read in the years of our youth, as it is known to be good for all of you in the end of it, which is not all that can be said."


def test_page_without_an_article_element():
    page = f"""<html><head><title>T</title></head><body class="has-sidebar"><header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
    <div class=menu><a href=x>one</a> <a href=y>two</a></div><div class="content"><h2>The title</h2><p>{PROSE}</p><p>Short &amp; plain.<ul><li>item <a href=q>ref</a> of many words<li>another</ul><p>{PROSE}</div>
    <div class="comments"><p>{PROSE}</p></div><aside>Related</aside><form><label>Name</label></form><script>if (a<b) write("<p>x</p>")</script><div>&copy; 2020</div><p>Call now</p></body>"""
    assert html_extract.main_text(page)[0] == f"The title\n{PROSE}\nShort & plain.\nitem ref of many words\nanother\n{PROSE}"


def test_parts_of_articles():
    text = lambda x: html_extract.main_text(x)[0]
    assert text('<article><header><h1>Head</h1></header><p>Hi <span class="ad">buy</span>there</p><nav>n</nav><section class="comments"><article>c</article></section></article><p>tail') == "Head\nHi there"
    assert text("<main><p>a<b>c</p>d<br>e<br> <br>f <i>g</i>&nbsp;h&lt;p&gt; &amp &bogus; &#x41;<!-- x > --></main>") == "ac\nd e\nf g h<p> & &bogus; A"
    assert text('<article><p>one<p class="notice">two<p>three<table><tr><td>x<td>y<tr><td>z</table></article>') == "one\nthree\nx\ny\nz"
    assert text("<article>a text with <a href=x>link</a></article><article><a href=x>only links here</a></article>") == "a text with link"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>n</nav>")[:1] + (0,) == ("", 0)
    assert text("<article>1 < 2 and <3 <p title='a > b'>x</article>") == "1 < 2 and <3\nx"


def test_ambiguous_blocks_inherit():
    """Short blocks take the label of the nearest decided block; headings look ahead at equal distance."""
    links = "<p><a href=x>a link that is all of this block</a></p>"
    at = lambda x: html_extract.main_text(x)[0].split("\n")
    assert at(f"{links}<p>near links</p><p>nearer to prose</p><p>{PROSE}</p>") == ["nearer to prose", PROSE]
    assert at(f"{links}<h2>Title</h2><p>{PROSE}</p><p>End.</p>{links}") == ["Title", PROSE, "End."]
    assert at(f"{links}<p>Middle</p><p>{PROSE}</p>") == [PROSE]


def test_broken_pages_take_linear_time():
    for page in ("<b>" * 50_000 + "</i>" * 50_000, '<div class="' * 30_000, "<p>" * 50_000, "<!--" * 50_000, "<svg '" * 30_000, "<span><b>" * 20_000 + "</span>" * 20_000, "&" * 100_000, "<td>" * 50_000):
        began = time.time()
        assert html_extract.main_text(page)[0] == ""
        assert time.time() - began < 10


def test_pages_table(spark):
    rows = [(1, "u", f"<article>{PROSE * 2000}</article>"), (1, "u", None), (None, None, ""), (2, "v", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as text", "'c' as n_chars", "'c' as __html")
    got = sorted((repr(r["page_id"]), r["n_chars"], len(r["text"])) for r in html_extract.extract(df).collect())
    assert got == [("1", 0, 0), ("1", len(PROSE) * 2000, len(PROSE) * 2000), ("2", 0, 0), ("None", 0, 0)]
    assert html_extract.extract(df.limit(0)).count() == 0
