import random
import zlib

import numpy as np
import pytest

from planlake.llm import chat_format, nearest, packing, sentencepiece_codec

ODD = [None, "", " ", "\n", "Don't PANIC: it's 2024!! <|endoftext|> über-ñandú ½ ²", "日本語 テスト", "a b\u0085c", "Σίσυφος İ", "<|startoftext|>x", "…,.,", "x" * 5000]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_nearest_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CANDIDATES", 60)
    monkeypatch.setattr(nearest, "QUERIES", 7)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[40:90] = v[40]  # ties
    v[100] *= 1e-20
    v[101] *= 1e20
    rows = [(i, v[i].tolist()) for i in range(300)]
    bad = [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, [1.0, 2.0]), (320, [float("inf")] * 16), (None, [1.0] * 16), (0, v[0].tolist())]
    df = vectors(spark, rows + bad)
    got = {}
    for r in nearest.nearest(df, df.where("vec_id % 20 = 0"), k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    v64 = v.astype(float)
    for q in range(0, 300, 20):
        s = np.zeros(300)
        for j in range(16):
            s += v64[:, j] * v64[q, j]
        all_ = [(i, s[i]) for i in range(300) if i != q] + ([(0, s[0])] if q else [])
        all_.sort(key=lambda x: (-x[1], x[0]))
        want[q] = [(k + 1, i, x) for k, (i, x) in enumerate(all_[:10])]
    assert {q: sorted(x) for q, x in got.items()} == want


def test_nearest_edges(spark):
    e = vectors(spark, [])
    assert nearest.nearest(e, e).count() == 0
    few = vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])])
    got = [(r["rank"], r["vec_id"]) for r in nearest.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]


def test_encoder_is_the_tokenizer():
    encoder = packing.UnitEncoder(packing.default_tokenizer())
    rng = random.Random(8)
    alphabet = "abcÀÉßµªº²½ 019'stredvml.,!?<|>-_\n\t\xa0\x85\x1c\x00éñ€Σİ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += [t.encode("latin-1", "ignore").decode("latin-1") for t in texts] + ODD
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert encoder.full.encode(t or "", add_special_tokens=False).ids == ids.tolist(), t


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    encoder = packing.UnitEncoder(packing.default_tokenizer())
    texts = [f"word{i} and letters like {chr(97 + i % 26) * (i % 7 + 1)}" for i in range(200)]
    for a in range(0, 200, 8):
        for t, ids in zip(texts[a : a + 8], encoder.encode(texts[a : a + 8]), strict=True):
            assert encoder.full.encode(t, add_special_tokens=False).ids == ids.tolist()


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    size = 100
    counts = {n: rng.choice([1, 2, 7, 500]) for n in rng.sample(range(1, size + 1), rng.randint(1, 60))}
    slots, used = {}, {}
    for length, rank0, n, seq0, each, place in packing.best_fit_plan(counts, size):
        for i in range(n):
            s, o = seq0 + i // each, place + i % each * length
            assert (length, rank0 + i) not in slots
            slots[length, rank0 + i] = s, o
            used.setdefault(s, []).append((o, length))
    assert set(slots) == {(x, r) for x, c in counts.items() for r in range(c)}
    for parts in used.values():
        end = 0
        for o, length in sorted(parts):
            assert o == end
            end += length
        assert end <= size
    # best fit, item by item
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((r for r in rooms if r >= length), default=None)
            rooms.append((fit if fit is not None else size) - length)
            if fit is not None:
                rooms.remove(fit)
    assert len(used) == len(rooms)


def test_packing(spark):
    texts = ODD + ["many words " * 3000, "many words " * 3000]
    df = spark.createDataFrame([(i % 9, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    rows = packing.packed_documents(df, size=512, with_ids=True).collect()
    full = packing.UnitEncoder(packing.default_tokenizer()).full
    want = sorted((i % 9, *full.encode(t or "", add_special_tokens=False).ids, 1) for i, t in enumerate(texts))
    pieces = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 512 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["start"] == r["piece"] * 512
        pieces.setdefault((r["doc_id"], r["piece"]), []).append(r["ids"])
    assert sorted(x for r in rows for x in r["ids"]) == sorted(x for w in want for x in w[1:])
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 512
    assert packing.packed_documents(df.limit(0)).count() == 0


def test_sentencepiece_is_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    rng = random.Random(9)
    texts = ODD + ["  Hello   world\n\tfoo", "aaaa bbbb    cc"] + ["".join(rng.choice("abcdethinors .,AE-'  \né😀") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = sentencepiece_codec.encode(df)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert all(ids[i] == sp.encode(t or "") for i, t in enumerate(texts))
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(encoded).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(df.limit(0))).count() == 0


def _pair(spark, rows):
    df = spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string")
    return {r["pair_id"]: r for r in chat_format.preference_pairs(df).collect()}


def test_preferences(spark):
    rows = [(1, s, 0, "user", "Hi") for s in ("chosen", "rejected")] + [(1, "chosen", 1, "assistant", "good"), (1, "rejected", 1, "assistant", "bad"), (1, "rejected", 2, "user", None)]
    rows += [(2, s, 0, "user", "same") for s in ("chosen", "rejected")] + [(3, "chosen", 0, None, "alone"), (None, "chosen", 0, "user", "x"), (4, "other", 0, "user", "x")]
    got = _pair(spark, rows)
    assert set(got) == {1, 2, 3}
    assert (got[1]["prompt"], got[1]["chosen"], got[1]["prompt_turns"]) == ("<|user|>\nHi<|end|>\n", "<|assistant|>\ngood<|end|>\n", 1)
    assert got[1]["chosen_mask"] == "0:14,1:12" and got[1]["rejected_mask"] == "0:14,1:11,0:9,0:8" and got[1]["complete"]
    assert (got[2]["prompt_turns"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "")
    assert not got[3]["complete"] and got[3]["rejected"] == "" and got[3]["chosen"].startswith("<||>\nalone")
    for r in got.values():
        for side in ("chosen", "rejected"):
            runs = [x.split(":") for x in r[f"{side}_mask"].split(",") if x]
            assert sum(int(n) for _, n in runs) == len(r[side])
    assert _pair(spark, []) == {}


def test_repeated_query_ids_and_clashing_columns(spark):
    """Of several vectors of one query id the smallest is searched for."""
    df = vectors(spark, [(0, [2.0, 0.0]), (0, [1.0, 5.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]).selectExpr("*", "'c' as v", "'c' as dim", "'c' as block", "'c' as score")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in nearest.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 2, 5.0), (2, 1, 1.0)]


def test_pairs_of_large_ids(spark, tmp_path):
    ids = [2**53 + k for k in range(4)]
    spark.createDataFrame([(i, 0, "user", f"text {i}") for i in ids], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["pair_id"]: r["complete"] for r in chat_format.op6_chat_format(spark, str(tmp_path)).collect()}
    assert got == {2**52: True, 2**52 + 1: True}


def test_ranks_of_one_length_are_dealt_out(spark):
    rows = [(i, 0, 0, 7, i) for i in range(500)] + [(1, 0, 0, 7, 1)] * 3
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = sorted(r["rank"] for r in packing.ranked(pieces, {7: 503}, per_task=40).collect())
    assert got == list(range(503))


def test_long_words_are_not_remembered(spark):
    codec = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    codec.encode(["short " + "x" * 5000])
    assert max(map(len, codec.known)) <= sentencepiece_codec.LONGEST
    encoder = packing.UnitEncoder(packing.default_tokenizer())
    encoder.encode(["short " + "x" * 5000])
    assert max(len(w) for kind in encoder.caches.values() for part in kind for w in part) <= packing.LONGEST
    rows = [(0, "chosen", 0, "user", "y" * 300_000), (0, "chosen", 0, "user", "y" * 300_000), (0, "rejected", 0, "user", "n")]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string").selectExpr("*", "'c' as t", "'c' as n", "'c' as prompt")
    one = chat_format.preference_pairs(df).collect()
    assert len(one) == 1 and len(one[0]["chosen"]) == 2 * (300_000 + len("<|user|>\n<|end|>\n"))
