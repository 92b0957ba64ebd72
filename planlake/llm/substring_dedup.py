"""Substring dedup with broadcast suffix automata of reference shards.

A window is `window` (35) consecutive words of one document. Every word covered by a window whose word sequence also
starts anywhere else, in the same document or another, is removed; windows are judged on the input.

1. Sieve: what is streamed. Each window has an anchor: its smallest 8-word hash, the leftmost of equal ones. Equal windows
   have equal anchors at equal places, so a window can only be repeated if its anchor's hash is. Only anchor hashes are
   counted over the corpus, about one for twelve words. The consecutive windows of a document that share one repeated anchor
   form a piece (at most 62 words), and equal pieces go on as one weighted piece.
2. Reference shards. Pieces are dealt by anchor, so all pieces with a common window meet in one shard of bounded size. A
   group of pieces too large for a shard is split by longer cores: windows that begin 0 to 13 words before the anchor all hold the
   same 22 words around it if they are equal, those that begin 14 to 27 words before it 22 others; each half is dealt by
   these words, a half still too large is split again, and after five splits a core is a whole window, which is one piece
   however often it occurs. Cores that occur once cannot be repeated and go. So a passage in ever new surroundings adds to no shard
   without bound, and every window is decided in the same way.
3. A shard's pieces build one suffix automaton with the weighted number of occurrences of each state.
4. Automata are broadcast in rounds of BROADCAST_BYTES at most, and a round's pieces are streamed through them for matching
   statistics: where the last 35 words are a state that occurs twice or more, the window is repeated. If that took more than
   ROUNDS rounds, the same join of pieces with automata is shuffled by shard instead.
5. The repeated windows of each document make its maximal repeated spans, and their words go.

An automaton meets the pieces of its shard only: sending all automata to all documents would grow with the square of the corpus.
Pieces are taken as equal by 128-bit hashes, windows by their words.

Null and empty text has no words. Repeated rows repeat each other's windows and both lose them. Rows are told apart by
doc_id and a hash of the text; a null doc_id is allowed. Extra columns stay, but for those
named as the result's own (n_words, n_removed, kept, kept_sha256). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planlake.llm.common import as_int64, cut, join_on_counted, mix, settled, shielded, sole, table, text_slices, unshielded, window_hashes, word_hashes, word_spans

WINDOW = 35
GRAM = 8
SHARD_WORDS = 20_000
#: Bytes of automata that are broadcast at once, and how often: what is beyond goes by a shuffle.
BROADCAST_BYTES, ROUNDS = 1 << 23, 128
#: Bytes of an automaton for each word it is built from, about.
WORD_BYTES = 14
#: Row ids that are broadcast to keep other texts out of a shuffle; beyond that the texts are shuffled.
BROADCAST_IDS = 2_000_000

ROW = ["did", "th"]
PIECE = ["p1", "p2"]
UNIT = ["core", "q1", "q2"]


def sliding_argmin(g: np.ndarray, width: int) -> np.ndarray:
    """Leftmost place of the smallest of g[i : i + width], for each i."""
    v, p, size = g, np.arange(len(g)), 1
    while size < width:
        d = min(size, width - size)
        left = v[:-d] <= v[d:]
        v, p = np.where(left, v[:-d], v[d:]), np.where(left, p[:-d], p[d:])
        size += d
    return p


def anchors(w: np.ndarray, first: np.ndarray, window: int, gram: int):
    """text, first window, windows, anchor hash and place of the anchor in the first window, of each run of windows with one anchor."""
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if len(w) < window:
        return empty
    g = window_hashes(w, gram)
    at = sliding_argmin(g, window - gram + 1)
    text = np.searchsorted(first, np.arange(len(w)), "right") - 1
    n = len(at)
    ok = np.flatnonzero(text[:n] == text[window - 1 : window - 1 + n])
    if not len(ok):
        return empty
    a = at[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (a[1:] != a[:-1]) | (text[ok[1:]] != text[ok[:-1]])
    start = np.flatnonzero(new)
    return text[ok[start]], ok[start], np.diff(np.append(start, len(ok))), g[a[start]], a[start] - ok[start]


_Q1, _Q2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)


def span_hashes(w: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each w[start:end]."""
    out = []
    with np.errstate(over="ignore"):
        for q in (_Q1, _Q2):
            inv = np.uint64(pow(int(q), -1, 2**64))
            power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(w), q, np.uint64))))
            back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(w), inv, np.uint64))))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(w ^ q) * power[:-1])))
            out.append(mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)))
    return out[0], out[1]


def _anchor_counts(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for a, _, buf, offs in text_slices(batch.column(2)):
                starts, ends, first = word_spans(buf, offs)
                text, _, _, h, _ = anchors(word_hashes(buf, starts, ends), first, window, gram)
                if not len(h):
                    continue
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(h)))
                rows = a + text[at]
                yield pa.record_batch([pa.array(did[rows]), pa.array(th[rows]), pa.array(as_int64(h[at])), pa.array(n.astype(np.int32))], names=[*ROW, "mhash", "n"])

    return run


def _pieces(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(3)
            for a, b, buf, offs in text_slices(batch.column(2)):
                starts, ends, first = word_spans(buf, offs)
                w = word_hashes(buf, starts, ends)
                text, at, n, h, place = anchors(w, first, window, gram)
                part = lists.slice(a, b - a)
                wanted = as_int64(h)
                bounds = np.searchsorted(text, np.arange(b - a + 1))
                keep = np.zeros(len(h), bool)
                for i in range(b - a):
                    x, y = bounds[i], bounds[i + 1]
                    if y > x:
                        keep[x:y] = np.isin(wanted[x:y], part[i].values.to_numpy())
                text, at, n, wanted, place = text[keep], at[keep], n[keep], wanted[keep], place[keep]
                if not len(at):
                    continue
                p1, p2 = (as_int64(x) for x in span_hashes(w, at, at + n + window - 1))
                rows = a + text
                cols = [did[rows], th[rows], (at - first[text]).astype(np.int32), n.astype(np.int32), place.astype(np.int32), wanted, p1, p2]
                yield pa.record_batch([pa.array(c) for c in cols], names=[*ROW, "i0", "n", "place", "mhash", *PIECE])

    return run


def _contents(window: int):
    """The words of chosen pieces. Rows have did, th, text and own: a list of (i0, n, core, q1, q2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch.column("text"), batch.column("own"), strict=True):
                words, own = (text.as_py() or "").encode().split(), own.values
                at, n = own.field("i0").to_pylist(), own.field("n").to_pylist()
                content = [b" ".join(words[i : i + k + window - 1]) for i, k in zip(at, n, strict=True)]
                yield pa.record_batch([*(own.field(c) for c in UNIT), pa.array(content, pa.binary())], names=[*UNIT, "content"])

    return run


class SuffixAutomaton:
    """A generalised suffix automaton over words, with the weighted number of occurrences of each state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]

    def add(self, seq: list[int], weight: int) -> None:
        nxt, link, ln, count = self.next, self.link, self.len, self.count
        last = 0
        for c in seq:
            q = nxt[last].get(c)
            if q is not None and ln[q] == ln[last] + 1:
                last = q
            else:
                p = last
                if q is None:
                    cur = len(nxt)
                    nxt.append({})
                    ln.append(ln[last] + 1)
                    link.append(0)
                    count.append(0)
                    while p != -1 and c not in nxt[p]:
                        nxt[p][c] = cur
                        p = link[p]
                else:
                    cur = -1
                if p != -1:
                    q = nxt[p][c]
                    if ln[q] != ln[p] + 1:
                        clone = len(nxt)
                        nxt.append(dict(nxt[q]))
                        ln.append(ln[p] + 1)
                        link.append(link[q])
                        count.append(0)
                        while p != -1 and nxt[p].get(c) == q:
                            nxt[p][c] = clone
                            p = link[p]
                        link[q] = clone
                        q = clone
                    if cur >= 0:
                        link[cur] = q
                last = cur if cur >= 0 else q
            count[last] += weight

    def close(self) -> None:
        """Occurrences of a state count for its suffixes."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]

    def arrays(self) -> list[bytes]:
        """Number of moves of each state, their words, how far they lead, links, lengths, and which states occur twice or more."""
        width = np.fromiter(map(len, self.next), np.int32, len(self.next))
        words = np.fromiter(chain.from_iterable(self.next), np.int32, int(width.sum()))
        to = np.fromiter(chain.from_iterable(d.values() for d in self.next), np.int32, len(words))
        ahead = to - np.repeat(np.arange(len(width), dtype=np.int32), width) - 1
        twice = (np.array(self.count) >= 2).astype(np.int32)
        return [_squeezed(x) for x in (width, words, ahead, np.array(self.link, np.int32), np.array(self.len, np.int32), twice)]


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers of 32 bits byte by byte, compressed: most of their upper bytes are equal."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unsqueezed(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1).T).view(np.int32).ravel()


class Matcher:
    """A suffix automaton as it was broadcast."""

    def __init__(self, words: bytes, *arrays: bytes):
        self.ids = {w: i for i, w in enumerate(zstandard.decompress(words).split(b" "))}
        width, labels, ahead, link, length, twice = map(_unsqueezed, arrays)
        state = np.repeat(np.arange(len(width)), width)
        self.moves = dict(zip((state << 32 | labels).tolist(), (state + 1 + ahead).tolist(), strict=True))
        self.link, self.len, self.twice = link.tolist(), length.tolist(), twice.tolist()

    def repeated(self, text: bytes, window: int) -> int:
        """Bit i: words i to i + window of the text occur twice or more in the shard."""
        moves, link, ln, twice = self.moves, self.link, self.len, self.twice
        v = size = out = 0
        for k, word in enumerate(text.split(b" ")):
            c = self.ids.get(word, -1)
            to = moves.get(v << 32 | c) if c >= 0 else None
            while to is None and v and c >= 0:
                v = link[v]
                size = ln[v]
                to = moves.get(v << 32 | c)
            if to is None:
                v = size = 0
                continue
            v, size = to, min(size + 1, window)
            while ln[link[v]] >= size:
                v = link[v]
            if size == window and twice[v]:
                out |= 1 << (k - window + 1)
        return out


AUTOMATON = ["words", "width", "labels", "ahead", "link", "length", "twice"]


def _automaton(turns: int):
    def run(units: pa.Table, contents: pa.Table) -> pa.Table:
        """The automaton of a shard, and the units that are to be streamed through it. Contents of other units are left out."""
        names = ["shard", "units", *AUTOMATON, "turn"]
        weight = dict(zip(zip(*(units.column(c).to_pylist() for c in UNIT), strict=True), units.column("weight").to_pylist(), strict=True))
        own = [weight.get(u) for u in zip(*(contents.column(c).to_pylist() for c in UNIT), strict=True)]
        contents = contents.filter(pa.array([w is not None for w in own], pa.bool_())).combine_chunks()
        if not len(contents):
            return pa.table([pa.array([], t) for t in (pa.int64(), _UNITS, *[pa.binary()] * len(AUTOMATON), pa.int64())], names=names)
        ids: dict[bytes, int] = {}
        automaton = SuffixAutomaton()
        for text, times in zip(contents.column("content").to_pylist(), (w for w in own if w is not None), strict=True):
            automaton.add([ids.setdefault(x, len(ids)) for x in text.split(b" ")], times)
        automaton.close()
        shard = contents.column("shard")[0].as_py()
        rows = pa.StructArray.from_arrays([contents.column(c).chunk(0) for c in (*UNIT, "content")], names=[*UNIT, "content"])
        parts = [zstandard.compress(b" ".join(ids), 1), *automaton.arrays()]
        return pa.table([pa.array([shard]), pa.ListArray.from_arrays([0, len(rows)], rows), *(pa.array([x], pa.binary()) for x in parts), pa.array([shard % turns])], names=names)

    return run


_UNITS = pa.list_(pa.struct([*((c, pa.int64()) for c in UNIT), ("content", pa.binary())]))


def _matched(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                matcher = Matcher(*(batch.column(c)[i].as_py() for c in AUTOMATON))
                units = batch.column("units")[i].values
                masks = [matcher.repeated(c.as_py(), window) for c in units.field("content")]
                yield pa.record_batch([*(units.field(c) for c in UNIT), pa.array(masks, pa.int64())], names=[*UNIT, "mask"])

    return run


def _halves(window: int, most: int):
    """Units of a core whose windows begin low to high words before the anchor become units of two longer cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            contents = batch.column("content").cast(pa.large_binary())
            buf = np.frombuffer(contents.buffers()[2], np.uint8)
            offs = np.frombuffer(contents.buffers()[1], np.int64)[contents.offset : contents.offset + len(contents) + 1]
            buf, offs = buf[offs[0] : offs[-1]], offs - offs[0]
            starts, ends, first = word_spans(buf, offs)
            w, raw = word_hashes(buf, starts, ends), buf.tobytes()
            n, place, low, high = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "place", "low", "high"))
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                # the window j words into the unit begins place - j words before the anchor
                j0, j1 = np.maximum(place - b, 0), np.minimum(place - a, n - 1)
                row = np.flatnonzero((j0 <= j1) & (low < high))
                if not len(row):
                    continue
                j0, m, a_, b_ = j0[row], (j1 - j0 + 1)[row], a[row], b[row]
                at, anchor = first[:-1][row] + j0, first[:-1][row] + place[row]
                q1, q2 = span_hashes(w, at, at + m + window - 1)
                core, _ = span_hashes(w, anchor - a_, anchor - b_ + window)
                core = mix(core + (a_ * most + b_).astype(np.uint64))
                content = [raw[starts[x] : ends[y]] for x, y in zip(at.tolist(), (at + m + window - 2).tolist(), strict=True)]
                take = pa.array(row)
                numbers = {"skip": batch.column("skip").to_numpy()[row] + j0, "n": m, "place": place[row] - j0, "low": a_, "high": b_}
                cols = [*(batch.column(c).take(take) for c in (*PIECE, "weight")), *(pa.array(as_int64(x)) for x in (core, q1, q2)), *(pa.array(x.astype(np.int32)) for x in numbers.values()), pa.array(content, pa.binary())]
                yield pa.record_batch(cols, names=[*PIECE, "weight", *UNIT, *numbers, "content"])

    return run


_KINDS = "p1 bigint, p2 bigint, weight bigint, core bigint, q1 bigint, q2 bigint, skip int, n int, place int, low int, high int, content binary"


def _sized(once: DataFrame, shard_words: int, window: int) -> tuple[DataFrame, DataFrame]:
    """Units whose core occurs twice or more: those of groups that a shard can hold, and the others. once: a row for each content of a core."""
    groups = once.groupBy("core").agg(F.count(F.lit(1)).alias("units"), F.sum("weight").alias("times"), F.sum(F.col("n") + window - 1).alias("in_core")).where("times > 1")
    kept = cut(join_on_counted(once, groups, ["core"], "units", once.count()).where("times > 1"))  # read five times
    fits = (F.col("in_core") <= shard_words) | (F.col("low") == F.col("high"))
    return kept.where(fits), kept.where(~fits)


def unit_masks(units: DataFrame, contents: DataFrame, window: int, shard_words: int, broadcast_bytes: int, rounds: int) -> DataFrame:
    """core, q1, q2, mask (a table): which windows of a unit are repeated, of those that have any. units: core, q1, q2, weight, n; contents: core, q1, q2, content."""
    words = units.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    turns = max(1, -(-words * WORD_BYTES // broadcast_bytes))
    by_broadcast = turns <= rounds
    shard = F.pmod(F.xxhash64("core"), F.lit(shards)).alias("shard")
    # equal contents are dropped where the shard is, before its group is formed
    sent = contents.select(shard, *UNIT, "content").repartition("shard").dropDuplicates(["shard", *UNIT])
    kinds = "shard bigint, units array<struct<core bigint, q1 bigint, q2 bigint, content binary>>, " + ", ".join(f"{c} binary" for c in AUTOMATON) + ", turn bigint"
    pairs = units.select(shard, *UNIT, "weight").groupBy("shard").cogroup(sent.groupBy("shard"))
    made = cut(pairs.applyInArrow(_automaton(turns if by_broadcast else 1), kinds), by="turn")
    sizes = dict(made.groupBy("turn").agg(F.sum(sum((F.octet_length(c) for c in AUTOMATON), F.lit(0)))).collect())  # a row for each turn
    out = None
    for turn, size in sorted(sizes.items()):
        own = made.where(F.col("turn") == turn)
        automata = own.select("shard", *AUTOMATON)
        if by_broadcast and size <= 2 * broadcast_bytes:
            automata = F.broadcast(automata)
        masks = cut(own.select("shard", "units").join(automata, "shard").mapInArrow(_matched(window), "core bigint, q1 bigint, q2 bigint, mask bigint").where("mask <> 0"))
        out = masks if out is None else out.unionByName(masks)
    return out if out is not None else units.select(*UNIT, F.lit(0).cast("bigint").alias("mask")).limit(0)


def piece_masks(lean: DataFrame, occ: DataFrame, window: int, gram: int, shard_words: int, broadcast_bytes: int, rounds: int) -> DataFrame:
    """p1, p2, mask, times: which windows of a piece are repeated, and how often the piece occurs. Pieces without such a window have no row."""
    spark, most = occ.sparkSession, window - gram
    carrier = F.min(F.struct(*ROW, "i0")).alias("carrier")  # one place where the piece's words are read
    pieces = cut(occ.groupBy(*PIECE).agg(F.count(F.lit(1)).alias("weight"), *(F.first(c).alias(c) for c in ("mhash", "n", "place")), carrier))
    as_unit = {"mhash": "core", "p1": "q1", "p2": "q2"}
    small, large = _sized(pieces.withColumns({"low": F.lit(0), "high": F.lit(most)}).withColumnsRenamed(as_unit), shard_words, window)

    def read() -> DataFrame:
        chosen = small.unionByName(large).select("carrier.did", "carrier.th", F.struct("carrier.i0", "n", *UNIT).alias("x"))
        own = cut(chosen.groupBy(*ROW).agg(F.collect_list("x").alias("own")))
        texts = _only(lean, own)[0].join(own, ROW).select(*ROW, "text", "own")
        return texts.mapInArrow(_contents(window), "core bigint, q1 bigint, q2 bigint, content binary")

    contents = sole(spark, read)
    masks = sole(spark, lambda: unit_masks(small, contents, window, shard_words, broadcast_bytes, rounds))
    masks = masks.select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), "mask")
    large = cut(large.select(*UNIT, "weight", "n", "place", "low", "high"))
    if large.take(1):
        whole = contents.join(large, UNIT).dropDuplicates(UNIT).withColumns({"p1": F.col("q1"), "p2": F.col("q2"), "skip": F.lit(0)})
        split = whole.select(*PIECE, "weight", "skip", "n", "place", "low", "high", "content")
        while True:
            split = cut(split.mapInArrow(_halves(window, most + 1), _KINDS))
            once = split.groupBy(*UNIT).agg(F.sum("weight").alias("weight"), *(F.first(c).alias(c) for c in ("n", "low", "high")), F.count(F.lit(1)).alias("times"))
            once = cut(once)
            small, large = _sized(once.drop("times"), shard_words, window)
            found = sole(spark, lambda small=small, split=split: unit_masks(small, split.select(*UNIT, "content"), window, shard_words, broadcast_bytes, rounds))
            times = once.select(*UNIT, "times")
            found = join_on_counted(split.select(*UNIT, *PIECE, "skip"), found.join(times, UNIT), UNIT, "times", split.count())
            masks = masks.unionByName(found.select(*PIECE, F.expr("shiftleft(mask, skip)").alias("mask")))
            large = cut(large.select(*UNIT))
            if not large.take(1):
                break
            split = join_on_counted(split, times.join(large, UNIT), UNIT, "times", split.count()).drop(*UNIT, "times")
    masks = masks.groupBy(*PIECE).agg(F.bit_or("mask").alias("mask"))
    return masks.join(pieces.select(*PIECE, F.col("weight").alias("times")), PIECE)


def _only(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs whose did is in ids, and the others if ids are few enough to be sent to all tasks."""
    ids = ids.select("did").distinct()
    if ids.count() > BROADCAST_IDS:
        return docs, None
    return docs.join(F.broadcast(ids), "did", "left_semi"), docs.join(F.broadcast(ids), "did", "left_anti")


def _removal(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i0s, masks = batch.column("i0s"), batch.column("masks")
            rest = [i for i, name in enumerate(batch.schema.names) if name not in ("i0s", "masks", "did", "th")]
            n_words, n_removed, kept, sha = [], [], [], []
            for a, b, buf, offs in text_slices(batch.column("text")):
                raw = buf.tobytes()
                for i in range(b - a):
                    words = raw[offs[i] : offs[i + 1]].split()
                    removed = 0
                    if i0s[a + i].is_valid:
                        step = np.zeros(len(words) + 1, np.int64)
                        for at, mask in zip(i0s[a + i].as_py(), masks[a + i].as_py(), strict=True):
                            bit = 0
                            while mask >> bit:
                                if mask >> bit & 1:
                                    step[at + bit] += 1
                                    step[at + bit + window] -= 1
                                bit += 1
                        stay = np.cumsum(step[:-1]) == 0
                        removed = int(len(words) - stay.sum())
                        n_words.append(len(words))
                        words = list(compress(words, stay.tolist()))
                    else:
                        n_words.append(len(words))
                    text = b" ".join(words)
                    n_removed.append(removed)
                    kept.append(text.decode() if with_text and n_removed[-1] else None)
                    sha.append(hashlib.sha256(text).hexdigest())
            cols = [batch.column(i) for i in rest]
            yield pa.record_batch([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], names=[*(batch.schema.names[i] for i in rest), "n_words", "n_removed", "kept", "kept_sha256"])

    return run


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, broadcast_bytes: int = BROADCAST_BYTES, rounds: int = ROUNDS, with_text: bool = True
) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and kept: the words that stay, joined by one space; null where none went."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = docs.columns
    docs, names = shielded(docs)
    keyed = docs.withColumns({"did": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), "th": F.xxhash64(text)})
    lean = keyed.select(*ROW, "text")
    spark = docs.sparkSession

    def anchor_lists() -> DataFrame:
        counted = cut(lean.mapInArrow(_anchor_counts(window, gram), "did bigint, th bigint, mhash bigint, n int"))
        twice = cut(counted.groupBy("mhash").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 1").select("mhash", "rows"))
        return join_on_counted(counted, twice, ["mhash"], "rows", counted.count()).groupBy(*ROW).agg(F.collect_set("mhash").alias("anchors"))

    def covered() -> DataFrame:
        lists = sole(spark, anchor_lists)
        with_anchors = _only(lean, lists)[0]
        occ = sole(spark, lambda: with_anchors.join(lists, ROW).mapInArrow(_pieces(window, gram), "did bigint, th bigint, i0 int, n int, place int, mhash bigint, p1 bigint, p2 bigint"))
        masks = sole(spark, lambda: piece_masks(lean, occ, window, gram, shard_words, broadcast_bytes, rounds))
        covers = join_on_counted(occ.select(*ROW, "i0", *PIECE), masks, PIECE, "times", occ.count()).select(*ROW, "i0", "mask").distinct()
        return covers.groupBy(*ROW).agg(F.collect_list(F.struct("i0", "mask")).alias("c")).select(*ROW, F.col("c.i0").alias("i0s"), F.col("c.mask").alias("masks"))

    covers = sole(spark, covered)
    hit, other = _only(keyed, covers)
    out = hit.join(covers, ROW, "left")
    if other is not None:
        none = {"i0s": F.lit(None).cast("array<int>"), "masks": F.lit(None).cast("array<bigint>")}
        out = out.unionByName(other.withColumns(none).select(*out.columns))
    added = [T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()), ("kept_sha256", T.StringType()))]
    out = out.select(*docs.columns, *ROW, "i0s", "masks")
    out = out.mapInArrow(_removal(window, with_text), T.StructType([*docs.schema.fields, *added]))
    return unshielded(out, names, [f.name for f in added], columns)


@settled
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
with t as (select doc_id, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, i, array_to_string(w[i:i+34], ' ') as win from t, lateral (select unnest(range(1, greatest(len(w) - 33, 1))) as i)),
r as (select doc_id, i, count(*) over (partition by win) > 1 as rep from s),
g as (select distinct doc_id, i + o as k from r, (select unnest(range(0, 35)) as o) where rep),
w as (select doc_id, k, w[k] as word from t, lateral (select unnest(range(1, len(w) + 1)) as k)),
j as (select w.*, g.k is not null as gone from w left join g using (doc_id, k)),
a as (select doc_id, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by k) filter (where not gone) as kept from j group by 1)
select t.doc_id, len(t.w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from t left join a using (doc_id)
"""
