"""Best-fit packing planned on a histogram of lengths.

Token counts are pre-aggregated to one row per length, at most `size` rows however many documents there are.
The plan fills sequences best-fit, longest first, over those counts: sequences of equal room are one interval
of numbers, so the plan is a short list of segments (length, ranks, sequences, place). Documents get a rank
within their length from per-bucket counts (no length is ranked in one task) and take the slot planned for
(length, rank) by a join.

Null text is empty: it still has the end id. Repeated rows are packed each on its own. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlake.llm.common import cut, settled, table

SIZE = 4096
END_ID = 1
#: Units whose ids a worker remembers, and how long they may be: longer ones are encoded each time.
REMEMBERED = 800_000
LONGEST = 64
#: Pieces of one length that a task ranks, on average.
RANK_ROWS = 100_000
CHUNK = 65_536

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The tokenizer's own split of lower-cased text, with its classes spelt out for Latin-1.
_L, _N, _S = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_UNIT = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_SPACE = re.compile("[\t-\r ]+")
#: Bytes of texts that replace() and split() can split: letters, white space, and stops and commas that stand alone.
_SIMPLE = bytes(i for i in range(256) if re.match(f"[{_L}A-Z\xc0-\xd6\xd8-\xde.,\t-\r ]", chr(i)))
_RUNS = re.compile("[.,]{2}")


def units(text: str) -> list[str] | None:
    """The tokenizer's words of a text, lower-cased; None for texts that it may treat otherwise."""
    if "<|" in text:
        return None
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    text = text.lower()
    if raw.translate(None, _SIMPLE) or _RUNS.search(text):
        return _UNIT.findall(text)
    return text.replace(",", " , ").replace(".", " . ").split()


class UnitEncoder:
    """Encodes texts by units, each distinct unit once.

    Units are words as the tokenizer splits them. They are encoded joined by spaces, by its model without the
    steps that made the units; each ends with the only id of its own that closes a word. Texts that units() leaves are split between
    ASCII white space, which the tokenizer drops and no token spans. A worker keeps what it has learnt for its next tasks: REMEMBERED
    units at most, of which the older half goes when the younger is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.full.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.closes[i] = token.endswith("</w>")
        self.caches: dict[bool, list[dict[str, bytes]]] = {True: [{}, {}], False: [{}, {}]}

    def _encoded(self, texts: list[str], whole: bool) -> list[np.ndarray]:
        tokenizer = self.full if whole else self.bare
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learnt(self, parts: set[str], simple: bool) -> dict[str, bytes]:
        """A cache that has all parts."""
        young, old = self.caches[simple]
        fresh = parts.difference(young)
        if len(young) + len(fresh) > REMEMBERED // 2:
            young, old = {}, young
            self.caches[simple] = [young, old]
            fresh = parts
        again = [p for p in fresh if p in old]
        young.update(zip(again, map(old.__getitem__, again), strict=True))
        new = list(fresh.difference(again))
        for a in range(0, len(new), 512):
            part = new[a : a + 512]
            if simple:
                ids = self._encoded([" ".join(part)], False)[0]
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(part):
                    raw, at = ids.tobytes(), (ends * 4).tolist()
                    young.update(zip(part, [raw[x:y] for x, y in zip([0, *at], at, strict=False)], strict=True))
                    continue
            young.update(zip(part, [x.tobytes() for x in self._encoded(part, True)], strict=True))
        return young

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [units(t or "") for t in texts]
        simple = [p is not None for p in split]
        split = [_SPACE.split(t) if p is None else p for p, t in zip(split, texts, strict=True)]
        parts = {kind: set(chain.from_iterable(p for p, s in zip(split, simple, strict=True) if s is kind)) for kind in (True, False)}
        known = {kind: self._learnt(own, kind) for kind, own in parts.items()}
        out = [np.frombuffer(b"".join(map(known[s].__getitem__, p)), "<u4") for p, s in zip(split, simple, strict=True)]
        for kind, own in parts.items():
            for p in own:
                if len(p) > LONGEST:
                    del known[kind][p]
        return out


_encoders: dict[str, UnitEncoder] = {}


def encoder_of(path: str) -> UnitEncoder:
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    path = tokenizer or default_tokenizer()
    schema = PIECES if with_ids else pa.schema([f for f in PIECES if f.name != "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        end = np.array([END_ID], "<u4")
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                cols: dict[str, list] = {f.name: [] for f in schema}
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids = np.concatenate((ids, end))
                    for k, start in enumerate(range(0, len(ids), size)):
                        piece = ids[start : start + size]
                        row = {"doc_id": doc_id, "piece": k, "start": start, "length": len(piece), "ids_crc32": zlib.crc32(piece.tobytes()), "ids": piece}
                        for name, values in cols.items():
                            values.append(row[name])
                yield pa.record_batch([pa.array(cols[f.name], f.type) for f in schema], schema=schema)

    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, kinds)


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, ranks, first sequence, ranks in each sequence, offset of the first).

    Longest first, each item into the fullest sequence that has room. Work and result depend on the number of
    distinct lengths alone.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted
    open_: dict[int, list[tuple[int, int]]] = {}  # room: intervals (first sequence, sequences)
    used = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
                fits = room // length
                full = min(n, left // fits)
                took, each = (full, fits) if full else (1, left)
                put(room, first + took, n - took)
            else:
                room, first, fits = size, used, size // length
                full = left // fits
                took, each = (full, fits) if full else (1, left)
                used += took
            out.append((length, rank, took * each, first, each, size - room))
            put(room - each * length, first, took)
            rank += took * each
            left -= took * each
    return out


def ranked(pieces: DataFrame, counts: dict[int, int], per_task: int = RANK_ROWS) -> DataFrame:
    """rank: a number from 0 within each length, without a gap. Lengths are dealt into as many buckets as their counts ask for."""
    spark = pieces.sparkSession
    dealt = spark.createDataFrame([(k, -(-n // per_task)) for k, n in counts.items()], "length bigint, buckets bigint")  # a row for each length
    p = pieces.join(F.broadcast(dealt), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("buckets"))).drop("buckets")
    per = p.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for per_task pieces
    per = per.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        p.withColumn("nth", F.row_number().over(within))
        .join(per, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("nth") - 1)
        .drop("bucket", "nth", "before")
    )


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces with sequence_id and offset. Column `length` is from 1 to size."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    segments = spark.createDataFrame(best_fit_plan(counts, size), "length bigint, rank0 bigint, n bigint, seq0 bigint, each bigint, place bigint")
    chunks = segments.withColumn("low", F.explode(F.expr(f"sequence(0L, n - 1, {CHUNK}L)")))
    slots = chunks.withColumn("i", F.explode(F.expr(f"sequence(low, least(low + {CHUNK - 1}L, n - 1))"))).select(
        "length",
        (F.col("rank0") + F.col("i")).alias("rank"),
        (F.col("seq0") + F.floor(F.col("i") / F.col("each"))).alias("sequence_id"),
        (F.col("place") + F.expr("mod(i, each)") * F.col("length")).alias("offset"),
    )
    return ranked(pieces, counts).join(slots, ["length", "rank"]).drop("rank")


def packed_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    out = pack(cut(token_pieces(docs, tokenizer, size, with_ids)), size)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return out.select(*cols, *["ids"] * with_ids)


@settled
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
