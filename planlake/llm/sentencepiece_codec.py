"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Each task takes the distinct marked words of an Arrow batch that it does not know yet, sorts them, and walks their
trie depth-first: going from one sorted word to the next keeps the forward states of the common prefix and adds
the new letters only. Nothing is shuffled, and a worker remembers a bounded number of words.

The model at hand is a BPE model, for which the highest sum of piece scores would not be the library's
segmentation. The forward pass therefore scores transitions: a piece may follow another if BPE leaves the two apart
when it encodes their concatenation, and may stand at all if BPE makes it from its own letters. For BPE exactly one
path has no forbidden transition, so the forward score is 0 or -inf, a state is the last piece of the best
path, and the result equals the library's own encoding.

Marked words: a space is written as U+2581 and one is put before a non-empty text; a marked word is a run of marks with the letters after
it. No piece goes on from a letter to a mark, which is checked when the model is read. Characters that the vocabulary lacks
become byte pieces. Null and empty text has no ids. Decoding gives the text back, with U+2581 read as a space. Repeated rows
are encoded each on its own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlake.llm.common import table

MARK = "▁"
REMEMBERED = 200_000
#: Longer words are encoded each time instead of being remembered.
LONGEST = 64
#: Rows of a batch that are encoded at once.
ROWS_AT_ONCE = 512
_WORD = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id_of):
            raise ValueError("the model has pieces that go on over a word's end")
        # lengths of the pieces of three letters and more by their last three letters, longest first
        ends: dict[str, set[int]] = {}
        for p in self.id_of:
            if len(p) >= 3:
                ends.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in ends.items()}
        self.bytes_of = [b""] * n
        for p, i in self.id_of.items():
            self.bytes_of[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte_id.items():
            self.bytes_of[i] = bytes([b])
        self.apart: dict[tuple[str, str], bool] = {}
        self.makes: dict[str, bool] = {}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """BPE on a short list of symbols: the best-scored neighbours first, the leftmost of equals."""
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = self.score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def may_follow(self, left: str, right: str) -> bool:
        got = self.apart.get((left, right))
        if got is None:
            if len(self.apart) > REMEMBERED:
                self.apart.clear()
            got = self.apart[left, right] = self.merged(list(left + right)) == [left, right]
        return got

    def may_stand(self, piece: str) -> bool:
        got = self.makes.get(piece)
        if got is None:
            got = self.makes[piece] = self.merged(list(piece)) == [piece]
        return got

    def learn(self, words: list[str]) -> None:
        """Forward states along the sorted words, prefix by prefix."""
        id_of, lengths, known = self.id_of, self.lengths, self.known
        stands, apart = self.makes, self.apart
        last: list[tuple[str, int]] = [("", -1)]  # at each length: the last piece (empty: an unknown character) and where it starts
        before = ""
        for word in sorted(words):
            same = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                same += 1
            del last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                state = None
                for n in lengths.get(word[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                    if n > end:
                        continue
                    start = end - n
                    piece = word[start:end]
                    if piece in id_of:
                        left = last[start][0]
                        if (n == 1 or (stands[piece] if piece in stands else self.may_stand(piece))) and (not left or (apart[left, piece] if (left, piece) in apart else self.may_follow(left, piece))):
                            state = (piece, start)
                            break
                last.append(state or ("", end - 1))
            ids: list[int] = []
            end = len(word)
            while end:
                piece, start = last[end]
                if piece:
                    ids.append(id_of[piece])
                else:
                    ids += [self.byte_id[b] for b in reversed(word[start:end].encode())]
                end = start
            known[word] = array("I", ids[::-1]).tobytes()
            before = word

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        split = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        words = set(chain.from_iterable(split))
        fresh = words.difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED // 2:
            self.known, self.old = {}, self.known
            fresh = words
        again = [w for w in fresh if w in self.old]
        self.known.update(zip(again, map(self.old.__getitem__, again), strict=True))
        self.learn(list(fresh.difference(again)))
        known = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(known, w)), "<u4") for w in split]
        for w in words:
            if len(w) > LONGEST:
                del self.known[w]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_codecs: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """A worker keeps its codec, and what that has learnt, for its next tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                ids = codec.encode(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                ids = [x.values.to_numpy() for x in part.column(1)]
                cols = [pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([codec.decode(x.tolist()) for x in ids], pa.string())]
                yield pa.record_batch([part.column(0), *cols], names=["doc_id", "n_tokens", "ids_crc32", "text"])

    return encoded.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))
