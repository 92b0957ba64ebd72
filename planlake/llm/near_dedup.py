"""MinHash near-dedup by a multi-index Hamming join.

A document's set holds its distinct 5-word shingles; two documents are linked if 100 * |A & B| >= PERCENT * |A | B|.
clusters() takes another percentage, with a signature-distance threshold and chunks to match.

1. Documents with the same set collapse into one representative (a 128-bit digest of the sorted set).
2. A signature has SYMBOLS minhashes of 16 bits. Of a pair at similarity 0.85 each symbol differs with probability
   0.15, so more than ERRORS of 64 differ with probability below 2e-5 (less for closer pairs): the signature-distance threshold.
3. Pigeonhole: the symbols are split into CHUNKS chunks; a pair within ERRORS differs in at most ERRORS // CHUNKS = 1
   symbol of some chunk. The allowed error is enumerated: a chunk gives one key for each symbol left out, so every
   pair under the threshold shares a key.
4. Within a key's bucket all members are first compared with its most central one: the member of most buckets, which in
   a family of copies is the text they were made from. Links are confirmed on full sets.
5. What is still apart: members of a bucket that lie in different components are compared by signature, block by block, those
   outside the bucket's largest component against all members. A block gives a spanning forest of its pairs under the
   threshold, not the pairs. These forests and the links make families: both ends of every untested pair under the threshold
   are in one family.
6. Families that hold several components are compared on full sets, block by block, again those outside the family's largest
   component against all members: products of 0/1 matrices over the blocks' common shingles give all intersection sizes,
   and a block gives a spanning forest of its links. So no link
   between components is left out, no pairs of a group become rows, and blocks bound what a task holds.

Words are maximal runs of bytes other than white space, A-Z read as a-z. With fewer than five words the whole sequence is one shingle; without words the set is
empty and the document is linked with nothing. Rows without
doc_id take part in nothing and get no component. Repeated rows of one doc_id are one document; if their texts
differ, the document is linked by each of them, so that its rows share one component and n_shingles is of the row's own text. A set
is held as 64-bit hashes of its shingles, equal sets are known by a 128-bit digest of these. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlake.llm.common import as_int64, cut, mix, settled, sole, table, text_slices, window_hashes, word_hashes, word_spans
from planlake.llm.components import components

SHINGLE = 5
PERCENT = 85
SYMBOLS = 64
ERRORS = 23
CHUNKS = 12
BLOCK = 256
#: A block of full sets holds so many shingles on average, and fewer rows where sets are large.
BLOCK_SHINGLES = 500_000

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def chunk_bounds(chunks: int = CHUNKS) -> list[tuple[int, int]]:
    """First symbol and number of symbols of each chunk."""
    cuts = [SYMBOLS * i // chunks for i in range(chunks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, first = word_spans(buf, offs)
    w = word_hashes(buf, starts, ends, lower=True)
    five = window_hashes(w, SHINGLE)
    out = []
    for i in range(len(offs) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= SHINGLE:
            out.append(np.unique(five[a : b - SHINGLE + 1]))
        else:
            out.append(window_hashes(w[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """len(sets) rows of SYMBOLS 16-bit minhashes. No set is empty."""
    flat = np.concatenate(sets)
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), SYMBOLS), ">u2")
    with np.errstate(over="ignore"):
        for k in range(SYMBOLS):
            out[:, k] = mix(np.minimum.reduceat(flat * _A[k] + _B[k], first)) >> np.uint64(48)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offs in text_slices(batch.column(1)):
            sets = shingle_sets(buf, offs)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            if full:
                for i, row in zip(full, signature([sets[i] for i in full]), strict=True):
                    sig[i] = row.tobytes()
            digest = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.record_batch(
                [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offs in text_slices(batch.column(1)):
            rows = pa.array([as_int64(s) for s in shingle_sets(buf, offs)], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0).slice(a, b - a), rows], names=["rep", "shingles"])


def keys(reps: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """key, rep: one row for each chunk and each of its symbols left out."""
    parts = []
    for c, (at, n) in enumerate(chunk_bounds(chunks)):
        for out in range(n):
            a = F.substring("sig", 2 * at + 1, 2 * out)
            b = F.substring("sig", 2 * (at + out + 1) + 1, 2 * (n - out - 1))
            parts.append(F.xxhash64(F.lit(c * SYMBOLS + out), F.concat(a, b)))
    return reps.select(F.explode(F.array(*parts)).alias("key"), "rep")


def _distance_ok(pairs: DataFrame, reps: DataFrame, errors: int) -> DataFrame:
    """The pairs whose signatures differ in at most `errors` symbols."""
    s = reps.select("rep", "sig")
    both = pairs.join(s.withColumnsRenamed({"rep": "a", "sig": "sa"}), "a").join(s.withColumnsRenamed({"rep": "b", "sig": "sb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u2").reshape(-1, SYMBOLS) for k in (2, 3))
            near = (x != y).sum(1) <= errors
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach `percent` on full sets. texts: rep, text. Only texts that occur in a pair are read in full."""
    pairs = cut(pairs)
    named = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = cut(texts.join(named, "rep", "left_semi").select("rep", "text").mapInArrow(_sets, "rep bigint, shingles array<bigint>"))
    both = pairs.join(sets.withColumnsRenamed({"rep": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"rep": "b", "shingles": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both_n = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both_n >= percent * (len(x) + len(y) - both_n)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _forest(apart: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the boolean matrix that join what is still apart. root has labels of rows, then of columns."""
    rows, out = len(apart), []
    for i in np.flatnonzero(apart.any(1)):
        while True:
            open_ = np.flatnonzero(apart[i] & (root[rows:] != root[i]))
            if not len(open_):
                break
            j = open_[0]
            out.append((i, j))
            root[root == root[rows + j]] = root[i]
    return out


def _by_tile(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal key, of a partition sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in key]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            own = tuple(c[x] for c in cols)
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def _forests(tiles: DataFrame, key: tuple[str, ...], near) -> DataFrame:
    """a, b: spanning forests of the tiles. A tile's rows have rep, comp and side (0 or 1); near(x, y) tests side 1 against side 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for tile in _by_tile(batches, key):
            side = tile.column("side").to_numpy() == 1
            rep, comp = tile.column("rep").to_numpy(), tile.column("comp").to_numpy()
            if len(rep) < 2 or (comp == comp[0]).all() or side.all() or not side.any():
                continue
            x, y = tile.filter(pa.array(side)), tile.filter(pa.array(~side))
            for i, j in _forest(near(x, y), np.concatenate([comp[side], comp[~side]])):
                a, b = int(rep[side][i]), int(rep[~side][j])
                found.add((min(a, b), max(a, b)))
            if len(found) > 10_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
                found.clear()
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    dealt = tiles.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a bigint, b bigint").where("a < b").distinct()


def _near_signatures(x: pa.Table, y: pa.Table, errors: int) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(t.column("sig").to_pylist()), ">u2").reshape(-1, SYMBOLS) for t in (x, y))
    return np.array([(y != row).sum(1) <= errors for row in x])


def _linked_sets(x: pa.Table, y: pa.Table, percent: int) -> np.ndarray:
    sets = [[v.values.to_numpy() for v in t.column("shingles")] for t in (x, y)]
    size = [np.array([len(v) for v in s]) for s in sets]
    flat = [np.concatenate(s) for s in sets]
    row = [np.repeat(np.arange(len(s)), n) for s, n in zip(sets, size, strict=True)]
    common = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    shared = np.zeros((len(sets[0]), len(sets[1])), np.float32)
    at = []
    for f, r in zip(flat, row, strict=True):
        k = np.minimum(np.searchsorted(common, f), max(len(common) - 1, 0))
        hit = common[k] == f if len(common) else np.zeros(len(f), bool)
        at.append((r[hit], k[hit]))
    for low in range(0, len(common), 4096):
        part = []
        for s, (r, k) in zip(sets, at, strict=True):
            m = np.zeros((len(s), 4096), np.float32)
            own = (k >= low) & (k < low + 4096)
            m[r[own], k[own] - low] = 1
            part.append(m)
        shared += part[0] @ part[1].T
    both = shared.astype(np.int64)
    return 100 * both >= percent * (size[0][:, None] + size[1][None, :] - both)


def _slots(n: str, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(n)).cast("int")


def _each(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _tiles(m: DataFrame, group: str, size: int) -> DataFrame:
    """Blocks of the groups of m that hold several components. m: `group`, rep, comp and what is compared.

    A link between two components has an end outside the group's largest one, so members outside it (side 1) are set against
    all members (side 0): what a group adds to its own rows grows with its members outside the largest component.
    """
    per = m.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy(group).agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"))
    blocks = lambda c: F.ceil(c / size).cast("int")
    per = per.where("comps > 1").select(group, F.col("top.comp").alias("top"), blocks(F.col("n") - F.col("top.n")).alias("n_odd"), blocks(F.col("n")).alias("n_all"))
    cols = m.columns
    m = m.join(per, group)
    every = m.select(*cols, _slots("n_all", 2).alias("j"), _each("n_odd").alias("i"), F.lit(0).alias("side"))
    odd = m.where("comp <> top").select(*cols, _each("n_all").alias("j"), _slots("n_odd", 1).alias("i"), F.lit(1).alias("side"))
    return every.unionByName(odd)


def _candidates(members: DataFrame, comps: DataFrame, errors: int) -> DataFrame:
    """Forests of the pairs under the distance threshold that share a bucket and lie in different components. members: key, rep, sig."""
    tiles = _tiles(cut(_labelled(members, comps).select("key", "rep", "comp", "sig")), "key", BLOCK)
    return _forests(tiles, ("key", "i", "j"), partial(_near_signatures, errors=errors))


def _within_families(links: DataFrame, forests: DataFrame, comps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Forests of the links on full sets between different components of a family."""
    family = components(links.unionByName(forests)).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    m = cut(_labelled(family, comps))
    several = m.groupBy("family").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("family")
    m = m.join(several, "family", "left_semi")
    sets = texts.join(m.select("rep"), "rep", "left_semi").select("rep", "text").mapInArrow(_sets, "rep bigint, shingles array<bigint>")
    m = cut(m.join(sets, "rep").select("family", "rep", "comp", "shingles"))
    width = m.agg(F.coalesce(F.avg(F.size("shingles")), F.lit(1.0))).first()[0]
    size = int(max(8, min(BLOCK, BLOCK_SHINGLES // max(width, 1))))
    return _forests(_tiles(m, "family", size), ("family", "i", "j"), partial(_linked_sets, percent=percent))


def clusters(docs: DataFrame, percent: int = PERCENT, errors: int = ERRORS, chunks: int = CHUNKS) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id, kept; one row for each input row.

    Documents are linked from `percent` on. More than `errors` differing symbols must be improbable at that similarity, and
    errors // chunks may be 1 at most, or keys miss pairs under the threshold.
    """
    if errors >= 2 * chunks:
        raise ValueError(f"{chunks} chunks do not cover {errors} errors")
    spark = docs.sparkSession
    signed = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_signatures, "doc_id bigint, n_shingles bigint, digest binary, sig binary"))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    # equal sets: every row is linked with the smallest doc_id of its digest; only that one goes on
    heads = cut(full.groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    reps = heads.select("rep", "sig")
    k = keys(reps, chunks)
    buckets = cut(k.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi"))
    members = k.join(buckets.where("n > 2").select("key"), "key")
    degree = members.groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
    members = cut(members.join(reps.join(degree, "rep"), "rep"))
    centre = members.groupBy("key").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("centre"))
    near = members.join(centre, "key").where("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
    star = near.unionByName(buckets.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text")
    links = sole(spark, lambda: confirmed(_distance_ok(star, reps, errors), texts, percent))
    comps = components(links)
    forests = sole(spark, lambda: _candidates(members.select("key", "rep", "sig"), comps, errors))
    if forests.take(1):
        links = sole(spark, lambda links=links: links.unionByName(_within_families(links, forests, comps, texts, percent)))
    comps = components(links)
    final = _labelled(heads.select("n_shingles", "digest", "rep"), comps).select("n_shingles", "digest", "comp")
    out = signed.select("doc_id", "n_shingles", "digest").join(final, ["n_shingles", "digest"], "left")
    comp = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(False)).alias("kept"))


@settled
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
             else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as both_n from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * both_n >= 85 * (x.n + y.n - both_n)),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join l on r.b = l.a),
c as (select a, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, c.component_id = d.doc_id as kept
from documents d left join n using (doc_id) join c on c.a = d.doc_id
"""
