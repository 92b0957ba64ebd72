"""Line dedup over levelled sorted runs of line digests.

Documents are taken in batches of descending doc_id. A batch's distinct line digests are merge-anti-joined with the
live runs: digests found in none are fresh, and only for them the batch's largest doc_id with the line is stored as its
holder. Digests that some run has bring their number of documents only. Both go into the batch's own run, a table
bucketed and sorted by digest, so that joins with runs move the batch alone. FANOUT runs of one level are compacted into
one run of the next: counts add up, and of a digest's rows the one that was fresh has the holder. The number of batches
follows from the number of digests, and run tables are dropped at the end.

A line's key is the line stripped of white space at both ends, with A-Z lower-cased. Keys of at least
`min_chars` code points found in at least `min_docs` documents lose their lines everywhere but in the largest
doc_id that holds them. Null and empty text is one empty line. A null doc_id sorts before all others. Rows
that repeat a doc_id count as one document and are treated alike. Extra columns stay as they are, but for n_lines and n_dropped, which the
result's own columns replace.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlake.llm.common import WS_CHARS, cut, hash_pair, join_on_counted, settled, shielded, table, unshielded

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FANOUT = 3
#: A batch has about so many line digests in each bucket of its run; there are BATCHES batches at least.
BATCH_ROWS = 2_000_000
BATCHES = 4
NO_ID = -(2**63)
DIGEST = ["h1", "h2"]
ROW = ["doc_id", "th"]


def line_key(line):
    return F.translate(F.btrim(line, F.lit(WS_CHARS)), UPPER, LOWER)


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, holder) by level. Of the runs that have a digest one has its holder, the others null."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.fanout = fanout
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        run.repartition(self.buckets, *DIGEST).write.bucketBy(self.buckets, *DIGEST).sortBy(*DIGEST).saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for t in names:
            self.spark.sql(f"drop table {t}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """A merge join of co-located, sorted runs; nothing moves."""
        out = runs[0]
        for r in runs[1:]:
            right = r.withColumnsRenamed({"n_docs": "n2", "holder": "holder2"})
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))
            out = out.join(right, DIGEST, "full").select(*DIGEST, n.alias("n_docs"), F.coalesce("holder2", "holder").alias("holder"))
        return out

    def add(self, batch: DataFrame) -> None:
        """batch: doc_id, h1, h2 without repeats, of documents smaller than all that were added before."""
        own = batch.groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder"))
        for run in self.runs():
            # an anti-join that leaves the counts of known digests: they lose the holder
            known = run.select(*DIGEST, F.lit(True).alias("known"))
            own = own.join(known, DIGEST, "left").select(*DIGEST, "n_docs", F.when(F.col("known").isNull(), F.col("holder")).alias("holder"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(own))
        self.compact(self.fanout)

    def compact(self, fanout: int) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= fanout:
                run = self._write(self.merged([self.spark.table(t) for t in self.levels[k]]))
                self._drop(self.levels[k])
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(run)

    def counts(self) -> DataFrame:
        return self.merged(self.runs())

    def close(self) -> None:
        self._drop([t for level in self.levels for t in level])
        self.levels = []


def line_digests(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, th (a hash of the row's text), pos (from 0), h1, h2 of every line whose key has min_chars code points or more."""
    stripped = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(WS_CHARS)).alias("line")))
    h1, h2 = hash_pair(F.translate("x.line", UPPER, LOWER))
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.explode(F.filter(stripped, lambda x: F.char_length(x["line"]) >= min_chars)).alias("x"))
    return rows.select(*ROW, "x.pos", h1.alias("h1"), h2.alias("h2"))


def frequent_lines(digests: DataFrame, min_docs: int, batches: int | None) -> DataFrame:
    """h1, h2, n_docs, holder of what min_docs documents or more have; a table."""
    spark = digests.sparkSession
    runs = LineRuns(spark)
    if batches is None:
        batches = max(BATCHES, -(-digests.count() // (BATCH_ROWS * runs.buckets)))
    cuts = digests.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    edges = [None, *sorted(set(cuts or [])), None]
    try:
        for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
            part = digests.select("doc_id", *DIGEST)
            if low is not None:
                part = part.where(F.col("doc_id") > low)
            if high is not None:
                part = part.where(F.col("doc_id") <= high)
            runs.add(part.distinct())
        return cut(runs.counts().where(F.col("n_docs") >= min_docs))
    finally:
        runs.close()


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int | None = None) -> DataFrame:
    """docs with `text` cut and the columns n_lines, n_dropped. Rows and other columns stay."""
    columns = docs.columns
    docs, names = shielded(docs)
    digests = cut(line_digests(docs, min_chars))
    frequent = frequent_lines(digests, min_docs, batches).select(*DIGEST, "n_docs", "holder")
    gone = join_on_counted(digests, frequent, DIGEST, "n_docs", digests.count()).where("doc_id <> holder")
    drops = cut(gone.groupBy(F.col("doc_id").alias("__drop_doc"), F.col("th").alias("__drop_th")).agg(F.collect_set("pos").alias("__drop_pos")))
    lines = lines_of(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop_pos"))
    same = (F.coalesce(docs["doc_id"], F.lit(NO_ID)) == drops["__drop_doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == drops["__drop_th"])
    out = (
        docs.join(drops, same, "left")
        .withColumn("n_lines", F.size(lines).cast("bigint"))
        .withColumn("n_dropped", F.coalesce(F.size("__drop_pos"), F.lit(0)).cast("bigint"))
        .withColumn("text", F.when(F.col("n_dropped") > 0, F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")).otherwise(F.col("text")))
    )
    return unshielded(out, names, ["n_lines", "n_dropped"], columns)


@settled
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
with l as (select doc_id, unnest(string_split(coalesce(text,''), chr(10))) as line, generate_subscripts(string_split(coalesce(text,''), chr(10)), 1) as i from documents),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as holder from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select k.*, f.key is not null and k.doc_id <> f.holder as gone from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from j group by doc_id
"""
