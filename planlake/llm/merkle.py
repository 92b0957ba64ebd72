"""Merkle manifest of a table, checked by a recursive query that climbs from every leaf.

Rows become leaves: the digest of their fields, each with its length in bytes. The leaves of a source lie in the order
of the ids, and level by level three neighbours at most become the digest of their run, up to the source's subroot;
the subroots, in the order of the sources, become the root in the same way. Every built node but the root is stored
as a row that knows its parent and the digests of its run before and after it. A recursive query then starts at each
leaf, goes from parent to parent, gives the siblings of each step and folds the leaf, or what has become of it since,
with them. What is folded at the root equals the root where nothing was changed.

Positions come from sorted ranges and the number of rows in each, so no source, however large, is sorted in one task;
runs hold three nodes, so no group is larger. Rows that climb move as one narrow row a level.

A null id or source is first in its order, and a null field counts as '-'. Rows of one id lie in the order of their
leaves; rows that are alike in all fields are leaves of their own, and all of them have valid proofs. Texts of any
length are hashed whole; an empty text differs from a null one. A source of one row has its leaf as subroot, a table
of one source its subroot as root. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlake.llm.common import cut, join_on_counted, settled, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 3
#: The tree of subroots; the trees of sources count from 0.
TOP = -1
#: Rows of a sorted range, on average.
RANGE_ROWS = 250_000
_NTH = (1 << 33) - 1
#: A node's place in its tree: the level above these bits, its position below.
_LEVEL_BITS = 50


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(values[f]) for f in FIELDS)), 256))


def _hex(digest: str | Column) -> Column:
    return F.lower(F.hex(digest))


def ordered(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """rows with `number`: their place, from 0, in the order of keys, nulls first. Large groups of equal keys need a key that tells them apart."""
    dealt = rows.repartitionByRange(max(1, -(-count // RANGE_ROWS)), *keys).sortWithinPartitions(*keys)
    placed = cut(dealt.withColumn("__at", F.monotonically_increasing_id()))  # the range above 33 bits, the row below
    part = F.shiftright("__at", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each range
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before or [(0, 0)], "__part bigint, __before bigint")
    return (
        placed.join(F.broadcast(offsets), part == F.col("__part"))
        .withColumn("number", F.col("__before") + F.col("__at").bitwiseAND(F.lit(_NTH)))
        .drop("__at", "__part", "__before")
    )


def leaves(docs: DataFrame, after: dict[str, Column]) -> DataFrame:
    """doc_id, source_key, leaf and now (the leaf with the fields of `after` in place of the stored ones), one row each."""
    fields = docs.select(*(F.col(f).alias(f"__{f}") for f in FIELDS))
    own = {f: F.col(f"__{f}") for f in FIELDS}
    source = own["source"].cast("string")
    return fields.select(
        own["doc_id"].cast("bigint").alias("doc_id"),
        # null before all others, and otherwise the order of the bytes
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("source_key"),
        leaf_digest(own).alias("leaf"),
        leaf_digest(own | after).alias("now"),
        F.monotonically_increasing_id().alias("row"),
    )


def build(nodes: DataFrame, below_top: bool, carried: tuple[str, ...] = ()) -> tuple[list[DataFrame], list[DataFrame]]:
    """Builds trees from their lowest nodes: tree, pos, digest, n (nodes of the tree), and columns that the lowest nodes carry.

    Gives the parent-linked rows of each level, and the roots of trees as tree and digest.
    """
    links, roots = [], []
    level = 0
    while True:
        roots.append(nodes.where("n = 1").select("tree", "digest"))
        node = F.struct(F.col("pos"), F.col("digest").alias("d"), *carried)
        runs = nodes.where("n > 1").groupBy("tree", F.expr(f"pos div {RUN}").alias("pos")).agg(F.sort_array(F.collect_list(node)).alias("run"), F.max("n").alias("n"))  # RUN at most
        runs = cut(runs.withColumn("digest", F.unhex(F.sha2(F.concat_ws("", F.transform("run", lambda x: F.lower(F.hex(x["d"])))), 256))))
        if not runs.take(1):
            return links, roots
        parents = F.expr(f"(n + {RUN - 1}) div {RUN}")
        below = F.lit(level << _LEVEL_BITS)
        above = F.lit((level + 1) << _LEVEL_BITS)
        # a source's subroot is a lowest node of the tree of subroots
        last = (parents == 1) & F.lit(below_top)
        one = runs.select("*", F.posexplode("run").alias("i", "node")).select(
            "tree",
            (below + F.col("node.pos")).alias("at"),
            F.when(last, F.lit(TOP)).otherwise(F.col("tree")).cast("bigint").alias("parent_tree"),
            F.when(last, F.col("tree")).otherwise(above + F.col("pos")).alias("parent_at"),
            F.expr("aggregate(slice(run, 1, i), unhex(''), (a, x) -> concat(a, x.d))").alias("before"),
            F.expr(f"aggregate(slice(run, i + 2, {RUN}), unhex(''), (a, x) -> concat(a, x.d))").alias("after"),
            *(F.col(f"node.{c}") for c in carried),
        )
        links.append(one)
        nodes, carried = runs.select("tree", "pos", "digest", parents.alias("n")), ()
        level += 1


def fold(before: str, digest: str, after: str) -> Column:
    """The digest of a run, from one of its nodes and what lies before and after it."""
    return F.unhex(F.sha2(F.concat(_hex(before), _hex(digest), _hex(after)), 256))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@contextmanager
def _all_rows(spark: SparkSession) -> Iterator[None]:
    """Recursion over any number of rows; Spark stops at a million otherwise."""
    name = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


CLIMB = """
with recursive climb (row, step, tree, at, siblings, folded) as (
    select row, step, tree, at, siblings, folded from {starts}
    union all
    select c.row, c.step + 1, n.parent_tree, n.parent_at, concat(n.before, n.after),
           unhex(sha2(concat(lower(hex(n.before)), lower(hex(c.folded)), lower(hex(n.after))), 256))
    from climb c join {nodes} n on c.tree = n.tree and c.at = n.at
)
select row, step, siblings, folded from climb
"""


def manifest(docs: DataFrame, after: dict[str, Column]) -> DataFrame:
    """doc_id, source_key, leaf, subroot, root, proof_sha256 of docs as stored; folded_root and verified of docs with the fields of `after`.

    The expressions of `after` read the stored fields under their names with two underscores in front.
    """
    rows = cut(leaves(docs, after))
    total = rows.count()
    if not total:
        return rows.select("doc_id", "source_key", *(F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), F.lit(True).alias("verified"))
    placed = ordered(rows, ["source_key", "doc_id", "leaf", "now", "row"], total).withColumnRenamed("row", "__row").withColumnRenamed("number", "row")
    placed = cut(placed.drop("__row"))
    sizes = cut(placed.groupBy("source_key").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")))
    n_sources = sizes.count()
    trees = cut(ordered(sizes, ["source_key"], n_sources).withColumnRenamed("number", "tree"))
    placed = cut(join_on_counted(placed, trees, ["source_key"], "n", total).withColumn("pos", F.col("row") - F.col("first")).drop("first"))

    alone = placed.where("n = 1")
    links, roots = build(placed.select("tree", "pos", F.col("leaf").alias("digest"), "n", "row", "now"), below_top=True, carried=("row", "now"))
    subroots = cut(union(roots))
    top = subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(n_sources).cast("bigint").alias("n"))
    top_links, top_roots = build(top, below_top=False)
    root = union(top_roots).select(_hex("digest").alias("digest")).first()["digest"]

    # a leaf knows its own run and starts at its parent; the one leaf of a source is its subroot and starts in the tree of subroots
    starts = alone.select("row", F.lit(0).alias("step"), F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.unhex(F.lit("")).alias("siblings"), F.col("now").alias("folded"))
    for lowest in links[:1]:
        up = lowest.select("row", F.lit(1).alias("step"), F.col("parent_tree").alias("tree"), F.col("parent_at").alias("at"), F.concat("before", "after").alias("siblings"), fold("before", "now", "after").alias("folded"))
        starts = starts.unionByName(up)
    inner = links[1:] + top_links
    spark = docs.sparkSession
    with _all_rows(spark):
        steps = spark.sql(CLIMB, starts=starts, nodes=cut(union(inner))) if inner else starts
        proofs = cut(steps.groupBy("row").agg(  # a row for each level
            F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("step", "siblings"))), lambda x: F.lower(F.hex(x["siblings"])))), 256).alias("proof_sha256"),
            _hex(F.max(F.struct("step", "folded"))["folded"]).alias("folded_root"),
        ))
    by_tree = trees.select("tree", "n").join(subroots, "tree").select("tree", "n", _hex("digest").alias("subroot"))
    out = join_on_counted(placed.drop("n"), cut(by_tree), ["tree"], "n", total)
    return (
        out.select("row", "doc_id", "source_key", _hex("leaf").alias("leaf"), "subroot")
        .hint("merge")
        .join(proofs, "row")
        .select("doc_id", "source_key", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
    )


@settled
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, held against texts that lost their line ends where 2 divides the crc32 of the id."""
    lost = F.crc32(F.col("__doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.col("__text")
    tampered = F.when(lost, F.translate(text, "\n", "")).otherwise(text)
    return manifest(table(spark, sf_dir, "documents"), {"text": tampered}).drop("source_key")


_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS[:4]) + " || " + _FIELD.replace("{0}", "{text}") + ")"
#: The lowest bit of the crc32, one bit of the bytes at a time.
_CRC_BIT = """(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, length(doc_id::varchar) + 1),
    lambda i: [256 + ascii((doc_id::varchar)[i]), 0, 0, 0, 0, 0, 0, 0]::bigint[]))),
    lambda c, b: case when xor(c, b % 256) % 2 = 1 then xor(xor(c, b % 256) // 2, 3988292384) else xor(c, b % 256) // 2 end) + 1) % 2"""

ORACLE = f"""
with recursive d as (
  select doc_id, source, {_LEAF.format(text='text')} as leaf,
    case when {_CRC_BIT} = 0 then {_LEAF.format(text="replace(text, chr(10), '')")} else {_LEAF.format(text='text')} end as now
  from documents
), l as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n,
    dense_rank() over (order by case when source is null then 0 else 1 end, encode(source)) - 1 as tree from d
), t as (
  select tree, pos, leaf as h, 0 as lv, n from l
  union all
  select tree, pos // 3, sha256(string_agg(h, '' order by pos)), lv + 1, (max(n) + 2) // 3 from t where n > 1 group by tree, pos // 3, lv
), s as (
  select tree as pos, h, 0 as lv, (select count(distinct tree) from l) as n from t where n = 1
), u as (
  select * from s
  union all
  select pos // 3, sha256(string_agg(h, '' order by pos)), lv + 1, (max(n) + 2) // 3 from u where n > 1 group by pos // 3, lv
), nodes as (
  select tree, lv, pos, h, n from t where n > 1
  union all
  select -1, lv, pos, h, n from u where n > 1
), linked as (
  select a.tree, a.lv, a.pos, a.n,
    coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as before, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as after
  from nodes a join nodes b on a.tree = b.tree and a.lv = b.lv and a.pos // 3 = b.pos // 3 group by all
), climb as (
  select doc_id, leaf, tree as own, case when n = 1 then -1 else tree end as tree, 0 as lv, case when n = 1 then tree else pos end as pos, '' as proof, now as folded from l
  union all
  select doc_id, leaf, own, case when k.n <= 3 and k.tree >= 0 then -1 else k.tree end, case when k.n <= 3 and k.tree >= 0 then 0 else k.lv + 1 end,
    case when k.n <= 3 and k.tree >= 0 then k.tree else k.pos // 3 end, proof || before || after, sha256(before || folded || after)
  from climb c join linked k on c.tree = k.tree and c.lv = k.lv and c.pos = k.pos
), r as (select h as root, lv as top from u where n = 1)
select doc_id, leaf, s.h as subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified
from climb c join s on c.own = s.pos cross join r where c.tree = -1 and c.lv = r.top
"""
