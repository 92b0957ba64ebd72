"""Corpora of notes to lines, sections, sentences, signals, candidates and suggestions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from planlake.functions import textcols as tc
from planlake.operators import segment
from planlake.operators.cuts import cut

#: Words that come last in the order of words, and of these the ones whose sets are dealt out, in so many shares.
FREQUENT_WORDS = 4096
CROWDED_WORDS = 64
SHARES = 16


def sections(notes: DataFrame) -> DataFrame:
    """One row for each section of each note (note_id, body), with a key and what its text has."""
    s = segment.sections(notes)
    return s.withColumn("section_id", F.concat_ws("#", "note_id", "ordinal")).withColumn("has", tc.structure(F.col("raw_text"))).select("*", "has.*").drop("has")


def sentence_rows(secs: DataFrame, split=tc.bullet_sentences) -> DataFrame:
    text = F.regexp_replace("raw_text", r"(?m)^[ \t]*[-*+•][ \t]+", "")
    return secs.select("note_id", "section_id", "ordinal", "heading_text", F.posexplode(split(text)).alias("sentence_index", "sentence"))


def signal_rows(sents: DataFrame) -> DataFrame:
    """One row for each signal; process noise gives none."""
    s = sents.where(~tc.process_noise(F.col("sentence"))).withColumn("x", F.explode(tc.signals(F.col("sentence"))))
    return s.select("note_id", "section_id", "sentence_index", "sentence", "x.signal", "x.label", "x.confidence")


def best_signals(rows: DataFrame) -> DataFrame:
    """The most confident one of a (section, sentence, label)."""
    best = F.max_by(F.struct("signal", "sentence", "confidence"), F.struct("confidence", "signal")).alias("b")
    return rows.groupBy("note_id", "section_id", "sentence_index", "label").agg(best).select("note_id", "section_id", "sentence_index", "label", "b.*")


def suppressed_heading(heading: Column) -> Column:
    leaf = F.trim(F.element_at(F.split(heading, ">"), -1))
    return F.lower(leaf).rlike(r"^(next steps|summary|recap|tl;dr)\b")


def candidates(notes: DataFrame) -> DataFrame:
    """Notes to scored candidates: signals of sections, one per (section, sentence, label), with a key and a drop reason."""
    secs = cut(segment.sections(notes).withColumn("section_id", F.concat_ws("#", "note_id", "ordinal")).select("note_id", "section_id", "ordinal", "heading_text", "raw_text"))
    sig = best_signals(signal_rows(sentence_rows(secs)))
    s = secs.select("section_id", "heading_text", "raw_text")
    c = sig.join(s, "section_id")
    grounded = F.contains(F.regexp_replace("raw_text", r"\s+", " "), F.regexp_replace("sentence", r"\s+", " "))
    vague = (tc.generic_ratio(F.col("sentence")) > 0.55) & (F.size(tc.domain_nouns(F.col("raw_text"))) < 2)
    reason = (
        F.when(suppressed_heading(F.col("heading_text")), "suppressed_section").when(~grounded, "ungrounded").when(vague, "too_generic")
        .when((F.col("label") == "project_update") & tc.spec_section(F.col("raw_text"), F.col("heading_text")), "spec_section")
    )
    return c.withColumns({"drop_reason": reason, "suggestion_key": tc.suggestion_key(F.col("note_id"), F.col("section_id"), F.col("label"), F.col("sentence"))}).drop("raw_text")


def capped(kept: DataFrame, most: int) -> DataFrame:
    """The best `most` of each note, risks, bugs and updates before ideas, and whether others were cut."""
    order = [F.when(F.col("label") == "idea", 1).otherwise(0), F.desc("confidence"), F.col("section_id"), F.col("sentence_index"), F.col("label")]
    n = F.count(F.lit(1)).over(Window.partitionBy("note_id"))
    r = F.row_number().over(Window.partitionBy("note_id").orderBy(*order))
    return kept.withColumns({"rank": r, "trimmed": n > most}).where(F.col("rank") <= most)


def first_by_key(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("suggestion_key").orderBy("section_id", "sentence_index")
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def best_by_structure(rows: DataFrame) -> DataFrame:
    """Of rows with one structure the most confident stays, the first of equal ones.

    A mutation's structure is its target, kind of change and new value; an artifact's is its title, owner (id, else name) and kind.
    """
    owner = F.coalesce(F.nullif("owner_id", F.lit("")), F.nullif("owner_name", F.lit("")), F.lit("unknown"))
    mutation = F.concat_ws(":", F.lit("mutation"), F.coalesce("target_id", F.lit("")), F.coalesce("change_type", F.lit("")), F.coalesce("after", F.lit("")))
    artifact = F.concat_ws(":", F.lit("artifact"), F.trim(F.lower("title")), owner, F.coalesce("artifact_kind", F.lit("")))
    keyed = rows.withColumn("structure_key", F.when(F.col("type") == "PLAN_MUTATION", mutation).otherwise(artifact))
    w = Window.partitionBy("structure_key").orderBy(F.desc("confidence"), "position")
    return keyed.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def confident(rows: DataFrame, at_least: float, most: int, by: list[str]) -> DataFrame:
    """Rows of `at_least` confidence, the best `most` of each `by`."""
    w = Window.partitionBy(*by).orderBy(F.desc("confidence"), "position")
    return rows.where(F.col("confidence") >= at_least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def suggestions_of(notes: DataFrame, most: int = 5) -> DataFrame:
    return capped(first_by_key(candidates(notes).where("drop_reason is null").drop("drop_reason")), most)


def buckets(rows: DataFrame, most: int = 5) -> DataFrame:
    """The first `most` rows of each (note, bucket) and how many are hidden."""
    rows = rows.withColumn("bucket", tc.bucket(F.col("label"), F.col("label")))
    w = Window.partitionBy("note_id", "bucket")
    r = F.row_number().over(w.orderBy(F.desc("confidence"), "section_id", "sentence_index"))
    hidden = F.greatest(F.count(F.lit(1)).over(w) - most, F.lit(0))
    return rows.withColumns({"bucket_rank": r, "hidden": hidden}).where(F.col("bucket_rank") <= most)


def drop_report(c: DataFrame) -> DataFrame:
    return c.groupBy(F.coalesce("drop_reason", F.lit("emitted")).alias("stage"), "label").agg(F.count(F.lit(1)).alias("n"))


def evaluation(notes: DataFrame, kept: DataFrame) -> DataFrame:
    """Totals over notes, counted by note first."""
    per = kept.groupBy("note_id").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("s"))
    a = notes.select("note_id").join(per, "note_id", "left").fillna(0, ["n"]).agg(
        F.count(F.lit(1)).alias("notes"), F.sum("n").alias("suggestions"), F.avg("n").alias("mean_per_note"), F.count_if(F.col("n") == 0).alias("zero_notes"), F.sum("s").alias("s"))
    return a.select("notes", "suggestions", F.round("mean_per_note", 6).alias("mean_per_note"), F.round(F.col("zero_notes") * 100.0 / F.col("notes"), 6).alias("zero_pct"), F.round(F.col("s") / F.col("suggestions"), 6).alias("mean_confidence"))


def threshold_sweep(scored: DataFrame, values: list[float]) -> DataFrame:
    """Rows that reach each threshold, in one pass, with the drop against the one before."""
    counts = scored.agg(*(F.count_if(F.col("confidence") >= v).alias(f"t{i}") for i, v in enumerate(values)))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(v).alias("threshold"), F.col(f"t{i}").alias("n")) for i, v in enumerate(values)))).alias("x")).select("x.*")
    before = F.lag("n").over(Window.orderBy("threshold"))  # one row for each threshold
    return rows.withColumn("drop_pct", F.when(before > 0, F.round((before - F.col("n")) * 100.0 / before, 6)).otherwise(0.0))


def route_stats(routed: DataFrame) -> DataFrame:
    return routed.agg(F.count_if(F.col("route") == "attach").alias("attached"), F.count_if(F.col("route") == "create_new").alias("create_new"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))


def near_duplicates(new: DataFrame, open_: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Pairs (new_id, open_id) in one block whose word sets reach the Jaccard similarity.

    Prefix filter: at 0.8, two sets share one of their rarest |words| - ceil(0.8 |words|) + 1 words, so only these are joined. Exact.
    """
    words = lambda d: d.withColumn("words", F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")))
    a, b = words(new), words(open_)
    freq = a.select("words").unionByName(b.select("words")).select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))

    def prefix(d: DataFrame, key: str) -> DataFrame:
        x = d.select("block", F.col("id").alias(key), F.size("words").alias("n"), F.explode("words").alias("w")).join(freq, "w")
        r = F.row_number().over(Window.partitionBy(key).orderBy("df", "w"))
        return x.withColumn("r", r).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(at_least)) + 1).select("block", key, "w")

    pairs = prefix(a, "new_id").join(prefix(b, "open_id"), ["block", "w"]).select("new_id", "open_id").where("new_id <> open_id").distinct()
    full = pairs.join(a.select(F.col("id").alias("new_id"), F.col("words").alias("x")), "new_id").join(b.select(F.col("id").alias("open_id"), F.col("words").alias("y")), "open_id")
    return full.withColumn("similarity", F.round(tc.jaccard(F.col("x"), F.col("y")), 6)).where(F.col("similarity") >= at_least).select("new_id", "open_id", "similarity")


def word_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")))


def _often(values: list[str]):
    """For each word of an array its place in the list, -1 for others."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def place(words: pa.Array) -> pa.Array:
        found = pc.fill_null(pc.index_in(words.flatten(), pa.array(values, pa.string())), -1)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(words), 0)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), found)

    return place


def merged_duplicates(new: DataFrame, open_: DataFrame, at_least: float = 0.8) -> DataFrame:
    """id, duplicate_of, similarity: for each new suggestion the first open one (by position, id) of its action and initiative that is as similar as at_least.

    Both have id, action, initiative_id (null equals null), text and position, and are read several times. Rows of one block with
    the same words become one word set first, so copies meet as one row; two sets can only be similar if neither is much larger
    and if they share one of their rarest words, down to where the rest could not suffice. Sets that meet in such a word are
    compared whole there and then, and a set keeps only the first one alike: pairs are never stored, however many have common words
    only. Frequent words come last in the order of words; any order gives the same result. Members take the result of
    their set. Texts without words resemble nothing.
    """
    block = F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("="), "action"), F.lit("")), F.coalesce(F.concat(F.lit("="), "initiative_id"), F.lit("")))
    keyed = lambda d: d.select("id", "position", block.alias("block"), word_set(F.col("text")).alias("words")).withColumn("set", F.unhex(F.sha2(F.concat_ws("\x1f", "block", F.array_join("words", " ")), 256)))
    a, b = keyed(new), keyed(open_)
    sets = lambda d: d.where(F.size("words") > 0).groupBy("set").agg(F.first("block").alias("block"), F.first("words").alias("words"), F.min(F.struct("position", "id")).alias("first"))
    count = F.count(F.lit(1))
    freq = a.select("words").unionByName(b.select("words")).select(F.explode("words").alias("w")).groupBy("w").agg(count.alias("df"))
    often = [r["w"] for r in freq.orderBy(F.desc("df"), "w").limit(FREQUENT_WORDS).collect()][::-1]
    place, crowded = _often(often), max(0, len(often) - CROWDED_WORDS)

    def rarest(d: DataFrame, shares: Column) -> DataFrame:
        """A row for each of the rarest words of a set and each share of its key."""
        n = F.size("words")
        x = sets(d).withColumn("place", place(F.col("words")))
        order = F.slice(F.array_sort(F.arrays_zip(F.col("place"), F.col("words").alias("w"))), F.lit(1), (n - F.ceil(n * F.lit(at_least)) + 1).cast("int"))
        x = x.select("block", "set", "words", n.alias("n"), "first", F.posexplode(order).alias("nth", "p"))
        return x.select("block", F.col("p.w").alias("w"), F.explode(F.when(F.col("p.place") >= crowded, shares).otherwise(F.array(F.lit(0)))).alias("share"), "set", "words", "n", (F.col("nth") + 1).alias("nth"), "first")

    # words of many sets are dealt out: a new set has one share, open ones all
    x = rarest(a, F.array(F.pmod(F.hash("set"), F.lit(SHARES)))).drop("first").withColumnsRenamed({"set": "new_set", "words": "p", "n": "n_p", "nth": "nth_p"})
    y = rarest(b, F.array(*map(F.lit, range(SHARES)))).withColumnsRenamed({"set": "open_set", "words": "q", "n": "n_q", "nth": "nth_q"})
    total = F.col("n_p") + F.col("n_q")
    # of the words after this one, no more can be shared than the smaller rest holds
    rest = F.least(F.col("n_p") - F.col("nth_p"), F.col("n_q") - F.col("nth_q")) + 1
    shared = F.size(F.array_intersect("p", "q"))
    same = (x["block"] == y["block"]) & (x["w"] == y["w"]) & (x["share"] == y["share"])
    able = (F.least("n_p", "n_q") >= F.greatest("n_p", "n_q") * at_least) & (rest * (1 + at_least) >= total * at_least - 1e-9)
    alike = x.join(y, same & able & (shared / (total - shared) >= at_least)).select("new_set", "first", (shared / (total - shared)).alias("similarity"))
    best = alike.groupBy(F.col("new_set").alias("set")).agg(F.min(F.struct("first", "similarity")).alias("b")).select("set", F.col("b.first.id").alias("duplicate_of"), F.round("b.similarity", 6).alias("similarity"))
    return a.select("id", "set").join(best, "set", "left").select("id", "duplicate_of", "similarity")


def merged_evidence(found: DataFrame, new: DataFrame, open_: DataFrame) -> DataFrame:
    """id and evidence of open suggestions, their own and that of their duplicates, each text once: a row for each."""
    gained = found.where("duplicate_of is not null").join(new.select("id", "evidence"), "id").select(F.col("duplicate_of").alias("id"), "evidence")
    return open_.select("id", "evidence").unionByName(gained).where("evidence is not null").distinct()


def centroids(vectors: DataFrame, by: str, vec: str) -> DataFrame:
    """Mean vector of each cluster, component by component."""
    x = vectors.select(by, F.posexplode(vec).alias("pos", "v")).groupBy(by, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return x.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s")).select(by, F.col("s.m").alias("centroid"))


def nearest_centroid(vectors: DataFrame, cents: DataFrame, id_col: str, vec: str, by: str, at_least: float) -> DataFrame:
    """Best cosine over the centroids, attached at `at_least`. Centroids go to all tasks: one short vector for each initiative."""
    s = vectors.crossJoin(F.broadcast(cents.withColumnRenamed(by, "candidate"))).select(id_col, "candidate", F.round(tc.cosine(F.col(vec), F.col("centroid")), 6).alias("similarity"))
    best = s.groupBy(id_col).agg(F.max("similarity").alias("similarity"), F.min(F.struct(-F.col("similarity"), "candidate"))["candidate"].alias("candidate"))
    return best.withColumn("route", F.when(F.col("similarity") >= at_least, "attach").otherwise("create_new"))
