"""Notes to blocks and sections by running sums over their lines; all of it stays in the JVM.

Lines are numbered rows; what a line belongs to follows from counts of the lines before it in its note: fence marks (odd:
within code), lines that end a list, headings. One sort by (note, line) serves all counts of a job. A null or empty body is one
empty line and gives no block and no section. Offsets count characters from 0, as substring() does from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Pseudo-headings of notes without headings.
PSEUDO = r"(?i)^(?:(?:Plan|Roadmap|Execution|Next Steps|Decisions|Goals|Scope|Timeline|Strategy):|Q[1-4]\s+\d{4}|H[12]\s+\d{4}|Phase\s+\d+|Sprint\s+\d+)"
PLAIN_HEADING = 40
SPACE = " \t\n\x0b\x0c\r"
_ITEM = r"^\s*(?:[-*+]|\d+\.)\s+"


#: Bytes of bodies that a task takes: its sorts hold their lines several times over.
TASK_BYTES = 1 << 23


def dealt(notes: DataFrame) -> DataFrame:
    """note_id, body by note_id in as many partitions as their bytes ask for, so what a task holds doesn't grow with the table.

    Windows and groups of a note's lines find them here: the bodies are shuffled, once, and not the lines.
    """
    size = notes.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    return notes.select("note_id", "body").repartition(1 + size // TASK_BYTES, "note_id")


def _order() -> WindowSpec:
    return Window.partitionBy("note_id").orderBy("line")


def _before() -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def _up_to() -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def lines_of(notes: DataFrame) -> DataFrame:
    """note_id, line (from 0), s, start (offset in the body), last (whether it is the last line)."""
    x = dealt(notes).select("note_id", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\n")).alias("line", "s"))
    before = F.coalesce(F.sum(F.char_length("s") + 1).over(_before()), F.lit(0))
    return x.withColumns({"start": before, "last": F.lead("line").over(_order()).isNull()})


def _count(flag: Column, over: WindowSpec | None = None) -> Column:
    return F.coalesce(F.sum(flag.cast("int")).over(over or _up_to()), F.lit(0))


def blocks(notes: DataFrame) -> DataFrame:
    """Blocks of meeting notes: note_id, index, type (heading, list, code, body), title, level, start_char, end_char, content.

    A line that starts with `1. ` is a heading of level 2 unless a list is open; a list goes on over empty lines and ends at
    any other text. An open fence holds all lines to the next fence. Blocks carry the title of the heading before them.
    """
    mark = F.startswith(strip(F.col("s")), F.lit("```"))
    x = lines_of(notes).withColumn("mark", mark).withColumn("marks", _count(F.col("mark"), _before()))
    x = x.withColumns({"code": F.col("mark") | (F.col("marks") % 2 == 1), "opens": F.col("mark") & (F.col("marks") % 2 == 0)})
    text = ~F.col("code")
    blank = text & (strip(F.col("s")) == "")
    hashes = text & F.col("s").rlike(r"^#{1,6}\s+[^\r\n]+\z")
    numbered = text & F.col("s").rlike(r"^\d+\.\s+[^\r\n]+\z")
    item = text & F.col("s").rlike(_ITEM + r"[^\r\n]+\z")
    x = x.withColumns({"blank": blank, "hashes": hashes, "item": item & ~hashes, "numbered": numbered & ~hashes})
    # runs of items and empty lines: from the first item on that is no numbered line at the margin, all is one list
    x = x.withColumn("run", _count(~(F.col("item") | F.col("blank"))))
    within = Window.partitionBy("note_id", "run").orderBy("line")
    opener = F.col("item") & ~F.col("numbered")
    in_run = F.col("item") | F.col("blank")
    listed = in_run & F.coalesce(F.max(opener.cast("int")).over(within), F.lit(0)).cast("boolean") & ~(F.col("blank") & F.col("last"))
    x = x.withColumn("listed", listed)
    first_item = F.col("listed") & ~F.coalesce(F.lag("listed").over(within), F.lit(False))
    heading = ~F.col("listed") & (F.col("hashes") | F.col("numbered"))
    body = ~(F.col("code") | F.col("listed") | F.col("hashes") | F.col("numbered") | F.col("blank"))
    x = x.withColumns({"first_item": first_item, "heading": heading, "body": body})
    stops = F.col("s").rlike(r"^#{1,6}\s+") | F.col("s").rlike(_ITEM)
    goes_on = F.coalesce(F.lag("body").over(_order()), F.lit(False)) & ~stops
    starts = F.col("opens") | F.col("first_item") | F.col("heading") | (F.col("body") & ~goes_on)
    name = strip(F.regexp_replace("s", r"^(?:#{1,6}|\d+\.)\s+", ""))
    x = x.withColumn("starts", starts).where(~F.col("blank") | F.col("listed")).withColumns({"index": _count(F.col("starts")) - 1, "name": F.when(F.col("heading"), name)})
    kind = F.when(F.col("code"), "code").when(F.col("listed"), "list").when(F.col("heading"), "heading").otherwise("body")
    level = F.when(F.col("hashes"), F.length(F.regexp_extract("s", "^#+", 0))).when(F.col("heading"), 2)
    x = x.withColumns({"type": kind, "title": F.last("name", ignorenulls=True).over(_up_to()), "level": level})
    return x.groupBy("note_id", "index").agg(
        F.min("type").alias("type"), F.first("title").alias("title"), F.max("level").alias("level"), F.min("start").alias("start_char"),
        F.sum(F.char_length("s") + 1).alias("n"), F.array_join(F.sort_array(F.collect_list(F.struct("line", "s")))["s"], "\n").alias("content"),
    ).select("note_id", F.col("index").cast("int").alias("index"), "type", F.nullif("title", F.lit("")).alias("title"), "level", "start_char", (F.col("start_char") + F.col("n")).alias("end_char"), "content")


# Abbreviations whose stop ends no sentence.
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "sr", "jr", "vs", "e.g", "i.e", "etc"]
_ABBREVIATED = r"\b(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\."


def utterances(found: DataFrame) -> DataFrame:
    """Utterances of blocks: note_id, block, index, text, start_char, end_char; substring(body, start_char + 1, end_char - start_char) is the text.

    List items, and sentences of other text; headings and code have none. Text is cut before white space that follows . ! ? of no
    abbreviation, so the pieces of a block keep all of its characters and their lengths add up to offsets. The text stays as written.
    """
    x = found.where("type in ('list', 'body')")
    sentence = rf"(?i)(?<=[.!?])(?<!{_ABBREVIATED})(?=\s)"
    pieces = F.when(F.col("type") == "list", F.split("content", r"(?=\n)")).otherwise(F.split("content", sentence))
    x = x.select("note_id", F.col("index").alias("block"), "type", "start_char", F.posexplode(pieces).alias("i", "piece"))
    before = Window.partitionBy("note_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.when(F.col("type") == "list", F.regexp_extract("piece", _ITEM + r"(?=\S)", 0)).otherwise(F.regexp_extract("piece", r"^\s*", 0))
    x = x.withColumns({"at": F.col("start_char") + F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)), "lead": F.char_length(lead)})
    text = F.regexp_replace(F.expr("substring(piece, lead + 1)"), r"\s+\z", "")
    x = x.withColumn("text", text).where((F.char_length("text") > 0) & ((F.col("type") != "list") | (F.col("lead") > 0)))
    index = F.row_number().over(Window.partitionBy("note_id", "block").orderBy("i")) - 1
    start = F.col("at") + F.col("lead")
    return x.select("note_id", "block", index.alias("index"), "text", start.alias("start_char"), (start + F.char_length("text")).alias("end_char"))


def fence_marks(lines: Column) -> Column:
    """The numbers of the lines that open or close code: a fence of backticks ends at backticks, one of tildes at tildes."""
    kind = lambda t: F.when(F.startswith(t, F.lit("```")), "`").when(F.startswith(t, F.lit("~~~")), "~")
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), kind(strip(x)).alias("k"))), lambda m: m["k"].isNotNull())
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<int>").alias("at"))

    def step(a, m):
        counts = (a["open"] == "") | (a["open"] == m["k"])
        return F.when(counts, F.struct(F.when(a["open"] == "", m["k"]).otherwise("").alias("open"), F.concat(a["at"], F.array(m["i"])).alias("at"))).otherwise(a)

    return F.aggregate(marks, start, step, lambda a: a["at"])


def section_lines(notes: DataFrame) -> DataFrame:
    """The lines of notes with what they are for sections: kind, head (it starts a section), name, level, section (headings up to here)."""
    lines = F.split(F.coalesce("body", F.lit("")), "\n")
    x = dealt(notes).select("note_id", lines.alias("lines")).withColumn("fences", fence_marks(F.col("lines"))).select("note_id", "fences", F.posexplode("lines").alias("line", "s"))
    t = strip(F.col("s"))
    mark = F.array_contains("fences", F.col("line"))
    x = x.select("note_id", "line", "s", t.alias("t"), mark.alias("mark"))
    code = F.col("mark") | (_count(F.col("mark")) % 2 == 1)
    kind = (
        F.when(code, "code").when(F.col("t") == "", "blank").when(F.col("t").rlike(r"^#{1,6}\s"), "heading").when(F.col("t").rlike(r"^>\s"), "quote")
        .when(F.col("t").rlike(r"^(?:[-*+•]\s|\d+[.)]\s)"), "list_item").otherwise("paragraph")
    )
    x = x.withColumn("kind", kind)
    after = F.lead("kind").over(_order())
    short = (F.col("kind") == "paragraph") & (F.char_length("t") <= PLAIN_HEADING) & ~F.col("t").rlike(r"[.?!]\z") & (after.isNull() | after.isin("blank", "paragraph", "list_item"))
    marked = F.col("kind") == "heading"
    hashes = F.regexp_extract("t", "^#+", 0)
    x = x.withColumns({"short": short, "marked": marked, "plain": F.regexp_replace("t", r":\z", ""), "rest": strip(F.expr("substring(t, char_length(regexp_extract(t, '^#+', 0)) + 1)"))})
    x = x.withColumns({"part": _count(F.col("marked")), "under": F.last(F.when(F.col("marked"), F.col("rest")), ignorenulls=True).over(_up_to())})
    # below a heading named General, the first short line of another name is a heading and ends that
    of_part = Window.partitionBy("note_id", "part").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    renamed = F.coalesce(F.sum((F.col("short") & (F.col("plain") != "General")).cast("int")).over(of_part), F.lit(0))
    plain_head = F.col("short") & ((F.col("part") == 0) | ((F.col("under") == "General") & (renamed == 0)))
    pseudo = F.col("t").rlike(PSEUDO)
    x = x.withColumns({"plain_head": plain_head, "pseudo": pseudo})
    sure = F.col("marked") | F.col("plain_head")
    first_pseudo = F.col("pseudo") & ~sure & (_count(sure | F.col("pseudo"), _before()) == 0)
    name = F.when(F.col("marked"), F.col("rest")).when(F.col("plain_head"), F.col("plain")).otherwise(strip(F.regexp_replace("s", r":\z", "")))
    head = F.coalesce(sure | first_pseudo, F.lit(False))
    x = x.withColumns({"head": head, "name": name, "level": F.when(F.col("marked"), F.length(hashes)).otherwise(2)})
    return x.select("note_id", "line", "s", "kind", "head", "name", "level", _count(F.col("head")).alias("section"))


def sections(notes: DataFrame) -> DataFrame:
    """One row for each section with text: note_id, ordinal, heading_text, heading_level, start_line, end_line, raw_text, num_lines, num_list_items.

    Markdown headings start sections; before the first of them, and below one named General, short plain lines without a closing
    stop do too; a line like `Plan:` does where it is the first heading of all. What stands before any heading is General. A heading
    over empty lines passes its name on: `Parent > Child`.
    """
    own = ~F.col("head")
    g = section_lines(notes).groupBy("note_id", "section").agg(
        F.max(F.when(F.col("head"), F.col("name"))).alias("name"), F.max(F.when(F.col("head"), F.col("level"))).alias("level"), F.min("line").alias("start_line"), F.max(F.when(own, F.col("line"))).alias("end_line"),
        F.array_join(F.sort_array(F.collect_list(F.when(own, F.struct("line", "s"))))["s"], "\n").alias("raw_text"), F.count_if(own).alias("num_lines"), F.count_if(F.col("kind") == "list_item").alias("num_list_items"),
    ).where("num_lines > 0")
    g = g.withColumns({"name": F.coalesce("name", F.lit("General")), "level": F.coalesce("level", F.lit(1)), "full": strip(F.col("raw_text")) != ""})
    w = Window.partitionBy("note_id").orderBy("section")
    g = g.withColumn("ordinal", F.coalesce(F.sum(F.col("full").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    passed = F.when(F.col("full"), F.nullif("name", F.lit(""))).otherwise(F.nullif(F.nullif("name", F.lit("")), F.lit("General")))
    names = F.array_join(F.collect_list(passed).over(Window.partitionBy("note_id", "ordinal").orderBy("section")), " > ")
    return g.withColumn("heading_text", names).where("full").select(
        "note_id", F.col("ordinal").cast("int").alias("ordinal"), "heading_text", F.col("level").cast("int").alias("heading_level"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"),
        "raw_text", F.col("num_lines").cast("int").alias("num_lines"), F.col("num_list_items").cast("int").alias("num_list_items"),
    )
