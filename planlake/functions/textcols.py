"""Text rules as column functions, for whole corpora."""

from __future__ import annotations

import re
from functools import cache, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from planlake.functions import lexicon as lx
from planlake.functions.compat import poly_hash, signed_base36

_BOUND = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


_STRUCTURE = {"has_dates": lx.DATES, "has_metrics": lx.METRICS, "has_quarter_refs": lx.QUARTERS, "has_version_refs": lx.VERSIONS, "has_launch_keywords": lx.LAUNCH_WORDS}


def _alternatives(pattern: str, open_at: int) -> tuple[list[str], int]:
    """The alternatives of the group that opens at a place, and where it closes."""
    depth, start, out, i, in_class = 0, open_at + 1, [], open_at, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == "|" and depth == 1:
            out.append(pattern[start:i])
            start = i + 1
        elif c == ")":
            depth -= 1
            if not depth:
                out.append(pattern[start:i])
                return [x.removeprefix("?:") for x in out], i
        i += 1
    return [], len(pattern)


def _letter(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _begins(pattern: str, at: int) -> str | None:
    """The letters with which what stands at a place of the pattern can begin, if it always begins with one."""
    parts, end = [pattern[at:]], len(pattern)
    if pattern[at : at + 1] == "(" and (pattern[at + 1 : at + 2] != "?" or pattern[at + 1 : at + 3] == "?:"):
        parts, end = _alternatives(pattern, at)
    sure = parts and all(x and _letter(x[0]) and x[1:2] not in ("?", "*", "{") for x in parts) and pattern[end + 1 : end + 2] not in ("?", "*", "{")
    return "".join(sorted({x[0].lower() for x in parts})) if sure else None


def java(pattern: str, ignore_case: bool = True) -> str:
    """The pattern with ASCII word boundaries, which Java's own are not.

    A boundary before words of known first letters is tried at these letters only, and one after a letter looks ahead only.
    """
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] != "\\":
            out.append(pattern[i])
            i += 1
            continue
        if pattern[i : i + 2] != r"\b":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        after_letter = i > 0 and _letter(pattern[i - 1]) and pattern[i - 2 : i - 1] != "\\"
        first = None if after_letter else _begins(pattern, i + 2)
        letters = first and (first if not ignore_case else first + first.upper())
        out.append("(?![A-Za-z0-9_])" if after_letter else f"(?=[{letters}])(?<![A-Za-z0-9_])" if letters and ignore_case else "(?<![A-Za-z0-9_])" if first else _BOUND)
        i += 2
    return ("(?i)" if ignore_case else "") + "".join(out)


def has(c: Column, pattern: str) -> Column:
    """Whether the pattern is found, in any case. Whole batches are searched by Arrow, whose engine tries all alternatives of a
    pattern at once and has ASCII word boundaries of its own. Patterns that look ahead or behind, and lambdas, take matches().
    """
    return matches(c, pattern) if _looks(pattern) else _search(pattern)(c)


def _looks(pattern: str) -> bool:
    return re.search(r"\(\?<?[=!]", pattern) is not None


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(java(pattern))


@cache
def _search(pattern: str):
    @F.arrow_udf("boolean")
    def search(text: pa.Array) -> pa.Array:
        return pc.match_substring_regex(text, pattern, ignore_case=True)

    return search


def let(value: Column, use) -> Column:
    """use(value), with the value made once: a lambda makes what it reads from outside again for each element."""
    return F.transform(F.array(value), use)[0]


def any_of(c: Column, patterns: list[str], has=has) -> Column:
    parts = ["|".join(f"(?:{p})" for p in patterns if _looks(p) == looks) for looks in (False, True)]
    return reduce(Column.__or__, (has(c, p) for p in parts if p))


def normalised_newlines(c: Column) -> Column:
    """Unix line ends, no blanks at line ends, no blank lines at either end."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"^(?:[ \t]*\n)+", ""), r"\s+$", "")


def comparison_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), r"[^A-Za-z0-9_ ]", ""))


def title_form(c: Column) -> Column:
    c = F.regexp_replace(F.trim(F.lower(c)), r"[^A-Za-z0-9_\s]", "")
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, 120)


def suggestion_key(note_id: Column, section_id: Column, kind: Column, title: Column) -> Column:
    return F.sha1(F.concat_ws("|", note_id, section_id, kind, title_form(title)))


def fingerprint(kind: Column, title: Column, body: Column) -> Column:
    c = F.lower(F.concat_ws("::", kind, title, body))
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"[^A-Za-z0-9_ :]", ""))
    return signed_base36(poly_hash(F.substring(c, 1, 200), 0, 31))


@F.arrow_udf(StringType())
def redacted(c: pa.Array) -> pa.Array:
    """Mail addresses and numbers replaced by their labels, in whole Arrow batches."""
    return reduce(lambda x, rule: pc.replace_substring_regex(x, *rule), lx.REDACTION, c)


def preview(c: Column, most: int = 160) -> Column:
    r = redacted(F.trim(c))
    return F.when(F.char_length(r) <= most, r).otherwise(F.concat(F.substring(r, 1, most), F.lit("…")))


def sentences(c: Column) -> Column:
    """Split after . ! ? and white space where no lower-case letter follows: fragments stay with their sentence."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+(?![a-z])"), lambda x: F.trim(x)), lambda x: x != "")


def bullet_sentences(c: Column) -> Column:
    """Split after . ! ? and white space, then at line ends."""
    parts = F.flatten(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.split(x, "\n")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def line_type(line: Column) -> Column:
    """heading, list_item, quote, blank or paragraph, for a line outside code."""
    t = F.btrim(line)
    return (
        F.when(t == "", "blank").when(t.rlike(r"^#{1,6}\s"), "heading").when(t.rlike(r"^>\s"), "quote")
        .when(t.rlike(r"^[-*+•]\s|^\d+[.)]\s"), "list_item").otherwise("paragraph")
    )


@F.arrow_udf(StructType([StructField(k, BooleanType()) for k in _STRUCTURE] + [StructField("initiative_phrase_density", DoubleType())]))
def _structure(low: pa.Array) -> pa.Array:
    low = pc.replace_substring(low, "\n", " ")
    words = pc.add(pc.count_substring_regex(low, "[ \\t\\n\\x0b\\f\\r]+"), 1)
    phrases = pc.count_substring_regex(low, lx.INITIATIVE_PHRASES, ignore_case=True)
    density = pc.min_element_wise(1.0, pc.divide(pc.cast(phrases, "double"), pc.divide(pc.cast(words, "double"), 10.0)), skip_nulls=False)
    return pa.StructArray.from_arrays([*(pc.match_substring_regex(low, p, ignore_case=True) for p in _STRUCTURE.values()), density], [*_STRUCTURE, "initiative_phrase_density"])


def structure(text: Column) -> Column:
    """What a text has: dates, metrics, references, and initiative phrases for each ten words; whole texts in Arrow batches."""
    return _structure(F.lower(text))


def tokens(c: Column, longer_than: int) -> Column:
    """Words of a-z and 0-9, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[a-z0-9]{{{longer_than + 1},}}"), F.lit(0))


def _lits(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def generic_ratio(c: Column) -> Column:
    """The share of generic words among those of three letters."""
    return let(tokens(c, 2), lambda t: F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.filter(t, lambda w: w.isin(lx.GENERIC))) / F.size(t)))


def domain_nouns(c: Column) -> Column:
    return F.array_except(tokens(c, 3), _lits([*lx.GENERIC, *lx.COMMON]))


def concrete_delta(c: Column) -> Column:
    return has(c, lx.CONCRETE_DELTA)


def schedule_event(c: Column) -> Column:
    return has(c, lx.SCHEDULE_EVENT)


def spec_section(text: Column, heading: Column) -> Column:
    both = F.concat_ws(" ", heading, text)
    n = sum((has(text, p).cast("int") for p in lx.SPEC_TOKENS), F.lit(0))
    return (has(heading, lx.SPEC_HEADING) | (n >= 2)) & ~has(both, lx.SPEC_EXCLUSIONS) & ~concrete_delta(both) & ~schedule_event(both)


def process_noise(c: Column, has=has) -> Column:
    return any_of(c, lx.NOISE, has) & ~any_of(c, lx.OWNERSHIP, has)


def signals(sentence: Column) -> Column:
    """Array of (signal, label, confidence) of a sentence."""
    demand = has(sentence, lx.EXTERNAL_ACTORS) & has(sentence, lx.DESIRE_VERBS)
    plan = has(sentence, lx.TIME_MILESTONE) & has(sentence, lx.SHIFT_VERBS) & ~has(sentence, lx.PLAN_CONDITIONAL)
    bug = has(sentence, lx.BUG_TOKENS) & ~has(sentence, lx.BUG_CONDITIONAL)
    direct = has(sentence, lx.ACTIONABLE_CONDITIONAL) | (has(sentence, lx.RISK_CONDITIONAL) & has(sentence, lx.CONSEQUENCES))
    topic = has(sentence, lx.RISK_TOKENS) & ~(has(sentence, lx.SHIFT_VERBS) & has(sentence, lx.TIME_UNITS)) & ~has(sentence, lx.FEATURE_ASK)
    pii = has(sentence, lx.PII) & has(sentence, lx.PII_PARTNERS)
    risk = ~has(F.trim(sentence), lx.SUBJECTIVE_CONCERN) & (direct | topic)
    made = lambda name, label, conf: F.struct(F.lit(name).alias("signal"), F.lit(label).alias("label"), conf.cast("double").alias("confidence"))
    return F.array_compact(
        F.array(
            F.when(demand, made("FEATURE_DEMAND", "idea", F.when(has(sentence, lx.AMPLIFIERS), 0.75).otherwise(0.65))),
            F.when(plan, made("PLAN_CHANGE", "project_update", F.lit(0.75))),
            F.when(risk, made("SCOPE_RISK", "risk", F.when(~direct & pii, 0.85).otherwise(0.7))),
            F.when(bug, made("BUG", "bug", F.lit(0.7))),
        )
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two word arrays as sets; 0 if both are empty."""
    share = lambda p: F.when(F.size(p["u"]) > 0, F.size(F.array_intersect(p["a"], p["b"])) / F.size(p["u"])).otherwise(F.lit(0.0))
    return let(let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.array_union(p["a"], p["b"]).alias("u"))), share)


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or a zero vector."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot / n).otherwise(F.lit(0.0))


def duration_days(c: Column) -> Column:
    """The first relative duration in days: N days, weeks, months or quarters."""
    n = F.regexp_extract(c, java(r"\b(\d+)[\s-]*(day|week|month|quarter)s?\b"), 1)
    unit = F.lower(F.regexp_extract(c, java(r"\b(\d+)[\s-]*(day|week|month|quarter)s?\b"), 2))
    days = F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).when(unit == "quarter", 90)
    return F.when(n != "", n.try_cast("bigint") * days)


BUCKET_TITLES = {"risk": "Risks", "bug": "Bugs", "idea": "New ideas", "project_update": "Project updates"}


def bucket(label: Column, kind: Column) -> Column:
    return F.when(label.isin("risk", "bug"), label).otherwise(kind)
