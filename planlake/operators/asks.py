"""Explicit asks of texts, the most direct ones first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planlake.functions import lexicon as lx
from planlake.functions import textcols as tc

SHORTEST = 10


def _word(s: Column, words: list[str]) -> Column:
    return tc.matches(s, rf"\b(?:{'|'.join(words)})\b")


def explicit_request(s: Column) -> Column:
    return tc.any_of(s, lx.EXPLICIT_REQUESTS, tc.matches) | (tc.matches(s, r"\bwe\s+could\b") & tc.matches(s, lx.WE_COULD_VERBS)) | (tc.matches(s, r"\busers?\s+wants?\s+") & tc.matches(s, lx.WANTED_ARTIFACTS))


def only_talk(s: Column) -> Column:
    """To review or discuss without any work; a priority or a worry without an action; process noise."""
    meta = _word(s, lx.META_VERBS) & ~_word(s, lx.CONCRETE_VERBS) & ~_word(s, lx.CONCRETE_NOUNS)
    acts = _word(s, lx.WORK_VERBS)
    return meta | (tc.any_of(s, lx.PRIORITY_STATUS, tc.matches) & ~acts) | (tc.any_of(s, lx.CONCERNS, tc.matches) & ~tc.any_of(s, lx.ASK_MARKERS, tc.matches) & ~acts) | tc.process_noise(s, tc.matches)


def plan_change(s: Column) -> Column:
    t = F.trim(F.lower(s))
    return tc.matches(t, r"^if\b") & (tc.matches(t, lx.REMOVAL_VERBS) | tc.matches(t, lx.MARKET_ARTIFACTS))


#: In order: the first that holds gives the rank of an ask.
LADDER = [
    (1, [r"\brequirement(?:s)?(?:\s+to|\s*:)?\s+implement\b"]), (2, [r"\brequest(?:s|ed)?\s+(?:to\s+add|to\b)"]), (3, [r"\b(?:we|users?|teams?)\s+needs?\s+"]), (3, [r"\busers?\s+wants?\s+", lx.WANTED_ARTIFACTS]),
    (4, [r"\basks?\s+for\b"]), (5, [r"\bthis\s+will\s+require\b"]), (6, [r"\bsuggestion:"]), (7, [r"\bmaybe\s+we\s+could\b"]), (7, [r"\bwe\s+could\b", lx.WE_COULD_VERBS]),
]


def rank(s: Column) -> Column:
    out = F.lit(8)
    for n, patterns in reversed(LADDER):
        holds = F.lit(True)
        for p in patterns:
            holds = holds & tc.matches(s, p)
        out = F.when(holds, n).otherwise(out)
    return F.when(plan_change(s), 9).otherwise(out)


def ranked_asks(text: Column, most: int = 2) -> Column:
    """The first `most` distinct asks of a text as (rank, sentence), by rank and then by place.

    One expression over the text's sentences: no rows are made for those that are no asks. Plan changes come last.
    """
    stripped = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    sentences = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), stripped), lambda x: F.char_length(x) > SHORTEST)
    asks = F.filter(sentences, lambda x: explicit_request(x) & ~only_talk(x))
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^[-*+•]\s+", ""), r"^\d+[.)]\s+", ""), r"\s+", " ")
    ranked = F.array_sort(F.transform(asks, lambda x, i: F.struct(rank(x).alias("rank"), i.alias("place"), plain(x).alias("sentence"))))
    start = F.array().cast("array<struct<rank:int,place:int,sentence:string>>")
    add = lambda a, x: F.when((F.size(a) < most) & ~F.exists(a, lambda y: y["sentence"] == x["sentence"]), F.concat(a, F.array(x))).otherwise(a)
    return F.transform(F.aggregate(ranked, start, add), lambda x: F.struct(x["rank"].alias("rank"), x["sentence"].alias("sentence")))
