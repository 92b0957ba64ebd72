"""Main text of web pages by block rules in two passes.

Markup is read once, tag by tag, whatever is left open or closed twice. Block-level tags, and two line breaks in a row,
end a block; white space in a block becomes one space. Scripts, styles, comments and the like are no text.

The first pass decides what it can. Bad: blocks in navigation, footers, sidebars, forms, notices, adverts or comments
(by tag, role, or a word of class or id), and blocks of which links make up too much. Good: long blocks with enough stop words;
with fewer they are nearly good, without bad. Blocks too short for the counts are ambiguous. In the page's article (by
tag or role), text that is not bad by its place or its links is good or ambiguous: names and tables have no stop words.

The second pass lets every ambiguous block inherit the label of the nearest decided block in page order: in an article
among its own blocks (without those bad by their place) and its ends, which count as good, and elsewhere among all blocks. At equal distance a heading takes
what follows, any other block what goes before. Nearly good blocks count as decided for others.

A null or empty page, or one without main text, gives an empty text. Every page gives one row, repeated and null ids too.
Pages of any length are read whole, in time that grows with their length. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlake.llm.common import settled, table

#: Characters from which a block is long enough to be judged, and good without doubt.
SHORT = 70
LONG = 200
#: Share of stop words in a good block, and in a nearly good one.
STOP_HIGH = 0.30
STOP_LOW = 0.15
#: Share of a block's characters in links from which it is bad: anywhere, and within the article.
LINKS = 0.2
ARTICLE_LINKS = 0.5

#: Frequent function words of English, German, French, Spanish, Italian and Portuguese.
STOP_WORDS = frozenset(
    """
    the of and a to in is it that for on was with as be by at this have from or not are but had they which you one we all
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
    le la les de des du et à un une est en que qui dans pour pas au sur ne se ce il sont plus par avec je son elle
    el los las y por con no una su para como más pero sus le ya o fue este sí porque esta entre cuando muy sin sobre
    che di il per non sono ma come lo anche si da nel della questo gli
    não uma os com dos mas ao ele das seu sua ou quando muito já
    """.split()
)
#: Elements that end a block of text.
BLOCKS = frozenset(
    """
    address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table
    tbody td textarea tfoot th thead title tr ul
    """.split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is no text of the page.
SILENT = "script|style|title|textarea|noscript|template|iframe|noframes|noembed|object|svg|math|canvas|audio|video|xmp"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are bad by their name.
BAD_TAGS = frozenset("nav footer aside form menu button select dialog fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of a class or id that make an element bad.
BAD_WORDS = frozenset(
    """
    ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu
    menus breadcrumb breadcrumbs sidebar sidebars footer cookie cookies consent gdpr notice notices notification alert disclaimer comment
    comments disqus respond replies share sharing social newsletter subscribe subscription signup login related recommended popup modal
    overlay widget widgets pagination pager toolbar copyright masthead
    """.split()
)
#: An article's parts have these in their names too, so there they say nothing.
OUTER_WORDS = frozenset("header topbar top bottom tags meta".split())
#: Classes and ids, and roles and properties, of articles.
ARTICLE_WORDS = frozenset("article-body article-content article__body articlebody entry-content post-content post-body story-body main-content content-body".split())
#: Elements that an element of the same kind ends, up to their list or table.
SIBLINGS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: Attributes of a tag. No tag has a hundred quoted values, and none outside of quotes begins within one.
_ATTRS = r"(?:[^<>\"']++|\"[^\"]{0,9999}\"|'[^']{0,9999}'){0,99}+"
_TOKEN = re.compile(
    rf"<!--(?:.*?--!?>|.*\Z)|<(?P<raw>{SILENT})\b{_ATTRS}>.*?(?:</(?P=raw)\s*(?:>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-z][^\s/<>]*)(?P<attrs>{_ATTRS})>|</?[a-z][^<>]*+>|<[!?/][^<>]*+>",
    re.S | re.I,
)
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: How many open elements up an inline tag looks for the one that it ends.
DEEP = 64
_OUTSIDE = ("", False, 0, False)
_WORD = re.compile(r"[^\W\d_]+")
_NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Block:
    __slots__ = ("bad", "heading", "article", "text", "linked", "label")

    def __init__(self, bad: bool, heading: bool, article: int, text: str, linked: int):
        self.bad, self.heading, self.article, self.text, self.linked = bad, heading, article, text, linked
        self.label = ""


def _traits(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether the element is bad, and whether it is an article."""
    bad, article = tag in BAD_TAGS or (tag == "header" and not in_article), tag in ("article", "main")
    if not attrs or tag in ("html", "body"):
        return bad, article
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "role":
            bad, article = bad or value.lower() in BAD_ROLES, article or value.lower() in ("main", "article")
        elif name == "itemprop":
            article = article or value.lower() == "articlebody"
        elif name == "style":
            bad = bad or "display:none" in value.replace(" ", "").lower()
        elif name == "hidden":
            bad = True
        elif name == "aria-hidden":
            bad = bad or value.lower() == "true"
        else:
            for one in value.split():
                if one.lower() in ARTICLE_WORDS:
                    article = True
                    continue
                parts = {p.lower() for p in _NAME_PART.findall(one)}
                if parts & {"has", "with", "no", "without"}:
                    continue  # says what is beside it
                bad = bad or bool(parts & BAD_WORDS) or (not in_article and tag != "article" and bool(parts & OUTER_WORDS))
    return bad, article


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    open_: list[tuple[str, bool, int, bool]] = []  # tag, bad here, number of the article or 0, whether the block around is bad
    names: Counter = Counter()
    articles, links, breaks = 0, 0, 0
    text: list[str] = []
    linked = 0
    heading = ""

    def flush() -> None:
        nonlocal linked, breaks
        if text:
            words = "".join(text).split()
            if words:
                _, bad, article, _ = open_[-1] if open_ else _OUTSIDE
                out.append(Block(bad, bool(heading), 0 if bad else article, " ".join(words), linked))
            text.clear()
        linked = breaks = 0

    def say(raw: str) -> None:
        nonlocal linked, breaks
        if not raw:
            return
        if "&" in raw:
            raw = references.unescape(raw)
        if links:
            linked += sum(map(len, raw.split()))
        if breaks and raw.strip():
            breaks = 0
        # in an inline element that is bad, in a block that is not, the words go alone
        if not open_ or not open_[-1][1] or open_[-1][3]:
            text.append(raw)

    def pop(to: int) -> None:
        nonlocal links
        for t, *_ in open_[to:]:
            names[t] -= 1
            links -= t == "a"
        del open_[to:]

    def nearest(tag: str, up_to: Collection[str]) -> int:
        """Place of the innermost open element of this name, within one of `up_to`; -1 if none is near."""
        for k in range(len(open_) - 1, max(-1, len(open_) - 1 - DEEP), -1):
            if open_[k][0] == tag:
                return k
            if open_[k][0] in up_to:
                break
        return -1

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag, ends = m["tag"].lower(), bool(m["end"])
        if tag == "br":
            breaks += 1
            if breaks == 2:
                flush()
            text.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if tag in HEADINGS:
            heading = "" if ends else tag
        if ends:
            if names[tag] <= 0:
                continue
            k = len(open_) - 1
            if tag in BLOCKS:
                while open_[k][0] != tag:
                    k -= 1
                pop(k)
                continue
            k = nearest(tag, BLOCKS)
            if k >= 0:
                names[tag] -= 1
                links -= tag == "a"
                del open_[k]
            continue
        if tag in BLOCKS:
            if names["p"] > 0:  # a block ends the paragraph that it stands in
                k = nearest("p", BLOCKS)
                if k >= 0:
                    pop(k)
            if tag in SIBLINGS and names[tag] > 0:
                k = nearest(tag, SIBLINGS[tag])
                if k >= 0:
                    pop(k)
        if tag in VOID:
            continue
        _, bad, article, around = open_[-1] if open_ else _OUTSIDE
        if tag == "a" and names["a"] > 0 and open_[-1][0] == "a":
            pop(len(open_) - 1)
        own_bad, own_article = _traits(tag, m["attrs"], bool(article))
        if own_article and not own_bad and not article:
            articles += 1
            article = articles
        bad = bad or own_bad
        open_.append((tag, bad, article, bad if tag in BLOCKS else around))
        names[tag] += 1
        links += tag == "a"
    say(page[at:])
    flush()
    return out


def decide(blocks: list[Block]) -> None:
    """First pass: sets label to good, near, bad, or leaves it empty."""
    for b in blocks:
        solid = max(1, len(b.text) - b.text.count(" "))
        if b.bad or b.linked > (ARTICLE_LINKS if b.article else LINKS) * solid:
            b.label = "bad"
        elif len(b.text) >= SHORT:
            words = _WORD.findall(b.text.lower())
            stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
            if stops >= STOP_HIGH:
                b.label = "good" if len(b.text) >= LONG or b.article else "near"
            elif stops >= STOP_LOW:
                b.label = "near"
            elif not b.article:
                b.label = "bad"
        elif not b.article and "©" in b.text:
            b.label = "bad"


def inherit(blocks: list[Block]) -> list[str]:
    """Second pass: the text of the blocks that are good in the end."""
    n = len(blocks)
    far = n + 1
    before: list[tuple[int, bool]] = []  # distance and label of the nearest decided block, article by article
    for order in (range(n), range(n - 1, -1, -1)):
        last: dict[int, tuple[int, bool]] = {}
        seen = Counter()
        for i in order:
            b = blocks[i]
            seen[0] += 1
            if b.article:
                seen[b.article] += 1
            group = b.article
            start = (0, True) if group else None
            known = last.get(group, start)
            found = (seen[group] - known[0], known[1]) if known else (far, False)
            if order.step > 0:
                before.append(found)
            elif not b.label:
                ahead, behind = found, before[i]
                if ahead[0] != behind[0]:
                    good = min(ahead, behind)[1]
                else:
                    good = (ahead if b.heading else behind)[1]
                b.label = "in" if good else "out"
            if b.label not in ("", "in", "out"):
                last[0] = seen[0], b.label != "bad"
                if b.article:
                    last[b.article] = seen[b.article], b.label != "bad"
    return [b.text for b in blocks if b.label in ("good", "near", "in")]


def main_text(page: str | None) -> tuple[str, int]:
    """Text, and the number of blocks that are no part of it."""
    blocks = blocks_of(page or "")
    decide(blocks)
    kept = inherit(blocks)
    return "\n".join(kept), len(blocks) - len(kept)


def extract(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """`columns`, text, n_chars, n_dropped (blocks): one row for each page."""
    read = pages.select(*columns, F.col(html_col).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(x.as_py()) for x in batch.column("__html")]
            texts = [t for t, _ in got]
            own = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array((d for _, d in got), pa.int64())]
            yield pa.record_batch([*(batch.column(c) for c in columns), *own], names=[*columns, "text", "n_chars", "n_dropped"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1])
    return read.mapInArrow(run, f"{kinds}, text string, n_chars bigint, n_dropped bigint")


@settled
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).drop("n_dropped")


#: On pages whose article element holds the main text and nothing else, as in the given tables, SQL finds it without the rules.
ORACLE = r"""
with a as (select page_id, url, string_split_regex(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br>', ' ', 'g'), '</?(p|h1)>') as parts from pages
), b as (
  select page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as parts from a
), c as (select page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) as text from b)
select page_id, url, coalesce(text, '') as text, length(coalesce(text, '')) as n_chars from c
"""
