"""Main text of web pages by maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words score above zero; a tag's score is a weight learnt from labelled
pages, the smoothed log-odds that this tag stands inside rather than outside the main content. One linear scan finds the
contiguous region with the greatest sum. Within that region, elements that never belong to an article (menus, adverts,
forms, comment threads and the like) are passed over, character references are decoded, and blocks are joined. Inline
elements and headings are never passed over for their names; an aside that is never closed ends with the element around it. Words of
formulas (``math``) and of an ``object``'s fallback are text; annotations of formulas, which no page shows, are not.

Labels: pages that mark their content with ``<article>`` or ``<main>`` label themselves. Weights are fitted on at most
``sample`` such pages of at most ``sample_bytes`` bytes each, those with the smallest hash; every page is then read whole.

Defined results: a null or empty page, and one without words outside passed-over elements, has an empty text; equal
pages have equal texts; of regions with equal sums the first is taken.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Elements whose content is never text (fixed values).
RAW = "script|style|noscript|template|textarea|title|svg|iframe|select|annotation-xml|annotation"
#: Elements that don't break a line of text (fixed values).
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle mspace mpadded mphantom semantics".split()
)
#: Elements without an end tag (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and the names in class, id or role that never belong to an article (fixed values).
ASIDE = frozenset("nav aside form footer button dialog menu".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer login menu nav navbar navigation "
    "newsletter notice pagination popup promo related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Elements that no name turns into an aside: they hold words of a text, or all of it.
NEVER_ASIDE = INLINE | frozenset("h1 h2 h3 h4 h5 h6 html body main article".split())
#: Elements whose end tags authors leave out (fixed values): such an end tag says nothing about what is around it.
LOOSE = INLINE | frozenset("p li dt dd tr td th thead tbody tfoot option optgroup colgroup caption".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[a-zA-Z/!?](?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+>|<[a-zA-Z/!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
_NAME = re.compile(r"</?\s*([a-zA-Z][\w:-]*)")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Token(NamedTuple):
    """A text (``name`` empty) or a tag: ``key`` says which weight it takes."""

    text: str
    name: str = ""
    key: str = ""
    end: bool = False
    aside: bool = False


def aside_names(tag: str) -> set[str]:
    """The ASIDE_NAMES by which a tag is called: a name as a whole or its last part says what an element is (ad, site-nav), an
    earlier part what it is about (related-work, search-page-content)."""
    names = (x for g in _NAMES.findall(tag) for x in "".join(g).lower().split())
    return {parts[-1] for x in names if (parts := re.findall(r"[a-z0-9]+", x))} & ASIDE_NAMES


def tokens(page: str) -> Iterator[Token]:
    for m in _TOKEN.finditer(page):
        raw = m[0]
        if m["raw"] or raw.startswith(("<!", "<?")):
            continue
        name = _NAME.match(raw) if len(raw) > 1 and raw[0] == "<" else None
        if not name:
            yield Token(raw)
            continue
        tag, end = name[1].lower(), raw.startswith("</")
        called = aside_names(raw) if not end else set()
        yield Token("", tag, f"/{tag}" if end else ".".join([tag, *sorted(called)]), end, tag in ASIDE or (tag not in NEVER_ASIDE and bool(called)))


def inside(found: list[Token]) -> list[bool]:
    """Which tokens lie in the content that a page itself marks."""
    out, mark, depth = [], "article" if any(t.name == "article" for t in found) else "main", 0
    for t in found:
        if t.name == mark:
            depth = max(0, depth + (-1 if t.end else 1))
            out.append(not t.end)
        else:
            out.append(depth > 0)
    return out


class Weights(NamedTuple):
    word: float
    tags: dict[str, float]
    #: Of tags that no labelled page has.
    unseen: float


def fit(pages: list[str], scale: float = 20.0) -> Weights:
    """Log-odds, with one count added on both sides. ``scale``: words that a tag's unit of log-odds weighs."""
    within, without = Counter(), Counter()
    for page in pages:
        found = list(tokens(page))
        for t, here in zip(found, inside(found), strict=True):
            (within if here else without)[t.key or "words"] += 1 if t.name else len(t.text.split())
    odds = lambda k: math.log((within[k] + 1) / (without[k] + 1))
    return Weights(1.0, {k: scale * odds(k) for k in sorted(within | without) if k != "words"}, -1.0)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first contiguous region with the greatest sum above zero, end exclusive."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, where = total, (start, i + 1)
    return where


def extract(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    found = list(tokens(page))
    scores = [weights.tags.get(t.key, weights.unseen) if t.name else weights.word * len(t.text.split()) for t in found]
    first, last = best_region(scores)
    blocks, line, skipped, around = [], [], [], []
    for t in found[first:last]:
        if skipped:
            if t.end and t.name in skipped:
                del skipped[len(skipped) - 1 - skipped[::-1].index(t.name) :]
                continue
            if not (t.end and t.name in around):
                if t.name and not t.end and t.name not in VOID:
                    skipped.append(t.name)
                continue
            skipped.clear()  # the end of an element around it also ends an aside that was never closed
        if not t.name:
            line.append(t.text)
            continue
        if t.name not in INLINE:
            blocks.append("".join(line))
            line = []
        if t.aside and not t.end and t.name not in VOID:
            skipped.append(t.name)
        elif t.end and t.name in around:
            del around[len(around) - 1 - around[::-1].index(t.name) :]
        elif not t.end and t.name not in VOID and t.name not in LOOSE:
            around.append(t.name)
    blocks.append("".join(line))
    lines = (" ".join(entities.unescape(b).split()) for b in blocks)
    return " ".join(x for x in lines if x)


def labelled_pages(pages: DataFrame, sample: int, sample_bytes: int) -> list[str]:
    usable = pages.where(F.octet_length("html").between(1, sample_bytes) & F.lower("html").rlike(r"<(article|main)\b"))
    hashed = usable.select("html", F.xxhash64("html").alias("h"))
    rows = usable.count()
    if rows > 4 * sample:  # only hashes below a bound that lets through twice the sample; else every task would send its own
        hashed = hashed.where(F.col("h") < int(2**64 * 2 * sample / rows) - 2**63)
    return [r[0] for r in hashed.orderBy("h", "html").limit(sample).collect()]


def main_text(weights: Weights):
    """A function from an html column to its main text."""
    known = tuple(weights)

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        learnt = Weights(*known)
        for batch in batches:
            yield pd.Series([extract(x, learnt) for x in batch], dtype=object)

    def column(html: Column) -> Column:
        return run(html)

    return column


def extract_pages(pages: DataFrame, sample: int = 400, sample_bytes: int = 100_000) -> DataFrame:
    """``pages`` (page_id, url, html) without html, with text and n_chars."""
    weights = fit(labelled_pages(pages, sample, sample_bytes))
    out = pages.select("page_id", "url", main_text(weights)(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
