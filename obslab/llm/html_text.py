"""Main text of web pages: blocks from the markup, and differences from the page with the nearest URL.

Pages are sorted by host and path (range-partitioned, so that a hot host spreads over many tasks). Each page is paired with
the neighbour on its host whose path shares the longer beginning; their lines are aligned by longest common subsequence.
Shared lines are furniture and go. Where the markup has ``article`` elements the alignment decides on each as a whole: one
that has a line of its own keeps the lines that it shares with one neighbour, because passages that articles quote would be lost
otherwise, but not those that both neighbours align with it, if they are less than its rest: these are the host's; one
whose lines are all shared is the host's, not the page's, and goes if it is shorter than the page's own ones. A page that has
none of its own, such as a copy of its neighbour, keeps them all. Elements that name themselves
furniture (``nav``, an ``ad`` class and the like) go whether or not the neighbour has them. A class, id or role counts as a
whole: ``sidebar`` is one, ``has-sidebar`` is not. What is named so, or is a form, stays if it holds the page's article or
main element (one that is not named so itself and lies in no other article). Articles that name themselves cards (``teaser``,
``card`` and the like) beside more text, or that are shorter than the text of ``main`` before them, are links to other pages:
then ``main`` without them is the text, less the lines that the neighbour shares.

Every step takes time in proportion to the page, but for the alignment, which takes lines times lines / 64 word operations
whatever the lines are: unclosed tags and quotes are looked for once, and end tags do not search the open elements.

Null html counts as empty; a page without a neighbour on its host, or whose lines are all shared, keeps what its markup
leaves (nothing tells its furniture). Repeated pages are extracted each; null URLs form a host of their own.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of elements and of classes, ids and roles.
RAW = {"script", "style", "title", "textarea", "template", "iframe", "select", "head"}
#: Raw outside articles; inside one their words are the article's.
RAW_OUTSIDE = {"noscript", "svg"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "header", "label", "input"}
FURNITURE_NAMES = {
    "ad", "ads", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "disqus", "footer", "gdpr", "header", "login",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination", "popup",
    "promo", "promotion", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words of an article's names that make it a link to another page.
CARDS = {"card", "preview", "related", "teaser", "tile"}
#: Classes and ids of several words, ``_`` read as ``-``.
COMPOUNDS = {
    "ad-banner", "ad-container", "ad-slot", "ad-unit", "ad-wrapper", "comment-body", "comment-form", "comment-list", "comments-area",
    "comments-section", "cookie-banner", "cookie-bar", "cookie-consent", "cookie-notice", "left-sidebar", "main-menu", "main-nav",
    "nav-bar", "nav-menu", "newsletter-signup", "page-footer", "related-articles", "related-posts", "right-sidebar", "search-box",
    "search-form", "share-buttons", "side-bar", "sidebar-left", "sidebar-right", "site-footer", "site-header", "site-nav",
    "skip-link", "social-links", "social-media", "social-share", "top-nav",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend",
    "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

OPENING = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
ATTRIBUTES = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Line(NamedTuple):
    """A block's text, whether it is inside an article, the main element, an article that is a card, and which article."""

    text: str
    article: bool
    main: bool = False
    card: bool = False
    part: int = 0


class Tag(NamedTuple):
    start: int
    end: int
    closing: bool
    name: str
    attributes: str
    loose: bool


def next_tag(page: str, at: int, loose: bool) -> Tag | None:
    """The next tag, comment or declaration (these without a name) from ``at`` on; what no ``>`` ends is text.

    If quotes would hide every ``>`` to the page's end, this tag and all later ones are ``loose``: they end at the first ``>``.
    """
    m = OPENING.search(page, at)
    if not m:
        return None
    end = m.end()
    if m[1] or m[2]:
        stop = page.find("-->" if m[1] else "]]>", end)
        return Tag(m.start(), len(page) if stop < 0 else stop + 3, False, "", "", loose)
    start = end
    if m[5] and not loose:
        end = ATTRIBUTES.match(page, end).end()
    # A quote that nothing closes belongs to the tag like any other character.
    stop = page.find(">", end)
    if stop < 0 and end > start:
        loose, stop = True, page.find(">", start)
    return None if stop < 0 else Tag(m.start(), stop + 1, bool(m[4]), (m[5] or "").lower(), page[start:stop] if m[5] else "", loose)


def names_in(attributes: str) -> set[str]:
    return {w.replace("_", "-") for m in NAMED.finditer(attributes) for w in "".join(filter(None, m.groups())).lower().split()}


def is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in FURNITURE:
        return not (name in ("header", "label") and in_article)
    if not attributes or name in ("html", "body", "main"):
        return False
    return bool(names_in(attributes) & ((FURNITURE_NAMES | COMPOUNDS) - {"header"} if in_article else FURNITURE_NAMES | COMPOUNDS))


def lines_of(page: str) -> list[Line]:
    """Text of the blocks outside furniture, in page order, white space made single."""
    spared: set[int] = set()  # where elements start that are shown for what they hold
    while True:
        out, holders = parse(page, spared)
        if holders <= spared:
            return out
        spared |= holders


def parse(page: str, spared: set[int]) -> tuple[list[Line], set[int]]:
    """The lines, and where furniture starts that holds the page's article or main element."""
    out: list[Line] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: name, furniture, may be spared, card
    opened: Counter[str] = Counter()
    sparing: list[int] = []  # where the open elements start that may be spared
    told = 0  # how many of these are holders already
    holders: set[int] = set()
    endless: set[str] = set()  # raw elements that no further tag ends
    hidden = articles = cards = part = 0
    at, loose = 0, False

    def close_block() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(Line(text, articles > 0 and not cards, opened["main"] > 0, cards > 0, part if articles else 0))

    def pop() -> None:
        nonlocal hidden, articles, cards, told
        name, furniture, may, card = stack.pop()
        opened[name] -= 1
        hidden -= furniture
        articles -= name == "article"
        cards -= card
        if may:
            sparing.pop()
            told = min(told, len(sparing))

    while True:
        tag = next_tag(page, at, loose)
        if not hidden:
            held.append(page[at : tag.start if tag else len(page)])
        if not tag:
            break
        at, name, loose = tag.end, tag.name, tag.loose
        if not name:
            continue
        if not tag.closing and (name in RAW or name in RAW_OUTSIDE and not articles):
            if not tag.attributes.endswith("/"):
                end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if not end:
                    endless.add(name)
                at = end.end() if end else len(page) if name != "head" else at
            continue
        if name == "br":
            held.append(" ")
        if name in BLOCKS:
            close_block()
            while stack and stack[-1][0] == "p" and (not tag.closing or name != "p"):
                pop()
        if tag.closing:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name not in VOID:
            furniture = tag.start not in spared and is_furniture(name, tag.attributes, articles > 0)
            if hidden and not furniture and not articles and name in ("article", "main"):
                holders.update(sparing[told:])
                told = len(sparing)
            if furniture or name in BLOCKS:
                may = furniture and not articles and (name == "form" or name not in FURNITURE | {"article"})
                card = name == "article" and any(not CARDS.isdisjoint(w.split("-")) for w in names_in(tag.attributes))
                stack.append((name, furniture, may, card))
                opened[name] += 1
                if may:
                    sparing.append(tag.start)
                hidden += furniture
                part += name == "article" and not articles
                articles += name == "article"
                cards += card
    close_block()
    return out, holders


def ends_of(a: list[int], places: dict[int, int], width: int) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` with each beginning of the other side, 0 to ``width`` lines long.

    The row of lengths is one integer: a bit is off where the length grows (Hyyro's bit-parallel recurrence).
    """
    full = (1 << width) - 1
    row = full
    for line in a:
        hits = row & places.get(line, 0)
        row = (row + hits | row - hits) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((width + 7) // 8 or 1, "little"), np.uint8), bitorder="little")[:width]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def places_of(b: list[int]) -> dict[int, int]:
    """For each line the integer whose bits are its places."""
    found: dict[int, list[int]] = {}
    for j, line in enumerate(b):
        found.setdefault(line, []).append(j)
    out = {}
    for line, at in found.items():
        bits = np.zeros(at[-1] + 1, np.uint8)
        bits[at] = 1
        out[line] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Lines that only one side has go first, then common beginnings and ends; the rest is halved (Hirschberg), with rows of
    lengths from ``ends_of``: memory in proportion to the lines, and equal lines cost no more than different ones.
    """
    known = {line: n for n, line in enumerate(dict.fromkeys(b))}
    own = set(a)
    out: set[int] = set()
    work = [([i for i, x in enumerate(a) if x in known], [known[x] for x in b if x in own])]
    numbers = [known.get(x, -1) for x in a]
    while work:
        left, right = work.pop()
        start = 0
        while start < min(len(left), len(right)) and numbers[left[start]] == right[start]:
            start += 1
        end = 0
        while end < min(len(left), len(right)) - start and numbers[left[-1 - end]] == right[-1 - end]:
            end += 1
        out.update(left[:start], left[len(left) - end :])
        left, right = left[start : len(left) - end], right[start : len(right) - end]
        if not left or not right:
            continue
        if len(left) == 1:
            out.update(left if numbers[left[0]] in right else [])
            continue
        half = len(left) // 2
        head = ends_of([numbers[i] for i in left[:half]], places_of(right), len(right))
        tail = ends_of([numbers[i] for i in left[:half - 1 : -1]], places_of(right[::-1]), len(right))
        cut = int(np.argmax(head + tail[::-1]))
        work += [(left[:half], right[:cut]), (left[half:], right[cut:])]
    return out


def common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def size(lines: Iterable[Line]) -> int:
    return sum(len(x.text) for x in lines)


def body_of(page: list[Line]) -> tuple[list[Line], bool]:
    """The lines that may be the text, and whether they are the page's articles, of which each is kept or goes as a whole."""
    article = [x for x in page if x.article]
    own = [x for x in page if x.main and not x.article and not x.card]
    if article:
        before = page[: page.index(article[0])]
        if size(x for x in before if x.main and not x.card) <= size(article):
            return article, True
        return own, False
    cards = [x for x in page if x.card]
    if not cards:
        return page, False
    # A page's only article may well be styled as a card: then there is little text beside it.
    rest = own or [x for x in page if not x.card]
    return (rest, False) if size(rest) > size(cards) else (cards, True)


def difference(page: list[Line], neighbour: list[Line] | None, other: list[Line] | None = None) -> str:
    """The page's text without the lines that it shares with its neighbour.

    Articles that are all shared go as a whole; the others lose the lines that the ``other`` neighbour has as well.
    """
    body, article = body_of(page)
    align = lambda lines: shared([x.text for x in body], [x.text for x in lines]) if lines else set()
    gone = align(neighbour)
    if article:
        own = {x.part for i, x in enumerate(body) if i not in gone}
        common = align(other) & gone if gone else gone
        sizes: Counter[int] = Counter()
        often: Counter[int] = Counter()
        for i, x in enumerate(body):
            sizes[x.part] += len(x.text)
            often[x.part] += len(x.text) if i in common else 0
        least = sum(sizes[part] for part in own)
        # What is common to three pages is the host's if it is less than the article's rest; else the three are near copies.
        gone = {i for i, x in enumerate(body) if (
            i in common and 2 * often[x.part] < sizes[x.part] if x.part in own else sizes[x.part] < least)}
    kept = [x.text for i, x in enumerate(body) if i not in gone]
    return "\n".join(kept or [x.text for x in body])


def extract_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (host, path) in; page ids, URLs and texts out. Three pages are held at a time."""
    before = here = None  # (key, url, host, path, lines)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(c) for c in ("_key", "url", "_host", "_path", "html")]
            for i in range(batch.num_rows):
                key, url, host, path, page = (c[i].as_py() for c in columns)
                yield key, url, host, path, lines_of(page or "")
        yield None

    def told(before, here, after) -> tuple:
        near = [x for x in (before, after) if x and x[2] == here[2]]
        near.sort(key=lambda x: -common_start(x[3], here[3]))
        return here[0], here[1], difference(here[4], *(x[4] for x in near)) if near else difference(here[4], None)

    out: list[tuple] = []
    for after in rows():
        if here:
            out.append(told(before, here, after))
        before, here = here, after
        if len(out) >= 1000 or after is None and out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))], names=["_key", "url", "text"])
            out = []


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    bare = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[?#].*$", "")
    rows = pages.select(
        F.col(key).cast("bigint").alias("_key"), F.col(url).alias("url"), F.col(page).alias("html"),
        F.lower(F.regexp_extract(bare, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/]*)", 1)).alias("_host"),
        F.regexp_replace(bare, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "").alias("_path"),
    )
    order = ["_host", "_path", "_key"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = ordered.mapInArrow(extract_sorted, "_key bigint, url string, text string")
    return found.select(F.col("_key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("bigint").alias("n_chars"))
