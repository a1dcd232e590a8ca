"""Main text of web pages.

The standard library's parser streams events; blocks of text become lines with
the elements that hold them. The text-to-tag ratio of each line is smoothed by
a Gaussian and split in two clusters by a threshold; the innermost element that
holds all dense lines is the content region. Lines of the region are kept,
short ones too, but for those inside navigation, adverts, forms and the like.

Elements that are such by their name, role or style never count. A class or an
id, or a form, only suggests it: one that encloses nearly all dense text, where
neither a heading nor prose stands outside of it, is an element like others. So
comments and forms beside or inside an article go, however long they are. Work
is linear in the events and in the depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of an article.
DROPPED = frozenset(
    "head title script style noscript template nav footer aside button select option textarea iframe object svg canvas audio video map dialog menu datalist".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split()
)
#: Elements that can be a content region.
REGIONS = frozenset("html body main article section div center td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class or id that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice popup modal overlay subscribe subscription newsletter signup login comment comments commentlist reply replies respond "
    "disqus form social share sharing sharebar related recommended recommendations widget widgets toolbar pagination pager skip hidden copyright legal disclaimer".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Beside a mark these say that it is absent, or only present, in what is named.
ABSENT = frozenset("no with without has have hide hides show shows free less non not".split())
#: Words of place or shape: the word before them says what the thing is.
SHAPES = frozenset("area bar block blocks body bottom box button buttons column container content copy count desktop fixed form group head heading icon icons id inner item items left link links list logo main mobile outer panel post posts primary right row secondary section site slot small story sticky title top unit wide wrap wrapper".split())
#: With one of these beside it, "header" names the head of the article.
OWN_HEAD = frozenset("entry post article story content".split())
#: An element that starts ends one of these that is open.
ENDS = {k: frozenset(("p " + v).split()) for k, v in {"p": "", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}.items()}
SIGMA, RADIUS = 1.0, 3
#: A form or a marked element with this share of the dense text, and at least so many characters of it, can be one like others.
WRAPPER, WRAPPED = 0.9, 200
#: A line outside a paragraph is prose with so many characters, and so many for each tag.
PROSE, PROSE_RATIO = 20, 10


class _Element:
    """``n`` and ``last`` are the first and the last number among the element and what it holds; ``mark`` is the nearest form or marked element."""

    __slots__ = ("block", "counts", "heading", "inner", "last", "mark", "n", "outer", "parent", "region", "skip", "tag")

    def __init__(self, tag: str, parent: _Element | None, n: int, skip: bool, marked: bool):
        self.tag, self.parent, self.n, self.last, self.skip = tag, parent, n, n, skip
        self.outer = parent and parent.mark
        self.mark = self if marked else self.outer
        self.heading = tag in HEADINGS or bool(parent and parent.heading)
        self.region = self if parent is None or tag in REGIONS else parent.region
        self.block = self
        #: Of an inline element that is left out: the inline tags open inside it, and how many of each.
        self.inner: list[str] | None = None
        self.counts: dict[str, int] = {}


class _Line:
    __slots__ = ("at", "tags", "text")

    def __init__(self, text: str, tags: int, at: _Element):
        self.text, self.tags, self.at = text, tags, at


def _token_marks(token: str) -> bool:
    """Whether a class name marks: its last word that isn't a shape is a mark, or the first one is and shapes follow."""
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
    if not words or ABSENT.intersection(words):
        return False
    if "header" in words and OWN_HEAD.intersection(words):
        return False
    while len(words) > 1 and words[-1] in SHAPES:
        words.pop()
    return words[-1] in MARKS


@lru_cache(4096)
def _named(names: str) -> bool:
    return any(_token_marks(x) for x in names.split())


def _attributes(attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
    """Whether an element is out for certain, and whether its names mark it."""
    names = ""
    for k, v in attrs:
        if k in ("class", "id"):
            names += f" {v or ''}"
        elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and (v or "").lower() in ROLES:
            return True, False
        elif k == "role" and v == "form":
            names += " form"
        elif k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v or "", re.I):
            return True, False
    return False, names != "" and _named(names)


def _inline_out(e: _Element) -> None:
    e.inner, e.block = [], e.parent.block


class _Lines(HTMLParser):
    """Lines of a page; each has the tags seen since the line before.

    Inline elements only count as tags, but for those that are left out and what stands in these. Every element is entered
    and left once, and ends of elements that aren't open are found by a count, so the work is linear.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.root = _Element("", None, 0, False, False)
        self.open: dict[str, int] = {}
        self.lines: list[_Line] = []
        self.parts: list[str] = []
        self.tags, self.at, self.n = 0, self.root, 0

    def updatepos(self, i, j):  # line numbers aren't asked for
        return j

    def end_line(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append(_Line(text, self.tags, self.at))
                self.tags = 0
            self.parts = []

    def enter(self, tag: str, skip: bool, marked: bool) -> None:
        self.n += 1
        self.top = _Element(tag, self.top, self.n, self.top.skip or skip, marked)
        self.open[tag] = self.open.get(tag, 0) + 1

    def leave(self) -> None:
        e = self.top
        e.last = self.n
        self.open[e.tag] -= 1
        self.top = e.parent

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        out, marked = _attributes(attrs) if attrs else (False, False)
        if tag in INLINE:
            self.start_inline(tag, out, marked)
            return
        self.end_line()
        if tag in VOID:
            return
        if tag not in DROPPED and tag != "form":
            self.end_open(tag)
        out = out or tag in DROPPED or tag == "header" and not self.open.get("article")  # an article's own header keeps its headings
        self.enter(tag, out, tag == "form" or marked and tag not in ("html", "body", "main"))

    def start_inline(self, tag: str, out: bool, marked: bool) -> None:
        e = self.top
        if out or marked:
            self.end_line()
            self.enter(tag, out, marked)
            _inline_out(self.top)
        elif e.inner is not None:
            e.inner.append(tag)
            e.counts[tag] = e.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def end_open(self, tag: str) -> None:
        """Ends the blocks that the start of this one ends, and the inline elements open in them."""
        ends, b = ENDS.get(tag, ENDS["p"]), self.top.block
        while b.tag in ends or b.tag in HEADINGS and tag in HEADINGS:
            while self.top is not b:
                self.leave()
            self.leave()
            b = self.top.block

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in VOID:
            return
        e = self.top
        if tag in INLINE:
            if e.inner is None:
                return
            if e.counts.get(tag):
                while (x := e.inner.pop()) != tag:
                    e.counts[x] -= 1
                e.counts[tag] -= 1
            elif e.tag == tag:
                self.end_line()
                self.leave()
            return
        self.end_line()
        if not self.open.get(tag) or tag == "p" and e.block.tag != "p":
            return
        while self.top.tag != tag:
            self.leave()
        self.leave()

    def handle_data(self, data):
        if not self.parts:
            self.at = self.top
        self.parts.append(data)

    def finish(self) -> None:
        self.close()
        self.end_line()
        while self.top.parent is not None:
            self.leave()
        self.root.last = self.n


GAUSS = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA * SIGMA))


def smoothed(values: np.ndarray) -> np.ndarray:
    """The mean of the values around each, weighted by a Gaussian; beyond the ends there is nothing."""
    near = np.convolve(np.concatenate([values, np.zeros(2 * RADIUS)]), GAUSS)[RADIUS : RADIUS + len(values)]
    full = np.convolve(np.concatenate([np.ones(len(values)), np.zeros(2 * RADIUS)]), GAUSS)[RADIUS : RADIUS + len(values)]
    return near / full


def threshold(values: np.ndarray) -> float:
    """Between the means of two clusters, moved until it stays, but at most half the mean of the upper one: a page of text alone isn't cut.

    (A line beside text gets 0.3 of its level by the smoothing, the first line of text 0.7.)
    """
    cut = upper = float(values.mean())
    for _ in range(20):
        high = values > cut
        if high.all() or not high.any():
            break
        upper = float(values[high].mean())
        new = (float(values[~high].mean()) + upper) / 2
        if new == cut:
            break
        cut = new
    return min(cut, upper / 2)


def dense_lines(sizes: np.ndarray, tags: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Which lines are above the threshold, of lines with so many characters and tags; without one, all that aren't out."""
    ratios = np.where(out, 0.0, sizes / np.maximum(1, tags))
    smooth = smoothed(ratios)
    dense = (smooth >= threshold(smooth)) & (ratios > 0)
    return dense if dense.any() else ~out


def _left_out(lines: list[_Line], sizes: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Whether each line is in an element that is out, or in a form or marked element that isn't a wrapper of the whole.

    A wrapper encloses nearly all dense text, and what encloses it holds no heading and no prose but in marked elements.
    """
    out = np.array([x.at.skip for x in lines])
    marks: dict[_Element, int] = {}
    #: Whether an element (None: the page) has a heading or prose that stands in no marked element inside of it.
    tells: set[_Element | None] = set()
    for x in lines:
        e = x.at.mark
        while e is not None and e not in marks:
            marks[e] = 0
            e = e.outer
    if not marks:
        return out
    for x, k in zip(lines, out.tolist(), strict=True):
        if not k and (x.at.heading or x.at.tag == "p" or len(x.text) >= max(PROSE, PROSE_RATIO * x.tags)):
            tells.add(x.at.mark)
    dense, total = dense_lines(sizes, tags, out), 0
    for x, d, n in zip(lines, dense, sizes.tolist(), strict=True):
        if d:
            total += n
            if x.at.mark is not None:
                marks[x.at.mark] += n
    inside_first = sorted(marks, key=lambda e: -e.n)
    for e in inside_first:
        if e.outer is not None:
            marks[e.outer] += marks[e]
    dead: dict[_Element | None, bool] = {None: False}
    told: dict[_Element | None, bool] = {None: None in tells}
    for e in reversed(inside_first):
        dead[e] = dead[e.outer] or told[e.outer] or not (marks[e] >= WRAPPER * total and marks[e] >= WRAPPED)
        told[e] = told[e.outer] or e in tells
    return out | np.array([x.at.mark is not None and dead[x.at.mark] for x in lines])


def _region(lines: list[_Line], dense: np.ndarray, out: np.ndarray) -> _Element | None:
    """The innermost element that holds all dense text; an article isn't entered further."""
    some = [x.at.region for x, d in zip(lines, dense, strict=True) if d]
    if not some:
        return None
    own_heading = {x.at.region for x, k in zip(lines, out, strict=True) if x.at.heading and not k}
    first, last = min(some, key=lambda e: e.n), max(some, key=lambda e: e.n)
    way, e = [], first
    while e is not None:
        if e.last >= last.n:  # holds both, and so all that stand between
            way.append(e)
        e = e.parent.region if e.parent is not None else None
    for e in reversed(way):
        if e.tag == "article" or e in own_heading and e.tag not in ("", "html", "body"):
            return e
    return way[0]


def main_blocks(html: str | None) -> list[str]:
    """The blocks of a page's main text, in order; none for null, empty or text-free pages."""
    if not html:
        return []
    parser = _Lines()
    parser.feed(html)
    parser.finish()
    lines = parser.lines
    if not lines:
        return []
    sizes, tags = np.array([len(x.text) for x in lines]), np.array([x.tags for x in lines])
    out = _left_out(lines, sizes, tags)
    region = _region(lines, dense_lines(sizes, tags, out), out)
    if region is None:
        return []
    return [x.text for x, k in zip(lines, out, strict=True) if not k and region.n <= x.at.n <= region.last]


def _texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series(["\n\n".join(main_blocks(h)) for h in s], dtype=object)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages``.

    A null or empty page, or one without an article, gives an empty text. Pages are independent: null or repeated ids and
    equal pages are no special case, and other columns are ignored. The whole page is parsed, however long.
    """
    text = F.pandas_udf(_texts, "string")(F.col(html_col))
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text.alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
