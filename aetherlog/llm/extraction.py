"""Main text of web pages from streamed parser events and text-to-tag ratios.

The library's records hold no web pages, so this works on any table with a page's markup.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEED = 1 << 16  # code points given to the parser at a time

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset(
    "aside button canvas datalist dialog footer form head iframe input menu nav noframes noscript object script select style svg "
    "template textarea title video audio".split())
PAGE_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
    "promoted promotion related replies reply search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
# of these a part of a name is as good as the whole (``comment-list``, ``share-buttons``); the others also name pages and layouts
_ALWAYS = frozenset("ads advert adverts advertisement comment comments consent cookie cookies disqus newsletter popup promo promoted replies "
                    "share sharing sponsor sponsored subscribe".split())
_READERS = frozenset("comment comments disqus replies".split())
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
LEAVES = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li option p pre summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_CLOSES_P = BLOCK - {"br", "body", "html", "head"}
_PARTS = re.compile(r"[^a-z]+")
_HEAD = frozenset("base link meta noscript script style template title".split())  # what a head may hold


class _Line:
    """Text between block tags: how many tags it has, how much of it is linked, and the innermost element it stands in."""

    __slots__ = ("text", "tags", "linked", "node", "item", "title")

    def __init__(self, node: int, item: bool, title: bool):
        self.text, self.tags, self.linked, self.node, self.item, self.title = [], 0, 0, node, item, title


_WEAK, _STRONG, _READER = 1, 2, 3  # how surely a name stands for a part around the article


class PageLines(HTMLParser):
    """Turns parser events into lines of text between block tags. Elements are numbered as they open; ``parent`` has the one around each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, number, skipped
        self.opened: Counter = Counter()  # how many of a tag are open
        self.parent = [-1]
        self.layout = [True]  # whether an element can be a region: a block that holds blocks
        self.skipped = 0
        self.mains: dict[int, bool] = {}  # article (False) and main elements (True)
        self.named: dict[int, int] = {}  # elements named like a part around the article, and how surely
        self._fresh()

    def _fresh(self) -> None:
        self.line = _Line(self.open[-1][1] if self.open else 0, self.opened["li"] > 0, self.opened["h1"] > 0)

    def _break(self) -> None:
        if self.line.text:
            self.lines.append(self.line)
        self._fresh()

    def _is_skipped(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in SKIPPED:
            return True
        if tag in ("html", "body", "main"):
            return False
        if tag == "header" and not self.opened["article"] and not self.opened["main"]:
            return True
        return any(name == "role" and value and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true"
                   or name == "style" and value and _HIDDEN.search(value) for name, value in attrs)

    @staticmethod
    def _name(tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """How surely a class or id names a part around the article: as a whole (``cookie-notice``) or in part (``has-sidebar``); 0: not."""
        if tag in ("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
            return 0
        words = [w for name, value in attrs if name in ("class", "id") and value for w in value.lower().split()]
        parts = [[x for x in _PARTS.split(w) if x] for w in words]
        if not _READERS.isdisjoint(x for p in parts for x in p):
            return _READER
        if any(p and (PAGE_PARTS.issuperset(p) or not _ALWAYS.isdisjoint(p)) for p in parts):
            return _STRONG
        return 0 if all(PAGE_PARTS.isdisjoint(p) for p in parts) else _WEAK

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _HEAD and self.open and self.open[-1][0] == "head":
            self._close("head")
        if tag in BLOCK:
            if tag in _CLOSES_P and any(t == "p" for t, _, _ in self.open[-3:]):
                self._close("p")
            if tag == "li" and self.open and self.open[-1][0] == "li":
                self._close("li")
            self._break()
        self.line.tags += 1
        if tag in VOID:
            return
        node = len(self.parent)
        self.parent.append(self.open[-1][1] if self.open else 0)
        self.layout.append(tag in BLOCK and tag not in LEAVES)
        skip = self._is_skipped(tag, attrs)
        if tag in ("article", "main") or ("role", "main") in attrs:
            self.mains[node] = tag != "article"
        if name := self._name(tag, attrs):
            self.named[node] = name
        self.open.append((tag, node, skip))
        self.opened[tag] += 1
        self.skipped += skip
        if tag in BLOCK:
            self._fresh()
            self.line.tags = 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        if not self.opened[tag]:
            return
        if tag not in BLOCK:  # an inline end tag does not close blocks
            for t, _, _ in reversed(self.open):
                if t == tag:
                    break
                if t in BLOCK:
                    return
        while True:
            t, _, skip = self.open.pop()
            self.opened[t] -= 1
            self.skipped -= skip
            if t == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        if tag in BLOCK:
            self._break()
        self._close(tag)
        if tag in BLOCK:
            self._fresh()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._close("head")
            self._fresh()
        if self.skipped:
            return
        if not self.line.text and self.open:  # an inline element may have opened since the line began
            self.line.node = self.open[-1][1]
        elif self.open and self.line.node != self.open[-1][1]:
            self.line.node = self._shared(self.line.node, self.open[-1][1])
        self.line.text.append(data)
        if self.opened["a"]:
            self.line.linked += len(data.strip())

    def _shared(self, a: int, b: int) -> int:
        """The innermost element around two others; both stand in one block, so the way up is short."""
        while a != b:
            if a > b:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return a

    def finish(self) -> list[tuple[str, _Line]]:
        self.close()
        self._break()
        return [(text, line) for line in self.lines if (text := " ".join("".join(line.text).split()))]


def smoothed_ratios(lengths: np.ndarray, tags: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Text-to-tag ratio per line, smoothed by a Gaussian over the neighbouring lines."""
    ratio = lengths / np.maximum(tags, 1)
    reach = int(np.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel, "full")[reach:reach + len(ratio)]
    return np.convolve(ratio, kernel, "full")[reach:reach + len(ratio)] / weight


def _clusters(found: list[tuple[str, _Line]], sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Length of each line, and whether it is in the content cluster."""
    length = np.array([len(t) for t, _ in found], float)
    ratio = smoothed_ratios(length, np.array([x.tags for _, x in found], float), sigma)
    return length, ratio >= min(float(np.std(ratio)), float(ratio.max()))


def _upwards(parent: list[int], lines: list[_Line], values: np.ndarray) -> list[float]:
    """Sums of the lines' values in each element: an element's number is larger than that of the one around it."""
    out = [0.0] * len(parent)
    for line, v in zip(lines, values.tolist()):
        out[line.node] += v
    for n in range(len(parent) - 1, 0, -1):
        out[parent[n]] += out[n]
    return out


def _within(parent: list[int], chosen: set[int]) -> list[bool]:
    """Which elements are in one of the chosen ones, or are one."""
    out = [0 in chosen] * len(parent)
    for n in range(1, len(parent)):
        out[n] = n in chosen or out[parent[n]]
    return out


def _without_parts(page: PageLines, found: list[tuple[str, _Line]], sigma: float) -> list[tuple[str, _Line]]:
    """The lines without those of elements that their names and the content cluster tell to be around the article.

    An element stays if it holds an article or main element, the page's title, or at least half of the cluster's text (readers'
    comments: all but a twentieth). Else it goes if its name says so surely; a part of another name is enough if no
    line of it is in the cluster or most of its text is linked.
    """
    if not page.named:
        return found
    lines = [x for _, x in found]
    length, content = _clusters(found, sigma)
    weight, size, linked, titles = (_upwards(page.parent, lines, v) for v in (
        length * content, length, np.array([x.linked for x in lines], float), np.array([x.title for x in lines], float)))
    holds = [0.0] * len(page.parent)
    for n in page.mains:
        holds[page.parent[n]] += 1
    for n in range(len(holds) - 1, 0, -1):
        holds[page.parent[n]] += holds[n]
    gone = set()
    for n, name in page.named.items():
        most = 0.95 if name == _READER else 0.5
        if holds[n] or titles[n] or weight[n] and weight[n] >= most * weight[0]:
            continue
        if name != _WEAK or not weight[n] or linked[n] > 0.5 * size[n]:
            gone.add(n)
    outside = _within(page.parent, gone)
    return [(t, x) for t, x in found if not outside[x.node]]


def main_text(html: str, sigma: float = 1.0) -> str:
    """The page's main text: its blocks in order, white space inside them reduced, joined by a blank.

    Lines whose smoothed ratio reaches the standard deviation of all ratios are the content cluster. They decide which
    region of the page is the article: the main element, or the article inside it, with most of the cluster's text; without one all article
    elements that are not inside others; else the innermost element that holds most of the cluster. Of an
    explicit region every line is kept, however short, but for runs of three and more linked list items that leave the cluster. Otherwise the lines from the
    cluster's first to its last and those beside them in the same element stay. A title above the region, and what
    stands between it and the region in the elements around, belongs to the article.
    """
    page = PageLines()
    for i in range(0, len(html), FEED):
        page.feed(html[i:i + FEED])
    found = _without_parts(page, page.finish(), sigma)
    if not found:
        return ""
    lines = [x for _, x in found]
    length, content = _clusters(found, sigma)
    weight = _upwards(page.parent, lines, length * content)
    mains = {n for n in page.mains if weight[n] > 0}
    if mains:
        top = max((n for n in mains if page.mains[n]), key=lambda n: (weight[n], n), default=0)
        if top:
            nested = _within(page.parent, {top})
            regions = {max((n for n in mains if nested[n]), key=lambda n: (weight[n], n))}
        else:
            nested = _within(page.parent, mains)
            regions = {n for n in mains if not nested[page.parent[n]]}
    else:  # those that hold so much of the cluster lie inside each other, the innermost has the largest number
        regions = {max((n for n in range(len(weight)) if page.layout[n] and weight[n] >= 0.7 * weight[0]), default=0)}
    held = _within(page.parent, regions)
    inside = np.array([held[x.node] for x in lines])
    items = np.array([x.item and x.linked >= 0.9 * len(t) for t, x in found])
    if mains:
        run = np.cumsum(np.append(True, items[1:] != items[:-1]))  # numbers of runs of items and of other lines
        size, outside = np.bincount(run), np.bincount(run, weights=~content)
        items &= (size[run] >= 3) & (outside[run] > 0)
    else:
        home = list(range(len(page.parent)))  # the layout element around each
        for n in range(1, len(home)):
            home[n] = n if page.layout[n] else home[page.parent[n]]
        at = np.flatnonzero(content & inside)
        homes = {home[lines[i].node] for i in at}
        inside &= np.array([at[0] <= i <= at[-1] or home[x.node] in homes for i, x in enumerate(lines)])
        items &= np.append(items[1:], False) | np.append(False, items[:-1])
    inside &= ~items
    if inside.any():
        around, n = {0}, min(regions)
        while n > 0:
            around.add(n := page.parent[n])
        first = int(np.argmax(inside))
        titles = [i for i in range(first) if lines[i].title]
        for i in range(titles[0] if titles else first, first):
            n = lines[i].node
            while n > 0 and not page.layout[n]:
                n = page.parent[n]
            inside[i] |= lines[i].title or n in around and not items[i]
    return " ".join(t for (t, _), keep in zip(found, inside) if keep)


def extract_pages(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the columns in ``keep``, text and n_chars (code points) of every page.

    Takes the whole markup of every row. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
    readers' comments go; nothing else is dropped or cut. A null or empty page has an empty text; repeated rows give
    repeated results; an empty table gives an empty one.
    """
    columns = [key, *keep]
    source = pages.select(*columns, F.col(html).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(len(columns))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(columns)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*columns, "text", "n_chars"])

    fields = ", ".join([*(f"`{c}` {t}" for c, t in source.dtypes[:-1]), "text STRING", "n_chars BIGINT"])
    return source.mapInArrow(run, fields)


def reference_sql() -> str:
    """The article text of ``pages`` from SQL: their one template has an article element with plain blocks in it."""
    return r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '</?(p|h1|br)>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&') AS t FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars
FROM (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)"""
