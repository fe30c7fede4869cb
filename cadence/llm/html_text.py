"""Main text of web pages.

The standard library's parser streams events; they make lines (the text of one
block and the tags met in it). The text-to-tag ratios of a page's lines are
smoothed with a Gaussian and split by a threshold; the lines above it show where
the content lies. The region is the innermost container that holds nearly all of
them, widened to the article it is part of, or else with the other containers that have
content of their own, without the menus, headers, footers, sidebars, notices,
adverts, forms and comments in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of HTML, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body article main section div td blockquote center".split())
ARTICLES = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img".split())
SKIPPED = frozenset("head title script style noscript template svg math iframe object canvas audio video map".split())
FURNITURE = frozenset("nav header footer aside form menu button select option textarea input dialog fieldset".split())
#: Words of class, id or role that name furniture, and reader comments.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay "
    "share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar "
    "comment comments disqus respond reply replies complementary contentinfo".split())
#: Words that make a name one of a page's layout ("with-sidebar"); words of place or shape after a name of furniture ("sidebar-left").
LAYOUT_WORDS = frozenset("has have with without no not hide show".split())
PLACE_WORDS = frozenset("area bar block body bottom box button buttons container content form inner items item left link links list main outer panel "
                        "posts right row section slot thread top unit wrap wrapper".split())
#: Elements that no name makes furniture.
UNNAMED = frozenset("html body main article".split())
#: Start tags that end an open paragraph or item of the list.
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                           "main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}

#: Standard deviation of the smoothing, in lines; the threshold as a share of the
#: mean smoothed ratio; the share of the content that a region must hold; the share
#: of a page's text above which an element is no furniture by a part of its name.
SIGMA, THRESHOLD, REGION, MOST = 1.0, 0.5, 0.9, 0.5


class _Lines(HTMLParser):
    """Collects (text, tags, furniture, container, named) lines from parser events.

    ``container`` is a node number; ``parent`` and ``kind`` describe the nodes;
    ``named`` has the numbers of the elements around that a part of their name says
    to be furniture."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int, tuple[int, ...]]] = []
        self.parent, self.kind = [-1], [""]
        self.open: list[tuple[str, int, bool, bool, tuple[int, ...]]] = []  # tag, container, furniture, skipped, named
        self.named = 0
        self.text: list[str] = []
        self.tags = 0

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers aren't needed."""
        return j

    def _state(self) -> tuple[str, int, bool, bool, tuple[int, ...]]:
        return self.open[-1] if self.open else ("", 0, False, False, ())

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, container, furniture, _, named = self._state()
            self.lines.append((text, self.tags, furniture, container, named))
            self.tags = 0
        self.text.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in INLINE:
            self.end_line()
            if tag in ENDS_PARAGRAPH:
                self._close({"p"}, CONTAINERS | FURNITURE | {"li", "table"})
            if tag in CLOSES:
                self._close(CLOSES[tag], CONTAINERS - {"td"} | {"ul", "ol", "dl", "table", "select"} | FURNITURE)
        if tag in VOID:
            return
        _, container, furniture, skipped, named = self._state()
        if not furniture:
            whole, part = self._named(tag, attrs)
            furniture = tag in FURNITURE or whole
            if part and not furniture:
                self.named += 1
                named = (*named, self.named)
        if tag in CONTAINERS:
            self.parent.append(container)
            self.kind.append(tag)
            container = len(self.kind) - 1
        self.open.append((tag, container, furniture, skipped or tag in SKIPPED, named))

    @staticmethod
    def _named(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Whether the element is furniture by a whole name (or hidden), and by part of one."""
        whole = part = False
        unnamed = tag in UNNAMED or any(name == "role" and value and value.lower() in UNNAMED for name, value in attrs)
        for name, value in attrs:
            if name in ("class", "id", "role") and value and not unnamed:
                for token in value.lower().split():
                    words = token.replace("-", " ").replace("_", " ").split()
                    if not words or not LAYOUT_WORDS.isdisjoint(words):
                        continue
                    if len(words) == 1:
                        whole |= words[0] in FURNITURE_WORDS
                        continue
                    last = len(words) - 1
                    while last and words[last] in PLACE_WORDS:
                        last -= 1
                    part |= words[last] in FURNITURE_WORDS
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                whole = True
        return whole, part

    def _close(self, tags: set[str], stop: frozenset[str] | set[str]) -> None:
        """Ends the innermost open element of ``tags``, unless one of ``stop`` is inside."""
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i][0]
            if tag in tags:
                self.end_line()
                del self.open[i:]
                return
            if tag in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag not in INLINE or any(t not in INLINE for t, *_ in self.open[i:]):
                    if tag in INLINE:  # a stray end inside a block ends no block
                        return
                    self.end_line()
                del self.open[i:]
                return
            if tag in INLINE and self.open[i][0] not in INLINE:
                return
        if tag not in INLINE:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not self._state()[3]:
            self.text.append(data)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with the edges repeated."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.concatenate([np.full(reach, ratio[0]), ratio, np.full(reach, ratio[-1])])
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def main_text(html: str) -> str:
    """The main text of a page; "" where there is none."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = _with_wrappers(parser)
    if not lines:
        return ""
    ratio = np.array([0.0 if furniture else len(text) / max(1, tags) for text, tags, furniture, _ in lines])
    if not ratio.any():
        return ""
    level = smoothed(ratio)
    content = (level >= THRESHOLD * level.mean()) & (ratio > 0)
    weight = [0.0] * len(parser.kind)  # content characters under each container
    for (text, _, _, at), inside in zip(lines, content, strict=True):
        while inside and at >= 0:
            weight[at] += len(text)
            at = parser.parent[at]
    region = 0
    for at in range(1, len(weight)):  # parents come before their children
        if parser.parent[at] == region and weight[at] >= REGION * weight[0]:
            region = at
    above, within, around = region, region, {0}
    while above > 0:
        around.add(above)
        if parser.kind[above] in ARTICLES:
            within = above
        above = parser.parent[above]
    inside = [False] * len(weight)
    for at in range(len(weight)):
        inside[at] = at == within or at > 0 and inside[parser.parent[at]]
    beside = content & (parser.kind[within] not in ARTICLES)
    for (_, _, _, at), has in zip(lines, beside, strict=True):
        if has and at not in around:
            inside[at] = True
    return " ".join(text for (text, _, furniture, at), has in zip(lines, beside, strict=True) if not furniture and (inside[at] or has))


def _with_wrappers(parser: _Lines) -> list[tuple[str, int, bool, int]]:
    """(text, tags, furniture, container) lines; an element that holds most of the
    page's text is no furniture by a part of its name, unless an article is elsewhere."""
    total, articles = 0, 0
    held: dict[int, int] = {}
    held_articles: dict[int, int] = {}
    in_article = [False] * len(parser.kind)
    for at in range(1, len(in_article)):  # parents come before their children
        in_article[at] = parser.kind[at] in ARTICLES or in_article[parser.parent[at]]
    for text, _, furniture, at, named in parser.lines:
        if furniture:
            continue
        total += len(text)
        articles += len(text) * in_article[at]
        for k in named:
            held[k] = held.get(k, 0) + len(text)
            held_articles[k] = held_articles.get(k, 0) + len(text) * in_article[at]
    # the text of an article counts alone where there is one
    wrapper = {k for k in held if (held_articles[k] > MOST * articles if articles else held[k] > MOST * total)}
    return [(text, tags, furniture or any(k not in wrapper for k in named), at) for text, tags, furniture, at, named in parser.lines]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h or "") for h in b["html"].to_pylist()]
        yield pa.record_batch({"page_id": b["page_id"], "url": b["url"], "text": pa.array(texts, pa.string()),
                               "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages`` (page_id, url,
    html), row by row without a shuffle. A null or empty page, and one whose text
    is all furniture, gives the empty text. Nothing else is dropped or cut; a page
    of any length is parsed whole. Repeated rows, and pages of equal html, give equal
    texts, each a row; null ids and addresses are kept; an empty table gives no rows;
    other columns, whatever their names, are not read."""
    p = pages.select(F.col("page_id").cast("long"), "url", "html")
    return p.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: main text of all ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
