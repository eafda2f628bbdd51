"""The main text of web pages: text-to-tag ratios per line, smoothed, and a threshold.

The events of the standard library's HTML parser are turned into lines, one per block of text, as they
come; nothing but the open elements and the lines is kept, no tree. A line has its text, the number of
tags since the line before, its share of link text, and the elements it lies in. Its ratio is characters per tag; lines
of scripts, forms, menus and the like have none. The ratios are smoothed by a Gaussian over
neighbouring lines, and lines above the threshold, a share of their standard deviation, are content.
Content clusters by the regions that hold it: the region with the most smoothed ratio above the
threshold is the article. All its lines that aren't boilerplate belong to it, short ones too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Standard deviation of the Gaussian, in lines.
SIGMA = 1.0
#: The threshold as a share of the ratios' standard deviation, at most that of their mean.
THRESHOLD = 0.5
#: The share of the content that a region must hold to be preferred to the one around it.
REGION_SHARE = 0.6
BETWEEN = "\n\n"

# Elements without an end tag, and those that end or begin a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu
    nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead title tr
    ul""".split())
# Elements whose text is no part of an article.
BOILERPLATE = frozenset("""aside audio button canvas dialog fieldset footer form head iframe input menu nav
    noscript object script search select style svg template textarea title video""".split())
# Words in class, id or role that name such a part, and those that name an article.
NAMES = frozenset("""ad ads adsense advert advertisement adverts aside banner breadcrumb breadcrumbs comment comments
    consent cookie cookies copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation
    newsletter notice notices notification pager pagination popup promo promoted promotion related replies
    reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar
    topbar widget widgets contentinfo complementary alert dialog""".split())
ARTICLE_NAMES = frozenset("article articlebody content entry main post story".split())
# Names that mean the page's header outside an article and its own title within.
HEADER_NAMES = frozenset(("header", "banner", "masthead"))
# Names of an article that is none.
COMMENT_NAMES = frozenset("comment comments reply related promo promoted sponsored ad ads advert".split())
# Regions of a page.
REGIONS = frozenset("article main section div td center body html form blockquote details".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# What an open element ends at: the start tags that close it, and no further out than there.
_CLOSED_BY = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table", "tbody", "thead", "tfoot"))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
}
# Elements that an end tag from further in doesn't reach across.
_WALLS = frozenset(("table", "td", "th", "caption", "button", "html", "object", "template"))

_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
# Words that make a name say how a page is laid out, as in "with-sidebar".
_LAYOUT = frozenset("with without has no not is layout".split())
#: How a line is told to be boilerplate: by a name, or by an element.
BY_NAME, BY_ELEMENT = 1, 2


def _names(attrs: list[tuple[str, str | None]]) -> set[str]:
    found: set[str] = set()
    for key, value in attrs:
        if value and key in ("class", "id", "role", "itemprop"):
            for name in value.split():
                words = {w.lower() for w in _WORD.findall(name)}
                if not words & _LAYOUT:
                    found |= words
                    found.add(name.lower())
    return found


class _Open:
    """An element that is open. A region has a number; 0 is the page. `off` says how its text is told to be
    boilerplate, 0 for none."""

    __slots__ = ("tag", "region", "off", "link", "article")

    def __init__(self, tag, region, off, link, article):
        self.tag, self.region, self.off, self.link, self.article = tag, region, off, link, article


class Lines(HTMLParser):
    """Lines of a page, in order, as (text, tags, link characters, region, how off, item)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Open("", 0, 0, False, False)]
        self.places: dict[str, list[int]] = {}  # of the open elements, by tag
        self.parents, self.kinds = [0], [""]
        self.lines: list[tuple[str, int, int, int, int, bool]] = []
        self.parts: list[str] = []
        self.linked = self.tags = 0
        self.ending = False

    def _line(self):
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.open[-1]
            self.lines.append((text, self.tags, min(self.linked, len(text)), top.region, top.off,
                               bool(self.places.get("li"))))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _close_from(self, at: int):
        """Close the element at this place and all within."""
        if any(e.tag in BLOCKS for e in self.open[at:]):
            self._line()
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def _find(self, tags, walls) -> int:
        """The place of the innermost open element of these, or 0 if a wall is further in."""
        places = self.places
        at = max((places[t][-1] for t in tags if places.get(t)), default=0)
        return at if at and at > max((places[t][-1] for t in walls if places.get(t) and t not in tags), default=0) else 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        block = tag in BLOCKS
        if tag in VOID:
            if block:
                self._line()
            elif tag == "br":
                self.parts.append(" ")
            return
        if block:
            at = self.places.get("p") and self._find(("p",), _WALLS)
            if at:
                self._close_from(at)
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self._close_from(len(self.open) - 1)
            if tag in _CLOSED_BY:
                at = self._find(*_CLOSED_BY[tag])
                if at:
                    self._close_from(at)
            self._line()
        above = self.open[-1]
        region, off = above.region, above.off
        names = _names(attrs) if attrs else ()
        if tag in BOILERPLATE or tag == "header" and not above.article or ("hidden", None) in attrs:
            off = BY_ELEMENT
        elif names and not off and tag not in ("html", "body", "main"):
            known = COMMENT_NAMES if tag == "article" else NAMES - HEADER_NAMES if above.article else NAMES
            off = BY_NAME if names & known else 0
        if tag in REGIONS:
            kind = tag if tag in ("article", "main") else ""
            if names and not kind and not off and names & ARTICLE_NAMES:
                kind = "main" if "main" in names else "named"
            region = len(self.parents)
            self.parents.append(above.region)
            self.kinds.append(kind)
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(_Open(tag, region, off, above.link or tag == "a",
                               above.article or tag in ("article", "main")))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        self.tags += 1
        if self.places.get(tag):
            at = self._find((tag,), () if tag in ("body", "html", "article", "main") else _WALLS)
            if at:
                self._close_from(at)

    def handle_data(self, data):
        top = self.open[-1]
        if top.tag not in ("script", "style"):
            self.parts.append(data)
            if top.link:
                self.linked += len(data.strip())

    def updatepos(self, i, j):
        """Line numbers aren't wanted."""
        return j

    def parse_comment(self, i, report=1):
        """A comment that is never closed ends with the page."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 and self.ending else end

    def close(self):
        self.ending = True
        super().close()
        self._line()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Ratios smoothed by a Gaussian over the lines around, whose weights add up to one."""
    reach = max(1, int(np.ceil(2 * sigma)))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, weights)[reach:reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), weights)[reach:reach + len(ratios)]


def content_mass(lines: list[tuple], sigma: float = SIGMA, threshold: float = THRESHOLD) -> np.ndarray:
    """For each line its smoothed ratio where that is above the threshold and the line isn't
    boilerplate, else 0."""
    chars = np.array([0 if off else len(text) - linked for text, _, linked, _, off, _ in lines], dtype=float)
    tags = np.array([max(1, t) for _, t, *_ in lines], dtype=float)
    level = smoothed(chars / tags, sigma)
    cut = threshold * min(level.std() or level.mean(), level.mean())
    return np.where((level >= cut) & (chars > 0), level, 0.0)


def _article(page: Lines, mass: np.ndarray) -> set[int]:
    """The regions of the article, all within one."""
    regions = len(page.parents)
    held = np.zeros(regions)
    for (_, _, _, region, _, _), m in zip(page.lines, mass):
        held[region] += m
    for region in range(regions - 1, 0, -1):  # inner regions come after the one around them
        held[page.parents[region]] += held[region]
    chosen = 0
    for kind in ("article", "main", "named"):
        named = [r for r in range(regions) if page.kinds[r] == kind and held[r] > 0]
        if named:
            chosen = max(named, key=lambda r: (held[r], -r))
            break
    else:
        inner: dict[int, list[int]] = {}
        for region in range(1, regions):
            inner.setdefault(page.parents[region], []).append(region)
        while chosen in inner:
            best = max(inner[chosen], key=lambda r: (held[r], -r))
            if held[best] < REGION_SHARE * held[chosen] or not held[best]:
                break
            chosen = best
    within = {chosen}
    for region in range(chosen + 1, regions):
        if page.parents[region] in within:
            within.add(region)
    return within


def main_text(html: str | None) -> str:
    """The article of one page: its blocks, joined by an empty line."""
    page = Lines()
    page.feed(html or "")
    page.close()
    lines = page.lines
    if not lines:
        return ""
    if all(off for *_, off, _ in lines):  # a name given to all of the page tells nothing
        lines = page.lines = [(*line[:4], line[4] if line[4] == BY_ELEMENT else 0, line[5]) for line in lines]
    within = _article(page, content_mass(lines))
    kept, menu = [], []
    for text, _, linked, region, off, item in [*lines, ("", 0, 0, -1, BY_ELEMENT, False)]:
        if item and region in within and not off and linked >= len(text):
            menu.append(text)  # list items that are links and nothing else: a menu, if there are several
            continue
        if len(menu) == 1:
            kept += menu
        menu = []
        if region in within and not off:
            kept.append(text)
    return BETWEEN.join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            texts = [main_text(html.as_py()) for html in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of the text).

    The text is the article of the whole html: character references decoded, white space within a block
    one space, blocks in page order with an empty line between; empty where there is none, as for
    a null or empty html or a page of boilerplate alone. Repeated pages are extracted one by one, null
    ids and urls are handed through, an empty table gives no rows, other columns are not read.
    A page is read by one task on its own: nothing is shuffled.
    """
    rows = pages.select("page_id", "url", F.col("html"))
    id_type = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extract, f"page_id {id_type}, url string, text string, n_chars long")
