"""HTML extraction: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clustering.

One pass of the standard library's streaming parser turns a page into lines
(one a block, in page order) with the number of text characters and of tags that
belong to each. The ratio of text to tags is smoothed along the lines with a
Gaussian kernel, a two-cluster threshold over the smoothed ratios separates
dense regions from sparse ones, and the content region is chosen from them.
What the markup itself declares to be no content (menus, forms, adverts ...)
never becomes a line. Names that content bears too (search, related, legal ...)
only lower their lines' ratios: such a line stays where it is dense all the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapse.llm.arrowtext import trimmed

#: Elements whose whole content is dropped.
SKIPPED = frozenset("script style noscript template nav header footer aside form button select option textarea input label fieldset iframe object embed canvas svg math dialog menu head title".split())
#: Elements that start and end a block.
BLOCKS = frozenset("address article blockquote body center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role attributes that mark no content.
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|nav(?:bar|igation)?|menu|header|masthead|footer|side-?bar|aside|breadcrumbs?|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|signup|login|comments?|comment-?list|disqus|respond|replies|pagination|pager|toolbar|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
#: Words that mark content as well: a feature of the ratio.
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:social|share|sharing|related|recommend(?:ed|ations)?|widget|copyright|legal|search|dialog|alert)(?:$|[\s_-])", re.I)
DOUBT = 0.25
#: Those that mark an article container as none: a reader's comment may be an article of its own.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|repl(?:y|ies)|respond)(?:$|[\s_-])", re.I)
#: Containers that the page itself declares to be the article.
ARTICLE = frozenset(("article", "main"))
#: A start tag of these closes an open paragraph.
CLOSES_P = BLOCKS - {"body", "html"}
SPACE = re.compile(r"\s+")


class _Events(HTMLParser):
    """Collects (text, tags, depth of containers, linked characters, block, whether its name is doubtful) lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, str, bool]] = []
        self.parts: list[str] = []
        self.tags = self.links = self.linked = 0
        self.skip: list[str] = []
        self.hidden = 0  # article containers opened in what is skipped
        self.article = 0
        self.doubts: list[str] = []  # elements of a doubtful name, and those of the same kind inside them
        self.kind = ""

    def end_block(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, self.tags, self.article, self.linked, self.kind, bool(self.doubts)))
                self.tags = 0
            self.parts = []
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip and ((self.skip[-1] == "p" and tag in CLOSES_P) or (self.skip == ["li"] and tag == "li")):
            self.skip.pop()  # closed without an end tag
        if self.skip:
            if tag == self.skip[-1] and tag not in VOID:
                self.skip.append(tag)
            elif tag in ARTICLE:
                self.hidden += 1
            return
        self.tags += 1
        if tag in SKIPPED or (attrs and tag not in ("html", "body") and self.is_boiler(attrs, READERS if tag in ARTICLE else BOILER)):
            if tag in BLOCKS or tag in SKIPPED:
                self.end_block()
            if tag not in VOID:
                self.skip, self.hidden = [tag], 0
            return
        doubtful = not self.doubts and tag in BLOCKS and any(n in ("class", "id", "role") and v and DOUBTFUL.search(v) for n, v in attrs)
        if doubtful or (self.doubts and tag == self.doubts[0] and tag not in VOID):
            self.end_block()
            self.doubts.append(tag)
        if tag == "br":
            self.parts.append(" ")
        elif tag in BLOCKS:
            self.end_block()
            self.kind = tag
        elif tag == "a":
            self.links += 1
        if tag in ARTICLE:
            self.end_block()
            self.article += 1

    def is_boiler(self, attrs: list[tuple[str, str | None]], words: re.Pattern) -> bool:
        for name, value in attrs:
            if name in ("class", "id", "role") and value and words.search(value):
                return True
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        return False

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            elif tag in ARTICLE and self.hidden:
                self.hidden -= 1
            elif tag in ("article", "main", "body", "html"):
                self.skip = []  # an end around what is skipped ends that too
                self.handle_endtag(tag)
            return
        self.tags += 1
        if tag in BLOCKS or tag == "main":
            self.end_block()
            self.kind = ""
            if self.doubts and (tag == self.doubts[0] or tag in ("article", "main", "body", "html")):
                self.doubts = self.doubts[:-1] if tag == self.doubts[0] else []
        elif tag == "a":
            self.links = max(0, self.links - 1)
        if tag in ARTICLE:
            self.article = max(0, self.article - 1)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def unknown_decl(self, data: str) -> None:
        pass

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Any ``<![...`` is skipped to its end, as browsers do: to ``]]>`` for character data, else to ``>``."""
        end = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        j = self.rawdata.find(end, i)
        return -1 if j < 0 else j + len(end)


def page_lines(html: str) -> list[tuple[str, int, int, int, str, bool]]:
    """(text, tags since the line before, depth of article containers, characters in links, block, doubtful name)."""
    parser = _Events()
    parser.feed(html)
    parser.close()
    parser.end_block()
    return parser.lines


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along the lines, with weights renormalised at both ends."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[radius:-radius]
    return total / np.convolve(np.ones(len(values)), kernel)[radius:-radius]


def two_means(values: np.ndarray) -> float:
    """The threshold between two clusters of one-dimensional values: midway between their means at rest."""
    cut = float(values.mean())
    for _ in range(50):
        high = values > cut
        if high.all() or not high.any():
            return cut
        new = (float(values[high].mean()) + float(values[~high].mean())) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article of a page: blocks in page order, joined by newlines; empty without one.

    Ratios are taken as log(1 + text / tags), so that one very long paragraph
    doesn't outweigh the others. The content region reaches from the first dense line
    to the last, with headings just before it, and link lists inside it are left out.
    Where the page declares an article container for which the dense cluster votes,
    all of the container counts as dense, short lines too, and what lies before and
    after it has regions of its own, from lines that are dense themselves and not
    only by their neighbours.
    """
    if not html:
        return ""
    lines = page_lines(html)
    if not lines:
        return ""
    chars = np.array([len(x[0]) for x in lines], dtype=float)
    tags = np.array([max(1, x[1]) for x in lines], dtype=float)
    linked = np.array([min(x[3], len(x[0])) for x in lines], dtype=float)
    doubt = np.array([x[5] for x in lines])
    alone = np.log1p((chars - linked) / tags * np.where(doubt, DOUBT, 1.0))
    ratio = smooth(alone, sigma)
    cut = two_means(ratio)
    # a doubtful line isn't carried by its neighbours
    dense = np.where(doubt, alone, ratio) >= cut
    inside = np.array([x[2] > 0 for x in lines])
    if inside.any() and (dense & inside).any() and chars[inside].sum() >= 0.25 * (chars - linked).sum():
        listed = (linked > 0.5 * chars) | (doubt & ~dense)
        heading = np.array([x[4] in ("h1", "h2", "h3") for x in lines])
        keep = inside & (~listed | heading)
        own = dense & (alone >= cut) & ~listed
        for run in np.split(np.arange(len(lines)), np.flatnonzero(np.diff(inside)) + 1):
            at = run[own[run]] if not inside[run[0]] else run[:0]
            if len(at):
                first = int(at[0])
                while first > run[0] and heading[first - 1]:
                    first -= 1
                region = np.arange(first, at[-1] + 1)
                keep[region] = ~listed[region] | heading[region]
        return "\n".join(x[0] for x, k in zip(lines, keep, strict=True) if k)
    plain = (linked <= 0.5 * chars) & (~doubt | dense)
    at = np.flatnonzero(dense & plain)
    if not len(at):
        at = np.flatnonzero(plain)
        if not len(at):
            return ""
    first, last = int(at[0]), int(at[-1])
    while first and lines[first - 1][4] in ("h1", "h2", "h3"):
        first -= 1
    while last + 1 < len(lines) and lines[last + 1][4] in ("p", "li", "blockquote", "pre", "td") and plain[last + 1]:
        last += 1
    return "\n".join(lines[i][0] for i in range(first, last + 1) if plain[i])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).

    A null or empty html gives an empty text. Null ids and urls, repeated rows and
    ties are kept, one result a row; an empty table gives an empty result; other
    columns are not read. Whole pages are parsed, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(i, 512)
                text = pa.array([main_text(x) for x in part.column(2).to_pylist()], pa.string())
                n = pc.cast(pc.utf8_length(text), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text, n], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    id_kind, url_kind = (picked.schema[i].dataType.simpleString() for i in range(2))
    return picked.mapInArrow(trimmed(run), f"page_id {id_kind}, url {url_kind}, text string, n_chars bigint")
