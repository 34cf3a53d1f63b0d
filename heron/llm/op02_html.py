"""Main text of HTML pages: parser events make lines, whose text-to-tag ratios are smoothed and clustered into content regions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import small_batches, table, with_fields

#: Elements whose text is never content, elements that end a line, elements without an end tag.
APART = frozenset("aside button datalist dialog fieldset footer form head header iframe label menu nav noscript object option script select style svg template textarea".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead title tr ul".split()
) | APART
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark menus, sidebars, notices, adverts, forms and reader comments.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|adbox|ads|adsbygoogle|adsense|adslot|adunit|advert|adverts|advertisement|advertising|alert|banner|breadcrumb|breadcrumbs|comment|comments|complementary|contentinfo|cookie|cookies|consent|disqus|disclaimer|dialog|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|overlay|pagination|pager|popup|promo|promoted|related|replies|respond|search|share|sharing|sidebar|skip|social|sponsor|sponsored|subscribe|toolbar|widget)(?=$|[\s_-])",
    re.I,
)
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: Texts of links that lead on from an article and are no part of it.
PAGER = frozenset("back|continue|continue reading|forward|home|more|newer|next|next article|next page|older|permalink|prev|previous|previous article|previous page|print|read more|reply|share|to top|top".split("|"))
HEADERS = frozenset(("header", "masthead"))
ARTICLES, HEADINGS = ("article", "main"), frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD, APART_WHOLLY = 1, 2
SPACE = re.compile(r"\s+")
#: Lines on each side that the Gaussian reaches, and its width.
RADIUS, SIGMA = 3, 1.5
#: Tags that a line counts more if most of it is links; tags of a short line that may still be content.
LINKED, FEW = 8, 4


class Line(NamedTuple):
    """A line of a page: its text, the tags it took, whether its text is links for the most part, whether it stands in a part that is never content, in which article (0: none), whether it is a heading, and how many of the tags are inline ones."""

    text: str
    tags: int
    linked: bool
    apart: bool
    article: int
    heading: bool = False
    inline: int = 0


def apartness(tag: str, attrs: dict[str, str | None], in_article: bool, after_article: bool = False) -> int:
    """0: may be content; HEAD: the header of an article, whose headings may be content; APART_WHOLLY: never content.

    The marks of an article count if it stands in or after another one, as the articles of readers' comments do.
    """
    marks = set() if tag in ("html", "body", "main") or tag == "article" and not (in_article or after_article) else {m[0].strip(" _-\t\n").lower() for k in ("class", "id", "role") for m in MARKS.finditer(attrs.get(k) or "")}
    if tag in APART - {"header"} or "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style") or "") or marks - HEADERS:
        return APART_WHOLLY
    if tag == "header" or marks:
        return HEAD if in_article else APART_WHOLLY
    return 0


class Lines(HTMLParser):
    """Streams a page's events into lines. Text in an inline part that is never content, such as an advert inside a paragraph, is no part of the line around it.

    The first article of a page may stand behind a menu or head that is never closed: it counts as content unless the
    part around it is closed after all (shut holds such articles).
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.other: list[str] = []  # text of parts that are never content
        self.tags = self.inline = 0
        self.heading = False
        self.open: list[tuple[str, int, int, int]] = []  # name, apartness and article around it, articles before it
        self.apart, self.article, self.articles = 0, 0, 0
        self.shut: set[int] = set()
        self.links = self.linked = 0  # open links, characters in them

    def end_line(self) -> None:
        for parts, apart in ((self.text, False), (self.other, True)):
            text = SPACE.sub(" ", "".join(parts)).strip() if parts else ""
            if text:
                self.lines.append(Line(text, self.tags, not apart and 2 * self.linked > len(text), apart, self.article, self.heading, self.inline))
                self.tags = self.inline = 0
        if self.text or self.other:
            self.linked, self.text, self.other = 0, [], []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        self.inline += tag not in BLOCKS
        if tag == "br":
            (self.other if self.apart else self.text).append(" ")
        if tag in VOID:
            return
        if tag == "a":
            self.links = 1
        inside = any(name in ARTICLES for name, *_ in self.open)
        self.open.append((tag, self.apart, self.article, self.articles))
        self.heading = self.heading or tag in HEADINGS
        after = self.articles > len(self.shut)
        if tag in ARTICLES:
            if not self.article:
                self.articles += 1
            self.article = self.article or self.articles
            if not inside and not after:
                self.apart = 0
        self.apart = max(self.apart, apartness(tag, dict(attrs), inside, after))
        if inside and tag in HEADINGS and self.apart == HEAD:
            self.apart = 0  # the title of an article may stand in its header

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        if tag == "a":
            self.links = 0
        for i in range(len(self.open) - 1, -1, -1):
            name, apart, article, before = self.open[i]
            if name == tag:
                within = self.open[i + 1][1] if i + 1 < len(self.open) else self.apart
                if name not in ARTICLES and within and not apart:  # the part that was apart ends here
                    self.shut.update(range(before + 1, self.articles + 1))
                self.apart, self.article, self.heading = apart, article, self.heading and tag not in HEADINGS
                del self.open[i:]
                return
            if name in ("article", "main", "body") or name in APART and tag not in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        (self.other if self.apart else self.text).append(data)
        if self.links and not self.apart:
            self.linked += len(data)


def read_lines(html: str) -> list[Line]:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return [x._replace(apart=True) if x.article in parser.shut else x for x in parser.lines]


def smoothed(ratios: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the page; weights are normed at the ends."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    sums, weights = np.convolve(ratios, kernel, "full"), np.convolve(np.ones(len(ratios)), kernel, "full")
    return (sums / weights)[radius : radius + len(ratios)]


def ratios(lines: list[Line]) -> np.ndarray:
    """Characters by tags of each line; a line of links counts LINKED tags more."""
    return np.array([len(x.text) / max(1, x.tags + LINKED * x.linked) for x in lines])


def regions(lines: list[Line]) -> list[int]:
    """Places of the lines in content regions.

    Lines in a part that is never content are neither smoothed in nor chosen. Of the others, those with a smoothed ratio
    of at least the threshold (their mean less half a deviation, or the largest) are the content cluster. Where some of
    it stands in articles, those articles are content from their first to their last line, but for links that lead on
    (PAGER) at their ends. Else a region is the run from the first to the last line of the cluster; it loses lines of
    links at its ends, headings never, and is extended there over headings and over lines that are no links and have FEW
    tags other than inline ones, up to a line of links or a part that is never content.
    """
    if not lines:
        return []
    apart = np.array([x.apart for x in lines])
    article = np.array([x.article for x in lines])
    linked = np.array([x.linked for x in lines])
    if apart.all():
        return []
    score = np.zeros(len(lines))
    score[~apart] = held = smoothed(ratios(lines)[~apart])
    core = (score >= min(held.max(), max(held.mean() - held.std() / 2, 1e-9))) & ~apart
    within = np.unique(article[core & (article > 0)])
    chosen: list[int] = []
    for number in within.tolist() or [0]:
        at = np.flatnonzero((article == number) & ~apart) if number else np.flatnonzero(article == 0)
        inner = np.flatnonzero(core[at]) if not number else np.array([0, len(at) - 1])
        first, last = int(inner[0]), int(inner[-1])
        while first < last and _leads_on(lines[at[first]]):
            first += 1
        while last > first and _leads_on(lines[at[last]]):
            last -= 1
        while not number and first > 0 and _plain(lines[at[first - 1]]):
            first -= 1
        while not number and last < len(at) - 1 and _plain(lines[at[last + 1]]):
            last += 1
        chosen += at[first : last + 1].tolist()
    return [i for i in sorted(chosen) if not apart[i]]


def _leads_on(line: Line) -> bool:
    """Whether a line at the end of a region is a link away from it."""
    return line.linked and not line.heading and (not line.article or line.text.strip(" .:»«›‹→←>|").lower() in PAGER)


def _plain(line: Line) -> bool:
    """Whether a line at the end of a region outside articles may belong to it: a heading, or a short first or last line."""
    return not line.apart and (line.heading or not line.linked and line.tags - line.inline <= FEW)


def main_text(html: str | None) -> str:
    """The main text of a page: lines of its content regions in page order, joined by one line feed; null is empty."""
    lines = read_lines(html or "")
    return "\n".join(lines[i].text for i in regions(lines))


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_lines): a row for each page, with the lines of its content regions joined by line feeds.

    Null, blank or wholly menu-like pages have an empty text; repeated rows and ids are read each. A very long page is
    read whole and takes memory for its lines. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for html in batch.column(1).to_pylist():
                lines = read_lines(html or "")
                chosen = regions(lines)
                texts.append("\n".join(lines[i].text for i in chosen)), counts.append(len(chosen))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["id", "text", "n_lines"])

    schema = with_fields(pages.select(F.col(id_col).alias("id")), "text string, n_lines long")
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 2; the page's other columns travel as its key."""
    pages = table(spark, sf_dir, "pages")
    found = extracted(pages.select(F.struct("page_id", "url").alias("page"), "html"), "page")
    return found.select("id.page_id", "id.url", F.coalesce("text", F.lit("")).alias("text"), F.length("text").cast("long").alias("n_chars"), "n_lines")
