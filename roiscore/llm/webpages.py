"""Main text of web pages: parser events make lines, text-to-tag ratios are smoothed and clustered, and dense lines say which region is the article."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roiscore.llm.common import give_back, small_batches
from roiscore.session import ship

# Fixed values of HTML: elements by what they do to a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("applet audio canvas head iframe math noembed noframes noscript object script select style svg template textarea title video".split())
#: Elements of the page's frame; of a header inside an article its headings are kept.
FRAME = frozenset("aside button dialog footer menu nav".split())
#: Elements that a region may be.
REGIONS = frozenset("article body center div form html main section table tbody td tr".split())
#: An opening tag of the key closes these where they are open in the same list or table.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Lists and tables, in which what is open outside stays open.
SCOPES = frozenset("button dl menu ol select table ul".split())

#: Words of class names, ids and roles that mark what is no part of an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disclaimer disqus "
    "footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion recommendations "
    "recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Marks that count for an element of the page's frame where these stand before them ("with-sidebar").
WITHOUT = frozenset("has hide no not show with without".split())
_COPYRIGHT = re.compile(r"(©|\(c\)|copyright\b)", re.IGNORECASE)
_NAME = re.compile(r"[a-z0-9]+")

#: Opening tags without an end that are skipped up to the next bracket; after so many the rest of the page is taken as a tag.
MOST_BROKEN = 16
#: Why a line is left out: it lies in the frame, or names or a form around it say so.
IN_FRAME, BY_NAME, IN_FORM = 1, 2, 4


@dataclass(frozen=True)
class Params:
    #: Lines on either side that smoothing reaches, and its standard deviation.
    reach: int = 2
    sigma: float = 1.0
    #: Share of the page's dense text that an inner region needs to be taken in place of what is around it.
    inside: float = 0.9
    #: Share of the dense text that articles need to be taken as the regions, and share of the largest that each of them needs.
    articles: float = 0.5
    other_articles: float = 0.25
    #: Share of a list entry's or cell's characters in links above which it is a menu.
    linked: float = 0.8


class Lines(HTMLParser):
    """The lines of a page: text between block boundaries, with the tags met since the line before."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        #: Of each line: tags, characters in links, reasons to leave it out, region, and the element that it is the text of.
        self.tags: list[int] = []
        self.linked: list[int] = []
        self.out: list[int] = []
        self.region: list[int] = []
        self.element: list[str] = []
        #: Of each region: the one around it, and its element.
        self.around, self.kind = [0], ["page"]
        # Of each open element: its name, reasons to leave it out, region, what an opening tag may close, whether in an article, in a header, and in a link.
        self._open: list[tuple[str, int, int, dict[str, int], bool, bool, bool]] = [("", 0, 0, {}, False, False, False)]
        self._names: dict[str, int] = {}
        self._silent = self._broken = 0
        self._quiet = False
        self._parts: list[str] = []
        self._links = self._tags = 0

    def _end_line(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                name, out, region, _, article, header, _ = self._open[-1]
                if header and not (article and name in HEADINGS):
                    out |= IN_FRAME
                self.texts.append(text)
                self.tags.append(self._tags)
                self.linked.append(self._links)
                self.out.append(out)
                self.region.append(region)
                self.element.append(name)
                self._tags = 0
            self._parts.clear()
        self._links = 0

    def _pop_to(self, at: int) -> None:
        while len(self._open) > at:
            name = self._open.pop()[0]
            self._names[name] -= 1
            self._silent -= name in SILENT

    def handle_starttag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if name in BLOCKS:
            self._end_line()
        if name in VOID:
            if name == "br":
                self._parts.append(" ")
            return
        if name in ("body", "article", "main") and (self._names.get("title") or self._names.get("head")):
            self._pop_to(next(k for k, x in enumerate(self._open) if x[0] in ("head", "title")))
        closes = self._open[-1][3]
        for other in ("p", *CLOSES.get(name, ())) if name in BLOCKS else ():
            if (at := closes.get(other, 0)) and at < len(self._open) and self._open[at][0] == other:
                self._pop_to(at)
                closes = self._open[-1][3]
        _, out, region, closes, article, header, link = self._open[-1]
        if name in ("main", "article"):
            out, article = out & ~(IN_FORM | (BY_NAME if name == "main" else 0)), True
        elif name in FRAME:
            out |= IN_FRAME
        elif name == "form":
            out |= IN_FORM
        elif name == "header":
            header = True
        if attrs and name in BLOCKS and name not in ("html", "body", "main"):
            marked, heads = _marked(attrs)
            out |= BY_NAME * marked
            header |= heads and name != "article"
        if name in REGIONS:
            self.around.append(region)
            self.kind.append(name)
            region = len(self.kind) - 1
        if name in SCOPES:
            closes = {}
        elif name in ("td", "th"):
            closes = {k: v for k, v in closes.items() if k == "tr"} | {name: len(self._open)}
        elif name == "p" or name in CLOSES:
            closes = closes | {name: len(self._open)}
        self._open.append((name, out, region, closes, article, header, link or name == "a"))
        self._names[name] = self._names.get(name, 0) + 1
        self._silent += name in SILENT

    def handle_startendtag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(name, attrs)  # a slash closes only void elements

    def handle_endtag(self, name: str) -> None:
        self._tags += 1
        if name in BLOCKS:
            self._end_line()
        if self._names.get(name):
            self._pop_to(next(k for k in range(len(self._open) - 1, 0, -1) if self._open[k][0] == name))

    def handle_data(self, data: str) -> None:
        if not self._silent and not self._quiet:
            self._parts.append(data)
            if self._open[-1][6]:
                self._links += len(data)

    def close(self) -> None:
        super().close()
        self._end_line()

    # What has no end runs to the end of the page, as in browsers. The class itself would show it as text and try again at the
    # next bracket, so that a page full of them takes time that grows with the square of its length.

    def parse_starttag(self, i: int) -> int:
        self._quiet = True
        end = super().parse_starttag(i)
        self._quiet = False
        if end < 0:
            self._broken += 1
            end = self.rawdata.find(">", i) + 1
        return end if end and self._broken < MOST_BROKEN else len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        end = super().parse_endtag(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_comment(self, i: int, report: bool = True) -> int:
        return self._after("-->", i + 4)

    def parse_html_declaration(self, i: int) -> int:
        return self._after(">", i + 2)

    def parse_pi(self, i: int) -> int:
        return self._after(">", i + 2)

    def _after(self, end: str, at: int) -> int:
        found = self.rawdata.find(end, at)
        return found + len(end) if found >= 0 else len(self.rawdata)


def _marked(attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
    """Whether an element's names mark it as no part of an article, and whether they call it a header."""
    marked = heads = False
    for key, value in attrs:
        if key in ("class", "id", "role"):
            for name in (value or "").lower().split():
                parts = _NAME.findall(name)
                heads |= "header" in parts
                marked |= any(p in MARKS and not (k and parts[k - 1] in WITHOUT) for k, p in enumerate(parts))
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and re.search(r"display\s*:\s*none", value):
            marked = True
    return marked, heads


def smoothed(ratio: np.ndarray, params: Params = Params()) -> np.ndarray:
    """Ratios under a Gaussian of lines; at the ends it is cut off and scaled to a sum of 1."""
    kernel = np.exp(-0.5 * (np.arange(-params.reach, params.reach + 1) / params.sigma) ** 2)
    whole = np.convolve(ratio, kernel)[params.reach : params.reach + len(ratio)]
    return whole / np.convolve(np.ones(len(ratio)), kernel)[params.reach : params.reach + len(ratio)]


def threshold(values: np.ndarray) -> float:
    """The bound between two clusters of numbers with the least sum of squared distances from their means; the smallest value where all are equal."""
    x = np.sort(values)
    cuts = np.flatnonzero(np.diff(x) > 0) + 1
    if not len(cuts):
        return float(x[0])
    total = np.cumsum(x)
    gain = total[cuts - 1] ** 2 / cuts + (total[-1] - total[cuts - 1]) ** 2 / (len(x) - cuts)
    at = int(cuts[np.argmax(gain)])
    return float((x[at - 1] + x[at]) / 2)


def _regions(lines: Lines, dense: np.ndarray, chars: np.ndarray, params: Params) -> set[int]:
    """The regions that hold the article: those of its article or main elements, or else the innermost region that holds nearly all dense text."""
    around, kind = lines.around, lines.kind
    weight = [0] * len(kind)
    heads = [0] * len(kind)
    for k in np.flatnonzero(dense).tolist():
        weight[lines.region[k]] += int(chars[k])
    for k, name in enumerate(lines.element):
        heads[lines.region[k]] += name == "h1" and not lines.out[k]
    best = [0] * len(kind)
    for r in range(len(kind) - 1, 0, -1):  # inner regions have larger numbers
        weight[around[r]] += weight[r]
        heads[around[r]] += heads[r]
    for r in range(len(kind) - 1, 0, -1):
        if not best[around[r]] or weight[r] >= weight[best[around[r]]]:
            best[around[r]] = r
    for name in ("article", "main"):
        inner = [False] * len(kind)
        outermost = []
        for r in range(1, len(kind)):
            inner[r] = inner[around[r]] or kind[around[r]] == name
            if kind[r] == name and not inner[r] and weight[r]:
                outermost.append(r)
        if outermost and sum(weight[r] for r in outermost) >= params.articles * weight[0]:
            most = max(weight[r] for r in outermost)
            return {r for r in outermost if weight[r] >= params.other_articles * most}
    at = 0
    while (inner_best := best[at]) and weight[inner_best] >= params.inside * weight[0] and heads[inner_best] == heads[at]:
        at = inner_best
    return {at}


def main_text(html: str, params: Params = Params()) -> str:
    """The article's blocks, joined by empty lines; '' where the page has no text outside of scripts, forms and the like."""
    lines = Lines()
    lines.feed(html)
    lines.close()
    if not lines.texts:
        return ""
    chars = np.array([len(t) for t in lines.texts])
    tags, linked, out = np.array(lines.tags), np.array(lines.linked), np.array(lines.out)
    if out.all():  # names and forms may be around all there is; the frame's elements are not
        out &= IN_FRAME
    ratio = np.log1p(smoothed(chars / np.maximum(tags, 1), params))
    prose = (out == 0) & (2 * linked < chars)
    dense = prose & (ratio >= threshold(ratio))
    if not dense.any():
        dense = prose
    if not dense.any():
        return ""
    chosen = _regions(lines, dense, chars, params)
    within = [False] * len(lines.kind)
    for r in range(len(within)):
        within[r] = r in chosen or (r > 0 and within[lines.around[r]])
    menu = (linked > params.linked * chars) & np.array([e in ("li", "td", "th", "div", "ul", "ol", "a") or not e for e in lines.element])
    last = int(np.flatnonzero(dense)[-1])
    kept = []
    for k, text in enumerate(lines.texts):
        if within[lines.region[k]] and not out[k] and not menu[k] and not (k > last and _COPYRIGHT.match(text)):
            kept.append(text)
    return "\n\n".join(kept)


def _texts(params: Params):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(0)
            found = [main_text(h.as_py(), params) for h in html]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*batch.schema.names[1:], "text", "n_chars"])
            give_back()

    return texts


def extract(pages: DataFrame, html_col: str = "html", keep: Sequence[str] = ("page_id", "url"), params: Params = Params()) -> DataFrame:
    """The columns of `keep`, the main text of each page, and its number of code points.

    Rows are read one by one, without a shuffle; each gives one row, whatever its id, and equal pages give equal texts. A null page is
    empty; an empty one, or one with nothing but markup, menus and the like, gives an empty text. Other columns are not
    read. An empty table gives no rows. Work is linear in the length of a page.
    """
    ship(pages.sparkSession)
    small_batches(pages.sparkSession)
    df = pages.select(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("_html"), *(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([*df.schema.fields[1:], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return df.mapInArrow(_texts(params), schema)
