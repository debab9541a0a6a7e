"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events. They become lines: the text of
a block element, with its number of tags and the element that holds it. Each
line's ratio of text to tags is smoothed with a Gaussian over its neighbours,
and one-dimensional two-means clustering of the smoothed ratios finds the
threshold above which lines are content. The content lines choose the region:
the article element that holds nearly all of their text, or without one the
deepest container that does. Every line of the region belongs to the article,
short ones too. Without an article element, lines outside the region belong to
it as well if they are content by the threshold or stand in a heading or a
paragraph, and are not mostly links. What stands in menus, headers and footers
of the page, sidebars, notices, adverts, forms, scripts, styles, comments of
readers or markup comments is left out wherever it stands, by its element,
role or class.

White space inside a block is one space; ``<br>`` is white space. Character
references are decoded. Unclosed and unmatched tags are tolerated; time and
memory grow with the length of a page, however deep its elements are.

Defined results: null or empty html has an empty text, as has a page without
text; a page without any block is one block; repeated rows get the same text
each; a null id or url passes through; further columns are passed in ``keep``;
an empty table gives an empty table. Pages are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

#: Elements that start a line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without a closing tag.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as part of an article.
SKIPPED = frozenset("applet audio button canvas datalist dialog footer form head header iframe input menu nav noframes noscript object script select style svg template textarea title video aside".split())
#: Elements that end an open one of the same kind.
CLOSED_BY_OWN = frozenset("p li dt dd option tr td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class names and ids that mark what is no article.
MARKS = frozenset("ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted related respond reply replies share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Elements that hold an article, and where a header belongs to it.
ARTICLE = frozenset(["article", "main"])
#: Elements that can be the region.
CONTAINERS = ARTICLE | frozenset("html body div section td center".split())
#: Marks that inside an article belong to it.
OWN = frozenset(["header", "banner"])
#: Blocks whose text is prose wherever they stand.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figcaption".split())
#: What may stand in a page's head; anything else ends it.
HEAD = frozenset("base link meta noscript script style template title".split())
#: Standard deviation of the smoothing, in lines, and share of the content that the region must hold.
SIGMA, SHARE = 1.0, 0.9
_WORDS = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


def _marked(tag: str, attributes: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element is none of the article."""
    if tag in SKIPPED:
        return not (tag == "header" and in_article)
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attributes:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if not value:
            continue
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and any(set(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", part).lower())) & (MARKS - OWN if in_article else MARKS) for part in value.split()):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


@dataclass
class Line:
    """The text of a block: its tags, the element that holds it, the block's tag, and its characters inside links."""

    text: str
    tags: int
    element: int
    block: str
    linked: int


class Lines(HTMLParser):
    """Lines of a page, and its elements as a tree in which parents have lesser numbers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, number, whether it is left out
        self.count: Counter[str] = Counter()  # of open tags
        self.blocks: list[int] = []  # places of the blocks among the open elements
        self.heads: list[int] = []
        self.parent, self.kind = [0], ["page"]  # of each element; 0 is the page
        self.left_out = 0
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[Line] = []

    def finish_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append(Line(text, self.tags, self.open[-1][1] if self.open else 0, self.open[self.blocks[-1]][0] if self.blocks else "", self.linked))
        self.text, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.heads and tag not in HEAD:
            self.drop(self.heads[0])
        if tag in BLOCKS:
            if tag in CLOSED_BY_OWN and self.blocks and self.open[self.blocks[-1]][0] == tag:
                self.finish_line()  # a new one ends an open one, unless another block stands between
                self.drop(self.blocks[-1])
            self.finish_line()
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in EMPTY:
            return
        out = self.left_out > 0 or _marked(tag, attrs, any(self.count[t] for t in ARTICLE))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        elif tag == "head":
            self.heads.append(len(self.open))
        self.parent.append(self.open[-1][1] if self.open else 0)
        self.kind.append(tag)
        self.open.append((tag, len(self.kind) - 1, out))
        self.count[tag] += 1
        self.left_out += out

    def drop(self, k: int) -> None:
        """End the open elements from place ``k`` on."""
        for tag, _, out in self.open[k:]:
            self.count[tag] -= 1
            self.left_out -= out
        del self.open[k:]
        for places in (self.blocks, self.heads):
            while places and places[-1] >= k:
                places.pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.count[tag]:
            k = len(self.open) - 1
            while self.open[k][0] != tag:  # all above it end too
                k -= 1
            if self.blocks and self.blocks[-1] >= k:
                self.finish_line()
            self.drop(k)
        elif tag in BLOCKS:
            self.finish_line()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.left_out:
            self.text.append(data)
            if self.count["a"]:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self.finish_line()


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends are weighted by the lines that exist."""
    reach = max(1, int(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, weights, "same")[: len(values)] / np.convolve(np.ones(len(values)), weights, "same")[: len(values)] if len(values) > 2 * reach else values


def threshold(values: np.ndarray) -> float:
    """The midpoint of two clusters, found by two-means from the extremes."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        middle = (low + high) / 2
        above = values > middle
        if not above.any() or above.all():
            break
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The article of a page, a line for each block."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines, parent, kind = parser.lines, parser.parent, parser.kind
    if not lines:
        return ""
    size = np.array([len(x.text) for x in lines], dtype=float)
    ratio = smoothed(size / np.maximum(1, np.array([x.tags for x in lines])))
    content = ratio >= threshold(ratio) if len(lines) > 1 else np.ones(1, dtype=bool)
    held = np.zeros(len(kind))
    for x, n, good in zip(lines, size, content, strict=True):
        held[x.element] += n * good
    for e in range(len(kind) - 1, 0, -1):
        held[parent[e]] += held[e]
    # those that hold so much lie on one path, and numbers grow inwards
    region = max((e for e in np.flatnonzero(held >= SHARE * size[content].sum()).tolist() if kind[e] in CONTAINERS), default=0)
    article = region
    while article and kind[article] not in ARTICLE:
        article = parent[article]
    region = article or region
    inside = [e == region for e in range(len(kind))]
    for e in range(region + 1, len(kind)):
        inside[e] = inside[e] or inside[parent[e]]
    own = lambda x, good: (good or x.block in PROSE) and 2 * x.linked <= len(x.text)
    return "\n".join(x.text for x, good in zip(lines, content, strict=True) if not region or inside[x.element] or (not article and own(x, good)))


def with_main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text: str = "text") -> DataFrame:
    """``keep`` and the main text of each page."""
    (own,) = free_name(pages, "html")
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made = [main_text(h) for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.string())], names=[*keep, text])

    return pages.select(*keep, F.col(html).cast("string").alias(own)).mapInArrow(run, schema)
