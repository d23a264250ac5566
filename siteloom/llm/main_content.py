"""Problem 6: the body of a page apart from what surrounds it.

The streaming parser of the standard library turns a page into lines of text, each
with the tags since the text before it and the characters that are link text. Each
line has a text-to-tag ratio: its text outside links by the number of its tags,
where a tag that opens running text (a paragraph, a heading) does not count as
markup but as a sign of text. The ratios are smoothed with a Gaussian over the
order of the lines, and a threshold that parts the smoothed ratios into two
clusters selects the dense lines. The regions (innermost containers; a badly closed
page only nests them deeper, it does not merge them) are ranked by the ratios of
their dense lines, and the best are the body. They mend what single ratios miss:
headings, lists, addresses and short messages in the main place come with it. The
names of elements such as nav or footer, classes and ids decide nothing.

Blocks of text are then matched with the lines of their page. A block belongs to
the surroundings if none of its lines is a body line.

Defined results: a page without html, or of an error in parsing, has no lines; a
block whose page is unknown is judged by its own text alone; a null or blank text
is in neither result; repeated rows are each reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import spread

SIGMA = 1.0
#: A region is body too if it has so large a part of the best region's weight.
REGION_PART = 0.5
#: Characters of text that a tag that opens running text counts as.
OPENS_CHARS = 400.0

_SKIP = frozenset(("script", "style", "title", "noscript", "template", "svg", "iframe", "canvas", "head", "select", "button"))
_VOID = frozenset(("br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"))
_REGION = frozenset(("body", "div", "td", "section", "article", "main", "aside", "nav", "header", "footer", "form", "dialog"))
_LINE = _REGION | frozenset(("p", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "address", "pre", "blockquote", "dl", "dt", "dd", "br", "hr", "figure", "figcaption"))
_PROSE = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "address", "blockquote", "pre"))
_IMPLIED = frozenset(("li", "td", "tr", "dt", "dd"))
_QUOTES = frozenset(("pre", "code", "samp", "kbd", "q", "textarea", "blockquote"))


#: A start tag whose quotes are closed; text and such a tag or an end tag after it; elements whose content the library reads in a way of its own.
_TAG = r"([a-zA-Z][a-zA-Z0-9]*)(?:\s(?:[^>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)?"
_START = re.compile(f"<{_TAG}>")
_PIECE = re.compile(rf"([^<]*+)<(?:{_TAG}|/([a-zA-Z][-.a-zA-Z0-9:_]*)\s*)>")
_RAW = frozenset(("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "plaintext"))


class _Lines(HTMLParser):
    """Lines of one page: [region, parts, tags, link characters, tags that open running text, parts within quoting elements]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.regions: list[tuple[str, int]] = [("body", -1)]
        self.stack: list[tuple[str, int | None]] = []
        self.skip = self.link = self.quotes = self.tags = self.opens = 0
        self.region = 0
        self.open: list | None = None

    def updatepos(self, i: int, j: int) -> int:
        return j

    def goahead(self, end: bool) -> None:
        """Text and well-formed tags at once; the library goes on where that ends."""
        if not end and not self.cdata_elem:
            self.rawdata = self.rawdata[self._pieces(self.rawdata) :]
        super().goahead(end)

    def _pieces(self, data: str) -> int:
        """Handles ``data`` in the library's order of events, up to the place that is returned."""
        i, match = 0, _PIECE.match
        while True:
            m = match(data, i)
            if m is not None:
                text, tag, ended = m.groups()
                if text and not self.skip:
                    self.handle_data(unescape(text))
                if ended is not None:
                    self.handle_endtag(ended.lower())
                    i = m.end()
                    continue
                tag = tag.lower()
                if tag not in _RAW:
                    i = m.end()
                    if data[i - 2] == "/":
                        self.handle_startendtag(tag, [])
                    else:
                        self.handle_starttag(tag, [])
                    continue
                at = m.end(1)
            else:
                at = data.find("<", i)
                if at < 0:
                    return i
                if i < at and not self.skip:
                    self.handle_data(unescape(data[i:at]))
            i = self._markup(data, at)
            if i < 0:
                return at
            if self.cdata_elem:
                m = self.interesting.search(data, i) if self.skip else None
                if m is None:
                    return i
                at, i = m.start(), self.parse_endtag(m.start())
                if i < 0 or self.cdata_elem:
                    return max(i, at)

    def _markup(self, data: str, at: int) -> int:
        """What the library makes of a ``<``: the place after it, negative if it wants more."""
        after = data[at + 1 : at + 2]
        if after.isascii() and after.isalpha():
            return self.parse_starttag(at)
        if after == "/":
            return self.parse_endtag(at)
        if data.startswith("!--", at + 1):
            return self.parse_comment(at)
        if after == "?":
            return self.parse_pi(at)
        if after == "!":
            return self.parse_html_declaration(at)
        if not after:
            return -1
        self.handle_data("<")
        return at + 1

    def parse_starttag(self, i: int) -> int:
        """A well-formed start tag at once, without its attributes; anything else as the library does."""
        m = _START.match(self.rawdata, i)
        if m is None or m[1].lower() in _RAW:
            return super().parse_starttag(i)
        tag = m[1].lower()
        if m[0][-2] == "/":
            self.handle_startendtag(tag, [])
        else:
            self.handle_starttag(tag, [])
        return m.end()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP:
            self.skip += 1
            self.stack.append((tag, None))
            return
        if tag == "body" and self.skip and any(t == "head" for t, _ in self.stack):
            self.stack = [x for x in self.stack if x[0] not in _SKIP]
            self.skip = 0
        if self.skip:
            return
        if tag in _LINE:
            self.open = None
        if tag in _VOID:
            self.tags += 1
            return
        if tag in _PROSE:
            self.opens += 1
            self._close(tag, implied=True)
        else:
            self.tags += 1
            if tag in _IMPLIED:
                self._close(tag, implied=True)
        own = None
        if tag in _REGION and tag != "body":
            own = len(self.regions)
            self.regions.append((tag, self.region))
            self.region = own
        if tag == "a":
            self.link += 1
        if tag in _QUOTES:
            self.quotes += 1
        self.stack.append((tag, own))

    def _close(self, tag: str, implied: bool = False) -> None:
        stack = self.stack
        for k in range(len(stack) - 1, -1, -1):
            name, own = stack[k]
            if name == tag:
                while len(stack) > k:
                    name, own = stack.pop()
                    if own is not None:
                        self.region = max(0, self.regions[own][1])
                    if name == "a":
                        self.link = max(0, self.link - 1)
                    elif name in _SKIP:
                        self.skip = max(0, self.skip - 1)
                    if name in _QUOTES:
                        self.quotes = max(0, self.quotes - 1)
                return
            if name in _SKIP or (own is not None and (implied or tag not in _REGION)):
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in _LINE:
            self.open = None
        if not self.skip and tag not in _PROSE:
            self.tags += 1
        if tag in _VOID or tag in ("body", "html"):
            return
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.skip or not data or data.isspace():
            return
        line = self.open
        for k, part in enumerate(data.split("\n")):
            text = part.strip()
            if not text:
                continue
            if line is None or k or line[0] != self.region:
                self.open = line = [self.region, [], 1, 0, 0, []]
                self.lines.append(line)
            line[1].append(text)
            line[2] += self.tags
            line[4] += self.opens
            self.tags = self.opens = 0
            if self.link:
                line[3] += len(text)
            if self.quotes:
                line[5].append(text)


def page_lines(html: str | None) -> tuple[list[list], list[tuple[str, int]]]:
    """The lines of a page and its regions (tag, parent)."""
    parser = _Lines()
    try:
        parser.feed(html or "")
        parser.close()
    except Exception:  # noqa: BLE001 - the parser may give up on broken declarations; what came before counts
        pass
    return parser.lines, parser.regions


_RADIUS = int(3 * SIGMA)
_KERNEL = np.exp(-0.5 * (np.arange(-_RADIUS, _RADIUS + 1) / SIGMA) ** 2)


@lru_cache(maxsize=256)
def _norm(n: int) -> np.ndarray:
    return np.convolve(np.ones(n), _KERNEL)[_RADIUS : _RADIUS + n]


def _smooth(values: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over the order of the lines."""
    return np.convolve(values, _KERNEL)[_RADIUS : _RADIUS + len(values)] / _norm(len(values))


def _threshold(values: np.ndarray) -> float:
    """Where two clusters of the values part (two means in one dimension)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(12):
        middle = (low + high) / 2
        over = values > middle
        above, below = values[over], values[~over]
        if not len(above) or not len(below):
            break
        new = float(np.add.reduce(below)) / len(below), float(np.add.reduce(above)) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def text_ratios(lines: list[list]) -> np.ndarray:
    """Text-to-tag ratio of each line."""
    return np.array([(max(0, sum(map(len, parts)) - link) + OPENS_CHARS * opens) / tags for _, parts, tags, link, opens, _ in lines])


def body_flags(lines: list[list], regions: list[tuple[str, int]], ratios: np.ndarray | None = None) -> list[bool]:
    """Whether each line belongs to the body."""
    if not lines:
        return []
    ratios = text_ratios(lines) if ratios is None else ratios
    smooth = _smooth(np.log1p(ratios))
    dense = smooth >= _threshold(smooth)
    weight = [0.0] * len(regions)
    for line, ratio, chosen in zip(lines, ratios.tolist(), dense.tolist()):
        if chosen:
            weight[line[0]] += ratio
    least = REGION_PART * max(weight)
    return [least > 0 and weight[line[0]] >= least for line in lines]


def line_key(line: Column) -> Column:
    """A line without case, white space and punctuation; a line of marks alone stays as it is."""
    bare = F.regexp_replace(F.lower(line), r"(?U)[\W_]+", "")
    return F.when(bare == "", F.trim(line)).otherwise(bare)


def _label_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every line, and as part ``False`` the pieces of a line that is made of several links or tags."""
    for pdf in batches:
        rows = []
        for page_id, address, html in pdf.itertuples(index=False):
            lines, regions = page_lines(html)
            for k, (line, body) in enumerate(zip(lines, body_flags(lines, regions))):
                rows.append((page_id, address, k, " ".join(line[1]), body, True))
                if not body and len(line[1]) > 1:
                    rows += [(page_id, address, k, part, body, False) for part in line[1]]
        yield pd.DataFrame(rows, columns=["page_id", "address", "line_no", "line", "body", "whole"])


def address_key(url: Column) -> Column:
    """An address without scheme, ``www.``, fragment and closing slash, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"#.*$", ""), r"^[a-z]+://(www\.)?|/+$", "")


def page_body_lines(pages: DataFrame) -> DataFrame:
    """(page_id, address, line_no, line, body, whole) of every line of every page with html."""
    rows = pages.filter(F.col("html").isNotNull() & (F.col("html") != "")).select("page_id", address_key(F.coalesce("final_url", "url")).alias("address"), "html")
    return spread(rows).mapInPandas(_label_batches, "page_id long, address string, line_no int, line string, body boolean, whole boolean")


def main_bodies(pages: DataFrame) -> DataFrame:
    """(page_id, n_lines, body): the body of each page, one line of text per line."""
    lines = page_body_lines(pages).filter("whole")
    return lines.groupBy("page_id").agg(
        F.count("*").alias("n_lines"),
        F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.when(F.col("body"), F.struct("line_no", "line")))), lambda x: x["line"])).alias("body"),
    )


#: What joins the entries of a menu or path on one line of a block.
JOINTS = r"\s+[>|·»/]\s+|\s{2,}|^\s*[-*•]\s+"
#: A sentence: an end mark after some text. Judges the blocks whose page is unknown.
SENTENCE = r"(?U)(\w+[\s,;:]+){4,}\w+[^\n]*[.!?…]|[\u3040-\u9FFF]{6,}[^\n]*[。！？]"


def surroundings(pages: DataFrame, passages: DataFrame) -> DataFrame:
    """passage_id of every block of which no line belongs to the body of its page.

    Lines travel as 64-bit keys of address and text. A line that a page has both
    in its body and around it counts as body only if the block has no line that
    is surely from around.
    """
    of_page = (
        page_body_lines(pages)
        .select(F.xxhash64("address").alias("a"), F.xxhash64(line_key(F.col("line"))).alias("k"), F.col("body").cast("int").alias("b"))
        .groupBy("a", "k")
        .agg(F.max("b").alias("inside"), F.min("b").alias("only"))
    )
    blocks = passages.filter(F.col("text").isNotNull() & F.col("text").rlike(r"(?U)\S"))
    line = F.regexp_replace("line", r"^\s*[-*•]\s+", "")
    of_block = (
        blocks.select("passage_id", F.xxhash64(address_key(F.col("url"))).alias("a"), F.explode(F.split("text", "\n")).alias("line"))
        .filter(F.col("line").rlike(r"(?U)\S"))
        .select("passage_id", "a", F.col("line").rlike(SENTENCE).alias("prose"), F.posexplode(F.array_distinct(F.concat(F.array(line), F.split("line", JOINTS)))).alias("n", "part"))
        .filter((F.col("part") != "") & F.col("part").isNotNull())
        .select("passage_id", "a", F.xxhash64(line_key(F.col("part"))).alias("k"), (F.col("n") == 0).alias("whole"), "prose")
    )
    met = of_block.join(of_page, ["a", "k"], "left").groupBy("passage_id").agg(
        F.bool_or(F.col("whole") & (F.col("only") == 1)).alias("body"),
        F.bool_or(F.col("whole") & (F.col("inside") == 1)).alias("maybe"),
        F.bool_or(F.col("inside") == 0).alias("around"),
        F.bool_or("prose").alias("prose"),
    )
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    body = yes("body") | (yes("maybe") & ~yes("around")) | (~yes("maybe") & ~yes("around") & yes("prose"))
    return met.filter(~body).select("passage_id")
