"""robots.txt rules and XML sitemaps."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import normalized
from ..session import cut

AGENT = "siteloom-audit/1.0"


def rules(status: int | None, body: str | None) -> RobotFileParser:
    """The rules of a site; anything but a body with status 200 allows all."""
    parser = RobotFileParser()
    parser.parse(body.splitlines() if status == 200 and body else [])
    return parser


def may_fetch(parser: RobotFileParser, url: str, agent: str = AGENT) -> bool:
    """Whether the crawler or any crawler may fetch a URL."""
    return parser.can_fetch(agent, url) or parser.can_fetch("*", url)


@F.pandas_udf(T.BooleanType())
def allowed(status: pd.Series, body: pd.Series, url: pd.Series) -> pd.Series:
    """Twin of :func:`may_fetch` over columns; each body is parsed once a batch."""
    known: dict[tuple, RobotFileParser] = {}
    out = []
    for s, b, u in zip(status, body, url):
        key = (None if pd.isna(s) else int(s), b)
        if key not in known:
            known[key] = rules(*key)
        out.append(bool(u) and may_fetch(known[key], u))
    return pd.Series(out, dtype=bool)


def sitemap_hints(body: Column) -> Column:
    """Addresses that a robots.txt names as sitemaps, whatever its status."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), r"\r\n|\n|\r"), lambda x: F.lower(x).startswith("sitemap:"))
    return F.transform(lines, lambda x: F.trim(F.substring(x, 9, 1_000_000)))


def sitemap_entries(xml: str | None, base: str) -> tuple[list[str], list[str]]:
    """(page addresses, addresses of further sitemaps); broken XML has none.

    One pass over the parser's events: the closing of a ``loc`` files its text under
    the element that is open around it. The kind of the document and what was filed
    then decide: an index lists sitemaps, anything else pages, and a document that
    files no page under ``url`` gives whatever locations it has.
    """
    filed: dict[str, list[str]] = {"sitemap": [], "url": [], "": []}
    open_: list[str] = []
    document = ""
    parser = ET.XMLPullParser(("start", "end"))
    try:
        parser.feed(xml or "")
        parser.close()
        for event, element in parser.read_events():
            name = element.tag.split("}")[-1].lower() if isinstance(element.tag, str) else ""
            if event == "start":
                document = document or name
                open_.append(name)
                continue
            open_.pop()
            if name == "loc" and element.text and element.text.strip():
                address = normalized(element.text.strip(), base)
                around = open_[-1] if open_ else ""
                if around in ("sitemap", "url") and (len(open_) == 2):
                    filed[around].append(address)
                filed[""].append(address)
    except ET.ParseError:
        return [], []
    kept = {kind: [a for a in found if a] for kind, found in filed.items()}
    if document == "sitemapindex":
        return [], kept["sitemap"]
    return kept["url"] or kept[""], []


def _entry_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for site, url, xml, base in pdf.itertuples(index=False):
            for nested, found in enumerate(sitemap_entries(xml, base)):
                rows += [(site, url, bool(nested), k, target) for k, target in enumerate(found)]
        yield pd.DataFrame(rows, columns=["site", "url", "nested", "entry_idx", "target"])


def sitemap_edges(sitemaps: DataFrame) -> DataFrame:
    """(site, url, nested, entry_idx, target) of sitemaps (site, url, xml)."""
    base = F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1)
    return sitemaps.select("site", "url", "xml", base.alias("base")).mapInPandas(_entry_batches, "site string, url string, nested boolean, entry_idx int, target string")


def sitemap_pages(seeds: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(site, target): the distinct page addresses of a site that are reached from its sitemaps, ``limit`` a site.

    ``seeds``: (site, url, seed_idx). Breadth first over nested sitemaps until
    none is new; a sitemap counts once, at its first place.
    """
    from pyspark.sql import Window as W

    level = seeds.groupBy("site", "url").agg(F.array(F.lit(0), F.min("seed_idx")).alias("place"))
    reached, step = level, 0
    inner = edges.filter("nested").limit(1).count() > 0
    while inner and level.limit(1).count():
        step += 1
        nested = edges.filter("nested").join(level, ["site", "url"]).select("site", F.col("target").alias("url"), F.concat(F.array(F.lit(step)), F.slice("place", 2, step), F.array("entry_idx")).alias("place"))
        level = cut(nested.join(reached, ["site", "url"], "left_anti").groupBy("site", "url").agg(F.min("place").alias("place")))
        reached = reached.unionByName(level)
    maps = reached.groupBy("site", "url").agg(F.min("place").alias("place"))
    host = F.regexp_replace(F.regexp_extract("target", r"^[a-z]+://([^/?#]*)", 1), r"^www\.", "")
    found = edges.filter(~F.col("nested")).join(maps, ["site", "url"]).filter(host == F.col("site"))
    firsts = found.groupBy("site", "target").agg(F.min(F.struct("place", "entry_idx")).alias("first"))
    order = W.partitionBy("site").orderBy("first")
    return firsts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).select("site", "target", (F.col("n") - 1).cast("int").alias("idx"))
