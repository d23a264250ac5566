"""A crawl of live sites: robots.txt, sitemaps, pages in the order of the replay, and citations.

Every step is a round over all sites at once: what is wanted next is a table of
addresses, one task fetches the share of its sites, and the replies are written
once. The transport is any function (address, timeout) -> reply, so tests crawl
without a network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.lexicon import FETCH_DELAY_S, FETCH_TIMEOUT_S, MAX_PAGES, SITEMAP_PATHS
from ..operators import crawl
from ..session import cut
from . import robots
from .fetch import SCHEMA, Reply, page_row, transport

Fetch = Callable[[str, float], Reply]
#: Addresses of a site that are fetched in one round beyond what the replay needs at once.
AHEAD = 8
#: Characters of a robots.txt and sitemap addresses that are kept of a site (fixed values).
KEPT_BODY, KEPT_SITEMAP = 4_000, 50


def fetched(wanted: DataFrame, fetch: Fetch = transport, delay: float = FETCH_DELAY_S, timeout: float = FETCH_TIMEOUT_S, citation: bool = False) -> DataFrame:
    """The replies to (site, url), one task for the addresses of a site, with a pause after each."""
    names = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "m").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for site, url in pdf.itertuples(index=False):
                rows.append((site, *page_row(url, fetch, timeout, citation)))
                time.sleep(delay)
            yield pd.DataFrame(rows, columns=["site", *names])

    return cut(wanted.select("site", "url").repartition("site").mapInPandas(run, f"site string, {SCHEMA}"))


def _texts(wanted: DataFrame, fetch: Fetch, delay: float) -> DataFrame:
    """(site, url, status, body) of plain files: whatever their type, their text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for site, url in pdf.itertuples(index=False):
                try:
                    status, _, _, body, _ = fetch(url, FETCH_TIMEOUT_S)
                    rows.append((site, url, status, body.decode("utf-8", "replace")))
                except Exception:  # noqa: BLE001 - any failure of the network is a reply of status 0
                    rows.append((site, url, 0, ""))
                time.sleep(delay)
            yield pd.DataFrame(rows, columns=["site", "url", "status", "body"])

    return cut(wanted.select("site", "url").repartition("site").mapInPandas(run, "site string, url string, status int, body string"))


def _sitemaps(seeds: DataFrame, fetch: Fetch, delay: float, limit: int) -> DataFrame:
    """(site, sitemap_urls) reached from (site, url, seed_idx): each sitemap is read once, level by level until none is new."""
    level, seen, edges = seeds.select("site", "url").distinct(), None, None
    while level.limit(1).count():
        texts = _texts(level, fetch, delay)
        new = cut(robots.sitemap_edges(texts.filter("status = 200").select("site", "url", F.col("body").alias("xml"))))
        edges = new if edges is None else edges.unionByName(new)
        seen = level if seen is None else seen.unionByName(level)
        level = cut(new.filter("nested").select("site", F.col("target").alias("url")).distinct().join(seen, ["site", "url"], "left_anti"))
    found = robots.sitemap_pages(seeds, edges, limit)
    return found.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "target"))), lambda x: x["target"]).alias("sitemap_urls"))


def crawl_sites(starts: DataFrame, budget: int = MAX_PAGES, fetch: Fetch = transport, delay: float = FETCH_DELAY_S) -> tuple[DataFrame, DataFrame]:
    """(archive, sites) of a crawl of (start_url): the tables that the pipeline reads."""
    first = starts.select(urls.normalize(F.col("start_url")).alias("start_url")).distinct().withColumn("site", urls.host(F.col("start_url")))
    origin = F.regexp_extract("start_url", r"^([a-z]+://[^/?#]+)", 1)
    first = cut(first.groupBy("site").agg(F.min("start_url").alias("start_url")).withColumn("origin", origin))
    about = _texts(first.select("site", F.concat("origin", F.lit("/robots.txt")).alias("url")), fetch, delay).withColumnRenamed("url", "robots_url")
    hints = about.select("site", F.posexplode(robots.sitemap_hints(F.col("body"))).alias("seed_idx", "url"))
    usual = first.select("site", F.posexplode(F.transform(F.array(*map(F.lit, SITEMAP_PATHS)), lambda p: F.concat("origin", p))).alias("seed_idx", "url")).withColumn("seed_idx", F.col("seed_idx") + 10**6)
    listed = _sitemaps(cut(hints.unionByName(usual)), fetch, delay, min(budget, KEPT_SITEMAP))
    body = F.when(F.col("status") == 200, F.substring("body", 1, KEPT_BODY)).otherwise("")
    sites = cut(
        first.join(about.select("site", "robots_url", F.col("status").alias("robots_status"), body.alias("robots_body")), "site")
        .join(listed, "site", "left")
        .select("site", "start_url", F.col("site").alias("host"), "robots_url", "robots_status", "robots_body", F.coalesce("sitemap_urls", F.array().cast("array<string>")).alias("sitemap_urls"))
    )
    replies = []

    def answer(wanted: DataFrame) -> DataFrame:
        got = fetched(wanted, fetch, delay)
        got = cut(got.withColumn("page_id", F.xxhash64("site", "url")))
        replies.append(got)
        return got

    order = crawl.replay_rounds(answer, sites, budget, AHEAD)
    every = replies[0]
    for more in replies[1:]:
        every = every.unionByName(more)
    probe = F.regexp_replace(F.col("url"), r"^[a-z]+://[^/]+", "").isin(*crawl.CONVENTIONAL_PATHS)
    mapped = sites.select("site", F.explode("sitemap_urls").alias("url")).select("site", urls.normalize(F.col("url")).alias("url"), F.lit(True).alias("mapped")).distinct()
    kept = order.join(every, ["site", "url"]).join(mapped, ["site", "url"], "left")
    archive = cut(kept.select("page_id", "site", *(c for c in every.columns if c not in ("page_id", "site", "from_sitemap", "from_probe")), F.coalesce("mapped", F.lit(False)).alias("from_sitemap"), (probe & F.col("mapped").isNull()).alias("from_probe"), F.col("idx").alias("crawl_idx")))
    cited = fetched(crawl.citations(archive).select("site", F.col("target").alias("url")), fetch, delay, citation=True)
    cited = cited.withColumn("page_id", F.xxhash64("site", "url", F.lit("citation"))).withColumn("crawl_idx", F.lit(None).cast("int"))
    return archive.unionByName(cited.select(*archive.columns)), sites
