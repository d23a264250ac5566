"""Link graph, citations, reachability, and the replay of a crawl over an archive."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.html import features
from ..functions.lexicon import CITATION_HOSTS, CONVENTIONAL_PATHS, LOCAL_HINTS, MAX_CITATIONS, MAX_PAGES
from ..session import cut
from ..sources.archive import crawl_pages, page_url
from ..sources.robots import may_fetch, rules


def link_edges(archive: DataFrame) -> DataFrame:
    """(page_id, link_idx, target): the distinct links of each page in order, made absolute."""
    return features(archive).select("page_id", F.posexplode("targets").alias("link_idx", "target"))


def local_links(edges: DataFrame) -> DataFrame:
    """The links whose path speaks of contact, hours, places and the like."""
    return edges.filter(urls.local_hint(F.col("target")))


def citations(archive: DataFrame, limit: int = MAX_CITATIONS) -> DataFrame:
    """(site, idx, target): the first distinct links of a site to directories and maps."""
    pages = crawl_pages(archive)
    hosts = "|".join(h.replace(".", "\\.") for h in CITATION_HOSTS)
    order = F.struct(F.coalesce("crawl_idx", F.lit(2**31 - 1)), "page_id", "link_idx")
    links = features(pages, "site string, crawl_idx int").select("page_id", "site", "crawl_idx", F.posexplode("targets").alias("link_idx", "target"))
    found = links.filter(F.lower("target").rlike(hosts))
    firsts = found.groupBy("site", "target").agg(F.min(order).alias("first"))
    return firsts.withColumn("n", F.row_number().over(W.partitionBy("site").orderBy("first"))).filter(F.col("n") <= limit).select("site", (F.col("n") - 1).alias("idx"), "target")


def reachable(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(site, node, depth): the least number of links from a site's start, of every node or up to a bound.

    Level by level: only nodes that no earlier level had go on, so circles end and no
    walk is followed twice. ``edges``: (site, source, target), ``starts``: (site, node).
    """
    edges = cut(edges.select("site", "source", "target").distinct())
    level = cut(starts.select("site", "node").distinct().withColumn("depth", F.lit(0).cast("long")))
    reached, step = level, 0
    while (depth is None or step < depth) and level.limit(1).count():
        step += 1
        following = edges.join(level.withColumnRenamed("node", "source"), ["site", "source"]).select("site", F.col("target").alias("node")).distinct()
        level = cut(following.join(reached, ["site", "node"], "left_anti").withColumn("depth", F.lit(step).cast("long")))
        reached = reached.unionByName(level)
    return reached


class Replay:
    """One site's crawl over the pages known so far.

    ``known`` maps a normalised address to (status, final address, links); an
    address that is not yet known stops the run and is asked for.
    """

    def __init__(self, start: str, robots: tuple[int | None, str | None], sitemap: list[str], budget: int, ahead: int | None = None) -> None:
        self.ahead = 2 * budget if ahead is None else ahead
        self.start = urls.normalized(start) or start
        self.host, self.rules, self.sitemap, self.budget = urls.host_of(self.start), rules(*robots), sitemap, budget

    def run(self, known: dict[str, tuple[int, str, list[str]] | None]) -> tuple[list[str], list[str]]:
        """(kept addresses in order, addresses that must be known to go on)."""
        first: deque[str] = deque()
        later: deque[str] = deque()
        asked: set[str] = set()
        finals: set[str] = set()
        probes: set[str] = set()
        kept: list[str] = []

        def put(url: str | None, probe: bool = False, front: bool = False) -> None:
            if not url or url in asked or urls.host_of(url) != self.host:
                return
            asked.add(url)
            if probe:
                probes.add(url)
                later.append(url)
            elif front:
                first.appendleft(url)
            else:
                first.append(url)

        def follow(links: list[str]) -> None:
            for link in links:
                path = link.split("://", 1)[-1].partition("/")[2].split("?")[0].lower()
                put(urls.normalized(link), front=any(h in path for h in LOCAL_HINTS))

        put(self.start)
        while (first or later) and len(kept) < self.budget:
            url = first.popleft() if first else later.popleft()
            if not may_fetch(self.rules, url):
                continue
            if url not in known:
                ahead = [u for u in [url, *first, *later] if u not in known]
                return kept, ahead[: max(1, self.ahead)]
            page = known[url]
            status, final, links = page if page else (0, url, [])
            key = urls.normalized(final) or final
            if key in finals or (url in probes and status >= 400):
                continue
            finals.add(key)
            kept.append(url)
            if len(kept) == 1:
                follow(links)
                for listed in self.sitemap:
                    put(urls.normalized(listed))
                origin = "://".join((final.partition("://")[0], final.partition("://")[2].partition("/")[0]))
                for path in CONVENTIONAL_PATHS:
                    put(urls.normalized(origin + path), probe=True)
            elif status == 200:
                follow(links)
        return kept, []


def _rounds(budget: int, most: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        about = None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.start_url is not None:
                    about = row
                else:
                    known.setdefault(row.url, (int(row.status), row.final_url, list(row.links)) if row.found else None)
        if about is None:
            return
        listed = list(about.sitemap) if about.sitemap is not None else []
        status = None if pd.isna(about.status) else int(about.status)
        kept, ahead = Replay(about.start_url, (status, about.body), listed, budget, most).run(known)
        rows = [(key[0], k, u, False) for k, u in enumerate(kept)] + [(key[0], k, u, True) for k, u in enumerate(ahead)]
        yield pd.DataFrame(rows, columns=["site", "idx", "url", "wanted"])

    return run


def replay(archive: DataFrame, sites: DataFrame, budget: int = MAX_PAGES) -> DataFrame:
    """(site, idx, url): the addresses a crawl of each site keeps, in order, answered from the archive.

    Runs in rounds over all sites at once: a round replays as far as the pages
    fetched from the archive reach and asks for those next in its queues, which a
    join then provides. A site's task holds at most the pages its budget asks for,
    never the site. An address that the archive lacks fails like one that cannot be reached.
    """
    pages = archive.withColumn("page", page_url())
    key = urls.normalize(F.col("url"))
    stored = pages.select("page_id", "site", key.alias("url"), F.col("page").alias("final_url"), F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("crawl_idx", F.lit(2**31 - 1)).alias("o"))
    stored = stored.groupBy("site", "url").agg(F.min_by(F.struct("page_id", "final_url", "status"), F.struct("o", "page_id")).alias("p")).select("site", "url", "p.*")
    stored = cut(stored)

    def answer(wanted: DataFrame) -> DataFrame:
        met = cut(wanted.join(stored.drop("final_url", "status"), ["site", "url"]))
        return pages.drop("url").join(met.select("page_id", "url"), "page_id")

    return replay_rounds(answer, sites, budget)


def replay_rounds(answer: Callable[[DataFrame], DataFrame], sites: DataFrame, budget: int, ahead: int | None = None) -> DataFrame:
    """(site, idx, url) of the crawl of each site, with ``answer`` giving the pages (page_id, site, url, final_url, status, html) for the wanted (site, url).

    Rounds go on until no site wants anything: every round makes its wanted addresses
    known, and a site has as many of these as its pages name, so they end.
    """
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    about = sites.select(
        "site", "start_url", F.lit("").alias("url"), F.lit(False).alias("found"), F.col("robots_status").alias("status"), F.lit("").alias("final_url"),
        empty.alias("links"), F.col("robots_body").alias("body"), F.coalesce("sitemap_urls", empty).alias("sitemap"),
    )
    provided = None
    while True:
        state = about if provided is None else about.unionByName(provided)
        out = cut(state.groupBy("site").applyInPandas(_rounds(budget, ahead), "site string, idx int, url string, wanted boolean"))
        wanted = cut(out.filter("wanted").select("site", "url").distinct())
        if not wanted.limit(1).count():
            return out.filter(~F.col("wanted")).select("site", "idx", "url")
        got = answer(wanted).withColumn("page", page_url()).withColumn("status", F.coalesce("status", F.lit(0)))
        read = features(got, "site string, url string, page string, status int", every=True).dropDuplicates(["site", "url"]).select("site", "url", F.col("page").alias("final_url"), "status", "targets", F.lit(True).alias("found"))
        new = wanted.join(read, ["site", "url"], "left").select(
            "site", none.alias("start_url"), "url", F.coalesce("found", F.lit(False)).alias("found"), "status", "final_url", F.coalesce("targets", empty).alias("links"), none.alias("body"), empty.alias("sitemap"),
        )
        new = cut(new)
        provided = new if provided is None else provided.unionByName(new)
