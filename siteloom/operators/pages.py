"""Pages parsed once, with what every operator after the parser needs of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import features
from ..sources.archive import admission, page_url

#: Columns of a page that go through the parser with it.
CARRIED = "site string, url string, page string, status int, crawl_idx int, error string, admission string, x_robots string, n_hops int, from_citation boolean"


def parsed(archive: DataFrame) -> DataFrame:
    """One row for every archived page: its features (null where nothing was to be read) and ``CARRIED``.

    The only pass of the html through Python; nothing is joined back to a page
    afterwards, so repeated page_ids stay the rows they were.
    """
    read = (F.col("admission") == "audited") | (F.col("status") == 200)
    rows = archive.withColumn("page", page_url()).withColumn("admission", admission())
    rows = rows.select(
        "page_id", "site", "url", "page", "status", "crawl_idx", "error", "admission",
        F.lower(F.coalesce(F.try_element_at("headers", F.lit("x-robots-tag")), F.lit(""))).alias("x_robots"),
        F.coalesce(F.size("redirect_chain"), F.lit(0)).alias("n_hops"), F.coalesce("from_citation", F.lit(False)).alias("from_citation"), F.when(read, F.col("html")).alias("html"),
    )
    return features(rows, CARRIED, every=True)


def live(pages: DataFrame) -> DataFrame:
    """The parsed pages that answered with 200 and html, citations included."""
    return pages.filter((F.col("status") == 200) & F.col("text").isNotNull())


def crawled(pages: DataFrame) -> DataFrame:
    """The parsed pages of the crawls themselves."""
    return pages.filter(~F.col("from_citation"))
