"""Reading crawled pages and sites, and sorting pages by what an audit may do with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import ROBOTS_BLOCK_ERROR


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def page_url(df_url: str = "url", df_final: str = "final_url") -> Column:
    """The address a page was served from."""
    return F.coalesce(F.nullif(df_final, F.lit("")), F.col(df_url), F.lit(""))


def admission() -> Column:
    """What becomes of a page, the first case that holds: blocked, probe, failed, moved, unread, empty, audited."""
    status = F.coalesce("status", F.lit(0))
    kind = F.coalesce(F.nullif("content_type", F.lit("")), F.lit("html"))
    no_html = (F.coalesce("html", F.lit("")) == "") | ~F.contains(kind, F.lit("html"))
    probe = F.coalesce("from_probe", F.lit(False)) & ~F.coalesce("from_sitemap", F.lit(False))
    return (
        F.when(F.col("error") == ROBOTS_BLOCK_ERROR, "blocked")
        .when((status >= 400) & probe, "probe")
        .when(status >= 400, "failed")
        .when(status.between(300, 399), "moved")
        .when(no_html & (F.coalesce("error", F.lit("")) != ""), "unread")
        .when(no_html, "empty")
        .otherwise("audited")
    )


def crawl_pages(archive: DataFrame) -> DataFrame:
    """The pages of the crawls themselves, without those fetched as citations, with ``page`` and ``admission``."""
    return archive.filter(~F.coalesce("from_citation", F.lit(False))).withColumn("page", page_url()).withColumn("admission", admission())


def live_pages(archive: DataFrame) -> DataFrame:
    """Pages answered with 200 and html, citations included."""
    return archive.filter((F.col("status") == 200) & (F.coalesce("html", F.lit("")) != "")).withColumn("page", page_url())
