"""Page rules over a stream of archive rows.

The rules of single pages need no other page, so they run on a stream as they do
on a table; groups of duplicates and site rules stay with the batch audit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audit import ABOUT, fact_columns, internal_links, page_findings
from ..operators.pages import crawled, parsed


def stream_findings(stream: DataFrame) -> DataFrame:
    """Findings of single pages for every page that arrives with html (a micro-batch keeps no state)."""
    pages = crawled(parsed(stream)).filter(F.col("admission") == "audited").select(*ABOUT, *fact_columns())
    return page_findings(pages.withColumn("n_internal", internal_links(F.col("out"), F.col("page"))).drop("out"))
