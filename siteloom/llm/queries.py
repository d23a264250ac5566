"""Queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import addresses, chunks, encoding, leakage, main_content, mixing, repeated_lines, residue, sentences
from .base import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that had to be cut."""
    return p1_pieces(spark, sf_dir).filter("piece_no = 0").select("item_kind", "item_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized passages and page bodies."""
    return chunks.audit_pieces(table(spark, sf_dir, "passages"), table(spark, sf_dir, "crawl_archive"), table(spark, sf_dir, "size_limits"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_restored(spark, sf_dir).select("table_name", "row_id")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrongly decoded rows with what could be restored."""
    return encoding.repair_encoding(table(spark, sf_dir, "crawl_archive"), table(spark, sf_dir, "answer"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.same_places(table(spark, sf_dir, "nap_report"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.excessive_occurrences(table(spark, sf_dir, "passages"))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage without its excessive lines."""
    return repeated_lines.without_excessive_lines(table(spark, sf_dir, "passages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "crawl_archive")).select("page_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_content.surroundings(table(spark, sf_dir, "crawl_archive"), table(spark, sf_dir, "passages"))


def p6_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of every page."""
    return main_content.main_bodies(table(spark, sf_dir, "crawl_archive"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mix and how often each is used."""
    return mixing.mix_selection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached shares of every mix."""
    return mixing.mix_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_pieces_summary, p2_found, p2_restored, p3_found, p4_found, p4_clean, p5_found, p6_found, p6_bodies, p7_found, p8_mix, p8_shares, p9_found)
    return {f.__name__: f for f in found}


def p1_pieces_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and characters of each cut item, its overlaps counted once."""
    return (
        p1_pieces(spark, sf_dir)
        .groupBy("item_kind", "item_id")
        .agg(F.count("*").alias("n_pieces"), F.max("end_char").cast("long").alias("n_chars"), F.max(F.col("end_char") - F.col("start_char")).cast("long").alias("longest"))
    )


_KEY = (
    r"regexp_replace(trim(regexp_replace(lower(line), '[\s\p{Z}\x{85}\x{200B}\x{2060}\x{FEFF}]+', ' ', 'g')), '\p{Nd}+', '0', 'g')"
)
_EXCESSIVE = f"""
lines AS (
  SELECT passage_id, coalesce(site, '') AS site, url, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM passages),
keyed AS (SELECT passage_id, site, url, line, line_no, {_KEY} AS k FROM lines),
sites_ AS (SELECT coalesce(site, '') AS site, count(DISTINCT url) AS urls FROM passages GROUP BY 1),
excessive AS (
  SELECT keyed.site, k FROM keyed JOIN sites_ USING (site) WHERE k <> ''
  GROUP BY keyed.site, k, urls HAVING count(DISTINCT url) >= 5 AND count(DISTINCT url) >= 0.2 * urls)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
SELECT 'passage' AS item_kind, passage_id AS item_id FROM passages
WHERE length(text) > (SELECT max_chars FROM size_limits WHERE item_kind = 'passage')
UNION ALL
SELECT 'html', page_id FROM crawl_archive
WHERE length(html) > (SELECT max_chars FROM size_limits WHERE item_kind = 'html')""",
        "p4_found": f"""
WITH {_EXCESSIVE.strip()}
SELECT passage_id, CAST(line_no AS BIGINT) AS line_no FROM keyed JOIN excessive USING (site, k)""",
        "p4_clean": f"""
WITH {_EXCESSIVE.strip()},
marked AS (SELECT keyed.passage_id, line_no, line, excessive.k IS NOT NULL AS gone FROM keyed LEFT JOIN excessive USING (site, k))
SELECT passage_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text
FROM marked GROUP BY passage_id""",
    }
