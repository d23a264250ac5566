"""Problem 4: lines that stand under a large share of one source's addresses.

1. Every task keeps a mergeable heavy-hitter summary per source: for each line
   the number of distinct addresses it was seen under, less an allowance ``t``
   that the task may forget (lines seen at most ``t`` times are dropped, which is
   what bounds the summary). Summaries merge by adding counts and allowances.
2. A line whose merged count plus the merged allowance reaches the threshold of
   its source is a candidate; none that is excessive can be missing. A source
   whose allowance itself reaches its threshold keeps all its lines as
   candidates (this happens only if its addresses are strewn over many tasks).
3. A second pass counts the candidates exactly. The confirmed lines are
   broadcast while their number is within a checked bound, else joined.

Defined results: a null text has no lines but its address counts for the share;
a null address counts for nothing; a null site is a source of its own; an empty
table gives an empty result. Rows repeated under a new id are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, python_ready

MIN_ADDRESSES = 5
MIN_SHARE = 0.2
#: Part of a task's own share of a source that its summary may forget.
FORGET = 0.25
#: Lines that may be broadcast (two 64-bit keys each: about 10 MB in memory).
BROADCAST_ROWS = 200_000
#: Pairs of line and address that a task gathers before it folds them together.
FOLD_ROWS = 1_000_000
WHITE = r"[\s\p{Z}\x{85}\x{200B}\x{2060}\x{FEFF}]+"


def line_key(line: Column) -> Column:
    """A line without what does not make lines differ: case, white space, digits of numbers."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), WHITE, " ")), r"\p{Nd}+", "0")


def passage_lines(passages: DataFrame) -> DataFrame:
    """One row per non-blank line with the keys of its source, itself and its address."""
    return (
        passages.select("passage_id", "site", "url", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .select("passage_id", F.col("line_no").cast("long"), "site", "url", line_key(F.col("line")).alias("key"))
        .filter(F.col("key") != "")
        .select("passage_id", "line_no", source_key().alias("source"), F.xxhash64("key").alias("line"), F.when(F.col("url").isNotNull(), F.xxhash64("url")).alias("address"))
    )


def source_key() -> Column:
    return F.when(F.col("site").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("site"))


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    """Distinct rows (source, line, address)."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))] if len(rows) else rows


def _summary(rows: np.ndarray, share: float) -> pd.DataFrame:
    """Counts by source and line, less what may be forgotten; line null: the allowance."""
    pairs = np.unique(rows[:, [0, 2]], axis=0)
    sources, n = np.unique(pairs[:, 0], return_counts=True)
    allowed = np.floor(share * FORGET * n).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
    count = np.diff(np.append(first, len(rows)))
    left = count - allowed[np.searchsorted(sources, rows[first, 0])]
    kept = left > 0
    lines = pd.DataFrame({"source": rows[first, 0][kept], "line": pd.array(rows[first, 1][kept], dtype="Int64"), "n": left[kept]})
    forgot = allowed > 0
    return pd.concat([lines, pd.DataFrame({"source": sources[forgot], "line": pd.array([pd.NA] * int(forgot.sum()), dtype="Int64"), "n": allowed[forgot]})])


def _summaries(share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for pdf in batches:
            parts.append(pdf.to_numpy(dtype=np.int64))
            held += len(pdf)
            if held > FOLD_ROWS:
                parts = [_fold(parts)]
                if len(parts[0]) > FOLD_ROWS:
                    yield _summary(parts[0], share)
                    parts = []
                held = sum(map(len, parts))
        if parts and held:
            yield _summary(_fold(parts), share)

    return run


def excessive_occurrences(passages: DataFrame, min_addresses: int = MIN_ADDRESSES, min_share: float = MIN_SHARE) -> DataFrame:
    """(passage_id, line_no) of every occurrence of an excessive line."""
    spark = passages.sparkSession
    lines = passage_lines(passages)
    merged = lines.filter(F.col("address").isNotNull()).select("source", "line", "address").mapInPandas(_summaries(min_share), "source long, line long, n long").groupBy("source", "line").agg(F.sum("n").alias("n"))
    # Rows of three numbers come in large batches; the summaries are made here, so fat rows elsewhere are not affected.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    merged = cut(merged)
    python_ready(spark)
    need = (
        passages.filter(F.col("url").isNotNull())
        .select(source_key().alias("source"), F.xxhash64("url").alias("address"))
        .distinct()
        .groupBy("source")
        .agg(F.greatest(F.lit(min_addresses), F.ceil(F.round(F.count("*") * F.lit(min_share), 6))).alias("need"))
    )
    forgot = merged.filter(F.col("line").isNull()).select("source", F.col("n").alias("forgot"))
    need = cut(need.join(forgot, "source", "left").select("source", "need", F.coalesce("forgot", F.lit(0)).alias("forgot")))
    candidates = merged.filter(F.col("line").isNotNull()).join(need, "source").filter(F.col("n") + F.col("forgot") >= F.col("need")).select("source", "line")
    candidates = cut(candidates)
    loose = need.filter(F.col("forgot") >= F.col("need")).select("source")
    by_line = lines.join(_small(candidates), ["source", "line"], "left_semi")
    if loose.limit(1).count():
        by_line = by_line.join(loose, "source", "left_anti").unionByName(lines.join(loose, "source", "left_semi"))
    seen = cut(by_line)
    exact = seen.filter(F.col("address").isNotNull()).select("source", "line", "address").distinct().groupBy("source", "line").agg(F.count("*").alias("n"))
    confirmed = cut(exact.join(need, "source").filter(F.col("n") >= F.col("need")).select("source", "line"))
    return seen.join(_small(confirmed), ["source", "line"], "left_semi").select("passage_id", "line_no")


def _small(keys: DataFrame) -> DataFrame:
    """Broadcast a set of line keys while its size is within the bound."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def without_excessive_lines(passages: DataFrame, **parameters: float) -> DataFrame:
    """(passage_id, n_removed, text): each passage that has a text, without its excessive lines.

    A passage of excessive lines only gets an empty text.
    """
    gone = excessive_occurrences(passages, **parameters).groupBy("passage_id").agg(F.collect_set(F.col("line_no").cast("int")).alias("gone"))
    lines = F.split("text", "\n", -1)
    none = F.array().cast("array<int>")
    return (
        passages.filter(F.col("text").isNotNull())
        .select("passage_id", "text")
        .join(gone, "passage_id", "left")
        .withColumn("gone", F.coalesce("gone", none))
        .select("passage_id", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n").alias("text"))
    )
