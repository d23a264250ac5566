"""Passages and the answers found in them: BM25, vectors, rank fusion, abstention, verbatim quotes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.html import features
from ..functions.lexicon import (
    ABSTAIN_LEXICAL,
    ABSTAIN_NO_TERMS,
    ABSTAIN_WEAK,
    BLOCK_CHARS,
    BM25_B,
    BM25_K1,
    FUSED_K,
    HOUR_BOOST,
    HOUR_TERMS,
    LEXICAL_K,
    LISTED_URLS,
    NULL_PICK_COVERAGE,
    NUMBER_THEN_WORD,
    PLACE_BOOST,
    PLACE_TERMS,
    RRF_CONSTANT,
    SEARCH_K,
    STOPWORDS,
    VECTOR_K,
)
from ..functions.text import chunks, has_time, is_chrome, query_terms, squeezed, tokens
from .pages import crawled, live, parsed


def passages(archive: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(site, passage_idx, id, url, text) from the crawled pages with status 200.

    Blocks without chrome are chunked; a page without such blocks gives the chunks
    of its content text. Numbering runs over a site in page order: the counts of
    pages are added up, so that no task holds more than a site's page counts.
    """
    pages = live(crawled(parsed(archive) if pages is None else pages))
    good = F.filter("blocks", lambda b: ~is_chrome(b))
    from_blocks = F.filter(F.flatten(F.transform("good", lambda b: chunks(b))), lambda c: ~is_chrome(c) & (F.length(c) >= BLOCK_CHARS))
    from_root = F.filter(chunks(F.col("root_text")), lambda c: ~is_chrome(c))
    order = F.struct(F.coalesce("crawl_idx", F.lit(2**31 - 1)), "page_id").alias("page_idx")
    distinct = F.size("good") > 0
    texts = pages.select("site", "page", order, good.alias("good"), "root_text").select("site", "page", "page_idx", F.when(distinct, from_blocks).otherwise(from_root).alias("texts"), distinct.alias("distinct"))
    rows = texts.select("site", "page_idx", "page", "distinct", F.posexplode("texts").alias("i", "text"))
    first = W.partitionBy("site", "page_idx", F.lower("text")).orderBy("i")
    kept = rows.withColumn("rn", F.row_number().over(first)).filter((F.col("rn") == 1) | ~F.col("distinct")).persist(StorageLevel.MEMORY_AND_DISK)
    per_page = kept.groupBy("site", "page_idx").agg(F.count("*").alias("n"))
    base = per_page.select("site", "page_idx", (F.sum("n").over(W.partitionBy("site").orderBy("page_idx")) - F.col("n")).alias("base"))
    idx = F.col("base") + F.row_number().over(W.partitionBy("site", "page_idx").orderBy("i")) - 1
    numbered = kept.join(base, ["site", "page_idx"]).select("site", idx.cast("int").alias("passage_idx"), F.col("page").alias("url"), "text")
    return numbered.select("site", "passage_idx", F.concat(F.lit("p-"), "passage_idx").alias("id"), "url", "text")


def idf(df: Column, n: Column) -> Column:
    half = F.lit(0.5)
    return F.log((n - df + half) / (df + half) + F.lit(1.0))


def term_statistics(texts: DataFrame, group: list[str], key: str) -> DataFrame:
    """(group, term, df) of texts (group, key, text): in how many texts each term stands."""
    return texts.select(*group, key, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy(*group, "term").agg(F.count("*").alias("df"))


def bm25(texts: DataFrame, questions: DataFrame, k: int = LEXICAL_K, group: str = "site", key: str = "passage_id") -> DataFrame:
    """(group, qid, key, score, coverage, rank): the best texts for each question of their group.

    Only terms that some question of the group has are joined; statistics are
    taken over all texts of the group. Texts without a matching term score their
    boosts alone, so only the longest of each kind (with a time or not, with a
    number or not) can rank; texts and questions are never paired as a whole. Ties: more coverage, longer text, lower key. A
    question of opening hours keeps only texts with a time of day. Null texts are
    empty texts.
    """
    rows = texts.select(group, key, F.coalesce("text", F.lit("")).alias("text"))
    asked = questions.select(group, "qid", query_terms(F.col("query")).alias("terms")).filter(F.size("terms") > 0)
    hour = F.arrays_overlap("terms", F.array(*map(F.lit, HOUR_TERMS)))
    place = F.arrays_overlap("terms", F.array(*map(F.lit, PLACE_TERMS)))
    asked = asked.select(group, "qid", "terms", F.size(F.array_distinct("terms")).alias("n_terms"), hour.alias("hour"), place.alias("place"))
    sized = rows.select(group, key, F.size(tokens(F.col("text"))).alias("dl"), F.length("text").alias("chars"), has_time(F.col("text")).alias("timed"), F.col("text").rlike("(?U)" + NUMBER_THEN_WORD).alias("placed"))
    whole = sized.groupBy(group).agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))
    asked_terms = asked.select(group, "qid", F.explode("terms").alias("term")).groupBy(group, "qid", "term").agg(F.count("*").alias("times"))
    used = asked_terms.select(group, "term").distinct()
    tf = rows.select(group, key, F.explode(tokens(F.col("text"))).alias("term")).join(used, [group, "term"], "left_semi").groupBy(group, key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(group, "term").agg(F.count("*").alias("df"))
    k1, b, one = F.lit(BM25_K1), F.lit(BM25_B), F.lit(1.0)
    lengths = F.greatest(F.col("dl"), F.lit(1)).cast("double")
    part = idf(F.col("df"), F.col("n").cast("double")) * (F.col("tf") * (k1 + one)) / (F.col("tf") + k1 * (one - b + b * lengths / F.col("avgdl")))
    scores = (
        tf.join(df, [group, "term"])
        .join(whole, group)
        .join(sized.select(group, key, "dl"), [group, key])
        .select(group, key, "term", part.alias("part"))
        .join(asked_terms, [group, "term"])
        .groupBy(group, "qid", key)
        .agg(F.sum(F.col("part") * F.col("times")).alias("bm25"), F.sum("times").alias("hits"))
    )
    traits = asked.drop("terms")
    longest = W.partitionBy(group, "timed", "placed").orderBy(F.desc("chars"), key)
    unmatched = sized.withColumn("n", F.row_number().over(longest)).filter(F.col("n") <= k).select(group, key).join(traits.select(group, "qid"), group)
    candidates = scores.select(group, "qid", key).unionByName(unmatched.select(group, "qid", key)).distinct()
    scored = candidates.join(traits, [group, "qid"]).join(sized, [group, key]).join(scores, [group, "qid", key], "left").filter(~F.col("hour") | F.col("timed"))
    boost = F.when(F.col("hour") & F.col("timed"), F.lit(HOUR_BOOST)).otherwise(F.lit(0.0)) + F.when(F.col("place") & F.col("placed"), F.lit(PLACE_BOOST)).otherwise(F.lit(0.0))
    total = F.round(F.coalesce("bm25", F.lit(0.0)) + boost, 9)
    coverage = F.coalesce("hits", F.lit(0)) / F.col("n_terms").cast("double")
    best = W.partitionBy(group, "qid").orderBy(F.desc("score"), F.desc("coverage"), F.desc("chars"), key)
    return scored.select(group, "qid", key, "chars", total.alias("score"), coverage.alias("coverage")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("chars")


def search(texts: DataFrame, questions: DataFrame, k: int = SEARCH_K) -> DataFrame:
    """(site, qid, passage_id, rank, url, text): the few best passages for each question, for looking at."""
    return bm25(texts, questions, k).join(texts.select("site", "passage_id", "url", "text"), ["site", "passage_id"]).select("site", "qid", "passage_id", "rank", "url", "text")


def indexed_urls(texts: DataFrame, k: int = LISTED_URLS) -> DataFrame:
    """(site, n, url): the first addresses of each site that has passages, in order."""
    distinct = texts.filter(F.col("url").isNotNull()).select("site", "url").distinct()
    return distinct.withColumn("n", F.row_number().over(W.partitionBy("site").orderBy("url"))).filter(F.col("n") <= k).select("site", "n", "url")


#: Texts that are embedded at a time, and characters of each that a model is given (fixed values).
EMBED_BATCH, EMBED_CHARS = 100, 2000
#: Query vectors that are compared with all vectors at a time.
QUERY_BLOCK = 2048


def _nearest(ids: np.ndarray, matrix: np.ndarray, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = np.empty((len(ids), 0))
        names = np.empty((len(ids), 0), dtype=np.int64)
        for pdf in batches:
            vectors = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["embedding"]])
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            near = np.concatenate([near, matrix @ vectors.T], axis=1)
            names = np.concatenate([names, np.broadcast_to(pdf["vec_id"].to_numpy(), (len(ids), len(pdf)))], axis=1)
            if near.shape[1] > k:
                # Ties at the edge go to the lower vec_id, as in the final ranking.
                keep = np.lexsort((names, -np.round(near, 9)), axis=1)[:, :k]
                near, names = np.take_along_axis(near, keep, 1), np.take_along_axis(names, keep, 1)
        if near.shape[1]:
            yield pd.DataFrame({"query_id": np.repeat(ids, near.shape[1]), "vec_id": names.ravel(), "cosine": near.ravel()})

    return run


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = VECTOR_K) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the ``k`` vectors of the greatest cosine for each query vector.

    Exact: blocks of queries pass over all vectors, each task keeps one running list of
    its best ``k`` for each query. A block has a fixed size, so what is sent to the tasks is bounded.
    Null vectors are left out; ties go to the lower vec_id.
    """
    spark = vectors.sparkSession
    clean = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("vec_id", "embedding")
    wanted = queries.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("vec_id", "embedding").orderBy("vec_id").toLocalIterator()
    out, block = None, []

    def add(block: list) -> DataFrame:
        matrix = np.array([r.embedding for r in block], dtype=np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        return clean.mapInPandas(_nearest(np.array([r.vec_id for r in block]), matrix, k), "query_id long, vec_id long, cosine double")

    for row in wanted:
        block.append(row)
        if len(block) == QUERY_BLOCK:
            out, block = (add(block) if out is None else out.unionByName(add(block))), []
    if block:
        out = add(block) if out is None else out.unionByName(add(block))
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, cosine double")
    best = W.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def fused(lexical: DataFrame, vector: DataFrame, k: int = FUSED_K, by: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (by..., id, rank, score, coverage) lists; what a vector list found has its score and no coverage.

    Ties go to what the lexical list names first, then to the vector list's order.
    """
    by = by or []
    a = lexical.select(*by, "id", "rank", "score", "coverage", F.lit(False).alias("vector"))
    b = vector.select(*by, "id", "rank", "score", F.lit(0.0).alias("coverage"), F.lit(True).alias("vector"))
    share = F.sum(F.lit(1.0) / (F.lit(RRF_CONSTANT) + F.col("rank")))
    first = F.min(F.struct("vector", "rank"))
    last = F.max_by(F.struct("score", "coverage", "vector"), F.col("vector"))
    merged = a.unionByName(b).groupBy(*by, "id").agg(share.alias("fusion"), first.alias("first"), last.alias("x"))
    order = W.partitionBy(*by).orderBy(F.desc("fusion"), "first") if by else W.orderBy(F.desc("fusion"), "first")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*by, "id", "rank", "fusion", "x.score", "x.coverage", "x.vector")


def abstains(query: Column, text: Column, score: Column, coverage: Column, vector: Column) -> Column:
    """Whether the best text is no answer; a null text means that nothing was found."""
    kept = F.filter(tokens(query), lambda t: ~t.isin(*STOPWORDS) & (F.length(t) > 1))
    hour = F.arrays_overlap(kept, F.array(*map(F.lit, HOUR_TERMS)))
    return (
        F.when(text.isNull() | is_chrome(F.coalesce(text, F.lit(""))), True)
        .when(hour & ~has_time(text), True)
        .when(F.size(kept) == 0, score < ABSTAIN_NO_TERMS)
        .when((coverage <= 0) & (score < ABSTAIN_LEXICAL) & ~vector, True)
        .otherwise((coverage == 0) & (score < ABSTAIN_WEAK))
    )


def picked(ranked: DataFrame, picks: DataFrame | None = None) -> DataFrame:
    """The rank each question is answered from: the first, or what an outside chooser picked (qid, pick).

    A null pick abstains only where the first covers little of the question; a pick
    out of range keeps the first.
    """
    top = ranked.groupBy("qid").agg(F.count("*").alias("n"), F.min_by("coverage", "rank").alias("coverage"))
    if picks is None:
        return top.select("qid", F.lit(1).alias("rank"))
    choice = top.join(picks.withColumn("asked", F.lit(True)), "qid", "left")
    null_answer = F.col("asked") & F.col("pick").isNull() & (F.col("coverage") < NULL_PICK_COVERAGE)
    rank = F.when(F.col("pick").between(0, F.col("n") - 1), F.col("pick") + 1).otherwise(1)
    return choice.filter(~F.coalesce(null_answer, F.lit(False))).select("qid", rank.alias("rank"))


def verbatim(excerpt: Column, page_text: Column) -> Column:
    """Whether the page's visible text holds the excerpt, white space aside."""
    return F.coalesce((squeezed(excerpt) != "") & F.contains(squeezed(page_text), squeezed(excerpt)), F.lit(False))


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], keys: list[str]) -> DataFrame:
    """(keys..., embedding) of texts (keys..., text) by a function that embeds a list of texts; what it fails on has no vector."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), EMBED_BATCH):
                part = pdf.iloc[at : at + EMBED_BATCH]
                try:
                    found = [list(map(float, v)) for v in embed(part["text"].tolist())]
                except Exception:  # noqa: BLE001 - any failure of a model leaves the words' list alone
                    continue
                yield part[keys].assign(embedding=found)

    return texts.select(*keys, F.substring(F.coalesce("text", F.lit("")), 1, EMBED_CHARS).alias("text")).mapInPandas(run, f"{schema}, embedding array<double>")


def nearest_of_site(vectors: DataFrame, questions: DataFrame, k: int = VECTOR_K) -> DataFrame:
    """(site, qid, id, rank, score): the passages of a site whose vectors are nearest to each of its questions."""
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    a = questions.select("site", "qid", F.col("embedding").cast("array<double>").alias("q"))
    b = vectors.select("site", F.col("passage_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    dot = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    scored = b.join(a, "site").select("site", "qid", "id", (dot / F.greatest(norm(F.col("q")) * norm(F.col("v")), F.lit(1e-12))).alias("score"))
    best = W.partitionBy("site", "qid").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def answers(
    texts: DataFrame, pages: DataFrame, questions: DataFrame, picks: DataFrame | Callable[[DataFrame], DataFrame] | None = None, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None
) -> DataFrame:
    """(site, qid, query, url, excerpt): the verbatim answer to each question, or nulls.

    ``texts``: (site, passage_id, url, text); ``pages``: (site, url, visible_text), or
    (page_id, site, url, html), of which only the pages of chosen texts are then parsed;
    ``questions``: (site, qid, query). With ``vectors`` (site, passage_id, embedding) and
    ``question_vectors`` (site, qid, embedding) the list of the nearest is fused with that
    of the words. ``picks``: see ``picked``; or a function from the ranked texts to picks.
    """
    lexical = bm25(texts, questions, LEXICAL_K).withColumnRenamed("passage_id", "id")
    if vectors is not None and question_vectors is not None:
        ranked = fused(lexical, nearest_of_site(vectors, question_vectors), by=["site", "qid"]).withColumnRenamed("id", "passage_id")
    else:
        ranked = lexical.filter(F.col("rank") <= FUSED_K).withColumnRenamed("id", "passage_id").withColumn("vector", F.lit(False))
    named = ranked.join(texts.select("site", "passage_id", "url", "text"), ["site", "passage_id"])
    top = named.filter("rank = 1").join(questions.select("qid", "query"), "qid")
    fit = top.filter(~abstains(F.col("query"), F.col("text"), F.col("score"), F.col("coverage"), F.col("vector"))).select("qid")
    if callable(picks):
        picks = picks(named.join(questions.select("qid", "query"), "qid").join(fit, "qid", "left_semi"))
    chosen = named.join(fit, "qid", "left_semi").join(picked(ranked, picks), ["qid", "rank"])
    if "html" in pages.columns:
        cited = chosen.select("site", "url").distinct()
        pages = features(pages.join(cited, ["site", "url"], "left_semi").withColumn("page", F.col("url")), "site string, url string").select("site", "url", F.col("text").alias("visible_text"))
    quoted = (
        chosen.join(pages.select("site", "url", "visible_text"), ["site", "url"])
        .filter(verbatim(F.col("text"), F.col("visible_text")))
        .groupBy("qid")
        .agg(F.min("url").alias("url"), F.min("text").alias("excerpt"))
    )
    return questions.select("site", "qid", "query").join(quoted, "qid", "left").select("site", "qid", "query", "url", "excerpt")
