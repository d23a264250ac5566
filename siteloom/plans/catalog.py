"""The queries of the website audit over the archived tables, and their SQL.

The SQL says the same in another way (patterns over the raw html instead of a
parsed tree), so that agreement means something. Queries without SQL run code that
SQL cannot express; they are tested against hand-traced cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..functions.html import features
from ..functions.lexicon import OUTLINE_CHARS
from ..operators import audit, crawl, nap, retrieval
from ..session import dealt
from ..sources import robots
from ..sources.archive import admission, crawl_pages, page_url, table

long = "long"


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawl_archive")


def url_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archive(spark, sf_dir).select("page_id", urls.normalize(F.col("url")).alias("norm_url"), urls.host(F.col("url")).alias("host"), urls.is_http(F.col("url")).alias("is_http"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archive(spark, sf_dir).groupBy(urls.host(F.col("final_url")).alias("host")).agg(F.count("*").alias("n_pages"), F.count_distinct(urls.normalize(F.col("final_url"))).alias("n_urls"))


def page_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archive(spark, sf_dir).select("page_id", admission().alias("admission"))


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.link_edges(_archive(spark, sf_dir)).select("page_id", F.col("link_idx").cast(long), "target")


def local_hint_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.local_links(crawl.link_edges(_archive(spark, sf_dir).withColumn("html", F.concat("html", F.lit('<a href="/visit-us">v</a>'))))).select("page_id", "target")


def internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = features(_archive(spark, sf_dir).withColumn("page", page_url()), "page string")
    return pages.select("page_id", "page", F.filter("anchors", lambda a: a["has_href"]).alias("out")).select("page_id", audit.internal_links(F.col("out"), F.col("page")).cast(long).alias("n_internal"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(_archive(spark, sf_dir)).select("page_id", audit.word_count(F.col("text")).cast(long).alias("n_words"), F.md5(F.regexp_replace("text", r"(?U)\s+", "")).alias("text_md5"))


def page_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(_archive(spark, sf_dir)).select("page_id", "title", "lang", "charset")


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(_archive(spark, sf_dir)).select("page_id", F.posexplode("headings").alias("idx", "h")).select("page_id", F.col("idx").cast(long), F.col("h.level").cast(long).alias("level"), F.substring("h.text", 1, OUTLINE_CHARS).alias("text"))


def schema_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(_archive(spark, sf_dir)).select("page_id", F.col("n_json_ld").cast(long).alias("n_json_ld"), F.array_join("types", ",").alias("types"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(_archive(spark, sf_dir))


def audit_page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.page_findings(_audited(spark, sf_dir)).select("page_id", "metric", "severity")


def audit_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_findings(_audited(spark, sf_dir).persist()).select("site", "metric", "page", "evidence")


def audit_site_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.site_findings(_audited(spark, sf_dir).persist(), table(spark, sf_dir, "sites")).select("site", "page", "metric", "severity")


def audit_site_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.site_schema(_audited(spark, sf_dir))


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.findings(_archive(spark, sf_dir), table(spark, sf_dir, "sites"))


def audit_finding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_findings(spark, sf_dir).select("site", "page", "metric", "severity")


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summary(audit_findings(spark, sf_dir))


def robots_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sites").select("site", F.posexplode(robots.sitemap_hints(F.col("robots_body"))).alias("idx", "hint")).select("site", F.col("idx").cast(long), "hint")


def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "sites").select("site", "robots_status", "robots_body")
    return _archive(spark, sf_dir).select("page_id", "site", "url").join(sites, "site").select("page_id", robots.allowed("robots_status", "robots_body", "url").alias("allowed"))


_MAPS = (
    ("a.com", "https://a.com/sitemap.xml", '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>/m1.xml</loc></sitemap><sitemap><loc>https://a.com/m2.xml</loc></sitemap></sitemapindex>'),
    ("a.com", "https://a.com/m1.xml", "<urlset><url><loc>https://a.com/x/</loc></url><url><loc>https://b.com/y</loc></url><url><loc>https://www.a.com/z</loc></url></urlset>"),
    ("a.com", "https://a.com/m2.xml", "<urlset><url><loc>https://a.com/x</loc></url><url><loc>https://a.com/w</loc></url></urlset>"),
    ("c.com", "https://c.com/sitemap.xml", "<urlset><loc>https://c.com/bare</loc></urlset>"),
    ("d.com", "https://d.com/sitemap.xml", "<urlset><url><loc>https://d.com/broken"),
)
_HTML_CASES = (
    (1, "https://a.com/", '<html><head><title>Widgets - Acme</title><meta name="Description" content="d"><meta property="og:title" content="one"><meta property="og:title" content="two"><link rel="Shortcut Icon" href="/i.png"></head><body><h1>A</h1><h3>B</h3><img src="/p.png"><img src="/q.png" alt=""><a href="/c">Read more</a><a href="https://www.yelp.com/biz/a">y</a></body></html>'),
    (2, "http://a.com/b", '<html lang="en"><head><meta charset=""><meta name="viewport" content="width=1"><meta name="robots" content="NOINDEX"><link rel="canonical" href="https://a.com/b"></head><body><h1></h1><h1>x</h1><a href="/">Home</a><a href="https://maps.google.com/x">m</a><a href="https://www.yelp.com/biz/a">y</a></body></html>'),
    (3, "https://a.com/c", '<html lang="en"><head><title></title><script type="application/ld+json">{"@graph":[{"@type":["Dentist","Thing"]},{"@type":"FAQPage"}]}</script></head><body><h1>t</h1></body></html>'),
)


def _cases(spark: SparkSession) -> DataFrame:
    """Pages with markup that the archived pages never show."""
    rows = [(i, "a.com", u, u, 200, "text/html", h, None, None, [], False, False, False, i) for i, u, h in _HTML_CASES]
    schema = "page_id long, site string, url string, final_url string, status int, content_type string, html string, headers map<string,string>, error string, redirect_chain array<string>, from_sitemap boolean, from_probe boolean, from_citation boolean, crawl_idx int"
    return spark.createDataFrame(rows, schema)


def audit_rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.page_findings(audit.audited(_cases(spark))).select("page_id", "metric", "severity")


def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.citations(_archive(spark, sf_dir).select(*_cases(spark).columns).unionByName(_cases(spark).withColumn("page_id", F.col("page_id") + 10**12))).select("site", F.col("idx").cast(long), "target")


def sitemap_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = spark.createDataFrame(list(_MAPS), "site string, url string, xml string")
    seeds = maps.filter(F.col("url").endswith("/sitemap.xml")).select("site", "url", F.lit(0).alias("seed_idx"))
    return robots.sitemap_pages(seeds, robots.sitemap_edges(maps), limit=40).select("site", F.col("idx").cast(long), "target")


def link_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses that links within a site lead to from its start."""
    links = features(_archive(spark, sf_dir).withColumn("page", page_url()), "page string, site string")
    edges = links.select("site", urls.normalize(F.col("page")).alias("source"), F.explode("targets").alias("target")).filter(urls.host(F.col("target")) == F.col("site")).distinct()
    starts = table(spark, sf_dir, "sites").filter("start_url IS NOT NULL").select("site", urls.normalize(F.col("start_url")).alias("node"))
    return crawl.reachable(edges, starts).select("site", "node")


def crawl_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.replay(_archive(spark, sf_dir), table(spark, sf_dir, "sites"))


def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "passages").select("passage_id", F.explode(tx.phone_matches(F.col("text"))).alias("raw")).select("passage_id", F.trim("raw").alias("raw"), tx.norm_phone(F.col("raw")).alias("norm"))


def nap_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "nap_report").select("field", F.explode(F.arrays_zip(F.col("values").alias("v"), F.col("value_ids").alias("i"))).alias("e"))
    return values.select(F.col("e.i").alias("value_id"), "field", tx.norm_value(F.col("field"), F.col("e.v")).alias("norm"))


def name_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("raw")).unionByName(table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(", Inc.")).alias("raw"))).distinct()
    return names.select("raw", tx.norm_name(F.col("raw")).alias("norm"))


def nap_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "nap_report").select("report_id", F.size("pages_compared").alias("p"), F.size("values").alias("v"), F.size("normalized_values").alias("n"), F.coalesce("sources", F.array().cast("array<string>")).alias("s"))
    r = r.select("report_id", *(F.greatest(F.col(c), F.lit(0)).alias(c) for c in "pvn"), "s").withColumn("verdict", nap.verdict(F.col("p"), F.col("n"), F.col("v"), F.col("n")))
    return r.select("report_id", "verdict", nap.confidence(F.col("p"), F.col("n"), F.col("s"), F.col("verdict") == "consistent_formatting_only").alias("confidence"))


def nap_phone_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison over the phones that patterns find in the passages."""
    found = table(spark, sf_dir, "passages").filter("url IS NOT NULL").select("site", "url", "passage_id", F.posexplode(tx.phone_matches(F.col("text"))).alias("value_idx", "value"))
    values = found.select("site", F.col("passage_id").alias("page_idx"), F.col("url").alias("page"), F.lit("phone").alias("field"), "value_idx", F.trim("value").alias("value"), F.array(F.lit("regex")).alias("sources"))
    return nap.compare(values).filter("field = 'phone'").select(
        "site", F.size("pages_compared").cast(long).alias("n_pages"), F.size("values").cast(long).alias("n_values"), F.size("normalized_values").cast(long).alias("n_norm"), "verdict", "confidence"
    )


def nap_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the address patterns find in the stored address values."""
    rows = table(spark, sf_dir, "nap_report").filter("field = 'full_address'").select(F.explode(F.arrays_zip(F.col("values").alias("v"), F.col("value_ids").alias("i"))).alias("e"))
    return rows.select(F.col("e.i").alias("value_id"), F.explode(nap.regex_values(F.col("e.v"))).alias("x")).filter("x.field <> 'phone'").select("value_id", "x.field", "x.value")


def nap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nap.report(_archive(spark, sf_dir), table(spark, sf_dir, "sites"))


def nap_name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that mention the first name of their site's home page."""
    archive = _archive(spark, sf_dir)
    return nap.spread_name(nap.cleaned(nap.page_values(archive)), archive).filter(F.array_contains("sources", "page_mention")).select("page_id", "value")


def passages_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.passages(_archive(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(tx.chunks(F.col("text"))).alias("i", "chunk")).select("doc_id", F.col("i").cast(long), "chunk")


def passage_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "passages").select("passage_id", tx.chunks(F.col("text")).alias("c"))
    return rows.select("passage_id", F.size("c").cast(long).alias("n"), F.md5(F.array_join("c", "|")).alias("chunks_md5")).filter("n > 0")


def chrome_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "passages").filter("text IS NOT NULL").select("passage_id", tx.is_chrome(F.col("text")).alias("is_chrome"))


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    stats = retrieval.term_statistics(docs.withColumn("g", F.lit(1)), ["g"], "doc_id")
    n = table(spark, sf_dir, "documents").count()
    return stats.select("term", "df", F.round(retrieval.idf(F.col("df").cast("double"), F.lit(float(n))), 6).alias("idf"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct question that was asked of a site."""
    return table(spark, sf_dir, "answer").filter("query IS NOT NULL AND site IS NOT NULL").select("site", "query").distinct().withColumn("qid", F.concat_ws("|", "site", "query"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.bm25(table(spark, sf_dir, "passages"), _questions(spark, sf_dir))
    return best.select("qid", "passage_id", F.round("score", 5).alias("score"), F.round("coverage", 6).alias("coverage"), F.col("rank").cast(long))


def search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.search(table(spark, sf_dir, "passages"), _questions(spark, sf_dir))
    return found.select("qid", "passage_id", F.col("rank").cast(long), "url")


def indexed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.indexed_urls(table(spark, sf_dir, "passages")).select("site", F.col("n").cast(long), "url")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieval.nearest_vectors(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all vectors for every vector whose id 50 divides."""
    return _vectors(spark, sf_dir).select("query_id", "vec_id", F.round("cosine", 4).alias("cosine"), F.col("rank").cast(long))


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words' and the vectors' lists fused for every vector whose id 50 divides; vector ids are read as document ids.

    The words asked for are those of the path of the document of that id.
    """
    whole = table(spark, sf_dir, "documents")
    docs = dealt(whole.select("doc_id", "text")).withColumn("site", F.lit("all")).select("site", F.col("doc_id").alias("passage_id"), "text")
    wanted = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("doc_id"))
    asked = whole.filter("path IS NOT NULL").join(wanted, "doc_id", "left_semi").select(F.lit("all").alias("site"), F.col("doc_id").cast("string").alias("qid"), F.col("path").alias("query"))
    lexical = retrieval.bm25(docs, asked).select("qid", F.col("passage_id").alias("id"), "rank", "score", "coverage")
    vector = _vectors(spark, sf_dir).select(F.col("query_id").cast("string").alias("qid"), F.col("vec_id").alias("id"), "rank", F.col("cosine").alias("score"))
    return retrieval.fused(lexical, vector, by=["qid"]).select("qid", "id", F.col("rank").cast(long), F.round("fusion", 9).alias("fusion"), "vector")


_ABSTAIN = (
    (1, "opening hours", None, 0.0, 0.0, False), (2, "opening hours", "We bake bread every day of the week here", 9.0, 1.0, False), (3, "opening hours", "We open at 9 am", 9.0, 1.0, False),
    (4, "what is it", "some text of a page", 1.4, 0.0, False), (5, "what is it", "some text of a page", 1.5, 0.0, False), (6, "parking garage", "some text of a page", 1.9, 0.0, False),
    (7, "parking garage", "some text of a page", 2.5, 0.0, False), (8, "parking garage", "some text of a page", 0.3, 0.0, True), (9, "parking garage", "some text of a page", 0.4, 0.0, True),
    (10, "parking garage", "Home Menu Contact Visit Shop News", 5.0, 1.0, False),
)


def abstain_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(_ABSTAIN), "case_id long, query string, text string, score double, coverage double, vector boolean")
    return rows.select("case_id", retrieval.abstains(F.col("query"), F.col("text"), F.col("score"), F.col("coverage"), F.col("vector")).alias("abstains"))


def answers_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the page of each stored answer holds its excerpt."""
    asked = table(spark, sf_dir, "answer").filter("url IS NOT NULL").select("answer_id", "url", "excerpt")
    cited = asked.select(F.col("url").alias("page")).distinct()
    shown = features(_archive(spark, sf_dir).withColumn("page", page_url()).join(cited, "page", "left_semi"), "page string").select("page", "text")
    met = asked.join(shown, asked["url"] == shown["page"], "left")
    return met.groupBy("answer_id").agg(F.bool_or(retrieval.verbatim(F.col("excerpt"), F.col("text"))).alias("verbatim"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question answered from the stored passages."""
    pages = crawl_pages(_archive(spark, sf_dir)).select("page_id", "site", F.col("page").alias("url"), "html")
    return retrieval.answers(table(spark, sf_dir, "passages"), pages, _questions(spark, sf_dir))


_QUERIES = (
    url_normalized, site_pages, page_admission, link_edges, local_hint_links, internal_links, page_text, page_head, headings, schema_types, audit_page_rules, audit_duplicates, audit_site_rules,
    audit_site_schema, audit_findings, audit_finding_keys, audit_summary, audit_rule_cases, robots_hints, robots_allowed, citation_links, sitemap_closure, link_reachability, crawl_replay, phones, nap_normalized,
    name_norm, nap_judged, nap_phone_report, nap_places, nap_report, nap_name_mentions, passages_built, chunks, passage_chunks, chrome_flags, term_df, bm25_topk, search_top, indexed_urls, vector_topk, rank_fusion,
    abstain_cases, answers_verbatim, answers,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return SQL

