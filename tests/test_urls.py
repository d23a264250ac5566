import pytest
from pyspark.sql import functions as F

from siteloom.functions import urls

NORMAL = [
    ("HTTP://WWW.A.com:80/p//?q=1#f", "http://www.a.com/p?q=1"),
    ("https://a.com", "https://a.com/"),
    ("https://a.com:443/x/", "https://a.com/x"),
    ("https://a.com:8443/x;v=1", "https://a.com:8443/x"),
    (" https://a.com/X?B=2&a=1 ", "https://a.com/X?B=2&a=1"),
    ("//a.com/x", "https://a.com/x"),
]


@pytest.mark.parametrize(("url", "expected"), NORMAL)
def test_normalized(url, expected):
    assert urls.normalized(url) == expected


def test_columns_agree_with_twins(spark):
    rows = spark.createDataFrame([(u,) for u, _ in NORMAL] + [(None,)], "u string").select("u", urls.normalize(F.col("u")).alias("n")).collect()
    assert {r.u: r.n for r in rows} == dict(NORMAL) | {None: None}


def test_host_and_site(spark):
    row = spark.sql("SELECT 'https://www.A.com:8443/' AS a, 'http://a.com:8443/x' AS b, 'https://m.a.com/' AS c").select(
        urls.host(F.col("a")).alias("h"), urls.same_site(F.col("a"), F.col("b")).alias("same"), urls.same_site(F.col("a"), F.col("c")).alias("other")
    ).first()
    assert (row.h, row.same, row.other) == ("a.com:8443", True, False)


@pytest.mark.parametrize(("href", "expected"), [("", False), ("#x", False), ("mailto:a@b.c", False), ("TEL:1", False), ("/a.PDF", False), ("/a.pdf?x=1", False), ("/a", True), ("https://b.com/x.html", True)])
def test_crawlable(spark, href, expected):
    assert urls.may_lead_to_page(href) is expected
    assert spark.createDataFrame([(href,)], "h string").select(urls.crawlable(F.col("h")).alias("c")).first().c is expected


def test_page_links_resolve_and_stay_distinct():
    assert urls.page_links(["/b", "b", "?q=1", "../c", "/b#x", "ftp://x/y", "https://www.x.com"], "https://a.com/d/e") == [
        "https://a.com/b", "https://a.com/d/b", "https://a.com/d/e?q=1", "https://a.com/c", "https://www.x.com/",
    ]
