import pytest
from pyspark.sql import functions as F

from siteloom.functions import text as tx
from siteloom.operators import nap

VALUES = "site string, page_idx int, page string, field string, value_idx int, value string, sources array<string>"


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(("raw", "norm"), [("+1 (212) 555-0100", "2125550100"), ("0012125550100", "0012125550100"), ("x", "")])
def test_phone(spark, raw, norm):
    assert one(spark, tx.norm_phone, raw) == norm


@pytest.mark.parametrize(("raw", "norm"), [("The Acme® Widgets, Inc.", "acme widgets"), ("Acme Co Co", "acme co"), ("Miller's Delicatessen", "miller s delicatessen"), ("", "")])
def test_name(spark, raw, norm):
    assert one(spark, tx.norm_name, raw) == norm


@pytest.mark.parametrize(("raw", "norm"), [("205 East Houston Street", "205 e houston st"), ("1 N. Main St., Suite #4", "1 n main st ste 4")])
def test_address(spark, raw, norm):
    assert one(spark, tx.norm_address, raw) == norm


@pytest.mark.parametrize(
    ("pages", "distinct", "sources", "only", "expected"),
    [(0, 0, [], False, 0.12), (1, 1, ["json_ld"], False, 0.55), (2, 1, ["regex"], False, 0.66), (2, 1, ["tel_link"], True, 0.84), (2, 2, ["regex"], False, 0.39), (6, 4, ["regex"], False, 0.48), (19, 1, ["regex", "tel_link"], True, 0.97)],
)
def test_confidence(spark, pages, distinct, sources, only, expected):
    df = spark.createDataFrame([(pages, distinct, sources, only)], "p int, d int, s array<string>, o boolean")
    assert df.select(nap.confidence(F.col("p"), F.col("d"), F.col("s"), F.col("o")).alias("c")).first().c == expected


def report(spark, rows, field):
    df = spark.createDataFrame([("s", i, p, field, k, v, ["regex"]) for i, (p, vs) in enumerate(rows) for k, v in enumerate(vs)], VALUES)
    out = {r.field: r for r in nap.compare(df).collect()}
    assert list(out) and len(out) == 7
    return out[field]


def test_two_spellings_of_one_phone(spark):
    r = report(spark, [("p1", ["(212) 555-0100"]), ("p2", ["212-555-0100"])], "phone")
    assert (r.verdict, r["values"], r.normalized_values) == ("consistent_formatting_only", ["(212) 555-0100", "212-555-0100"], ["2125550100"])


def test_conflicts_and_single_pages(spark):
    assert report(spark, [("p1", ["2125550100", "2125550199"]), ("p2", ["2125550100", "2125550199"])], "phone").verdict == "inconsistent"
    assert report(spark, [("p1", ["2125550100", "2125550199"])], "phone").verdict == "insufficient_evidence"
    assert report(spark, [("p1", ["123456"]), ("p2", ["123456"])], "phone").normalized_values == []


def test_dominant_name(spark):
    r = report(spark, [("p1", ["A"]), ("p2", ["a"]), ("p3", ["B"])], "business_name")
    assert (r.pages_compared, r["values"], r.normalized_values) == (["p1", "p2"], ["A", "a"], ["a"])
    assert report(spark, [("p1", ["A"]), ("p2", ["B"])], "business_name").verdict == "inconsistent"


def test_fields_that_nobody_names(spark):
    sites = spark.createDataFrame([("empty",)], "site string")
    rows = nap.compare(spark.createDataFrame([], VALUES), sites).collect()
    assert [r.verdict for r in rows] == ["insufficient_evidence"] * 7 and {r.confidence for r in rows} == {0.12}


def test_page_values(pages, spark):
    html = '<title>Acme - Home</title><body><header>Call (212) 555-0100 now!</header><p>At: 205 East Houston Street, New York, NY 10002</p><a href="tel:+12125550100">ring</a><meta property="og:site_name" content="Acme"></body>'
    values = nap.cleaned(nap.page_values(pages({"html": html, "url": "https://a.com/"}, {"html": "<p>We are Acme &amp; co, acme", "url": "https://a.com/x"})))
    got = {(r.field, r.value) for r in values.collect()}
    assert {("phone", "(212) 555-0100"), ("phone", "+12125550100"), ("street_address", "205 East Houston Street"), ("city", "New York"), ("region", "NY"), ("postal_code", "10002"), ("business_name", "Acme"), ("full_address", "205 East Houston Street, New York, NY 10002")} <= got
    archive = pages({"html": html, "url": "https://a.com/"}, {"html": "<p>We are Acme &amp; co, acme", "url": "https://a.com/x"})
    spread = nap.spread_name(values, archive).filter("page_id = 1").collect()
    assert [(r.value, r.sources) for r in spread] == [("Acme", ["page_mention"])]


def test_proposals_must_stand_on_the_page(spark):
    texts = spark.createDataFrame([(1, "Call us at 212 555 0100 on East Houston Street")], "page_id long, text string")
    rows = [(1, "Telephone", "(212) 555-0100"), (1, "phone", "999 9999999"), (1, "address", "Houston Street 7"), (1, "city", "Nowhere Town"), (1, "zip", " "), (1, "other", "x"), (1, "name", "Ab")]
    got = nap.accepted_proposals(spark.createDataFrame(rows, "page_id long, key string, value string"), texts).collect()
    assert sorted((r.field, r.value) for r in got) == [("business_name", "Ab"), ("full_address", "Houston Street 7"), ("phone", "(212) 555-0100")]
