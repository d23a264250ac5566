from siteloom.operators import audit

GOOD = (
    '<html lang="en"><head><meta charset="utf-8"><title>A title of sensible length</title><meta name="description" content="' + "d" * 80 + '"><meta name="viewport" content="w">'
    '<link rel="canonical" href="/c"><link rel="icon" href="/i"><meta property="og:title" content="t"><meta property="og:description" content="d">'
    '<script type="application/ld+json">{"@type":"LocalBusiness"}</script><script type="application/ld+json">{"@type":"FAQPage"}</script></head><body><h1>Head</h1><h2>x</h2><a href="/b">Baking</a><p>'
    + "word " * 160
    + "</p></body></html>"
)
SITES = "site string, start_url string, host string, robots_url string, robots_status int, robots_body string, sitemap_urls array<string>"


def metrics(pages, *rows):
    found = audit.page_findings(audit.audited(pages(*rows))).collect()
    return sorted((r.page_id, r.metric) for r in found)


def test_a_good_page_is_silent(pages):
    assert metrics(pages, {"html": GOOD}) == []


def test_each_rule_fires_alone(pages):
    cases = [
        ("not_https", {"html": GOOD, "url": "http://a.com/x"}),
        ("redirect_chain", {"html": GOOD, "redirect_chain": ["a", "b", "c"]}),
        ("empty_title", {"html": GOOD.replace("A title of sensible length", " ")}),
        ("missing_title", {"html": GOOD.replace("<title>A title of sensible length</title>", "")}),
        ("title_too_short", {"html": GOOD.replace("A title of sensible length", "Short")}),
        ("title_too_long", {"html": GOOD.replace("A title of sensible length", "t" * 66)}),
        ("missing_meta_description", {"html": GOOD.replace('name="description"', 'name="other"')}),
        ("meta_description_too_short", {"html": GOOD.replace("d" * 80, "d" * 49)}),
        ("meta_description_too_long", {"html": GOOD.replace("d" * 80, "d" * 166)}),
        ("noindex_directive", {"html": GOOD, "headers": {"x-robots-tag": "NoIndex"}}),
        ("missing_viewport", {"html": GOOD.replace('name="viewport"', 'name="v"')}),
        ("missing_html_lang", {"html": GOOD.replace('lang="en"', "")}),
        ("missing_charset", {"html": GOOD.replace('<meta charset="utf-8">', '<meta charset="">')}),
        ("missing_canonical", {"html": GOOD.replace("canonical", "other")}),
        ("missing_h1", {"html": GOOD.replace("h1>", "b>").replace("h2>", "i>")}),
        ("heading_hierarchy_skip", {"html": GOOD.replace("h2>", "h3>")}),
        ("thin_content", {"html": GOOD.replace("word " * 160, "word " * 20)}),
        ("images_missing_alt", {"html": GOOD.replace("<p>", "<img src=x><img alt='' src=y><p>")}),
        ("missing_open_graph", {"html": GOOD.replace("og:title", "og:x")}),
        ("missing_json_ld", {"html": GOOD.replace("ld+json", "json")}),
        ("generic_anchor_text", {"html": GOOD.replace("Baking", " Read  more".replace("  ", " "))}),
        ("no_internal_links", {"html": GOOD.replace("/b", "https://b.com/")}),
        ("soft_404", {"html": GOOD.replace("A title of sensible length", "Sorry, page Not Found here")}),
        ("http_error_status", {"html": GOOD, "status": 503}),
        ("fetch_error", {"html": None, "error": "timeout", "status": 0}),
        ("robots_txt_blocks_page", {"html": None, "error": "disallowed by robots.txt", "status": 0}),
    ]
    assert metrics(pages, *(row for _, row in cases)) == sorted((k, m) for k, (m, _) in enumerate(cases))


def test_several_h1(pages):
    rows = [{"html": GOOD.replace("<h1>Head</h1>", "<h1></h1><h1>x</h1>")}]
    assert [m for _, m in metrics(pages, *rows)] == ["empty_h1", "multiple_h1"]


def test_pages_that_are_not_audited(pages):
    rows = [{"html": GOOD, "status": 404, "from_probe": True}, {"html": GOOD, "status": 301}, {"html": ""}, {"html": None}, {"html": GOOD, "content_type": "application/pdf"}, {"html": GOOD, "from_citation": True, "status": 500}]
    assert metrics(pages, *rows) == []


def test_null_columns_do_not_break_rules(pages):
    row = {"html": "<p>x", "site": None, "url": None, "final_url": None, "status": None, "content_type": None, "headers": None, "redirect_chain": None, "from_probe": None, "crawl_idx": None, "from_sitemap": None, "from_citation": None}
    assert "missing_title" in [m for _, m in metrics(pages, row)]


def test_duplicates_name_the_first_address(pages):
    rows = [{"html": GOOD, "crawl_idx": 5}, {"html": GOOD.upper().replace("META", "meta"), "crawl_idx": 2}, {"html": GOOD, "url": "https://a.com/0", "crawl_idx": 9}, {"html": GOOD, "site": "b.com"}]
    found = {(r.metric, r.site, r.page) for r in audit.duplicate_findings(audit.audited(pages(*rows))).collect()}
    assert ("duplicate_title", "a.com", "https://a.com/1") in found
    assert not [x for x in found if x[1] == "b.com"]


def test_site_rules_and_deduplication(spark, pages):
    bare = GOOD.replace("LocalBusiness", "Thing").replace("FAQPage", "Thing").replace("icon", "x")
    sites = spark.createDataFrame([("a.com", "https://a.com", "a.com", None, 404, None, None), ("b.com", "https://b.com/", "b.com", "r", 200, "", ["s"])], SITES)
    rows = [{"html": bare, "url": "https://a.com/"}, {"html": bare, "url": "https://a.com/"}]
    found = audit.findings(pages(*rows), sites).collect()
    assert sorted(r.metric for r in found) == ["missing_aeo_schema", "missing_favicon", "missing_localbusiness_schema", "missing_robots_txt", "missing_xml_sitemap"]
    assert {r.page for r in found} == {"https://a.com"}


def test_empty_archive(spark, pages):
    empty = pages({"html": GOOD}).limit(0)
    assert audit.findings(empty, spark.createDataFrame([], SITES)).count() == 0
