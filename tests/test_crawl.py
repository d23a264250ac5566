import pytest

from siteloom.operators import crawl
from siteloom.sources import fetch, robots

SITES = "site string, start_url string, host string, robots_url string, robots_status int, robots_body string, sitemap_urls array<string>"


def known(links, gone=()):
    probes = ["/" + p for p in ("about", "locations", "menu")]
    out = {"https://a.com/": (200, "https://a.com/", links)}
    out |= {"https://a.com" + p: (200, "https://a.com" + p, []) for p in ("/a", "/b", "/contact", "/hours", "/s", *probes)}
    for path in crawl.CONVENTIONAL_PATHS:
        out.setdefault("https://a.com" + path, (404, "https://a.com" + path, []))
    return out


def test_order_of_the_queue():
    links = ["https://a.com/a", "https://a.com/contact", "https://a.com/b", "https://a.com/hours", "https://other.com/x"]
    run = crawl.Replay("https://a.com", (404, None), ["https://a.com/s"], 40).run(known(links))
    paths = [u.removeprefix("https://a.com") for u in run[0]]
    assert paths[:6] == ["/", "/hours", "/contact", "/a", "/b", "/s"] and set(paths[6:]) == {"/about", "/locations", "/menu"}
    assert crawl.Replay("https://a.com", (404, None), [], 4).run(known(links))[0] == ["https://a.com/", "https://a.com/hours", "https://a.com/contact", "https://a.com/a"]


def test_robots_block_and_unknown_pages_are_asked_for():
    replay = crawl.Replay("https://a.com", (200, "User-agent: *\nDisallow: /a"), [], 3)
    kept, wanted = replay.run({"https://a.com/": (200, "https://a.com/", ["https://a.com/a", "https://a.com/b"])})
    assert kept == ["https://a.com/"] and wanted[0] == "https://a.com/b"


def test_replay_over_the_archive(spark, pages):
    html = '<a href="/a">a</a><a href="/contact">c</a><a href="/a#x">again</a>'
    archive = pages({"html": html, "url": "https://a.com/"}, {"html": "<p>x", "url": "https://a.com/a"}, {"html": '<a href="/deep">d</a>', "url": "https://a.com/contact"}, {"html": "<p>y", "url": "https://a.com/deep"})
    sites = spark.createDataFrame([("a.com", "https://a.com/", "a.com", None, 404, None, None), ("none.com", "https://none.com/", "none.com", None, None, None, [])], SITES)
    got = crawl.replay(archive, sites, 4).orderBy("site", "idx").collect()
    assert [r.url for r in got if r.site == "a.com"] == ["https://a.com/", "https://a.com/contact", "https://a.com/a", "https://a.com/deep"]


def test_sitemaps():
    ns = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> /x/ </loc></url></urlset>'
    assert robots.sitemap_entries(ns, "https://a.com") == (["https://a.com/x"], [])
    assert robots.sitemap_entries("<urlset><loc>https://a.com/y</loc></urlset>", "https://a.com") == (["https://a.com/y"], [])
    for broken in (None, "", "<urlset>", "text"):
        assert robots.sitemap_entries(broken, "https://a.com") == ([], [])


def test_hints_from_any_status(spark):
    df = spark.createDataFrame([("Sitemap: https://a.com/m.xml\r\nsitemap:https://a.com/n.xml\nx",), (None,)], "b string")
    assert [r[0] for r in df.select(robots.sitemap_hints(df.b)).collect()] == [["https://a.com/m.xml", "https://a.com/n.xml"], []]


def test_fetched_rows():
    reply = lambda kind, body: lambda url, timeout: (200, "https://a.com/z", {"Content-Type": kind, "Server": "s"}, body, ["https://a.com/"])
    row = fetch.page_row("https://a.com/", reply("text/html; charset=latin-1", b"caf\xe9"), 1)
    assert row[1:7] == ("https://a.com/z", 200, "text/html", "caf\xe9", {"content-type": "text/html; charset=latin-1"}, None)
    assert "application/pdf" in fetch.page_row("u", reply("application/pdf", b"x"), 1)[6]
    assert len(fetch.page_row("u", reply("text/html", b"x" * 1_600_000), 1)[4]) == 1_500_000

    def fails(url, timeout):
        raise OSError("refused")

    assert fetch.page_row("u", fails, 1)[2:7] == (0, "", "", {}, "refused")


def test_data_source_reads(spark, monkeypatch):
    spark.dataSource.register(fetch.SitePages)
    rows = spark.read.format("site_pages").option("urls", "http://127.0.0.1:9/x\nhttp://127.0.0.1:9/y").option("delay", "0").option("timeout", "1").load().collect()
    assert sorted(r.url for r in rows) == ["http://127.0.0.1:9/x", "http://127.0.0.1:9/y"] and {r.status for r in rows} == {0}


@pytest.mark.parametrize("depth", [0, 2, None])
def test_reachability(spark, depth):
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("t", "a", "z")], "site string, source string, target string")
    got = crawl.reachable(edges, spark.createDataFrame([("s", "a")], "site string, node string"), depth).collect()
    assert {(r.node, r.depth) for r in got} == {("a", 0), ("b", 1), ("c", 2)} if depth != 0 else {("a", 0)}


def web(pages):
    """A transport over a dict of addresses; what it lacks is not found."""

    def fetch(url, timeout):
        kind, body = pages.get(url, ("", None))
        if body is None:
            return 404, url, {"Content-Type": "text/html"}, b"<p>gone", []
        return 200, url, {"Content-Type": kind}, body.encode(), []

    return fetch


SITE = {
    "https://a.com/": ("text/html", '<title>Acme - Home</title><a href="/a">a</a><a href="/contact">c</a><a href="/no">n</a><a href="https://www.yelp.com/biz/acme">y</a><a href="https://b.com/">b</a>'),
    "https://a.com/a": ("text/html", '<p>x<a href="/deep">d</a>'), "https://a.com/contact": ("text/html", "<p>We open at 9 am and close at 5 pm on every day of the week, says the door of Acme."), "https://a.com/deep": ("text/html", "<p>y"),
    "https://a.com/secret": ("text/html", "<p>s"), "https://a.com/listed": ("text/html", "<p>l"), "https://www.yelp.com/biz/acme": ("text/html", "<p>Acme"),
    "https://a.com/robots.txt": ("text/plain", "User-agent: *\nDisallow: /secret\nSitemap: https://a.com/maps.xml"),
    "https://a.com/maps.xml": ("text/xml", "<sitemapindex><sitemap><loc>https://a.com/m1.xml</loc></sitemap></sitemapindex>"),
    "https://a.com/m1.xml": ("text/xml", "<urlset><url><loc>https://a.com/listed</loc></url><url><loc>https://a.com/secret</loc></url></urlset>"),
}


def test_live_crawl_is_the_replay_of_its_archive(spark, tmp_path):
    from siteloom.__main__ import main
    from siteloom.sources import live

    archive, sites = live.crawl_sites(spark.createDataFrame([("https://a.com",)], "start_url string"), 7, web(SITE), 0)
    about = sites.first()
    assert (about.site, about.robots_status, about.sitemap_urls) == ("a.com", 200, ["https://a.com/listed", "https://a.com/secret"])
    got = [(r.url, r.status) for r in archive.filter("NOT from_citation").orderBy("crawl_idx").collect()]
    assert got == [("https://a.com/", 200), ("https://a.com/contact", 200), ("https://a.com/a", 200), ("https://a.com/no", 404), ("https://a.com/listed", 200), ("https://a.com/deep", 200)]
    assert [r.url for r in archive.filter("from_citation").collect()] == ["https://www.yelp.com/biz/acme"]
    assert [r.url for r in archive.filter("from_sitemap").collect()] == ["https://a.com/listed"]
    again = crawl.replay(archive.filter("NOT from_citation"), sites, 6).orderBy("idx").collect()
    assert [r.url for r in again] == [u for u, _ in got]
    assert main(["--url", "https://a.com", "--query", "when do you open", "--out", str(tmp_path), "--master", "local[2]"], web(SITE), 0) == 0
    assert "9 am" in (tmp_path / "answer.json").read_text()


def test_many_dead_addresses_do_not_end_a_crawl(spark, pages):
    links = "".join(f'<a href="/x{k}">d</a>' for k in range(60))
    archive = pages({"html": links + '<a href="/live">l</a>', "url": "https://a.com/"}, *({"html": "<p>", "url": f"https://a.com/x{k}", "final_url": "https://a.com/"} for k in range(60)), {"html": "<p>l", "url": "https://a.com/live"})
    sites = spark.createDataFrame([("a.com", "https://a.com/", "a.com", None, 404, None, None)], SITES)
    assert [r.url for r in crawl.replay(archive, sites, 2).orderBy("idx").collect()] == ["https://a.com/", "https://a.com/live"]
