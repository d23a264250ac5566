"""The site audit: rules over page features, groups of duplicates, rules over whole sites.

Every page rule is an expression that is a finding or null; one pass over the
pages yields them all. Pages never meet in one task: duplicates are aggregated by
site and text, site rules by site, both with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import urls
from ..functions.lexicon import ANSWER_TYPES, DESCRIPTION_CHARS, ERROR_TITLES, EVIDENCE_KEY_CHARS, GENERIC_ANCHORS, LOCAL_TYPES, LONG_CHAIN, THIN_WORDS, TITLE_CHARS
from .pages import crawled, parsed

#: Addresses that the evidence of a duplicate lists.
SHOWN_ADDRESSES = 6
FINDING = "struct<metric:string,severity:string,evidence:string,suggested_fix:string>"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9']+"))


def first_content(names: Column) -> Column:
    """Content of the first of the chosen meta elements."""
    return F.try_element_at(names, F.lit(1))["content"]


def fact_columns() -> list[str | Column]:
    """What the rules need of a page, as expressions over its features."""
    meta = lambda test: F.filter("metas", test)
    either = lambda m: F.when(m["name"] != "", m["name"]).otherwise(m["property"])
    other = lambda m: F.when(m["property"] != "", m["property"]).otherwise(m["name"])
    h1 = F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"])
    levels = F.transform("headings", lambda h: h["level"])
    skips = F.filter(F.arrays_zip(levels.alias("a"), F.slice(levels, 2, F.greatest(F.size("headings"), F.lit(1))).alias("b")), lambda p: p["b"] > p["a"] + 1)
    canonical = F.filter("links", lambda k: F.contains(k["rel"], F.lit("canonical")))
    return [
        "page_id",
        "has_title",
        "title",
        "lang",
        "charset",
        first_content(meta(lambda m: either(m) == "description")).alias("description"),
        first_content(meta(lambda m: m["name"] == "robots")).alias("robots"),
        first_content(meta(lambda m: m["name"] == "viewport")).alias("viewport"),
        F.try_element_at(meta(lambda m: other(m) == "og:title"), F.lit(-1))["content"].alias("og_title"),
        F.try_element_at(meta(lambda m: other(m) == "og:description"), F.lit(-1))["content"].alias("og_description"),
        F.try_element_at(canonical, F.lit(1))["href"].alias("canonical"),
        h1.alias("h1"),
        F.try_element_at(skips, F.lit(1)).alias("skip"),
        word_count(F.col("text")).alias("n_words"),
        F.substring("text", 1, 180).alias("opening"),
        F.size("imgs").alias("n_imgs"),
        F.transform(F.filter("imgs", lambda i: ~i["has_alt"]), lambda i: i["src"]).alias("no_alt"),
        F.transform(F.filter("anchors", lambda a: F.lower(a["text"]).isin(*GENERIC_ANCHORS)), lambda a: a["text"]).alias("generic"),
        F.filter("anchors", lambda a: a["has_href"] & ~a["href"].rlike(r"^(#|(?i:mailto:|tel:))")).alias("out"),
        "n_json_ld",
        "types",
        F.exists("links", lambda k: F.contains(k["rel"], F.lit("icon"))).alias("icon"),
    ]


def internal_links(anchors: Column, page: Column) -> Column:
    """Links that stay on the site of their page, repeated ones counted again."""
    return F.size(F.filter(anchors, lambda a: urls.host(urls.resolve(F.trim(a["href"]), page)) == urls.host(page)))


#: What the rules need of a page besides its features.
ABOUT = ("site", "crawl_idx", "page", "url", "status", "error", "admission", "x_robots", "n_hops")


def audited(archive: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Every crawled page with its admission and its facts; ``pages``: the archive as it was parsed."""
    known = crawled(parsed(archive) if pages is None else pages).select(*ABOUT, *fact_columns())
    return known.withColumn("n_internal", internal_links(F.col("out"), F.col("page"))).drop("out")


def _finding(metric: str, severity: str | Column, when: Column, evidence: Column, fix: str) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(when, F.struct(F.lit(metric).alias("metric"), level.alias("severity"), evidence.alias("evidence"), F.lit(fix).alias("suggested_fix")))


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("none")) for p in parts))


def _empty(name: str) -> Column:
    return F.coalesce(name, F.lit("")) == ""


def page_rules() -> list[Column]:
    """One expression for each rule over a page, in the order of reporting."""
    c = F.col
    ok = c("admission") == "audited"
    length = F.length("title")
    described = F.length("description")
    status = F.coalesce("status", F.lit(0))
    h1 = F.coalesce(F.size("h1"), F.lit(0))
    title = F.lower("title")
    rule = lambda metric, severity, when, evidence, fix: _finding(metric, severity, ok & when, evidence, fix)
    return [
        _finding("robots_txt_blocks_page", "low", c("admission") == "blocked", _say("The crawler may not fetch ", c("page"), " under robots.txt."), "Let crawlers in if the page should be indexed."),
        _finding("http_error_status", F.when(status >= 500, "high").otherwise("medium"), c("admission") == "failed", _say("Status ", status, " for ", c("url"), "; error: ", c("error"), "."), "Serve the page with status 200 or redirect it to a live one."),
        _finding("fetch_error", "medium", c("admission") == "unread", _say("No html was read: ", c("error"), "."), "Serve the page as text/html."),
        rule("not_https", "high", urls.scheme(c("page")) != "https", _say("Served from ", c("page"), "."), "Move the page to https and redirect the old address."),
        rule("redirect_chain", "medium", c("n_hops") >= LONG_CHAIN, _say(c("n_hops"), " redirects before ", c("page"), "."), "Redirect once, straight to the final address."),
        rule("missing_title", "high", ~c("has_title"), _say("The page has no title element."), "Add a title that names topic and business."),
        rule("empty_title", "high", c("has_title") & (c("title") == ""), _say("The title element is empty."), "Write a title."),
        rule("title_too_short", "medium", c("has_title") & (length > 0) & (length < TITLE_CHARS[0]), _say("Title of ", length, " characters: ", c("title")), "Lengthen the title to some 50 characters."),
        rule("title_too_long", "low", c("has_title") & (length > TITLE_CHARS[1]), _say("Title of ", length, " characters: ", c("title")), "Shorten the title to some 60 characters."),
        rule("missing_meta_description", "medium", _empty("description"), _say("No meta description."), "Describe the page in 120 to 160 characters."),
        rule("meta_description_too_short", "low", ~_empty("description") & (described < DESCRIPTION_CHARS[0]), _say("Description of ", described, " characters: ", c("description")), "Lengthen the description."),
        rule("meta_description_too_long", "low", ~_empty("description") & (described > DESCRIPTION_CHARS[1]), _say("Description of ", described, " characters: ", c("description")), "Shorten the description."),
        rule("noindex_directive", "high", F.contains(F.lower(F.concat_ws(" ", "robots", "x_robots")), F.lit("noindex")), _say("meta robots: ", c("robots"), "; X-Robots-Tag: ", c("x_robots"), "."), "Drop noindex from pages that should be found."),
        rule("missing_viewport", "high", _empty("viewport"), _say("No viewport meta element."), "Add a viewport meta element."),
        rule("missing_html_lang", "medium", c("lang").isNull(), _say("The html element names no language."), "Set lang on the html element."),
        rule("missing_charset", "low", c("charset").isNull(), _say("No character encoding is declared."), "Declare utf-8 in the head."),
        rule("missing_canonical", "medium", _empty("canonical"), _say("No canonical link."), "Link the preferred address as canonical."),
        rule("missing_h1", "high", h1 == 0, _say("No h1 element."), "Give the page one h1."),
        rule("empty_h1", "medium", F.exists("h1", lambda h: h == ""), _say(h1, " h1 elements, some of them empty."), "Put text into the h1."),
        rule("multiple_h1", "medium", h1 > 1, _say(h1, " h1 elements: ", F.array_join(F.slice("h1", 1, 6), " / ")), "Keep one h1."),
        rule("heading_hierarchy_skip", "low", c("skip").isNotNull(), _say("h", c("skip")["a"], " is followed by h", c("skip")["b"], "."), "Nest headings without gaps."),
        rule("thin_content", "medium", (c("n_words") < THIN_WORDS) & (status == 200), _say(c("n_words"), " words: ", c("opening")), "Add text that answers what visitors look for."),
        rule("images_missing_alt", "medium", F.size("no_alt") > 0, _say(F.size("no_alt"), " of ", c("n_imgs"), " images lack alt: ", F.array_join(F.slice("no_alt", 1, 5), ", ")), "Describe images in alt; leave it empty for ornaments."),
        rule("missing_open_graph", "low", _empty("og_title") | _empty("og_description"), _say("og:title: ", c("og_title"), "; og:description: ", c("og_description"), "."), "Add Open Graph title, description and image."),
        rule("missing_json_ld", "medium", c("n_json_ld") == 0, _say("No linked data could be read."), "Add linked data that describes the business or the page."),
        rule("generic_anchor_text", "low", F.size("generic") > 0, _say(F.size("generic"), " links say no more than: ", F.array_join(F.slice("generic", 1, 4), ", ")), "Name the target in the link."),
        rule("no_internal_links", "medium", (c("n_internal") == 0) & (status == 200), _say("No link leads to the same site."), "Link related pages."),
        rule("soft_404", "high", (status == 200) & title.rlike("|".join(ERROR_TITLES)), _say("Status 200 with the title ", c("title")), "Answer missing pages with status 404."),
    ]


def page_findings(pages: DataFrame) -> DataFrame:
    """Findings of single pages; ``ord`` is the place of the rule."""
    found = F.filter(F.transform(F.array(*page_rules()), lambda x, i: F.when(x.isNotNull(), F.struct(i.alias("ord"), x.alias("f")))), lambda x: x.isNotNull())
    return pages.select("site", "page", "crawl_idx", "page_id", F.explode(found).alias("x")).select("site", "page", "crawl_idx", "page_id", "x.ord", "x.f.*")


def duplicates(pages: DataFrame, text: Column, metric: str, severity: str, ord_: int, fix: str) -> DataFrame:
    """Texts that more than one address of a site uses; reported for the first of them."""
    rows = pages.filter(F.col("admission") == "audited").select("site", "page", "crawl_idx", "page_id", text.alias("raw")).withColumn("text", F.lower(F.trim("raw"))).filter(F.col("text") != "")
    by_page = rows.groupBy("site", "text", "page").agg(F.min(F.struct("crawl_idx", "page_id")).alias("first"))
    groups = by_page.groupBy("site", "text").agg(F.count("*").alias("n"), F.min_by("page", "first").alias("page"), F.min("first").alias("first")).filter(F.col("n") > 1)
    nth = F.row_number().over(W.partitionBy("site", "text").orderBy("first", "page"))
    shown = by_page.withColumn("k", nth).filter(F.col("k") <= SHOWN_ADDRESSES).groupBy("site", "text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "page"))), lambda x: x["page"]), ", ").alias("shown"))
    groups = groups.join(shown, ["site", "text"])
    return groups.select(
        "site", "page", F.col("first.crawl_idx").alias("crawl_idx"), F.col("first.page_id").alias("page_id"), F.lit(ord_).alias("ord"), F.lit(metric).alias("metric"), F.lit(severity).alias("severity"),
        _say(F.col("n"), " addresses share: ", F.col("text"), " (", F.col("shown"), ")").alias("evidence"), F.lit(fix).alias("suggested_fix"),
    )


def duplicate_findings(pages: DataFrame) -> DataFrame:
    titles = duplicates(pages, F.col("title"), "duplicate_title", "high", 100, "Give every page its own title.")
    descriptions = duplicates(pages, F.col("description"), "duplicate_meta_description", "medium", 101, "Describe every page in its own words.")
    headings = duplicates(pages.withColumn("h", F.explode("h1")), F.col("h"), "duplicate_h1", "low", 102, "Let every h1 say what its page is about.")
    return titles.unionByName(descriptions).unionByName(headings)


def site_schema(pages: DataFrame) -> DataFrame:
    """(site, n_pages, has_local, has_answer) over the audited pages of each site."""
    has = lambda names: F.arrays_overlap("types", F.array(*map(F.lit, names)))
    return pages.filter(F.col("admission") == "audited").groupBy("site").agg(F.count("*").alias("n_pages"), F.bool_or(has([*LOCAL_TYPES, "organization"])).alias("has_local"), F.bool_or(has(ANSWER_TYPES)).alias("has_answer"))


def site_findings(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Findings about whole sites, one pass over the sites."""
    bare = lambda u: F.regexp_replace(u, "/+$", "")
    homes = (
        pages.filter(F.col("admission") == "audited")
        .join(sites.select("site", bare(F.col("start_url")).alias("start")).distinct(), "site")
        .filter(bare(F.col("page")) == F.col("start"))
        .groupBy("site")
        .agg(F.min_by("icon", F.struct("crawl_idx", "page_id")).alias("icon"))
    )
    rows = sites.select("site", "start_url", "robots_url", "robots_status", F.coalesce(F.size("sitemap_urls"), F.lit(0)).alias("listed")).join(site_schema(pages), "site", "left").join(homes, "site", "left")
    n = F.coalesce("n_pages", F.lit(0))
    rules = [
        _finding("missing_robots_txt", "medium", F.col("robots_status") >= 400, _say("robots.txt answered with status ", F.col("robots_status"), "."), "Publish a robots.txt that names the sitemap."),
        _finding("missing_xml_sitemap", "medium", F.col("listed") <= 0, _say("No sitemap was found."), "Publish a sitemap and name it in robots.txt."),
        _finding("missing_localbusiness_schema", "medium", (n > 0) & ~F.col("has_local"), _say(n, " pages, none with linked data of a local business or organization."), "Describe the business in linked data."),
        _finding("missing_aeo_schema", "low", (n > 0) & ~F.col("has_answer"), _say(n, " pages, none with linked data of questions, guides or articles."), "Mark up questions and articles that the pages hold."),
        _finding("missing_favicon", "low", ~F.col("icon"), _say("The start page links no icon."), "Link an icon."),
    ]
    found = F.filter(F.transform(F.array(*rules), lambda x, i: F.when(x.isNotNull(), F.struct(i.alias("i"), x.alias("f")))), lambda x: x.isNotNull())
    about = F.when(F.col("x.f.metric") == "missing_robots_txt", F.coalesce(F.nullif("robots_url", F.lit("")), "start_url")).otherwise(F.col("start_url"))
    order = F.when(F.col("x.i") < 2, F.col("x.i") - 10).otherwise(F.col("x.i") + 200)
    return rows.select("site", "start_url", "robots_url", F.explode(found).alias("x")).select(
        "site", about.alias("page"), F.lit(None).cast("int").alias("crawl_idx"), F.lit(None).cast("long").alias("page_id"), order.cast("int").alias("ord"), "x.f.*"
    )


def deduplicated(findings: DataFrame) -> DataFrame:
    """The first finding of each metric, page and opening of the evidence within a site."""
    key = W.partitionBy("site", "metric", "page", F.substring("evidence", 1, EVIDENCE_KEY_CHARS)).orderBy("ord", "crawl_idx", "page_id")
    return findings.withColumn("rn", F.row_number().over(key)).filter("rn = 1").drop("rn")


def findings(archive: DataFrame, sites: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """All findings of all sites: (site, page, crawl_idx, page_id, ord, metric, severity, evidence, suggested_fix).

    Null flags count as false, a null site is a site, repeated pages are found
    again under their own page_id and then fall to the deduplication.
    """
    pages = audited(archive).persist(StorageLevel.MEMORY_AND_DISK) if pages is None else pages
    return deduplicated(page_findings(pages).unionByName(duplicate_findings(pages)).unionByName(site_findings(pages, sites)))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("metric", "severity").agg(F.count("*").alias("n"))
