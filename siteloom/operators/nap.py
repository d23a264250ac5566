"""Names, addresses and phones: extraction from pages, comparison across the pages of a site.

Values are kept in long form, one row each, with the order they were found in:
(site, page_idx, page_id, page, field, value_idx, value, source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import urls
from ..functions.lexicon import (
    CITY_STATE_ZIP,
    CITY_ZIP,
    DOMINANT_PAGES,
    DOMINANT_SHARE,
    FIELDS,
    NAME_CHARS,
    PHONE,
    PHONE_DIGITS,
    PROPOSAL_CHARS,
    PROPOSAL_KEYS,
    PROPOSAL_PAGE_HINTS,
    PROPOSAL_PAGES,
    SCOPE_CHARS,
    STREET,
)
from ..functions.text import norm_name, norm_phone, norm_value, squeezed
from ..sources.archive import live_pages
from .pages import live, parsed

_PAIR = "array<struct<field:string,value:string,source:string>>"


def _pairs(values: Column, field: str, source: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"), F.lit(source).alias("source")))


def _groups(text: Column, pattern: str, fields: tuple[str, ...]) -> Column:
    """Groups of all matches, match by match."""
    found = F.arrays_zip(*(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(k + 1)).alias(f) for k, f in enumerate(fields)))
    return F.flatten(F.transform(found, lambda m: F.array(*(F.struct(F.lit(f).alias("field"), m[f].alias("value"), F.lit("regex").alias("source")) for f in fields))))


def regex_values(scope: Column) -> Column:
    """Phones, streets and places that patterns find in a text."""
    phones = F.transform(F.regexp_extract_all(scope, F.lit("(?U)" + PHONE), F.lit(0)), lambda p: F.trim(p))
    streets = F.transform(F.regexp_extract_all(scope, F.lit("(?iU)" + STREET), F.lit(0)), squeezed)
    return F.concat(
        _pairs(phones, "phone", "regex"), _pairs(streets, "street_address", "regex"), _groups(scope, CITY_STATE_ZIP, ("city", "region", "postal_code")), _groups(scope, CITY_ZIP, ("city", "postal_code"))
    )


def _value_of(values: Column, field: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(values, lambda v: v["field"] == field), F.lit(1))["value"], F.lit(""))


def page_order() -> Column:
    """The place of a page: the crawl's own pages in their order, then those fetched as citations."""
    return F.struct(F.coalesce("from_citation", F.lit(False)), F.coalesce("crawl_idx", F.lit(2**31 - 1)), "page_id")


def page_values(archive: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """All values of the live pages in long form, as found; ``pages``: the archive as it was parsed."""
    f = live(parsed(archive) if pages is None else pages)
    named = lambda column, source: F.transform(column, lambda v: F.struct(v["field"].alias("field"), v["value"].alias("value"), F.lit(source).alias("source")))
    tel = F.filter("anchors", lambda a: a["has_href"] & a["href"].rlike("^(?i)tel:"))
    numbers = F.flatten(F.transform(tel, lambda a: F.filter(F.array(F.regexp_replace(a["href"], "^[^:]*:", ""), a["text"]), lambda v: v != "")))
    scope = F.concat_ws(" ", "footer_text", "header_text", F.substring("text", 1, SCOPE_CHARS))
    home = F.trim(F.split("title", " - ")[0])
    home_path = urls.path(F.col("page")).isin("", "/")
    is_home = home_path & F.col("has_title") & F.length(home).between(*NAME_CHARS) & ~F.contains(F.lower(home), F.lit("404"))
    site_name = F.try_element_at(F.filter("metas", lambda m: F.when(m["property"] != "", m["property"]).otherwise(m["name"]).isin("og:site_name", "application-name")), F.lit(1))["content"]
    none = F.array().cast(_PAIR)
    found = F.concat(
        named("linked", "json_ld"),
        named("microdata", "microdata"),
        _pairs(numbers, "phone", "tel_link"),
        regex_values(scope),
        F.when(is_home, _pairs(F.array(home), "business_name", "homepage_title")).otherwise(none),
        F.when(F.coalesce(site_name, F.lit("")) != "", _pairs(F.array(site_name), "business_name", "og_site_name")).otherwise(none),
    )
    street, city, code, region = (_value_of(F.col("v"), x) for x in ("street_address", "city", "postal_code", "region"))
    line = F.array_join(F.filter(F.array(street, city, F.trim(F.concat_ws(" ", region, code))), lambda x: x != ""), ", ")
    whole = ~F.exists("v", lambda x: x["field"] == "full_address") & (street != "") & ((city != "") | (code != ""))
    composed = F.when(whole, F.concat("v", _pairs(F.array(line), "full_address", "composed"))).otherwise(F.col("v"))
    return (
        f.select("site", page_order().alias("page_idx"), "page_id", "page", found.alias("v"))
        .select("site", "page_idx", "page_id", "page", F.posexplode(composed).alias("value_idx", "x"))
        .select("site", "page_idx", "page_id", "page", "x.field", "value_idx", squeezed(F.col("x.value")).alias("value"), "x.source")
        .filter(F.col("value") != "")
    )


def cleaned(values: DataFrame) -> DataFrame:
    """The first of each spelling per page and field, phones of ten digits and names of sensible length only.

    The sources of a page and field are kept whatever became of their values, so
    ``sources`` holds all of them.
    """
    page = W.partitionBy("site", "page_id", "field")
    first = W.partitionBy("site", "page_id", "field", F.lower("value")).orderBy("value_idx")
    good = F.when(F.col("field") == "phone", F.length(norm_phone(F.col("value"))) >= PHONE_DIGITS).when(F.col("field") == "business_name", F.length("value").between(*NAME_CHARS)).otherwise(True)
    return values.withColumn("sources", F.array_sort(F.collect_set("source").over(page))).withColumn("rn", F.row_number().over(first)).filter((F.col("rn") == 1) & good).drop("rn", "source")


def spread_name(values: DataFrame, archive: DataFrame) -> DataFrame:
    """Adds the first name of a site's home page to every page whose html mentions it.

    One name for each site joins the pages of the site; the substring is looked
    for within the equi-join.
    """
    home = values.filter((F.col("field") == "business_name") & urls.path(F.col("page")).isin("", "/"))
    names = home.groupBy("site").agg(F.min_by("value", F.struct("page_idx", "value_idx")).alias("name"))
    pages = live_pages(archive).select("site", page_order().alias("page_idx"), "page_id", "page", "html").join(names, "site")
    had = values.filter(F.col("field") == "business_name").select("page_id", F.lower("value").alias("key"))
    mentions = (
        pages.filter(F.contains(F.lower("html"), F.lower("name")))
        .withColumn("key", F.lower("name"))
        .join(had, ["page_id", "key"], "left_anti")
        .select(
            "site", "page_idx", "page_id", "page", F.lit("business_name").alias("field"), F.lit(2**30).alias("value_idx"), F.col("name").alias("value"), F.array(F.lit("page_mention")).alias("sources")
        )
    )
    return values.unionByName(mentions)


def confidence(pages: Column, distinct: Column, sources: Column, formatting_only: Column) -> Column:
    """How far a field can be trusted, from 0.12 to 0.97."""
    d = lambda x: F.lit(float(x))
    has = lambda name: F.array_contains(sources, name)
    source = F.when(has("json_ld"), d(0.18)).when(has("microdata") | has("tel_link"), d(0.10)).when(has("llm"), d(0.04)).otherwise(d(0))
    agreement = F.when(distinct <= 1, d(0.15)).otherwise(-F.least(d(0.35), d(0.12) * (distinct - 1)))
    raw = d(0.35) + d(0.08) * F.least(pages, F.lit(6)) + source + agreement + F.when(formatting_only, d(0.08)).otherwise(d(0))
    whole = F.round(F.greatest(d(0.12), F.least(d(0.97), raw)), 2)
    return F.when(pages == 0, d(0.12)).when(pages == 1, F.least(d(0.55), whole)).otherwise(whole)


def verdict(pages: Column, distinct: Column, raw: Column, per_page: Column) -> Column:
    return (
        F.when(pages <= 1, "insufficient_evidence")
        .when((distinct <= 1) & (raw <= 1), "consistent")
        .when(distinct <= 1, "consistent_formatting_only")
        .when(per_page > 1, "inconsistent")
        .otherwise("consistent")
    )


def _dominant(rows: DataFrame) -> DataFrame:
    """Keeps only the name most pages of a site agree on, where there is one.

    Ties go to the name found first, then to the lesser one.
    """
    names = rows.filter((F.col("field") == "business_name") & F.col("norm").isNotNull())
    pages = names.groupBy("site").agg(F.count_distinct("page").alias("pages"))
    counts = names.groupBy("site", "norm").agg(F.count_distinct("page").alias("n"), F.min("ord").alias("first"))
    best = counts.groupBy("site").agg(F.min_by(F.struct("norm", "n"), F.struct(-F.col("n"), "first", "norm")).alias("best"))
    kept = best.join(pages, "site").filter((F.col("best.n") >= DOMINANT_PAGES) & (F.col("best.n") / F.col("pages") >= DOMINANT_SHARE)).select("site", F.col("best.norm").alias("dominant"))
    joined = rows.join(kept, "site", "left")
    return joined.filter((F.col("field") != "business_name") | F.col("dominant").isNull() | (F.col("norm") == F.col("dominant"))).drop("dominant")


def compare(values: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """The report: seven rows a site, whatever was found.

    ``values``: (site, page_idx, page, field, value_idx, value, sources). All
    sources of a field count, also those of pages that a dominant name leaves out.
    Distinct values are aggregated before they are listed, so a group holds as
    many entries as there are distinct values and pages, not occurrences.
    """
    rows = values.withColumn("norm", norm_value(F.col("field"), F.col("value"))).withColumn("ord", F.struct("page_idx", "value_idx")).persist(StorageLevel.MEMORY_AND_DISK)
    sources = rows.groupBy("site", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"))
    kept = _dominant(rows).persist(StorageLevel.MEMORY_AND_DISK)

    def listed(column: str, alias: str) -> DataFrame:
        firsts = kept.filter(F.col(column).isNotNull()).groupBy("site", "field", column).agg(F.min("ord").alias("first"))
        return firsts.groupBy("site", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", column))), lambda x: x[column]).alias(alias))

    fields = F.posexplode(F.array(*map(F.lit, FIELDS))).alias("field_idx", "field")
    base = (sites if sites is not None else values).select("site").distinct().select("site", fields)
    out = base
    for part in (listed("page", "pages_compared"), listed("value", "values"), listed("norm", "normalized_values"), sources):
        out = out.join(part, ["site", "field"], "left")
    for name in ("pages_compared", "values", "normalized_values", "sources"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    pages, distinct, raw = F.size("pages_compared"), F.size("normalized_values"), F.size("values")
    out = out.withColumn("verdict", verdict(pages, distinct, raw, distinct))
    out = out.withColumn("confidence", confidence(pages, distinct, F.col("sources"), F.col("verdict") == "consistent_formatting_only"))
    said = F.concat(F.col("field"), F.lit(": "), pages.cast("string"), F.lit(" pages, "), raw.cast("string"), F.lit(" spellings, "), distinct.cast("string"), F.lit(" distinct values"))
    return out.select("site", "field_idx", "field", "pages_compared", "values", "normalized_values", "confidence", "verdict", "sources", said.alias("explanation"))


def report(archive: DataFrame, sites: DataFrame, pages: DataFrame | None = None, proposals: DataFrame | None = None) -> DataFrame:
    """The report of every site from its archived pages, citations included.

    ``pages``: the archive as it was parsed. ``proposals``: accepted proposals of an
    outside model (page_id, field, value, source), which join the values of their page.
    """
    pages = parsed(archive) if pages is None else pages
    values = cleaned(page_values(archive, pages))
    if proposals is not None:
        known = live(pages).select("page_id", "site", page_order().alias("page_idx"), "page").dropDuplicates(["page_id"])
        new = proposals.join(values.select("page_id", "field", F.lower("value").alias("key")), [proposals["page_id"] == values["page_id"], proposals["field"] == values["field"], F.lower(proposals["value"]) == F.col("key")], "left_anti")
        added = new.join(known, "page_id").select("site", "page_idx", "page_id", "page", "field", F.lit(2**29).alias("value_idx"), squeezed(F.col("value")).alias("value"), F.array("source").alias("sources"))
        values = values.unionByName(added)
    values = values.persist(StorageLevel.MEMORY_AND_DISK)
    return compare(spread_name(values, archive), sites)


def proposal_pages(archive: DataFrame) -> DataFrame:
    """The pages whose text goes to an outside extractor: the first and those that speak of contact and places, four a site."""
    pages = live_pages(archive)
    order = W.partitionBy("site").orderBy(F.col("crawl_idx").asc_nulls_last(), "page_id")
    chosen = pages.withColumn("n", F.row_number().over(order)).filter((F.col("n") == 1) | F.lower("page").rlike("|".join(PROPOSAL_PAGE_HINTS)))
    return chosen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PROPOSAL_PAGES).select("site", "page_id", "page", "rank")


def accepted_proposals(proposals: DataFrame, texts: DataFrame) -> DataFrame:
    """Proposals (page_id, key, value) of an outside extractor that their page's text bears out.

    A phone's digits must stand among the page's digits; of other values at least
    half of the words longer than two letters (and one) must stand in the text.
    """
    names = F.create_map(*(F.lit(x) for pair in PROPOSAL_KEYS.items() for x in pair))
    rows = proposals.join(texts.select("page_id", F.substring("text", 1, PROPOSAL_CHARS).alias("text")), "page_id").withColumn("field", F.try_element_at(names, F.lower("key"))).withColumn("value", F.trim("value"))
    words = F.filter(F.regexp_extract_all(F.lower("value"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2)
    seen = F.size(F.filter(words, lambda w: F.contains(F.lower("text"), w)))
    digits = norm_phone(F.col("value"))
    phone = (digits == "") | F.contains(F.regexp_replace("text", r"(?U)\D", ""), digits)
    other = (F.size(words) == 0) | (seen >= F.greatest(F.lit(1), F.floor(F.size(words) / 2)))
    return rows.filter(F.col("field").isNotNull() & (F.col("value") != "") & F.when(F.col("field") == "phone", phone).otherwise(other)).select("page_id", "field", "value", F.lit("llm").alias("source"))


__all__ = ["accepted_proposals", "cleaned", "compare", "confidence", "norm_name", "page_values", "proposal_pages", "regex_values", "report", "spread_name", "verdict"]
