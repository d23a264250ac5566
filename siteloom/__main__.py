"""``python -m siteloom (--url ADDRESS | --data FOLDER --site SITE) [--query TEXT] [--max-pages N] [--out FOLDER]``: one site's audit, live or from archived tables."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import functions as F

from .functions.lexicon import FETCH_DELAY_S, MAX_PAGES
from .plans import pipeline
from .session import session
from .sources import live
from .sources.archive import table


def main(args: list[str] | None = None, fetch: live.Fetch = live.transport, delay: float = FETCH_DELAY_S) -> int:
    parser = argparse.ArgumentParser(prog="siteloom", description="Audit a site, live or archived, and write audit.json, nap_report.json, answer.json and run_meta.json.")
    parser.add_argument("--url", help="address to crawl; without it --data and --site name an archived site")
    parser.add_argument("--data", help="folder of the tables crawl_archive and sites")
    parser.add_argument("--site", help="host without www.")
    parser.add_argument("--query", default="", help="a question to answer from the site's pages")
    parser.add_argument("--max-pages", type=int, default=MAX_PAGES, help="pages of the crawl that are read, in crawl order")
    parser.add_argument("--out", default="outputs")
    parser.add_argument("--master", default="local[*]")
    got = parser.parse_args(args)
    if not got.url and not (got.data and got.site):
        parser.error("give --url, or --data and --site")
    spark = session(got.master)
    if got.url:
        pages, sites = live.crawl_sites(spark.createDataFrame([(got.url,)], "start_url string"), got.max_pages, fetch, delay)
        got.site = sites.first().site
    else:
        sites = table(spark, got.data, "sites").filter(F.col("site") == got.site)
        pages = table(spark, got.data, "crawl_archive").filter(F.col("site") == got.site)
    citations = pages.filter("from_citation")
    kept = pages.filter(~F.coalesce("from_citation", F.lit(False))).orderBy(F.col("crawl_idx").asc_nulls_last(), "page_id").limit(got.max_pages)
    asked = spark.createDataFrame([(got.site, "q", got.query)], "site string, qid string, query string")
    results = pipeline.run(kept.unionByName(citations), sites, asked)
    results["answer"] = results["answer"].drop("qid")
    written = pipeline.write_site(results, got.site, got.out)
    start = (sites.select("start_url").first() or [""])[0]
    (Path(got.out) / "demo_url.txt").write_text(start or "", encoding="utf-8")
    if got.query:
        (Path(got.out) / "query.txt").write_text(got.query, encoding="utf-8")
    read = lambda name: json.loads(Path(written[name]).read_text(encoding="utf-8"))
    summary = {"input_url": start, "query": got.query or None, "pages_crawled": kept.count(), "audit_findings": len(read("audit")), "nap_fields": len(read("nap_report")), "answer": read("answer"), "files": written}
    print(json.dumps(summary, indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
