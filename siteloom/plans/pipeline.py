"""The whole audit over archived crawls, and where its results go."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators import audit, chooser, nap, retrieval
from ..operators.pages import crawled, parsed
from ..sources.archive import crawl_pages


def run(archive: DataFrame, sites: DataFrame, questions: DataFrame | None = None, call: chooser.Call | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None) -> dict[str, DataFrame]:
    """Findings, name-address-phone reports, answers and run data of every site at once.

    ``questions``: (site, qid, query); without them no answers are sought. ``call``: an
    outside model that proposes names and addresses and picks among ranked passages.
    ``embed``: a function that embeds a list of texts; with it the passages' vectors are
    searched as well and fused with the words. Pages are parsed once and kept.
    """
    pages = parsed(archive).persist(StorageLevel.MEMORY_AND_DISK)
    found = audit.findings(archive, sites, audit.audited(archive, pages))
    accepted = None
    if call is not None:
        wanted = nap.proposal_pages(archive).select("page_id").distinct()
        texts = pages.join(wanted, "page_id", "left_semi").select("page_id", "text")
        accepted = nap.accepted_proposals(chooser.proposals(texts, call), texts)
    out = {"audit": found, "nap_report": nap.report(archive, sites, pages, accepted)}
    if questions is not None:
        texts = retrieval.passages(archive, pages).withColumnRenamed("passage_idx", "passage_id")
        shown = crawled(pages).select("site", F.col("page").alias("url"), F.col("text").alias("visible_text"))
        asked = questions.filter(F.trim("query") != "")
        vectors = asked_vectors = None
        if embed is not None:
            vectors = retrieval.embedded(texts, embed, ["site", "passage_id"])
            asked_vectors = retrieval.embedded(asked.withColumnRenamed("query", "text"), embed, ["site", "qid"])
        picks = None if call is None else lambda ranked: chooser.picks(ranked.select("qid", "query", "rank", "url", "text"), call)
        answered = retrieval.answers(texts, shown, asked, picks, vectors, asked_vectors)
        out["answer"] = questions.select("site", "qid", "query").join(answered.drop("query", "site"), "qid", "left")
    kept = crawl_pages(archive).groupBy("site").agg(F.count("*").alias("pages_crawled"))
    n = found.groupBy("site").agg(F.count("*").alias("audit_findings"))
    out["run_meta"] = sites.select("site", "start_url").join(kept, "site", "left").join(n, "site", "left").select(
        "site", "start_url", F.coalesce("pages_crawled", F.lit(0)).alias("pages_crawled"), F.lit(call is not None).alias("chooser_used"), F.coalesce("audit_findings", F.lit(0)).alias("audit_findings"), F.lit(7).alias("nap_fields")
    )
    return out


def write(results: dict[str, DataFrame], folder: str) -> None:
    """Every result as JSON lines under ``folder``, parted by site."""
    for name, df in results.items():
        df.write.mode("overwrite").partitionBy("site").json(f"{folder}/{name}")


def write_site(results: dict[str, DataFrame], site: str, folder: str) -> dict[str, str]:
    """The indented files of one site, for reading; one site's reports are small."""
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    written = {}
    for name, df in results.items():
        rows = [r.asDict(recursive=True) for r in df.filter(F.col("site") == site).drop("site").collect()]
        single = name in ("answer", "run_meta") and len(rows) == 1
        path = to / f"{name}.json"
        path.write_text(json.dumps(rows[0] if single else rows, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
        written[name] = str(path)
    return written
