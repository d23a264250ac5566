"""Fetching pages over HTTP as a Python data source: ``spark.read.format("site_pages")``.

Options: ``urls`` (one per line), ``delay`` seconds after each fetch, ``timeout``.
Every partition fetches its own share. The transport can be replaced, as tests do.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.request import HTTPRedirectHandler, Request, build_opener

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.lexicon import FETCH_DELAY_S, FETCH_TIMEOUT_S, KEPT_HEADERS, MAX_BODY_BYTES
from .robots import AGENT

SCHEMA = (
    "url string, final_url string, status int, content_type string, html string, headers map<string,string>, error string,"
    " redirect_chain array<string>, from_sitemap boolean, from_probe boolean, from_citation boolean"
)
Reply = tuple[int, str, dict[str, str], bytes, list[str]]


class _Hops(HTTPRedirectHandler):
    def __init__(self) -> None:
        self.chain: list[str] = []

    def redirect_request(self, req, fp, code, msg, headers, newurl):  # noqa: ANN001, ANN201, PLR0913
        self.chain.append(req.full_url)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def transport(url: str, timeout: float) -> Reply:
    """(status, final address, headers, body, addresses passed on the way)."""
    hops = _Hops()
    request = Request(url, headers={"User-Agent": AGENT, "Accept": "text/html,application/xhtml+xml,*/*;q=0.8"})
    try:
        reply = build_opener(hops).open(request, timeout=timeout)
    except HTTPError as failed:
        reply = failed
    with reply:
        return reply.status, reply.url, dict(reply.headers.items()), reply.read(MAX_BODY_BYTES + 1), hops.chain


def page_row(url: str, fetch: Callable[[str, float], Reply], timeout: float, from_citation: bool = False) -> tuple:
    """The archive row of one address; a failure gives status 0 and the error."""
    try:
        status, final, headers, body, chain = fetch(url, timeout)
    except Exception as failed:  # noqa: BLE001 - any failure of the network is a result
        return (url, url, 0, "", "", {}, str(failed) or type(failed).__name__, [], False, False, from_citation)
    headers = {k.lower(): v for k, v in headers.items()}
    kind = headers.get("content-type", "").split(";")[0].strip().lower()
    kept = {k: v for k, v in headers.items() if k in KEPT_HEADERS}
    html, error = "", None
    if "html" in kind or "xml" in kind:
        charset = next((p.split("=", 1)[1].strip(" \"'") for p in headers["content-type"].split(";")[1:] if "charset=" in p.lower()), "utf-8")
        if len(body) > MAX_BODY_BYTES:
            body, error = body[:MAX_BODY_BYTES], "html cut at 1.5 MB"
        try:
            html = body.decode(charset, "replace")
        except LookupError:
            html = body.decode("utf-8", "replace")
    else:
        error = f"not html but {kind or 'of unknown type'}"
    return (url, final, status, kind, html, kept, error, chain, False, False, from_citation)


class _Share(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.delay, self.timeout = float(options.get("delay", FETCH_DELAY_S)), float(options.get("timeout", FETCH_TIMEOUT_S))
        self.shares, self.citation = int(options.get("shares", "8")), options.get("citation", "false") == "true"

    def partitions(self) -> list[_Share]:
        n = max(1, min(self.shares, len(self.urls)))
        return [_Share(self.urls[k::n]) for k in range(n)]

    def read(self, partition: _Share) -> Iterator[tuple]:
        for url in partition.urls:
            yield page_row(url, transport, self.timeout, self.citation)
            time.sleep(self.delay)


class SitePages(DataSource):
    """``spark.dataSource.register(SitePages)``, then ``spark.read.format("site_pages")``."""

    @classmethod
    def name(cls) -> str:
        return "site_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)
