"""URL functions as Catalyst expressions, with plain-Python twins for use inside parsing."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import LOCAL_HINTS, SKIPPED_EXTENSIONS, SKIPPED_SCHEMES

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _SPLIT, group)


def normalize(url: Column) -> Column:
    """One spelling of an absolute URL: no fragment, lower scheme and host, no default port, no closing slashes.

    A missing scheme is https, an empty path is "/", parameters of the last path
    segment are dropped, the query stays as it is. Null stays null.
    """
    scheme = F.lower(F.when(_part(url, 1) == "", "https").otherwise(_part(url, 1)))
    host = F.lower(_part(url, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(_part(url, 3), r";[^/]*$", "")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    query = _part(url, 4)
    return F.when(url.isNotNull(), F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def host(url: Column) -> Column:
    """Lower-case authority without a leading ``www.``; ports and other subdomains stay."""
    return F.when(url.isNotNull(), F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", ""))


def path(url: Column) -> Column:
    return _part(url, 3)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def same_site(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def is_http(url: Column) -> Column:
    return url.rlike(r"^(?i:https?)://[^/?#]+")


def crawlable(href: Column) -> Column:
    """Whether a link may lead to a page: not empty, no fragment, no skipped scheme or file type."""
    file = F.lower(F.regexp_replace(_part(href, 3), r";[^/]*$", ""))
    ends = "(?:" + "|".join(re.escape(x) for x in SKIPPED_EXTENSIONS) + ")$"
    return (href != "") & ~href.startswith("#") & ~F.lower(_part(href, 1)).isin(*SKIPPED_SCHEMES) & ~file.rlike(ends)


def resolve(href: Column, base: Column) -> Column:
    """An absolute or root-relative link, or one relative to the folder of ``base``, made absolute.

    Dot segments are left to :func:`resolved` inside parsing.
    """
    origin = F.concat(scheme(base), F.lit("://"), _part(base, 2))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.rlike(r"^[?]"), F.concat(origin, path(base), href))
        .when(href.rlike(r"^(#|$)"), base)
        .otherwise(F.concat(origin, F.regexp_extract(F.concat(F.lit("/"), path(base)), r"^/?(.*/)[^/]*$", 1), href))
    )


def local_hint(url: Column) -> Column:
    """Whether the path speaks of contact, hours, places and the like."""
    return F.lower(path(url)).rlike("|".join(LOCAL_HINTS))


def normalized(url: str, base: str | None = None) -> str | None:
    """Twin of :func:`normalize` for one string, resolving against ``base``; None for what is no URL."""
    try:
        parts = urlsplit(urljoin(base, url) if base else url.strip())
        name, where = (parts.scheme or "https").lower(), parts.netloc.lower()
    except ValueError:
        return None
    default = {"http": ":80", "https": ":443"}.get(name)
    if default and where.endswith(default):
        where = where[: -len(default)]
    file = re.sub(r";[^/]*$", "", parts.path)
    file = "/" if file in ("", "/") else file.rstrip("/")
    return f"{name}://{where}{file}" + (f"?{parts.query}" if parts.query else "")


def host_of(url: str) -> str:
    return urlsplit(url).netloc.lower().removeprefix("www.")


def may_lead_to_page(href: str) -> bool:
    """Twin of :func:`crawlable`."""
    if not href or href.startswith("#"):
        return False
    try:
        parts = urlsplit(href)
    except ValueError:
        return False
    return parts.scheme.lower() not in SKIPPED_SCHEMES and not re.sub(r";[^/]*$", "", parts.path).lower().endswith(SKIPPED_EXTENSIONS)


def page_links(hrefs: list[str], base: str) -> list[str]:
    """Distinct absolute links of a page in order."""
    out: dict[str, None] = {}
    for href in hrefs:
        href = href.strip()
        if may_lead_to_page(href):
            link = normalized(href, base)
            if link and re.match(r"https?://[^/?#]+", link):
                out[link] = None
    return list(out)
