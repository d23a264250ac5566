"""Pages parsed once: a lenient tree on the standard library's parser and the features taken from it.

``features`` is the only place where pages enter Python; everything after it is
Catalyst expressions over its columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dealt
from .lexicon import BLOCK_CHARS, MICRODATA_TYPES, NAP_TYPES
from .urls import page_links

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open element of the listed kinds, up to a boundary.
ENDS = {
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
BOUNDARY = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
SILENT = frozenset(("script", "style", "template"))
INVISIBLE = frozenset(("script", "style", "noscript", "svg", "iframe", "canvas", "template"))
NO_CONTENT = INVISIBLE | {"nav", "header", "footer", "form"}
BLOCKS = frozenset(("p", "li", "h1", "h2", "h3", "h4", "td", "address", "article", "div"))
_WHITE = re.compile(r"\s+")
_CHROME_ROLE = re.compile(r"navigation|banner|contentinfo", re.I)


class Node:
    """An element with its attributes, children (elements and strings) and parent."""

    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent

    def walk(self, without: frozenset[str] = frozenset()) -> Iterator[Node]:
        """The elements below in document order."""
        stack = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while stack:
            node = stack.pop()
            if node.tag not in without:
                yield node
                stack += [k for k in reversed(node.kids) if isinstance(k, Node)]

    def strings(self, without: frozenset[str] = SILENT) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.kids))
        while stack:
            kid = stack.pop()
            if isinstance(kid, str):
                yield kid
            elif kid.tag not in without:
                stack += reversed(kid.kids)

    def text(self, without: frozenset[str] = SILENT) -> str:
        """Stripped strings joined by blanks."""
        return " ".join(s for s in (x.strip() for x in self.strings(without)) if s)


class Tree(HTMLParser):
    """Builds a tree and closes what authors left open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def updatepos(self, i: int, j: int) -> int:
        return j

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for name in ENDS.get(tag, ()):
            self._close(name, BOUNDARY.get(tag, ("table", "td", "button")))
        node = Node(tag, {}, self.at)
        for key, value in attrs:
            node.attrs.setdefault(key, value or "")
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        self._close(tag, ())

    def _close(self, tag: str, boundary: tuple[str, ...]) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            if node.tag in boundary:
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; what stands before a fatal error is kept."""
    tree = Tree()
    try:
        tree.feed(html or "")
        tree.close()
    except Exception:  # noqa: BLE001 - broken declarations
        pass
    return tree.root


def visible_text(root: Node) -> str:
    return _WHITE.sub(" ", " ".join(root.strings(INVISIBLE))).strip()


_STRAY_COMMA = re.compile(r",(?=\s*[\]}])")


def _loaded(text: str) -> object | None:
    """The value of a linked-data script, stray commas aside; None if it is broken."""
    for mend in (False, True):
        try:
            return json.loads(_STRAY_COMMA.sub("", text) if mend else text)
        except ValueError:
            pass
    return None


def json_ld(root: Node) -> list:
    """The items of all linked-data scripts: lists and graphs give theirs, anything else is one item."""
    items: list = []
    for node in root.walk():
        if node.tag != "script" or "ld+json" not in node.attrs.get("type", "").lower():
            continue
        value = _loaded("".join(filter(lambda k: isinstance(k, str), node.kids)).strip())
        inner = value["@graph"] if isinstance(value, dict) and isinstance(value.get("@graph"), list) else value
        if isinstance(inner, list):
            items.extend(inner)
        elif inner is not None:
            items.append(inner)
    return items


def schema_types(item: object) -> list[str]:
    """The types an item names, as strings."""
    named = item.get("@type", []) if isinstance(item, dict) else []
    return [str(t) for t in (named if isinstance(named, list) else [named]) if t]


#: Parts of a linked address in the order of writing, and the fields that they fill (fixed values; a country fills none).
_ADDRESS_PARTS = {"streetAddress": "street_address", "addressLocality": "city", "addressRegion": "region", "postalCode": "postal_code", "addressCountry": None}


def _plain(value: object) -> str:
    """The text of a linked-data value: its name, its @value, or itself."""
    if isinstance(value, dict):
        value = value.get("name", value.get("@value"))
    return str(value).strip() if value else ""


def _each(value: object) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def _address_fields(address: object) -> Iterator[tuple[str, str]]:
    if not isinstance(address, dict):
        yield "full_address", _plain(address)
        return
    texts = {part: _plain(address.get(part)) for part in _ADDRESS_PARTS}
    yield from ((field, texts[part]) for part, field in _ADDRESS_PARTS.items() if field)
    yield "full_address", ", ".join(filter(None, texts.values()))


def _own_fields(item: dict) -> Iterator[tuple[str, str]]:
    """(field, value) that an item states of itself."""
    known = any(t.lower() in NAP_TYPES for t in schema_types(item))
    if not (known or item.keys() & {"telephone", "address"}):
        return
    yield "business_name", _plain(item.get("name"))
    yield from (("phone", _plain(number)) for number in _each(item.get("telephone") or item.get("phone")))
    for address in _each(item.get("address")):
        yield from _address_fields(address)


def _descend(value: object) -> Iterator[dict]:
    """The objects within a linked-data value, itself first, in document order."""
    stack = [value]
    while stack:
        value = stack.pop()
        if isinstance(value, dict):
            yield value
            stack += [v for k, v in reversed(value.items()) if k[:1] != "@"]
        elif isinstance(value, list):
            stack += reversed(value)


def linked_nap(item: object) -> list[tuple[str, str]]:
    """(field, value) of names, phones and addresses in a linked-data item, at any depth."""
    return [pair for found in _descend(item) for pair in _own_fields(found) if pair[1]]


def _microdata(root: Node) -> list[tuple[str, str]]:
    fields = {"telephone": "phone", "phone": "phone", "streetaddress": "street_address", "addresslocality": "city", "addressregion": "region", "postalcode": "postal_code"}
    out = []
    for node in root.walk():
        prop = node.attrs.get("itemprop", "").lower()
        if not prop:
            continue
        value = (node.attrs.get("content") or node.text()).strip()
        if prop == "name":
            scope = node.parent
            while scope is not None and "itemtype" not in scope.attrs:
                scope = scope.parent
            kind = (scope or node).attrs.get("itemtype", "").lower()
            if any(k in kind for k in MICRODATA_TYPES):
                out.append(("business_name", value))
        elif prop in fields:
            out.append((fields[prop], value))
    return [(f, v) for f, v in out if v]


def _content_blocks(root: Node) -> tuple[list[str], str]:
    """(texts of the content blocks, text of the content root)."""
    top = next((n for n in root.walk(NO_CONTENT) if n.tag == "main"), None) or next((n for n in root.walk(NO_CONTENT) if n.tag == "article"), None) or root
    hidden = {id(n) for n in root.walk() if _CHROME_ROLE.search(n.attrs.get("role", ""))}

    def shown(node: Node) -> Iterator[Node]:
        for kid in node.kids:
            if isinstance(kid, Node) and kid.tag not in NO_CONTENT and id(kid) not in hidden:
                yield kid
                yield from shown(kid)

    def text(node: Node) -> str:
        parts: list[str] = []
        stack: list[Node | str] = list(reversed(node.kids))
        while stack:
            kid = stack.pop()
            if isinstance(kid, str):
                if kid.strip():
                    parts.append(kid.strip())
            elif kid.tag not in NO_CONTENT and id(kid) not in hidden:
                stack += reversed(kid.kids)
        return " ".join(parts)

    blocks = []
    for node in shown(top):
        if node.tag in BLOCKS:
            if node.tag == "div" and sum(n.tag == "div" for n in shown(node)) > 3:
                continue
            found = text(node)
            if len(found) >= BLOCK_CHARS:
                blocks.append(found)
    return blocks, _WHITE.sub(" ", text(top)).strip()


SCHEMA = (
    "page_id long, title string, has_title boolean, lang string, charset string, metas array<struct<name:string,property:string,content:string>>,"
    " links array<struct<rel:string,href:string>>, headings array<struct<level:int,text:string>>,"
    " anchors array<struct<has_href:boolean,href:string,text:string>>, imgs array<struct<has_alt:boolean,src:string>>,"
    " n_json_ld int, types array<string>, linked array<struct<field:string,value:string>>, microdata array<struct<field:string,value:string>>,"
    " targets array<string>, text string, header_text string, footer_text string, blocks array<string>, root_text string"
)


def page_features(page_id: int, url: str, html: str) -> tuple:
    """All features of one page, in the order of ``SCHEMA``."""
    root = parse(html)
    first: dict[str, Node] = {}
    metas, links, headings, anchors, imgs = [], [], [], [], []
    charset = equiv = None
    for node in root.walk():
        a = node.attrs
        first.setdefault(node.tag, node)
        if node.tag == "meta":
            metas.append((a.get("name", "").lower(), a.get("property", "").lower(), a.get("content", "").strip()))
            if charset is None and "charset" in a:
                charset = a["charset"]
            if equiv is None and "content-type" in a.get("http-equiv", "").lower():
                equiv = a.get("content", "")
        elif node.tag == "link" and "rel" in a:
            links.append((a["rel"].lower(), a.get("href", "").strip()))
        elif len(node.tag) == 2 and node.tag[0] == "h" and node.tag[1] in "123456":
            headings.append((int(node.tag[1]), node.text()))
        elif node.tag == "a":
            anchors.append(("href" in a, a.get("href", ""), node.text()))
        elif node.tag == "img":
            imgs.append(("alt" in a, (a.get("src") or a.get("data-src") or "[no src]")[:80]))
    items = json_ld(root)
    blocks, root_text = _content_blocks(root)
    title, lang = first.get("title"), first["html"].attrs.get("lang", "").strip() if "html" in first else ""
    return (
        page_id,
        title.text() if title else "",
        title is not None,
        lang or None,
        (charset if charset is not None else equiv) or None,
        metas,
        links,
        headings,
        anchors,
        imgs,
        len(items),
        sorted({t.lower() for item in items for t in schema_types(item)}),
        [pair for item in items for pair in linked_nap(item)],
        _microdata(root),
        page_links([href for has, href, _ in anchors if has], url),
        visible_text(root),
        first["header"].text() if "header" in first else "",
        first["footer"].text() if "footer" in first else "",
        blocks,
        root_text,
    )


_NAMES = re.findall(r"(?:^|,) ?(\w+) (?=long|string|boolean|int|array)", SCHEMA)


def _batches(carry: list[str], integers: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [page_features(i, base, html) if html else (i, *[None] * (len(_NAMES) - 1)) for i, base, html in zip(pdf["page_id"], pdf["_base"], pdf["html"])]
            out = pd.DataFrame(rows, columns=_NAMES, dtype=object)
            for name in carry:
                out[name] = pd.array(pdf[name], dtype="Int64") if name in integers else pdf[name].to_numpy()
            yield out

    return run


def features(pages: DataFrame, carry: str = "", every: bool = False) -> DataFrame:
    """The features of every page with html, with the columns of ``carry`` (a schema) as they are.

    ``every`` keeps pages without html too; their features are null.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    kinds = dict(c.split() for c in carry.split(", ")) if carry else {}
    base = F.col("page") if "page" in pages.columns else F.coalesce(F.nullif("final_url", F.lit("")), "url", F.lit(""))
    rows = pages if every else pages.filter(F.col("html").isNotNull() & (F.col("html") != ""))
    rows = rows.select("page_id", base.alias("_base"), "html", *kinds)
    integers = [n for n, k in kinds.items() if k in ("int", "long")]
    return dealt(rows).mapInPandas(_batches(list(kinds), integers), f"{SCHEMA}, {carry}" if carry else SCHEMA)
