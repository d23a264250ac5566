"""Problem 2: text that was decoded with the wrong character encoding.

Round-trip repair. A suspicious stretch is encoded again under each encoding it
may wrongly have been read with and decoded strictly as each encoding it may have
been written in. A round trip is accepted when the garbling cost of the stretch
drops clearly; that is repeated for nested layers. Stretches are looked at in two
widths: runs of characters beyond ASCII (for text written in UTF-8, whose byte
patterns leave no doubt) and whole text nodes and words (for legacy encodings,
where only the cost can tell).

A replacement character marks a place where the bytes are lost: such a row is
reported, its other stretches are repaired.

Defined results: null, empty and ASCII-only texts are never reported; correct
text with unusual letters is left alone; ``restored`` is null where nothing could
be repaired, ``complete`` is false where garbled characters remain.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import spread

#: Encodings that text may wrongly have been read with.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "cp1254", "iso8859-15", "gb18030", "big5", "cp949", "shift_jis")
#: Encodings that text may have been written in besides UTF-8, each with those it is mistaken for.
WRITTEN_IN = {
    "cp1251": ("cp1252", "latin-1", "koi8-r", "mac_roman", "cp866", "cp437", "cp1250", "gb18030"),
    "koi8-r": ("cp1252", "latin-1", "cp1251", "mac_roman", "cp866", "gb18030"),
    "cp866": ("cp1252", "latin-1", "cp1251", "koi8-r", "cp437"),
    "iso8859-5": ("cp1252", "latin-1", "cp1251", "koi8-r"),
    "cp932": ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "gb18030"),
    "euc_jp": ("cp1252", "latin-1", "mac_roman", "gb18030", "cp932"),
    "cp1252": ("mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8-r", "cp866", "gb18030", "cp932"),
    "mac_roman": ("cp1252", "latin-1"),
    "cp437": ("cp1252", "latin-1"),
    "cp850": ("cp1252", "latin-1"),
}
#: Those of them whose characters take several bytes; they never show as letters of small alphabets.
_WIDE = frozenset(("gb18030", "big5", "cp949", "shift_jis"))
LAYERS = 4
#: The least drop of the cost, absolute and as a part, that a round trip of legacy encodings must bring.
LEAST_DROP, LEAST_PART = 0.75, 0.4
LOST = "�"


def _single_byte(encoding: str) -> dict[int, int] | None:
    """Code point -> byte for a one-byte encoding; bytes it leaves undefined are read as controls."""
    table = {}
    for byte in range(256):
        raw = bytes([byte])
        try:
            char = raw.decode(encoding)
        except UnicodeDecodeError:
            if byte >= 0x80 and encoding.startswith(("cp125", "iso", "latin")):
                char = chr(byte)
            else:
                return None
        table[ord(char)] = byte
    if encoding == "cp1252":
        for byte in range(0x80, 0xA0):
            table.setdefault(byte, byte)
    return table


_TABLES = {name: _single_byte(name) for name in READ_AS}


def _bytes(text: str, encoding: str) -> bytes | None:
    if LOST in text:
        return None
    table = _TABLES.get(encoding)
    try:
        return bytes([table[ord(c)] for c in text]) if table else text.encode(encoding)
    except (KeyError, UnicodeEncodeError):
        return None


def _script(code: int) -> str:
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "latin"
    if 0x370 <= code < 0x400:
        return "greek"
    if 0x400 <= code < 0x530:
        return "cyrillic"
    if 0x3040 <= code < 0x3100 or code in (0x30FC, 0x3005) or 0x31F0 <= code < 0x3200:
        return "kana"
    if 0x3400 <= code < 0xA000 or 0xF900 <= code < 0xFB00 or 0x20000 <= code < 0x32000:
        return "han"
    if 0xAC00 <= code < 0xD7B0:
        return "hangul"
    return "other"


#: Letters that the written languages of the tables use beyond ASCII (fixed values).
_COMMON = set("äöüßÄÖÜéèêëàâîïôùûçœæÉÈÊÀÂÎÔÙÛÇŒáíóúñÁÍÓÚÑãõÃÕ")
_COMMON_CYRILLIC = set("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфё")
#: Signs that stand in sound text (fixed values).
_SIGNS = set("’‘“”„«»‹›…–—·•°©®™€£§№¿¡ºª、。・「」『』（）！？：；〜￥　→←↑↓×✓★ \xa0‚")
#: Signs that sound text does not put right after a letter (fixed values).
_ODD_AFTER_LETTER = set("¢£¤¥¦§¨ª¬\xad¯°±²³´µ¶¸¹º¼½¾¿¡†‡‰ƒ‹ˆ˜«¿€‚„©®")


#: Signs that may stand between letters, and signs that rarely follow one without a blank (fixed values).
_JOINERS = set("’·・…\xa0")
_APART = set("«»‹›—–“„")


@lru_cache(maxsize=65536)
def _class(char: str) -> tuple[str, str, float]:
    """(kind, script, base cost) of a character."""
    code = ord(char)
    if code < 0x80:
        return ("L" if char.isalpha() else "a", "ascii", 0.0)
    category = unicodedata.category(char)
    if char == LOST or category in ("Cc", "Cn", "Co", "Cs"):
        return ("x", "none", 4.0)
    if category[0] == "L":
        script = _script(code)
        if script == "latin":
            base = 0.3 if char in _COMMON else 1.0
        elif script == "cyrillic":
            base = 0.25 if char in _COMMON_CYRILLIC else 0.4 if char.lower() in _COMMON_CYRILLIC else 1.6
        else:
            base = {"kana": 0.2, "han": 0.4, "greek": 0.8, "hangul": 0.8, "other": 2.0}[script]
            if 0xFF61 <= code < 0xFFA0:
                base = 1.2
        return ("l", script, base)
    if category[0] == "M":
        return ("m", "none", 2.5)
    if char in _SIGNS or code > 0x1F000:
        return ("s", "none", 0.2)
    return ("y", "none", 1.5)


def cost(text: str) -> float:
    """How garbled ``text`` looks; ASCII costs nothing by itself."""
    total, run, before, kind_before, script_before, sign_after_letter = 0.0, 0, "", "", "", False
    small_start = False
    for char in text:
        kind, script, base = _class(char)
        total += base
        if kind == "l":
            run = run + 1 if script == "latin" else 0
            if run > 2:
                total += 0.8
            if kind_before in ("l", "L"):
                mine, other = ("latin" if s == "ascii" else s for s in (script, script_before))
                if mine != other and not {mine, other} <= {"latin", "han", "kana"}:
                    total += 1.5
                elif {mine, other} == {"latin", "han"}:
                    total += 0.5
                if before.islower() and char.isupper():
                    total += 1.2
                elif small_start and char.isupper():
                    total += 0.6
            elif kind_before == "y":
                total += 0.5
            if kind_before not in ("l", "L"):
                small_start = char.islower()
        else:
            run = 0
            if kind == "L" and kind_before == "l":
                if script_before in ("cyrillic", "greek"):
                    total += 1.5
                elif script_before == "han":
                    total += 0.5
                elif before.islower() and char.isupper():
                    total += 1.2
            if char == "\xa0" and before in ("Ã", "Â"):
                total += 0.4
            if base and kind != "x" and char in _ODD_AFTER_LETTER and kind_before in ("l", "L", "y"):
                total += 0.9
        if sign_after_letter and kind in ("l", "L") and script not in ("han", "kana"):
            total += 1.2
        sign_after_letter = kind == "s" and char not in _JOINERS and kind_before in ("l", "L") and script_before not in ("han", "kana")
        if sign_after_letter and char in _APART:
            total += 0.3
        before, kind_before, script_before = char, kind, script
    return total


#: What Japanese without kana costs more: Han characters alone are short, so they look cheap.
_NO_KANA, _KANA = 1.0, re.compile("[\u3040-\u30ff]")
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_RUN = re.compile(r"[^\x00-\x7f]+")
_NODE = re.compile(r"[^<>\n]+")
_WORD = re.compile(r"[^\s<>]+")


@lru_cache(maxsize=16384)
def _repair_run(run: str, left: str, right: str) -> str | None:
    """The text a run of characters beyond ASCII was in UTF-8, with its neighbours for the cost."""
    best, least = None, cost(left + run + right)
    limit = least - 0.25
    for encoding in READ_AS:
        raw = _bytes(run, encoding)
        if raw is None:
            continue
        if encoding in _WIDE and any(ord(c) < 0x2000 for c in run):
            continue
        covered = sum(m.end() - m.start() for m in _UTF8.finditer(raw))
        if not covered:
            continue
        if _strict(raw):
            new = raw.decode("utf-8")
        elif covered >= 0.5 * len(raw) and _TABLES.get(encoding):
            new = _partly(run, raw)
        else:
            new = None
        if new is None:
            continue
        now = cost(left + new + right)
        if now < limit and _plausible(new):
            best, limit = new, now - 1e-9
    return best


_STRANGE = re.compile("[\u0530-\u1dff\u2c00-\u2e7f\ua000-\uabff\ud7b0-\uf8ff\ufb00-\ufe2f\ufe50-\ufeff]")


def _plausible(text: str) -> bool:
    """Whether a repair ends in scripts that are written here; layers still garbled show none of the others."""
    return not _STRANGE.search(text) and all(c < "\x80" or (k := _class(c))[0] != "m" and k[1] != "other" for c in text)


def _strict(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _partly(run: str, raw: bytes) -> str | None:
    """Decode the parts that are UTF-8 and keep the rest; one byte is one character."""
    out, at = [], 0
    for m in _UTF8.finditer(raw):
        if not _strict(m[0]) or any(ord(c) >= 0x2E80 for c in m[0].decode("utf-8")):
            return None
        out += [run[at : m.start()], m[0].decode("utf-8")]
        at = m.end()
    return "".join([*out, run[at:]])


def _utf8_pass(text: str) -> str:
    def put(m: re.Match) -> str:
        a, b = m.span()
        return _repair_run(m[0], text[max(0, a - 1) : a], text[b : b + 1]) or m[0]

    return _RUN.sub(put, text)


@lru_cache(maxsize=4096)
def _legacy(stretch: str) -> tuple[str, tuple[str, str]] | None:
    """The best strict round trip between legacy encodings and its pair, if its cost is clearly lower."""
    before = cost(stretch)
    if before < LEAST_DROP:
        return None
    best, limit = None, min(before - LEAST_DROP, before * (1 - LEAST_PART))
    encoded = {name: _bytes(stretch, name) for name in {x for read in WRITTEN_IN.values() for x in read}}
    for written, read in WRITTEN_IN.items():
        for name in read:
            raw = encoded[name]
            if raw is None or (name in ("gb18030", "cp932") and written in ("cp1252",) and len(raw) < 4):
                continue
            try:
                new = raw.decode(written)
            except UnicodeDecodeError:
                continue
            now = cost(new) + (_NO_KANA if written in ("cp932", "euc_jp") and not _KANA.search(new) else 0.0)
            if now < limit:
                best, limit = (new, (name, written)), now
    return best


#: What no sound text shows: odd characters, letters of two scripts in a word, signs and
#: capitals after letters they do not follow. Texts without it are left alone. It begins
#: with the character beyond ASCII that all of it has, so that plain text is skipped.
SCREEN = (
    "[^\u0000-\u007F](?:"
    "(?<=[^\u0000-\u007FäöüßÄÖÜéèêëàâîïôùûçœæÉÈÊÀÂÎÔÙÛÇŒáíóúñÁÍÓÚÑãõÃÕА-яЁё’‘“”„«»‹›…–—·•©®™€£§№¿¡ºª→←↑↓×✓★\u00A0"
    "\u3000-\u30FF\u3400-\u9FFF\uFF00-\uFF60\uFFE5\uD800-\uDFFF\U00010000-\U0010FFFF])"
    "|(?<=[À-ÿ])[À-ÿ]{2}|(?<=[À-ÿА-яЁё])[^\u0000-\u007FÀ-ÿА-яЁё’”»«…–—\u3000-\u9FFF]|(?<=[À-ÿ])[’”»«–—€£…][^\\s<]|(?<=[ÂÃâ])[^\u0000-\u007FÀ-ÿ]"
    "|(?<=[a-zß-ÿ][À-ÖØ-Þ])|(?<=[а-яё][А-ЯЁ])|(?<=[A-Za-zÀ-ÿ][А-яЁё])|(?<=[А-яЁё])[A-Za-zÀ-ÿ]"
    "|(?<=[îìí])[ .,;<]|(?<=[ >][ìÈÉ])[a-z]|(?<=[\u3400-\u9FFF])[a-z]|(?<=[a-z][\u3400-\u9FFF])(?![\u3000-\u9FFF])|(?<=[㐀-鿿])[À-ÿ�])"
)
_SCREEN = re.compile(SCREEN)


def _legacy_pass(text: str) -> str:
    pairs: set[tuple[str, str]] = set()

    def word(m: re.Match) -> str:
        found = None if m[0].isascii() else _legacy(m[0])
        if found is None:
            return m[0]
        pairs.add(found[1])
        return found[0]

    def put(m: re.Match) -> str:
        node = m[0]
        if node.isascii() or not _SCREEN.search(node):
            return node
        found = _legacy(node)
        if found is not None:
            pairs.add(found[1])
            return found[0]
        return _WORD.sub(word, node)

    def again(m: re.Match) -> str:
        """A node too short to tell by itself: the round trip that mended most of the text."""
        raw = None if m[0].isascii() else _bytes(m[0], pair[0])
        try:
            new = raw.decode(pair[1]) if raw else m[0]
        except UnicodeDecodeError:
            return m[0]
        return new if cost(new) <= cost(m[0]) - 0.05 else m[0]

    new = _NODE.sub(put, text)
    if len(pairs) == 1:
        pair = pairs.pop()
        new = _NODE.sub(again, new)
    return new


#: Characters beyond ASCII that are written as numbers, as pages do.
_NUMBERED = re.compile(r"&#(?:(1[3-9]\d|12[89]|[2-9]\d{2}|\d{4,6})|[xX](0*[8-9a-fA-F][0-9a-fA-F]|0*[1-9a-fA-F][0-9a-fA-F]{2,5}));")


def repair(text: str | None) -> tuple[bool, str | None, bool]:
    """(is a case, restored text or None, whether nothing garbled is left).

    Characters written as numeric references are looked at as the characters they stand for.
    """
    if not text:
        return False, None, True
    if "&#" in text:
        text = _NUMBERED.sub(lambda m: unescape(m[0]), text)
    if text.isascii() or not _SCREEN.search(text):
        return False, None, True
    now = text
    for _ in range(LAYERS):
        new = _utf8_pass(now)
        if new == now:
            new = _legacy_pass(now)
        if new == now:
            break
        now = new
    lost = LOST in now or any(0x80 <= ord(c) < 0xA0 for c in set(now))
    if now != text:
        return True, now, not lost
    return lost, None, not lost


SCHEMA = "table_name string, row_id long, restored string, complete boolean"


def _repair_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for name, row_id, text in pdf.itertuples(index=False):
            case, restored, complete = repair(text)
            if case:
                rows.append((name, row_id, restored, complete))
        yield pd.DataFrame(rows, columns=["table_name", "row_id", "restored", "complete"])


def repair_table(df: DataFrame, name: str, row_id: str, text: str) -> DataFrame:
    """The rows of ``df`` whose ``text`` was wrongly decoded, with what could be restored."""
    rows = spread(df.select(F.lit(name).alias("table_name"), F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"))).filter(F.col("text").rlike(r"[^\x00-\x7F]|&#"))
    return rows.mapInPandas(_repair_batches, SCHEMA)


def repair_encoding(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Wrongly decoded page bodies and answer excerpts."""
    return repair_table(pages, "crawl_archive", "page_id", "html").unionByName(repair_table(answers, "answer", "answer_id", "excerpt"))
