"""Problem 1: cut oversized texts into pieces at content-defined places.

A rolling hash over the last ``WINDOW`` characters marks landmarks. Each
landmark snaps to the nearest natural boundary around it; the cuts are taken
from the snapped landmarks between a least and a greatest piece size. Whether a
place is a cut depends on the text near it and on where the piece began, so after
an edit the cuts fall back into step at the next shared landmark and only the
pieces around the edit change.

Defined results: a null or empty text and a text within the limit have no
pieces; a limit of null keeps the text whole. Pieces are numbered from 0; piece
k > 0 begins exactly ``overlap`` characters before the end of piece k - 1, and
the pieces without their overlaps join to the text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import spread

WINDOW = 16
#: A landmark about every so many characters of the space a piece has.
LANDMARKS_A_PIECE = 4
#: How far a landmark looks for a boundary, as a part of the space a piece has.
SNAP_PART = 0.12

_GEAR = np.random.default_rng(20240611).integers(1, 2**63, size=4096, dtype=np.uint64)
_BOUNDARIES = (
    (4, re.compile(r"\n[ \t]*\n\s*|(?=<(?:p|div|section|article|main|aside|nav|header|footer|h[1-6]|ul|ol|table)\b)", re.I)),
    (3, re.compile(r"\n|<br\s*/?>|</(?:p|li|div|tr|h[1-6])\s*>|(?=<(?:li|tr)\b)", re.I)),
    (2, re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？][」』”）]*")),
    (1, re.compile(r"\s+|>(?=[^<])")),
)


def rolling_hash(text: str) -> np.ndarray:
    """Hash of the ``WINDOW`` characters before each position 0..len(text)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    gear = _GEAR[codes % len(_GEAR)] + codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    for back in range(min(WINDOW, len(codes))):
        out[back + 1 :] += gear[: len(codes) - back] << np.uint64(back)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def boundary_ranks(text: str) -> np.ndarray:
    """Rank of the natural boundary at each position, 0 where there is none."""
    ranks = np.zeros(len(text) + 1, dtype=np.int8)
    for rank, pattern in _BOUNDARIES:
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64)
        if len(ends):
            ranks[ends] = np.maximum(ranks[ends], rank)
    return ranks


def _snap(at: int, low: int, high: int, ranks: np.ndarray, radius: int) -> int | None:
    """Nearest boundary of the best rank within ``radius`` of ``at`` and in [low, high]."""
    a, b = max(low, at - radius), min(high, at + radius)
    if a > b:
        return None
    part = ranks[a : b + 1]
    best = part.max(initial=0)
    if best == 0:
        return None
    places = np.flatnonzero(part == best) + a
    return int(places[np.argmin(np.abs(places - at))])


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces of ``text``; a text within ``limit`` has one."""
    if len(text) <= limit:
        return [len(text)]
    overlap = max(0, min(overlap, limit - 1))
    space = max(1, limit - overlap)
    least = max(1, min(space, max(overlap, space // 4)))
    radius = max(1, int(space * SNAP_PART))
    hashes, ranks = rolling_hash(text), boundary_ranks(text)
    landmarks = np.flatnonzero(hashes % np.uint64(max(1, space // LANDMARKS_A_PIECE)) == 0)
    ends, start = [], 0
    while len(text) - start > space:
        low, high = start + least, start + space
        first, last = np.searchsorted(landmarks, [low, high + 1])
        cut, best = None, 0
        for mark in landmarks[first:last]:
            place = _snap(int(mark), low, high, ranks, radius)
            if place is not None and ranks[place] > best:
                cut, best = place, ranks[place]
                if best >= 2:
                    break
        if cut is None:
            part = ranks[low : high + 1]
            places = np.flatnonzero(part == part.max()) + low
            cut = int(places[np.argmax(hashes[places])])
        ends.append(cut)
        start = cut
    return [*ends, len(text)]


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece, the overlap with the piece before included."""
    ends = cuts(text, limit, overlap)
    overlap = max(0, min(overlap, limit - 1))
    return [(max(0, a - overlap) if k else 0, b) for k, (a, b) in enumerate(zip([0, *ends], ends))]


SCHEMA = "item_kind string, item_id long, piece_no int, n_pieces int, start_char int, end_char int, piece string"


def _cut_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    for pdf in batches:
        rows = []
        for kind, item, text, limit, overlap in pdf.itertuples(index=False):
            spans = pieces(text, int(limit), int(overlap))
            rows += [(kind, item, k, len(spans), a, b, text[a:b]) for k, (a, b) in enumerate(spans)]
        yield pd.DataFrame(rows, columns=columns)


def split_oversized(items: DataFrame, limits: DataFrame, kind: str, item_id: str | Column, text: str | Column) -> DataFrame:
    """Pieces of every text of ``items`` that is longer than the limit of ``kind``.

    ``limits`` is the small table of limits by kind, of which one row is read.
    Texts within the limit never reach Python.
    """
    own = limits.filter(F.col("item_kind") == kind).agg(F.min("max_chars"), F.min("overlap_chars")).first()
    text_of = F.col(text) if isinstance(text, str) else text
    rows = items.select(F.lit(kind).alias("item_kind"), (F.col(item_id) if isinstance(item_id, str) else item_id).alias("item_id"), text_of.alias("text"))
    over = spread(rows).filter(F.char_length("text") > own[0] if own[0] and own[0] > 0 else F.lit(False))
    over = over.select("item_kind", "item_id", "text", F.lit(own[0] or 0).alias("max_chars"), F.lit(own[1] or 0).alias("overlap_chars"))
    return over.mapInPandas(_cut_batches, SCHEMA)


def audit_pieces(passages: DataFrame, pages: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the oversized passages and page bodies."""
    return split_oversized(passages, limits, "passage", "passage_id", "text").unionByName(split_oversized(pages, limits, "html", "page_id", "html"))
