"""Problem 7: notebooks that contain text of held-out test items.

Latent semantic retrieval:

1. One pass over all notebooks turns each text into words (escapes, entities,
   markup, case and punctuation aside), counts in how many notebooks each word of
   the test items stands, and keeps the stretches that could hold a leak: a run of
   ``LEAST`` words, of which at most one in eight differs, has so many words of
   the items' vocabulary that no leak can be lost here.
2. Windows over these stretches and over the items become TF-IDF vectors over the
   items' vocabulary. A distributed randomised SVD (random range finder with a
   power step) gives the latent space: each task multiplies its own windows and the
   partial products are summed on the executors, one block of vocabulary rows a
   task. Vocabulary and rank bound what reaches the driver, not the corpus.
3. Each window of a notebook takes every window of an item whose cosine in the
   latent space reaches ``COSINE`` as a candidate.
4. Candidates are checked by a longest common subsequence of bounded width: the
   alignments of the two texts that reach furthest with each number of changed words,
   of which at most one in eight may be replaced, misspelt or added. A text that is only
   alike is told by what was changed: words side by side that take in every name and
   number of the run.

Items that share a text are one text in the search and each of them a case in the
result. Defined results: null and empty texts, contexts and questions, and item
texts of fewer than ``LEAST`` words give no pairs; repeated notebooks are each
reported; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, spread

LEAST, ONE_IN = 15, 8
#: Words in a window and words between the starts of two windows.
WINDOW, STEP = 20, 5
RANK, OVERSAMPLE, SEED = 160, 16, 7
COSINE = 0.55
#: Blocks of vocabulary rows in which partial products are summed, each by one task.
ROW_BLOCKS = 24

_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\[nrtfbv\"'`/\\]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--[^<>]*-->")
_ENTITY = re.compile(r"&#?\w{1,10};")
_WORD = re.compile(r"[^\W_]+")


def _bare(text: str) -> str:
    """A text without escapes, entities and markup."""
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: unescape(m[0]), text)
    return _TAG.sub(" ", text) if "<" in text else text


def words(text: str) -> list[str]:
    """Words in lower case without escapes, entities and markup."""
    return _WORD.findall(_bare(text).lower())


_STARTS = re.compile(r"(?:^|[.!?:…\"“„«])\W*$")


def named(text: str) -> list[bool]:
    """Which of the words are names or numbers: with a digit, or with a capital within a sentence."""
    text = _bare(text)
    return [any(c.isdigit() for c in m[0]) or m[0][0].isupper() and not _STARTS.search(text, max(0, m.start() - 12), m.start()) for m in _WORD.finditer(text)]


def least_known(length: int = LEAST) -> int:
    """Words of ``length`` words of a leak that are surely words of the item.

    One in eight of a longer run may be bunched in these; two edits in ``length``
    words is what runs up to twice that length allow, and an added word takes a place too.
    """
    return length - 2 * (length // ONE_IN + 1)


class Items:
    """The distinct texts of the test items, their vocabulary and their windows."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]]) -> None:
        texts: dict[tuple[str, ...], set[int]] = defaultdict(set)
        names: dict[tuple[str, ...], list[bool]] = {}
        for item_id, context, question in rows:
            for text in (context, question):
                found = tuple(words(text)) if text else ()
                if len(found) >= LEAST:
                    texts[found].add(item_id)
                    flags = named(text)
                    names.setdefault(found, flags if len(flags) == len(found) else [False] * len(found))
        self.names = [names[t] for t in texts]
        self.ids = [sorted(ids) for ids in texts.values()]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.texts = [np.array([self.vocabulary[w] for w in t], dtype=np.int32) for t in texts]
        self.windows = [(k, t[a : a + WINDOW]) for k, t in enumerate(self.texts) for a in _starts(len(t))]
        self.pairs = [set(zip(t.tolist(), t[1:].tolist())) for t in self.texts]


def _starts(length: int) -> list[int]:
    """Starts of windows that cover ``length`` words; the last one ends with them."""
    last = max(0, length - WINDOW)
    return [*range(0, last, STEP), last]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Parts of a text (word ids, -1: not in the vocabulary) in which a leak may lie."""
    if len(ids) < LEAST - 2:
        return []
    known = np.concatenate(([0], np.cumsum(ids >= 0)))
    length = min(LEAST, len(ids))
    dense = np.flatnonzero(known[length:] - known[:-length] >= least_known())
    if not len(dense):
        return []
    breaks = np.flatnonzero(np.diff(dense) > length)
    first = np.concatenate(([0], breaks + 1))
    last = np.concatenate((breaks, [len(dense) - 1]))
    return [(int(dense[a]), int(dense[b]) + length) for a, b in zip(first, last)]


_SCANNED = "doc_id long, ids array<int>, term int, n long"


def _scan(vocabulary: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(len(vocabulary) + 1, dtype=np.int64)
        get = vocabulary.get
        for pdf in batches:
            rows = []
            for doc_id, text in pdf.itertuples(index=False):
                counts[-1] += 1
                ids = np.array([get(w, -1) for w in words(text)], dtype=np.int32)
                counts[np.unique(ids[ids >= 0])] += 1
                rows += [(doc_id, ids[a:b].tolist()) for a, b in stretches(ids)]
            if rows:
                out = pd.DataFrame(rows, columns=["doc_id", "ids"])
                out["term"], out["n"] = None, None
                yield out
        terms = np.flatnonzero(counts)
        yield pd.DataFrame({"doc_id": pd.array([pd.NA] * len(terms), dtype="Int64"), "ids": None, "term": terms, "n": counts[terms]})

    return run


def _vectors(windows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Rows of unit TF-IDF vectors."""
    out = np.zeros((len(windows), len(idf)), dtype=np.float32)
    for k, ids in enumerate(windows):
        ids = ids[ids >= 0]
        np.add.at(out[k], ids, idf[ids])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def _doc_windows(ids: np.ndarray) -> list[np.ndarray]:
    return [ids[a : a + WINDOW] for a in _starts(len(ids))]


#: Windows whose vectors are held at once.
BLOCK = 512


def _blocks(batches: Iterator[pd.DataFrame], idf: np.ndarray) -> Iterator[tuple[list[tuple[int, np.ndarray]], np.ndarray]]:
    """Blocks of (document, window ids) with their vectors."""
    held: list[tuple[int, np.ndarray]] = []
    for pdf in batches:
        for doc_id, ids in zip(pdf["doc_id"], pdf["ids"]):
            held += [(doc_id, w) for w in _doc_windows(np.asarray(ids, dtype=np.int32))]
            while len(held) >= BLOCK:
                yield held[:BLOCK], _vectors([w for _, w in held[:BLOCK]], idf)
                held = held[BLOCK:]
    if held:
        yield held, _vectors([w for _, w in held], idf)


_PART = "block int, part binary"


def _height(n_rows: int) -> int:
    """Rows of one block of a product."""
    return max(1, -(-n_rows // ROW_BLOCKS))


def _added(width: int):
    """The sum of the partial products of one block; the parts pass by one Arrow batch at a time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for part in pdf["part"]:
                block = np.frombuffer(part, dtype=np.float32).reshape(-1, width)
                total = block.astype(np.float64) if total is None else total + block
        yield pd.DataFrame({"block": [key[0]], "part": [total.astype(np.float32).tobytes()]})

    return run


def _product(found: DataFrame, idf: np.ndarray, own: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) of the TF-IDF matrix A of the notebooks' windows and of the items' (``own``)."""
    shared = found.sparkSession.sparkContext.broadcast((idf, basis))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, right = shared.value
        total = np.zeros_like(right)
        for _, x in _blocks(batches, weights):
            total += x.T @ (x @ right)
        step = _height(len(total))
        ats = range(0, len(total), step)
        yield pd.DataFrame({"block": [at // step for at in ats], "part": [total[at : at + step].astype(np.float32).tobytes() for at in ats]})

    total = own.T @ (own @ basis)
    parts = found.mapInPandas(run, _PART).groupBy("block").applyInPandas(_added(basis.shape[1]), _PART)
    for row in parts.collect():
        block = np.frombuffer(row.part, dtype=np.float32).reshape(-1, basis.shape[1])
        at = row.block * _height(len(basis))
        total[at : at + len(block)] += block
    return total


def latent_space(found: DataFrame, idf: np.ndarray, own: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors (vocabulary x rank) by a randomised SVD."""
    rng = np.random.default_rng(SEED)
    size = min(rank + OVERSAMPLE, len(idf))
    basis, _ = np.linalg.qr(_product(found, idf, own, rng.standard_normal((len(idf), size)).astype(np.float32)))
    applied = _product(found, idf, own, basis.astype(np.float32))
    basis, _ = np.linalg.qr(applied)
    values, turn = np.linalg.eigh(basis.T @ _product(found, idf, own, basis.astype(np.float32)))
    order = np.argsort(values)[::-1][: min(rank, int((values > 1e-6 * values.max()).sum()))]
    return (basis @ turn[:, order]).astype(np.float32)


def _beginnings(ids: list[int], pairs: set[tuple[int, int]]) -> list[int]:
    """Places of a text at which a run may begin, by the pairs of neighbours that it shares with the item.

    The first ``LEAST`` words of a run hold three changes at most, each of which breaks
    two pairs, and stand within so many words of the text and three more.
    """
    shared = np.concatenate(([0], np.cumsum([pair in pairs for pair in zip(ids, ids[1:])], dtype=np.int64)))
    at = np.arange(max(0, len(ids) - LEAST + 4))
    ends = np.minimum(at + LEAST + 2, len(ids) - 1)
    return at[shared[ends] - shared[at] >= LEAST - 1 - 2 * 3].tolist() if len(at) else []


def leak(doc: np.ndarray, item: np.ndarray, names: list[bool], pairs: set[tuple[int, int]] | None = None) -> tuple[int, int] | None:
    """(words, changed words) of a run of ``item`` in ``doc`` of at least ``LEAST`` words with one in eight changed at most, or None.

    A run begins and ends with equal words. From each place where one can begin, the
    alignments that reach furthest along each diagonal are kept for every number of
    changes. An alignment that is more than two changes ahead of one in eight is given
    up: without its beginning the rest of such a run is long enough and has a place to
    begin of its own.
    """
    own, ids = item.tolist(), doc.tolist()
    begins = _beginnings(ids, set(zip(own, own[1:])) if pairs is None else pairs)
    if not begins:
        return None
    places = defaultdict(list)
    for j, w in enumerate(own):
        places[w].append(j)
    n, m = len(ids), len(own)
    for i in begins:
        for j in places.get(ids[i], ()):
            if m - j < LEAST or (i and j and ids[i - 1] == own[j - 1]):
                continue
            level: dict[int, tuple[int, tuple[int, ...]]] = {i - j: (j, ())}
            changes = 0
            while level:
                following: dict[int, tuple[int, tuple[int, ...]]] = {}
                for d, (at, changed) in level.items():
                    end = at
                    while end < m and end + d < n and ids[end + d] == own[end]:
                        end += 1
                    length = end - j
                    if end > at and length >= LEAST and changes * ONE_IN <= length and not _only_alike(changed, names, j, end):
                        return length, changes
                    if (changes + 1) * ONE_IN - length > 2 * ONE_IN:
                        continue
                    # replaced, added, left out; an added word is written as its place below zero
                    for diagonal, to, mark in ((d, end + 1, end), (d + 1, end, ~end), (d - 1, end + 1, end)):
                        if to < m and to + diagonal < n and (diagonal not in following or following[diagonal][0] < to):
                            following[diagonal] = (to, (*changed, mark))
                changes += 1
                level = following if changes * ONE_IN <= m - j else {}
    return None


def _only_alike(changed: tuple[int, ...], names: list[bool], start: int, end: int) -> bool:
    """Whether the changes are those of another text: some of them side by side, and no name or number of the run is left."""
    if not any(b - a == 1 for a, b in zip(changed, changed[1:])):
        return False
    told = [j for j in range(start, end) if names[j]]
    return bool(told) and set(told) <= set(changed)


#: Pairs of neighbouring words that any leak shares with its item.
LEAST_PAIRS = LEAST - 1 - 3 * (LEAST // ONE_IN + 1)


def _search(shared, cosine: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, space, latent, owners, texts, pairs, ids, names = shared.value
        for pdf in batches:
            out = set()
            for doc_id, stretch in zip(pdf["doc_id"], pdf["ids"]):
                doc = np.asarray(stretch, dtype=np.int32)
                seen: set[int] = set()
                mine = set(zip(doc.tolist(), doc[1:].tolist()))
                z = _vectors(_doc_windows(doc), idf) @ space
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
                for at in range(0, len(z), BLOCK):
                    seen.update(np.unique(owners[np.nonzero((z[at : at + BLOCK] @ latent.T >= cosine).any(axis=0))[0]]).tolist())
                for k in seen:
                    if len(mine & pairs[k]) >= LEAST_PAIRS and leak(doc, texts[k], names[k], pairs[k]):
                        out.update((item, doc_id) for item in ids[k])
            yield pd.DataFrame(sorted(out), columns=["item_id", "doc_id"])

    return run


def leaked_items(items: DataFrame, documents: DataFrame, cosine: float = COSINE, rank: int = RANK) -> DataFrame:
    """(item_id, doc_id) of every notebook that contains text of an item.

    The items are a small table of fixed size: their texts, vocabulary and latent
    windows are what is sent to every task.
    """
    spark = documents.sparkSession
    known = Items([(r.item_id, r.context, r.question) for r in items.select("item_id", "context", "question").collect()])
    schema = "item_id long, doc_id long"
    if not known.texts:
        return spark.createDataFrame([], schema)
    scanned = cut(spread(documents.filter(F.col("text").isNotNull()).select("doc_id", "text")).mapInPandas(_scan(known.vocabulary), _SCANNED))
    counts = np.zeros(len(known.vocabulary) + 1)
    for row in scanned.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[row.term] = row.n
    idf = np.log(1 + (1 + counts[-1]) / (1 + counts[:-1])).astype(np.float32)
    found = scanned.filter(F.col("ids").isNotNull()).select("doc_id", "ids")
    own = _vectors([w for _, w in known.windows], idf)
    space = latent_space(found, idf, own, rank)
    latent = own @ space
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    owners = np.array([k for k, _ in known.windows])
    shared = spark.sparkContext.broadcast((idf, space, latent.astype(np.float32), owners, known.texts, known.pairs, known.ids, known.names))
    return found.mapInPandas(_search(shared, cosine), schema).distinct()
