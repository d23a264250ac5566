"""The optional outside model: any callable from prompt to text, off by default.

A callable may fail; it is tried again a few times and then counts as silent. A
request that the model cannot take (:class:`BadRequest`) is never tried again: it ends
a reading of pages and leaves a pick silent. What it proposes is checked by the operators that take
its answers (``nap.accepted_proposals``, ``retrieval.picked``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import PROPOSAL_CHARS

Call = Callable[[str], str]
ATTEMPTS = 4
ASK_NAP = "Name the business, phone, street_address, city, region, postal_code and full_address that the text holds, as one JSON object; leave out what it does not hold.\n\n"
ASK_PICK = 'Give the number of the passage that answers the question as {"index": n}, or {"index": null} if none does.\n\n'


class BadRequest(Exception):
    """Raised by a callable for a request that will not become good by asking again."""


def ask(call: Call, prompt: str, attempts: int = ATTEMPTS, strict: bool = False) -> str:
    """The answer, or nothing after the last failed attempt; ``strict`` lets a bad request through."""
    for _ in range(attempts):
        try:
            return call(prompt) or ""
        except BadRequest:
            if strict:
                raise
            return ""
        except Exception:  # noqa: BLE001 - any failure of a service is a silent answer
            continue
    return ""


def json_object(text: str | None) -> dict:
    """The object from the first brace of a text to its last; empty if that is none."""
    found = re.search(r"\{.*\}", text or "", re.S)
    try:
        value = json.loads(found[0]) if found else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def proposals(texts: DataFrame, call: Call) -> DataFrame:
    """(page_id, key, value) that the model reads from the pages' texts (page_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, str(k), str(v)) for i, t in pdf.itertuples(index=False) for k, v in json_object(ask(call, ASK_NAP + t, strict=True)).items() if v]
            yield pd.DataFrame(rows, columns=["page_id", "key", "value"])

    return texts.select("page_id", F.substring(F.coalesce("text", F.lit("")), 1, PROPOSAL_CHARS).alias("text")).mapInPandas(run, "page_id long, key string, value string")


def picks(ranked: DataFrame, call: Call) -> DataFrame:
    """(qid, pick) of the model for ranked passages (qid, query, rank, url, text); a silent model picks nothing."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "url", "text"))), lambda p: F.concat(F.lit("["), (p["rank"] - 1).cast("string"), F.lit("] "), p["url"], F.lit("\n"), p["text"]))
    prompts = ranked.groupBy("qid", "query").agg(F.concat(F.lit(ASK_PICK), F.first("query"), F.lit("\n\n"), F.array_join(listed, "\n\n")).alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for qid, prompt in pdf.itertuples(index=False):
                answer = json_object(ask(call, prompt))
                if "index" in answer:
                    try:
                        rows.append((qid, None if answer["index"] is None else int(answer["index"])))
                    except (TypeError, ValueError):
                        continue
            yield pd.DataFrame({"qid": [q for q, _ in rows], "pick": pd.array([p for _, p in rows], dtype="Int64")})

    return prompts.select("qid", "prompt").mapInPandas(run, "qid string, pick int")
