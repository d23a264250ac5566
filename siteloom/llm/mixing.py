"""Problem 8: mix sources to target shares.

Sizes are tokens of a public tokenizer. Equal texts are one document that belongs
to every source it stands in, so the sources overlap. Documents are aggregated by
membership pattern (the set of their sources; as many patterns as the targets' few
sources allow), and for each mix a minimum-cost flow routes the patterns' tokens to
the sources' quotas; each further repetition of a pattern costs more than the one
before, so small sources are repeated only as far as they must be, and at most
``max_repeats`` times. The flow is then turned into documents in a seeded order: a
pattern's documents lie one after the other on a line, once per repetition, and a
source takes the documents in the stretch that the flow gave it. Where the last
stretch ends inside a document, that one is passed over and the rest is filled with
the next documents of the order that still fit, once around the line: what a source
lacks in the end is less than any document that it may still use.

Defined results: null and empty texts count for nothing; documents without a
source or of a source outside the mix fill no quota but count for the size of the
pool; a quota that cannot be filled stays short and the reached share says so; a
source without documents or with a share of 0 reaches 0; copies are used under the
least doc_id that they have in the source they are used for; an empty table gives shares of 0.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer parts text before it merges bytes (fixed value of the public vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SEED = 11
#: Documents in one slice of the seeded order, about.
SLICE = 20_000
#: Documents that are looked at in one round to fill the rest of a stretch; rounds go on until none fits.
FILLERS = 400
#: A text longer than this is counted in parts of about this size.
PART_CHARS = 200_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Places at which the pattern surely parts a text, whatever stands around them: before a blank that follows none, and between a letter and a figure.
_SURE = re.compile(r"\S(?=[ \n])|[A-Za-z](?=[0-9])")


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of a text. A very long one is counted in parts, cut only where no token can reach across, so the sum is that of the whole."""
    encode = tokenizer(path).encode_ordinary
    total = at = 0
    while len(text) - at > PART_CHARS:
        sure = _SURE.search(text, at + PART_CHARS)
        if sure is None:
            break
        total += len(encode(text[at : sure.end()]))
        at = sure.end()
    return total + len(encode(text[at:] if at else text))


def _shipped(path: str) -> str:
    """Where a task finds the vocabulary: the copy sent along with the job."""
    copy = SparkFiles.get(Path(path).name)
    return copy if Path(copy).exists() else path


def _count_batches(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _shipped(path)
        for pdf in batches:
            pdf["n_tokens"] = [count_tokens(t, own) for t in pdf["text"]]
            yield pdf[["doc_id", "source", "text_key", "n_tokens"]]

    return run


def source_name(source: Column) -> Column:
    """The clean spelling of a source."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_")


def sized_documents(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, text_key, n_tokens) of every document with a text."""
    documents.sparkSession.sparkContext.addFile(path)
    rows = spread(documents.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", source_name(F.col("source")).alias("source"), "text"))
    return rows.select("doc_id", "source", F.md5("text").alias("text_key"), "text").mapInPandas(_count_batches(path), "doc_id long, source string, text_key string, n_tokens long")


def min_cost_flow(supply: dict[str, int], members: dict[str, list[str]], quota: dict[str, int], repeats: dict[str, int]) -> dict[tuple[str, str], int]:
    """Tokens that go from each pattern to each source: as much as fits, at the least cost of repetition.

    The r-th use of a pattern costs r - 1 for each token; the network has one edge
    for each use. Augments along cheapest paths, so every step is optimal.
    """
    edges: list[list[int]] = []
    out: dict[str, list[int]] = defaultdict(list)
    where: list[tuple[str, str]] = []

    def edge(a: str, b: str, room: int, price: int) -> None:
        for x, y, r, p in ((a, b, room, price), (b, a, 0, -price)):
            out[x].append(len(edges))
            edges.append([r, p])
            where.append((x, y))

    for pattern, tokens in supply.items():
        own = [s for s in members[pattern] if quota.get(s)]
        for use in range(max((repeats[s] for s in own), default=0)):
            edge("<", "p:" + pattern, tokens, use)
        for source in own:
            edge("p:" + pattern, "s:" + source, tokens * repeats[source], 0)
    for source, tokens in quota.items():
        if tokens > 0:
            edge("s:" + source, ">", tokens, 0)
    nodes = {x for pair in where for x in pair} | {"<", ">"}
    while True:
        price, via = {n: float("inf") for n in nodes}, {}
        price["<"] = 0
        queue = ["<"]
        while queue:
            x = queue.pop(0)
            for k in out[x]:
                y = where[k][1]
                if edges[k][0] > 0 and price[x] + edges[k][1] < price[y]:
                    price[y], via[y] = price[x] + edges[k][1], k
                    if y not in queue:
                        queue.append(y)
        if ">" not in via:
            break
        path, at = [], ">"
        while at != "<":
            path.append(via[at])
            at = where[via[at]][0]
        room = min(edges[k][0] for k in path)
        for k in path:
            edges[k][0] -= room
            edges[k ^ 1][0] += room
    flow: dict[tuple[str, str], int] = {}
    for k in range(0, len(edges), 2):
        a, b = where[k]
        if a.startswith("p:") and edges[k ^ 1][0] > 0:
            flow[a[2:], b[2:]] = flow.get((a[2:], b[2:]), 0) + edges[k ^ 1][0]
    return flow


def _stretches(targets: list[Row], supply: dict[str, int], pool: int) -> list[tuple[str, str, str, int, int, int]]:
    """(mix, pattern, source, from, to, tokens of the pattern) of every flow."""
    mixes: dict[str, list[Row]] = defaultdict(list)
    for row in targets:
        mixes[row.mix_name].append(row)
    members = {p: p.split("|") for p in supply}
    out = []
    for mix, rows in sorted(mixes.items()):
        quota = {r.source: round(r.target_share * r.pool_fraction * pool) for r in rows if r.target_share}
        repeats = {r.source: r.max_repeats for r in rows}
        at: dict[str, int] = defaultdict(int)
        for (pattern, source), tokens in sorted(min_cost_flow(supply, members, quota, repeats).items()):
            out.append((mix, pattern, source, at[pattern], at[pattern] + tokens, supply[pattern]))
            at[pattern] += tokens
    return out


def _lined_up(units: DataFrame, n_docs: int, seed: int) -> DataFrame:
    """The units with the token at which each begins on its pattern's line, in seeded order.

    Sums run within slices of the order and, once, over the slices' totals, so no
    task holds a whole pattern.
    """
    bits = max(2, min(16, (n_docs // SLICE).bit_length() + 2))
    rows = units.withColumn("place", F.xxhash64("text_key", F.lit(seed))).withColumn("slice", F.shiftrightunsigned("place", 64 - bits))
    totals = rows.groupBy("pattern", "slice").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("pattern", "slice", (F.sum("total").over(W.partitionBy("pattern").orderBy("slice")) - F.col("total")).alias("base"))
    within = F.sum("n_tokens").over(W.partitionBy("pattern", "slice").orderBy(F.col("place"), F.col("doc_id")).rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.withColumn("within", within).join(base, ["pattern", "slice"]).select("doc_id", "pattern", "n_tokens", "members", (F.col("base") + F.col("within")).alias("begin"))


def _mixed(documents: DataFrame, targets: DataFrame, path: str, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """(selection, targets with clean names, tokens of the pool)."""
    spark = documents.sparkSession
    wanted = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats", "pool_fraction").dropDuplicates(["mix_name", "source"])
    rows = wanted.collect()
    named = sorted({r.source for r in rows if r.source})
    sized = cut(sized_documents(documents, path))
    pool = sized.agg(F.sum("n_tokens")).first()[0] or 0
    own = sized.groupBy("text_key", F.when(F.col("source").isin(named), F.col("source")).alias("source")).agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    units = cut(
        own.filter(F.col("source").isNotNull())
        .groupBy("text_key")
        .agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("source", F.col("doc_id").alias("as_doc")))).alias("members"))
        .withColumn("pattern", F.array_join(F.transform("members", lambda m: m["source"]), "|"))
        .withColumn("members", F.map_from_entries("members"))
    )
    by_pattern = units.groupBy("pattern").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()
    supply = {r.pattern: r.n for r in by_pattern if r.n}
    flows = _stretches(rows, supply, pool)
    last = {(m, p): max(high for m2, p2, _, _, high, _ in flows if (m2, p2) == (m, p)) for m, p, *_ in flows}
    most = {(r.mix_name, r.source): r.max_repeats for r in rows}
    rows_ = [(*f, f[4] == last[f[0], f[1]] and f[4] % f[5] > 0, most[f[0], f[2]]) for f in flows]
    schema = "mix_name string, pattern string, source string, low long, high long, length long, ends boolean, most int"
    stretches = F.broadcast(spark.createDataFrame(rows_, schema))
    middle = F.col("begin") + F.floor(F.col("n_tokens") / 2)
    turns = lambda edge: F.greatest(F.ceil((F.col(edge) - middle) / F.col("length")), F.lit(0))
    whole = F.greatest(F.floor((F.col("high") - F.col("begin") - F.col("n_tokens")) / F.col("length")) + 1, F.lit(0))
    lined = cut(_lined_up(units, sum(r.docs for r in by_pattern), seed))
    placed = lined.join(stretches, "pattern").withColumn("as_doc", F.try_element_at("members", F.col("source"))).drop("members").withColumn("uses", F.when(F.col("ends"), whole).otherwise(turns("high")) - turns("low"))
    chosen = placed.filter(F.col("uses") > 0).select("mix_name", "pattern", "source", F.col("as_doc").alias("doc_id"), "n_tokens", F.col("uses").cast("long").alias("uses"))
    extra = _fill(placed, chosen, {(m, p, s): high - low for m, p, s, low, high, _, ends, _ in rows_ if ends})
    if extra:
        chosen = chosen.unionByName(spark.createDataFrame(extra, chosen.schema))
    chosen = chosen.groupBy("mix_name", "source", "doc_id").agg(F.max("n_tokens").alias("n_tokens"), F.sum("uses").alias("uses"))
    return chosen, wanted, pool


def _fill(placed: DataFrame, chosen: DataFrame, wished: dict[tuple[str, str, str], int]) -> list[tuple]:
    """Documents that fill what the last stretches lack.

    Each round takes, of the documents that still fit, the next ones of the order
    (those behind the end of the stretch, then, where ``max_repeats`` permits one more
    use, those before it). The first of a round always goes in, and rounds go on until
    no document fits, so nothing is left out however many there are.
    """
    names = ["mix_name", "pattern", "source"]
    have = {(r.mix_name, r.pattern, r.source): r.n for r in chosen.groupBy(*names).agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("n")).collect()} if wished else {}
    lack = {k: n - have.get(k, 0) for k, n in wished.items()}
    passed = dict.fromkeys(lack, (-1, -1, -1))
    turn = F.when(F.col("begin") + F.col("n_tokens") > F.col("high") % F.col("length"), 0).otherwise(1)
    left = placed.filter("ends").withColumn("turn", turn).filter(F.col("uses") + 1 <= F.col("most"))
    order = W.partitionBy(*names).orderBy("turn", "begin", "doc_id")
    out = []
    while lacking := [(*k, n, *passed[k]) for k, n in lack.items() if n > 0 and passed[k] is not None]:
        asked = F.broadcast(placed.sparkSession.createDataFrame(lacking, "mix_name string, pattern string, source string, lack long, turn_ int, begin_ long, doc_ long"))
        beyond = F.struct("turn", "begin", "doc_id") > F.struct(F.col("turn_").alias("turn"), F.col("begin_").alias("begin"), F.col("doc_").alias("doc_id"))
        fit = left.join(asked, names).filter((F.col("n_tokens") <= F.col("lack")) & beyond)
        near = fit.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= FILLERS).orderBy(*names, "n").collect()
        seen: dict[tuple, int] = defaultdict(int)
        for r in near:
            key = (r.mix_name, r.pattern, r.source)
            seen[key] += 1
            passed[key] = (r.turn, r.begin, r.doc_id)
            if r.n_tokens <= lack[key]:
                lack[key] -= r.n_tokens
                out.append((*key, r.as_doc, r.n_tokens, 1))
        for *key, _, _, _, _ in lacking:
            if seen[tuple(key)] < FILLERS:
                passed[tuple(key)] = None
    return out


def mix_selection(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, uses): the documents of every mix."""
    return _mixed(documents, targets, path, seed)[0]


def mix_shares(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """One row per mix and source: wanted and reached tokens and shares, documents and their uses."""
    chosen, wanted, pool = _mixed(documents, targets, path, seed)
    reached = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("reached_tokens"), F.count("*").alias("n_docs"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_uses"))
    rows = wanted.join(reached, ["mix_name", "source"], "left").fillna(0, ["reached_tokens", "n_docs", "n_uses", "most_uses"])
    whole = F.sum("reached_tokens").over(W.partitionBy("mix_name"))
    return rows.select(
        "mix_name",
        "source",
        "target_share",
        F.round(F.col("target_share") * F.col("pool_fraction") * pool).cast("long").alias("wanted_tokens"),
        "reached_tokens",
        F.when(whole > 0, F.col("reached_tokens") / whole).otherwise(F.lit(0.0)).alias("reached_share"),
        "n_docs",
        "n_uses",
        "most_uses",
    )
