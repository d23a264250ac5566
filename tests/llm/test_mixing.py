import random

from pathlib import Path

import pytest

from siteloom.llm import mixing as X

pytestmark = pytest.mark.skipif(not Path(X.TOKENIZER).exists(), reason="no tokenizer")
DOC = "doc_id long, text string, source string, pattern string, place long"
TARGET = "mix_name string, source string, target_share double, max_repeats int, pool_fraction double"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOC)


def test_flow_repeats_small_sources_last():
    flow = X.min_cost_flow({"a": 100, "a|b": 50}, {"a": ["a"], "a|b": ["a", "b"]}, {"a": 100, "b": 120}, {"a": 3, "b": 3})
    assert flow == {("a", "a"): 100, ("a|b", "b"): 120}
    assert X.min_cost_flow({"a": 10}, {"a": ["a"]}, {"a": 100}, {"a": 2}) == {("a", "a"): 20}
    assert X.min_cost_flow({}, {}, {"a": 1}, {"a": 1}) == {}


def test_shares_and_caps(spark):
    rows = [(k, f"the text number {k} " * (3 + k % 5), "Big-One") for k in range(300)] + [(1000 + k, f"small piece {k} of it", "small") for k in range(10)] + [(2000, None, "small"), (2001, "", "small"), (2002, "no source at all here", None), (5000, "small piece 3 of it", "big_one")]
    targets = spark.createDataFrame([("m", "big_one", 0.6, 2, 0.5), ("m", "small", 0.4, 3, 0.5), ("m", "gone", 0.0, 2, 0.5)], TARGET)
    shares = {r.source: r for r in X.mix_shares(docs(spark, rows), targets).collect()}
    assert abs(shares["big_one"].reached_tokens / shares["big_one"].wanted_tokens - 1) < 0.05
    assert shares["small"].most_uses == 3 and shares["small"].n_docs == 10 and shares["gone"].reached_tokens == 0
    chosen = X.mix_selection(docs(spark, rows), targets).collect()
    assert len({(r.source, r.doc_id) for r in chosen}) == len(chosen) and 5000 not in {r.doc_id for r in chosen}
    assert sorted(chosen) == sorted(X.mix_selection(docs(spark, rows).repartition(5), targets).collect())


def test_empty(spark):
    targets = spark.createDataFrame([("m", "a", 0.5, 2, 0.5)], TARGET)
    empty = docs(spark, [(1, "x", "a")]).limit(0)
    assert [r.reached_tokens for r in X.mix_shares(empty, targets).collect()] == [0]


def test_long_texts_are_counted_whole(monkeypatch):
    whole = lambda t: len(X.tokenizer(X.TOKENIZER).encode_ordinary(t))
    rng = random.Random(6)
    texts = ["word " * 3_000, "ab12" * 2_000, "\n\n \t" * 2_000 + "x", "é" * 5_000, "don't   stop\r\n  at 12'sAll" * 400, "".join(rng.choice("ab1 \n'.é²\t中") for _ in range(20_000))]
    monkeypatch.setattr(X, "PART_CHARS", 97)
    assert [X.count_tokens(t) for t in texts] == [whole(t) for t in texts]


def test_rest_is_filled_until_nothing_fits(spark, monkeypatch):
    monkeypatch.setattr(X, "FILLERS", 3)
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([1, 2, 60, 400]))), "a") for k in range(120)]
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 0.37), ("n", "a", 0.5, 2, 0.9)], TARGET)
    df = docs(spark, rows)
    chosen = X.mix_selection(df, targets).collect()
    sizes = {r.doc_id: r.n_tokens for r in X.sized_documents(df).collect()}
    for r in X.mix_shares(df, targets).collect():
        used = {c.doc_id: c.uses for c in chosen if c.mix_name == r.mix_name}
        most = {"m": 1, "n": 2}[r.mix_name]
        left = [n for d, n in sizes.items() if used.get(d, 0) < most]
        lacks = r.wanted_tokens - r.reached_tokens
        assert lacks >= 0 and max(used.values()) <= most
        assert not left or lacks < min(left)
