import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siteloom.functions import text as tx
from siteloom.functions.lexicon import STOPWORDS
from siteloom.operators import retrieval


def wrapped(text, width=420):
    out = []
    for para in re.split(r"\n\s*\n", text):
        line = ""
        for word in para.split():
            if line and len(line) + 1 + len(word) > width:
                out.append(line)
                line = word
            else:
                line = f"{line} {word}" if line else word
        if line:
            out.append(line)
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=1, max_size=5))
def test_chunks(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.chunks(F.col("t"), 12).alias("c"))
    assert {r.i: r.c for r in df.collect()} == {i: wrapped(t, 12) for i, t in enumerate(texts)}


def test_null_text_has_null_chunks(spark):
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(tx.chunks(F.col("t")).alias("c")).first().c is None


@pytest.mark.parametrize(
    ("text", "chrome"),
    [("", True), ("Skip to Main", True), ("Home Menu Contact Visit Shop News", True), ("Home Menu Contact Visit Shop 5", False), ("a & b & c", True), ("a & b & c 1", False), ("We bake bread every day", False)],
)
def test_chrome(spark, text, chrome):
    assert spark.createDataFrame([(text,)], "t string").select(tx.is_chrome(F.col("t")).alias("c")).first().c is chrome


def brute(texts, query, k=12):
    tok = lambda t: re.findall("[a-z0-9]+", t.lower())
    terms = [t for t in tok(query) if t not in STOPWORDS and len(t) > 1] or tok(query)
    bags = {i: tok(t) for i, t in texts.items()}
    avg = sum(map(len, bags.values())) / len(bags)
    out = []
    for i, bag in bags.items():
        score = hits = 0
        for t in terms:
            if t in bag:
                df = sum(t in b for b in bags.values())
                hits += 1
                score += math.log((len(bags) - df + 0.5) / (df + 0.5) + 1) * bag.count(t) * 2.5 / (bag.count(t) + 1.5 * (0.25 + 0.75 * max(1, len(bag)) / avg))
        out.append((-round(score, 9), -hits / len(set(terms)), -len(texts[i]), i))
    return [(i, -s) for s, _, _, i in sorted(out)[:k]]


def test_bm25_against_brute_force(spark):
    texts = {0: "fresh bread and rolls", 1: "bread bread bread", 2: "coffee to go", 3: "", 4: "rolls with bread and more rolls for all of us"}
    df = spark.createDataFrame([("s", i, t or None) for i, t in texts.items()] + [("other", 9, "bread")], "site string, passage_id long, text string")
    for query in ("bread rolls bread", "the of", "nothing such"):
        got = retrieval.bm25(df, spark.createDataFrame([("s", "q", query)], "site string, qid string, query string")).orderBy("rank").collect()
        assert [(r.passage_id, pytest.approx(r.score, abs=1e-6)) for r in got] == brute(texts, query)


def test_hour_questions_keep_times_only(spark):
    df = spark.createDataFrame([("s", 1, "hours are long"), ("s", 2, "open at 9 am")], "site string, passage_id long, text string")
    got = retrieval.bm25(df, spark.createDataFrame([("s", "q", "opening hours")], "site string, qid string, query string")).collect()
    assert [r.passage_id for r in got] == [2] and got[0].score >= 4


def test_fusion(spark):
    a = spark.createDataFrame([("a", 1, 5.0, 1.0), ("b", 2, 4.0, 0.5)], "id string, rank int, score double, coverage double")
    b = spark.createDataFrame([("b", 1, 0.9), ("c", 2, 0.8)], "id string, rank int, score double")
    got = retrieval.fused(a, b).orderBy("rank").collect()
    assert [(r.id, r.score, r.coverage, r.vector) for r in got] == [("b", 0.9, 0.0, True), ("a", 5.0, 1.0, False), ("c", 0.8, 0.0, True)]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((40, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "vec_id long, embedding array<double>").repartition(3)
    got = retrieval.nearest_vectors(df, df.filter("vec_id < 3"), 5).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(3):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == np.argsort(-(unit @ unit[q]), kind="stable")[:5].tolist()


def test_picks(spark):
    ranked = spark.createDataFrame([("q1", 1, 0.2), ("q1", 2, 0.9), ("q2", 1, 0.9), ("q3", 1, 0.2)], "qid string, rank int, coverage double")
    picks = spark.createDataFrame([("q1", 1), ("q2", None), ("q3", None)], "qid string, pick int")
    assert {(r.qid, r["rank"]) for r in retrieval.picked(ranked, picks).collect()} == {("q1", 2), ("q2", 1)}


def test_passages_and_answer(spark, pages):
    html = "<main><p>We open at 9 am on weekdays and close at noon on all other days.</p><p>Bread is baked here every single morning by our own bakers.</p></main>"
    archive = pages({"html": html}, {"html": html, "status": 404}, {"html": "<div>short</div>"}, {"html": None})
    built = retrieval.passages(archive).orderBy("passage_idx").collect()
    assert [(r.id, r.url) for r in built] == [("p-0", "https://a.com/0"), ("p-1", "https://a.com/0"), ("p-2", "https://a.com/2")]
    texts = retrieval.passages(archive).withColumnRenamed("passage_idx", "passage_id")
    shown = spark.createDataFrame([("a.com", "https://a.com/0", "x We open at 9 am on weekdays and close at noon on all other days. y")], "site string, url string, visible_text string")
    asked = spark.createDataFrame([("a.com", "1", "When are you open?"), ("a.com", "2", "parking garage")], "site string, qid string, query string")
    got = {r.qid: r.excerpt for r in retrieval.answers(texts, shown, asked).collect()}
    assert got == {"1": "We open at 9 am on weekdays and close at noon on all other days.", "2": None}
