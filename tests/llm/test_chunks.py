import random

from hypothesis import given, settings
from hypothesis import strategies as st

from siteloom.llm import chunks


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n<p>漢。\U0001f35e", max_size=900), st.integers(5, 80), st.integers(0, 30))
def test_pieces_join_to_the_text(text, limit, overlap):
    spans = chunks.pieces(text, limit, overlap)
    overlap = min(overlap, limit - 1)
    assert all(b - a <= limit for a, b in spans)
    assert all(spans[k][0] == max(0, spans[k - 1][1] - overlap) for k in range(1, len(spans)))
    assert text == "".join(text[(spans[k - 1][1] if k else 0) : b] for k, (a, b) in enumerate(spans))


def test_an_edit_changes_neighbouring_pieces_only():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) + rng.choice(["", "", ".", ",\n"]) for _ in range(4000))
    edited = text[:9000] + " an inserted sentence." + text[9000:]
    body = lambda t: {t[a:b] for a, b in chunks.pieces(t, 420, 60)}
    assert len(body(text) - body(edited)) <= 6


def test_cuts_prefer_natural_places():
    text = ("word " * 30 + "end.\n\n") * 20
    ends = chunks.cuts(text, 420, 60)[:-1]
    assert sum(text[e - 2 : e] == "\n\n" for e in ends) >= 0.9 * len(ends)


def test_nulls_limits_and_clashing_columns(spark):
    limits = spark.createDataFrame([("passage", 10, 3), ("html", None, None)], "item_kind string, max_chars int, overlap_chars int")
    rows = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, "a" * 10, "x", 1), (4, "b" * 31, "x", 1), (4, "b" * 31, "x", 1)], "passage_id long, text string, item_kind string, piece_no int")
    got = chunks.split_oversized(rows, limits, "passage", "passage_id", "text").collect()
    assert {r.item_id for r in got} == {4} and len(got) == 2 * got[0].n_pieces
    assert chunks.split_oversized(rows, limits, "html", "passage_id", "text").count() == 0
    assert chunks.split_oversized(rows, limits.limit(0), "passage", "passage_id", "text").count() == 0
    assert chunks.split_oversized(rows.limit(0), limits, "passage", "passage_id", "text").count() == 0
