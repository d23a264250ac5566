import random

import numpy as np

from siteloom.llm import leakage as L

WORDS = [f"w{k}" for k in range(400)]
DOC = "doc_id long, text string, ids array<int>, term int, n long"
ITEM = "item_id long, context string, question string"


def text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def test_words_without_markup_escapes_and_case():
    assert L.words('<b>The</b>&nbsp;Caf\\u00e9\\n# “No”, <i x="1">it</i>\\tend') == ["the", "café", "no", "it", "end"]


def test_runs():
    rng = random.Random(2)
    item = np.array([rng.randrange(1000) for _ in range(60)])
    found = lambda doc, names=None: L.leak(np.asarray(doc), item, names or [False] * 60)
    part = item[10:30].copy()
    assert found(part) == (15, 0) or found(part)[0] >= 15
    assert found(np.concatenate([[2000], part, [2001]]))
    assert not found(item[10:24])
    part[8] = 5000
    assert found(part) and found(np.insert(part[9:], 4, 6000)) is None
    assert found(np.insert(item[10:30], 4, 6000))
    assert not found(np.where(np.arange(20) % 4 == 3, -1, part))
    beside = item[10:26].copy()
    beside[7:9] = -1
    assert found(beside) and found(beside[:15]) is None
    start = item[10:26].copy()
    start[1], start[3] = -1, -1  # single equal words at the beginning
    assert found(start)
    names = [17 <= k < 19 for k in range(60)]
    assert not found(beside, names)  # both names were changed: only alike
    assert found(beside, [k in (17, 12) for k in range(60)])


def test_names():
    assert L.named("How did Ann Lee sell 12 figs? Who knows. The end of May") == [False, False, True, True, False, True, False, False, False, False, False, False, True]


def test_runs_and_latent_search_against_brute_force(spark):
    """Every leak with one word in eight changed is found through the latent space, and nothing else."""
    rng = random.Random(8)
    items = [(k, None, text(rng, 40)) for k in range(30)]
    docs = []
    for d in range(90):
        part = items[d % 30][2].split()
        size = rng.randrange(10, 33)
        at = rng.randrange(0, 40 - size)
        part = part[at : at + size]
        for _ in range(rng.randrange(0, size // 6 + 1)):
            part[rng.randrange(len(part))] = rng.choice(["other", "w7", "new"])
        docs.append((d, f"{text(rng, rng.randrange(0, 60))} {' '.join(part)} {text(rng, 30)}"))
    got = {tuple(r) for r in L.leaked_items(spark.createDataFrame(items, ITEM), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    known = L.Items(items)
    ids = {d: np.array([known.vocabulary.get(w, -1) for w in L.words(t)]) for d, t in docs}
    want = {(known.ids[k][0], d) for d in ids for k in range(len(known.texts)) if L.leak(ids[d], known.texts[k], known.names[k])}
    assert got == want and len(want) > 40


def test_found_pairs(spark):
    rng = random.Random(4)
    items = [(k, text(rng, 50) if k % 3 else None, text(rng, 24)) for k in range(12)]
    items.append((99, items[1][1], "short"))
    filler = lambda n: " ".join(f"z{rng.randrange(5000)}" for _ in range(n))
    q = items[0][2].split()
    docs = [(1, filler(80) + " " + items[1][1].upper().replace(" ", ",\n# ") + " " + filler(60)), (2, filler(500)), (3, None), (4, ""), (5, " ".join(q[:14]) + " " + filler(9)), (6, "x " * 40_000 + " ".join([*q[:7], "oops", *q[8:]])), (6, " ".join(q))]
    df = spark.createDataFrame([(*d, [1], 2, 3) for d in docs], DOC)
    its = spark.createDataFrame([*items, (100, None, None)], ITEM)
    got = sorted(map(tuple, L.leaked_items(its, df).collect()))
    assert got == [(0, 6), (1, 1), (99, 1)]
    assert L.leaked_items(its, df.limit(0)).count() == 0
    assert L.leaked_items(its.limit(0), df).count() == 0
