import random
import re

from siteloom.llm import repeated_lines as R

ROW = "passage_id long, site string, url string, text string, line string, n int, source string"


def brute(rows):
    key = lambda s: re.sub(r"\d+", "0", re.sub(r"\s+", " ", s.lower()).strip())
    urls, seen = {}, {}
    for _, site, url, text in rows:
        urls.setdefault(site, set()).add(url)
        for line in (text or "").split("\n"):
            if key(line):
                seen.setdefault((site, key(line)), set()).add(url)
    bad = set()
    for (site, k), us in seen.items():
        n, all_ = len(us - {None}), len(urls[site] - {None})
        if n >= 5 and n >= 0.2 * all_:
            bad.add((site, k))
    return {(i, k) for i, site, _, text in rows for k, line in enumerate((text or "").split("\n")) if (site, key(line)) in bad}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], ROW)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows, i = [], 0
    for site, n in (("big", 90), ("small", 7), (None, 20), ("tiny", 3)):
        for u in range(n):
            for _ in range(rng.randint(1, 3)):
                lines = [rng.choice(["All rights  reserved", "ALL RIGHTS reserved ", f"© {rng.randint(1990, 2030)} Us", "", f"own line {rng.random()}", "rare share"]) for _ in range(rng.randint(0, 4))]
                rows.append((i, site, rng.choice([f"u{u}", f"u{u}", None]), rng.choice(["\n".join(lines), None]) if rng.random() < 0.1 else "\n".join(lines)))
                i += 1
    df = frame(spark, rows).repartition(7)
    got = {tuple(r) for r in R.excessive_occurrences(df).collect()}
    assert got == brute(rows) and got


def test_addresses_strewn_over_tasks_lose_nothing(spark):
    rows = [(i, "s", f"u{i % 40}", "menu\nx%d" % i) for i in range(800)]
    df = frame(spark, rows).repartition(40)
    assert {tuple(r) for r in R.excessive_occurrences(df).collect()} == brute(rows)


def test_cleaned_passages(spark):
    rows = [(i, "s", f"u{i}", f"Share this\nbody {chr(97 + i)}") for i in range(6)] + [(9, "s", "u9", None), (10, "s", "u10", "share THIS")]
    got = {r.passage_id: (r.n_removed, r.text) for r in R.without_excessive_lines(frame(spark, rows)).collect()}
    assert got[0] == (1, "body a") and got[10] == (1, "") and 9 not in got


def test_empty_table(spark):
    assert R.excessive_occurrences(frame(spark, [(1, "s", "u", "x")]).limit(0)).count() == 0
