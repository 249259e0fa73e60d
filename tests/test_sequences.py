import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeframe.functions import text


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + (x == y))
    return row[-1]


def f1(n, p, g):
    return 0.0 if not p or not g else 2.0 * n / (p + g)


@pytest.mark.parametrize("kinds", [1, 3, 40])
def test_rouge_l_of_tokens(spark, kinds):
    rng = random.Random(kinds)
    side = lambda: [f"t{rng.randrange(kinds)}" for _ in range(rng.randrange(25))]
    pairs = [(i, side(), side()) for i in range(60)] + [(100, [], []), (101, [], ["a"]), (102, ["a"], ["a"])]
    df = spark.createDataFrame(pairs, "k long, p array<string>, g array<string>")
    want = {k: f1(lcs(p, g), len(p), len(g)) for k, p, g in pairs}
    assert {r["k"]: r["rougeL"] for r in text.rouge_l_table(df, ["k"], F.col("p"), F.col("g")).collect()} == pytest.approx(want)
    short = df.select("k", text.rouge_l(F.array_join("p", " "), F.array_join("g", " ")).alias("l"))
    assert {r["k"]: r["l"] for r in short.collect()} == pytest.approx(want)


def plain_match(pred, gold):
    """Every gold cell against every free cell."""
    if not pred or not gold:
        return float(not pred and not gold)
    free, hits = dict(enumerate(pred)), 0
    for g in gold:
        best, score = None, 0.0
        for i, p in free.items():
            alike = text.ratio(g["txt"].lower(), p["txt"].lower()) / 100.0
            value = 0.7 * alike + 0.3 * (1.0 if (g["r"], g["c"]) == (p["r"], p["c"]) else 0.5)
            if alike >= 0.8 and value > score:
                best, score = i, value
        if best is not None:
            del free[best]
            hits += 1
    if not hits:
        return 0.0
    a, b = hits / len(pred), hits / len(gold)
    return 2 * (a * b) / (a + b)


cell = st.builds(lambda t, r, c: {"txt": t, "r": r, "c": c}, st.text("abAB1é ", min_size=1, max_size=7), st.integers(0, 2), st.integers(0, 2))


@settings(max_examples=300, deadline=None)
@given(st.lists(cell, max_size=9), st.lists(cell, max_size=9))
def test_bounds_leave_cells_matched_as_before(pred, gold):
    assert text.match_cells(pred, gold) == plain_match(pred, gold)


def test_two_thousand_cells():
    rng = random.Random(2)
    words = [" ".join(rng.choice(["north", "south", "total", "rate", "1.5", "2024"]) + str(rng.randrange(300)) for _ in range(3)) for _ in range(2000)]
    gold = [{"r": i // 10, "c": i % 10, "txt": w} for i, w in enumerate(words)]
    pred = [{"r": i // 10, "c": i % 10, "txt": w[:-1] + "x"} for i, w in enumerate(words)]
    began = time.time()
    assert text.match_cells(pred, gold) > 0.9
    assert time.time() - began < 30
