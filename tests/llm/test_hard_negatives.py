import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeframe.llm import hard_negatives as hn


def brute(rows, positives=5, negatives=10):
    """Every row scored for every anchor."""
    good = {(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, al, av in good:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, label == al) for i, label, v in good if i != a and len(v) == len(av))
        for ps, p, _ in [x for x in scored if x[2]][:positives]:
            hard = [x for x in scored if not x[2] and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:negatives]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(hard)]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return sorted(tuple(r) for r in hn.mine(df, spark).select(*COLUMNS).collect())


def table(seed, n, dim, labels=3, step=10):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) + 0.5
    return [(int(i * step), int(rng.integers(0, labels)), [float(x) for x in v[i]]) for i in range(n)]


@pytest.mark.parametrize("seed, n, dim", [(1, 300, 8), (2, 120, 1), (3, 200, 70)])
def test_equal_to_scoring_every_row(spark, seed, n, dim):
    rows = table(seed, n, dim)
    want = brute(rows)
    assert want and run(spark, rows) == want


def test_blocks_and_batches_change_nothing(spark, monkeypatch):
    rows = table(4, 400, 6)
    monkeypatch.setattr(hn, "BLOCK_BYTES", 200)
    assert run(spark, rows) == brute(rows)


def test_ties_and_copies(spark):
    """A vector that a third of the rows share, near copies of it, scores that tie, negative and zero scores."""
    hot = [0.5, 0.25, -0.125]
    rows = [(i, i % 3, hot) for i in range(0, 400, 2)]
    rows += [(1001 + i, i % 4, [0.5, 0.25, -0.125 + i % 3 / 256]) for i in range(90)]
    rows += [(2000 + i, i % 2, [0.25, 0.0, 0.0] if i % 2 else [-0.5, 0.0, 0.0]) for i in range(60)]
    rows += [(3000, 5, [0.0, 0.0, 0.0]), (3001, 5, [0.0, 0.0, 0.0]), (3002, 6, [1.0, 0.0, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    """Nulls in any column, null and non-finite components, empty vectors, other lengths, rows and ids that repeat, huge components."""
    nan, inf = float("nan"), float("inf")
    good = table(5, 80, 4)
    rows = good + [good[0], good[3], (None, 1, [1.0, 0.0, 0.0, 0.0]), (100, None, [1.0, 0.0, 0.0, 0.0]), (100, 1, None), (300, 1, [1.0, None, 0.0, 0.0]), (300, 2, [nan, 0.0, 0.0, 0.0]), (300, 2, [inf, 0.0, 0.0, 0.0]), (500, 1, []), (500, 1, [1.0, 2.0]), (501, 1, [2.0, 1.0]), (502, 2, [1.0, 1.0])]
    rows += [(100, 2, [0.5, 0.5, 0.5, 0.5]), (-100, 1, [0.25, 0.5, 0.5, 0.5]), (-7, -1, [0.3, 0.5, 0.5, 0.5])]
    rows += [(700, 1, [2.0**18, 1.0]), (701, 1, [2.0**18, 1.5]), (702, 2, [2.0**17, 1.25]), (703, 2, [2.0**17, 1.5])]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    rows = table(6, 60, 3)
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, label int, embedding array<double>, code int, `List.id` string, rank double")
    assert sorted(tuple(r) for r in hn.mine(df, spark).select(*COLUMNS).collect()) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 5), st.sampled_from([2, 5, 64]), st.sampled_from([3, 300, 2**28]))
def test_bounds_hold(seed, n, dim, cells, size):
    rng = np.random.default_rng(seed)
    x = rng.integers(-size, size, (n, dim))
    grid = hn.Grid(x[: n // 2], x.min(axis=0), x.max(axis=0), cells)
    cell = grid.cell(x)
    low, high = grid.ends(cell)
    assert (low <= x).all() and (x <= high).all() and cell.max() < cells
    a = rng.integers(-size, size, (7, dim))
    lower, upper = hn.bounds(a.astype(float), low, high)
    score = a @ x.T
    assert (lower <= score).all() and (score <= upper).all()


def test_few_rows_are_scored_exactly():
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(20_000, 16)) * 100).astype(np.int64)
    grid = hn.Grid(x[:4096], x.min(axis=0), x.max(axis=0))
    q = hn.Anchors(np.arange(50), np.zeros(50, np.int64), x[:50])
    lists = hn.Lists(50, 6)
    done = sum(hn.positives(q, np.arange(lo, lo + 2000), np.zeros(2000, np.int64), grid.cell(x[lo : lo + 2000]), x[lo : lo + 2000], grid, lists) for lo in range(0, 20_000, 2000))
    want = np.sort(x[:50] @ x.T, axis=1)[:, ::-1][:, :6]
    assert (lists.score.reshape(50, 6) == want).all() and done < 0.02 * 50 * 20_000
