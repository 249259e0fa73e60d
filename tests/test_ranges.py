import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe import queries
from gaugeframe.operators import perf, ranges, stats

INF = float("inf")


def series(seed):
    rng = np.random.default_rng(seed)
    return {
        "plain": rng.normal(size=300),
        "ties": rng.integers(0, 5, 300).astype(float),
        "outlier": np.r_[rng.random(200), 1e18, -1e18],
        "close": 1.0 + rng.integers(0, 50, 100) * 2.0**-52,
        "ends": np.r_[rng.random(20), INF, INF, -INF],
        "huge": rng.normal(size=50) * 1e308,
        "one": np.array([3.0]),
        "same": np.full(40, -2.0),
    }


@pytest.mark.parametrize("digits", [3, 4096])
def test_order_statistics_are_those_of_the_sorted_list(spark, monkeypatch, digits):
    monkeypatch.setattr(ranges, "DIGITS", digits)
    own = series(1)
    df = spark.createDataFrame([(k, float(x)) for k, v in own.items() for x in v] + [("plain", None), ("plain", float("nan")), ("none", None)], "k string, v double")
    n = F.col("_n")
    got = {r["k"]: r for r in ranges.order_statistics(df, ["k"], "v", {"first": F.lit(0), "mid": F.floor((n - 1) / 2), "late": F.rint(0.95 * (n - 1)), "last": n - 1}).collect()}
    assert set(got) == set(own)
    for k, v in own.items():
        v = sorted(v.tolist())
        assert [got[k][c] for c in ("first", "mid", "late", "last")] == [v[0], v[(len(v) - 1) // 2], v[round(0.95 * (len(v) - 1))], v[-1]], k


@pytest.mark.parametrize("digits", [2, 4096])
def test_weight_before(spark, monkeypatch, digits):
    monkeypatch.setattr(ranges, "DIGITS", digits)
    rows = {(k, float(x)): i % 7 for k, v in series(2).items() for i, x in enumerate(v)}
    df = spark.createDataFrame([(k, x, w) for (k, x), w in rows.items()], "k string, v double, w long")
    for r in ranges.weight_before(df, ["k"], "v", "w").collect():
        assert r["before"] == sum(w for (k, x), w in rows.items() if k == r["k"] and x < r["v"])


def test_without_keys_and_of_whole_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    assert ranges.order_statistics(df, [], "v", {"m": F.floor(F.col("_n") / 2)}).first()["m"] == 500
    assert {r["v"]: r["before"] for r in ranges.weight_before(df.withColumn("w", F.lit(1)), [], "v", "w").collect()} == {v: v for v in range(1000)}


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, v double, w long")
    assert ranges.order_statistics(none, ["k"], "v", {"m": F.lit(0)}).collect() == [] == ranges.weight_before(none, ["k"], "v", "w").collect()


@pytest.mark.parametrize("name", ["perf_by_model", "wilcoxon_pairs", "wilcoxon_w"])
def test_no_task_orders_a_group(spark, name):
    """Values are ordered only within a part of a part of their group's range; windows over whole groups see parts."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[([^\]]*)\]", plan)
    assert windows
    for inside, order in windows:
        assert re.match(r"_d[12]#", order) or "_d2#" in inside, (inside, order)


def brute_p(d):
    """Two-sided p over all sign patterns; no ties, no zeros."""
    ranks = {x: i + 1 for i, x in enumerate(sorted(map(abs, d)))}
    n = len(d)
    plus = sum(ranks[abs(x)] for x in d if x > 0)
    w = min(plus, n * (n + 1) // 2 - plus)
    hits = sum(sum(r for r, s in zip(range(1, n + 1), signs) if s) <= w for signs in itertools.product((0, 1), repeat=n))
    return w, min(1.0, 2 * hits / 2**n)


def test_all_pairs_of_models(spark):
    rng = np.random.default_rng(3)
    rows = [(t, m, i, float(x)) for t, n in (("a", 9), ("b", 12), ("c", 1), ("d", 2)) for m in ("m0", "m1", "m2") for i, x in enumerate(rng.normal(size=n) + (m == "m2"))]
    rows += [("e", m, i, 1.0) for m in ("m0", "m1") for i in range(5)]  # no difference at all
    rows += [("f", "m0", 1, 1.0), ("f", "m0", 2, 3.0), ("f", "m0", 3, 2.0), ("f", "m1", 1, 2.0), ("f", "m1", 2, 1.0), ("f", "m1", 4, 1.0), ("f", "m2", 9, None)]  # samples that don't pair
    got = {(r["task_id"], r["model_a"], r["model_b"]): r for r in stats.wilcoxon_pairs(spark.createDataFrame(rows, "task_id string, model_id string, sample_id long, score double"), ["task_id"]).collect()}
    assert len(got) == 4 * 3 + 2
    of = {(t, m): {i: x for a, b, i, x in rows if (a, b) == (t, m)} for t, m, _, _ in rows}
    for t in "ab":
        for a, b in itertools.combinations(("m0", "m1", "m2"), 2):
            w, p = brute_p([of[t, a][i] - of[t, b][i] for i in of[t, a]])
            r = got[t, a, b]
            assert (r["w"], r["n"], r["unpaired"]) == (w, len(of[t, a]), 0) and r["pval"] == pytest.approx(p, abs=1e-12) and r["significant"] == (p < 0.05)
    assert got["c", "m0", "m1"]["pval"] is None and got["c", "m0", "m1"]["n"] == 1 and not got["c", "m0", "m1"]["significant"]
    assert got["d", "m0", "m1"]["pval"] == pytest.approx(brute_p([of["d", "m0"][i] - of["d", "m1"][i] for i in (0, 1)])[1])
    assert (got["e", "m0", "m1"]["pval"], got["e", "m0", "m1"]["n"], got["e", "m0", "m1"]["w"]) == (None, 5, None)
    assert (got["f", "m0", "m1"]["pval"], got["f", "m0", "m1"]["n"], got["f", "m0", "m1"]["unpaired"]) == (None, 2, 2)


def test_normal_p_with_ties():
    w, n, ties = 20.0, 12, 6
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert stats.wilcoxon_p(n, w, ties, n) == pytest.approx(2 * 0.5 * math.erfc(abs(z) / math.sqrt(2)))
    assert stats.sign_patterns(3) == (1, 2, 3, 5, 6, 7, 8) and stats.sign_patterns(50)[-1] == 2**50


def test_total_usd_skips_errors_and_calls_without_a_price(spark):
    calls = spark.createDataFrame([("m", False, 1.0, 0.5, 1, 1), ("m", False, 2.0, None, 1, 1), ("m", True, 9.0, 4.0, 1, 1)], "model_id string, is_error boolean, latency_ms double, usd double, in_tokens long, out_tokens long")
    r = perf.perf_by_model(calls).first()
    assert (r["total_usd"], r["n_calls"], r["errors"], r["latency_ms_median"]) == (0.5, 3, 1, 1.5)
