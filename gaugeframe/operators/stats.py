"""Paired Wilcoxon signed-rank test."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import weight_before

#: Pairs up to which p is exact where there are no ties or zeros; significance.
EXACT, ALPHA = 50, 0.05


def signed_ranks(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """keys, n (pairs), n_nonzero, w, tie_term: w is the smaller sum of mid-ranks of |a - b| over non-zero differences.

    Differences are counted by size first, so a tie of any number of pairs is one row; ranks are sums of counts of
    smaller ranges, so no task orders the differences of a group.
    """
    d = pairs.select(*keys, (F.col(a) - F.col(b)).alias("d"))
    size = d.groupBy(*keys).agg(F.count("d").alias("n"))
    ties = d.where("d <> 0").groupBy(*keys, F.abs("d").alias("m")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("plus"))
    ranked = weight_before(ties, keys, "m", "t").withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("t").alias("n_nonzero"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("plus"))).alias("w_minus"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie_term"))
    joined = size.join(sums, keys, "left") if keys else size.crossJoin(sums)
    return joined.select(*keys, "n", F.coalesce("n_nonzero", F.lit(0)).alias("n_nonzero"), F.least("w_plus", "w_minus").alias("w"), F.coalesce("tie_term", F.lit(0)).alias("tie_term"))


@functools.lru_cache(maxsize=EXACT)
def sign_patterns(n: int) -> tuple[int, ...]:
    """For each w, of how many of the 2^n sign patterns of the ranks 1 to n the positive ones sum to w or less; from n - 1, one rank more."""
    if n == 0:
        return (1,)
    less = sign_patterns(n - 1)
    top = n * (n + 1) // 2
    at = lambda i: less[min(i, len(less) - 1)] if i >= 0 else 0
    return tuple(at(i) + at(i - n) for i in range(top + 1))


def wilcoxon_p(n_nonzero: int, w: float, tie_term: int, n_pairs: int, exact_up_to: int = EXACT) -> float | None:
    """Two-sided p: exact by counting sign patterns for few pairs without ties or zeros, else the normal approximation with tie correction."""
    if n_pairs < 2 or n_nonzero < 2:
        return None
    if tie_term == 0 and n_nonzero == n_pairs and n_nonzero <= exact_up_to:
        return min(1.0, 2 * sign_patterns(n_nonzero)[int(w)] / 2**n_nonzero)
    mean = n_nonzero * (n_nonzero + 1) / 4
    var = n_nonzero * (n_nonzero + 1) * (2 * n_nonzero + 1) / 24 - tie_term / 48
    if var <= 0:
        return None
    return math.erfc(abs((w - mean) / math.sqrt(var)) / math.sqrt(2))


@F.pandas_udf(T.DoubleType())
def p_value(n_nonzero: pd.Series, w: pd.Series, tie_term: pd.Series, n_pairs: pd.Series) -> pd.Series:
    """wilcoxon_p of each row; one row for each comparison, however many pairs it has."""
    return pd.Series([None if pd.isna(x) else wilcoxon_p(int(k), float(x), int(t), int(n)) for k, x, t, n in zip(n_nonzero, w, tie_term, n_pairs)], dtype="float64")


def wilcoxon_pairs(scores: DataFrame, keys: list[str], model: str = "model_id", sample: str = "sample_id", score: str = "score") -> DataFrame:
    """keys, model_a, model_b, n, w, pval, significant, unpaired: every two models of the same keys compared on their common samples.

    scores: one row for each keys, model and sample; rows without a score don't count. unpaired: samples that only one of the two has; with any there is no test.
    Models come in the order of their ids; a comparison with fewer than two pairs or differences has no p and is not significant.
    """
    rows = scores.where(F.col(score).isNotNull()).select(*keys, F.col(model).alias("m"), F.col(sample).alias("s"), F.col(score).cast("double").alias("v"))
    have = rows.groupBy(*keys, "m").agg(F.count(F.lit(1)).alias("k"))
    side = lambda df, x: df.select(*keys, *[F.col(c).alias(c + x) if c in ("m", "v", "k") else F.col(c) for c in df.columns if c not in keys])
    compared = side(have, "a").join(side(have, "b"), keys).where("ma < mb")
    # a sample has a row for each model; those of one sample meet once, as the models are few
    pairs = side(rows, "a").join(side(rows, "b"), [*keys, "s"]).where("ma < mb")
    found = signed_ranks(pairs, [*keys, "ma", "mb"], "va", "vb")
    out = compared.join(found, [*keys, "ma", "mb"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "n_nonzero": F.coalesce("n_nonzero", F.lit(0)), "tie_term": F.coalesce("tie_term", F.lit(0))})
    out = out.withColumn("unpaired", F.col("ka") + F.col("kb") - 2 * F.col("n"))
    p = p_value("n_nonzero", F.when(F.col("unpaired") == 0, F.col("w").cast("double")), "tie_term", "n")
    out = out.select(*keys, F.col("ma").alias("model_a"), F.col("mb").alias("model_b"), "n", F.col("w").cast("double").alias("w"), p.alias("pval"), "unpaired")
    return out.withColumn("significant", F.coalesce(F.col("pval") < ALPHA, F.lit(False)))


def wilcoxon_test(pairs: DataFrame, a: str = "a", b: str = "b") -> dict:
    """pval, significant (p < 0.05) and n of one series of pairs; n < 2 or fewer than two differences: no p."""
    r = signed_ranks(pairs, [], a, b).collect()
    n = r[0]["n"] if r else 0
    p = wilcoxon_p(r[0]["n_nonzero"], r[0]["w"], r[0]["tie_term"], n) if r and r[0]["w"] is not None else None
    return {"pval": p, "significant": bool(p is not None and p < ALPHA), "n": n}
