"""Latency, token and cost aggregates by model, with exact order statistics that need no sorted list of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import order_statistics

def median_and_p95(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median (mean of the middle two), p95: the sorted element at round-half-even(0.95 (n - 1))."""
    n = F.col("_n")
    got = order_statistics(rows, keys, value, {"a": F.floor((n - 1) / 2), "b": F.ceil((n - 1) / 2), "p": F.rint(F.lit(0.95) * (n - 1))})
    return got.select(*keys, ((F.col("a") + F.col("b")) / 2).alias("median"), F.col("p").cast("double").alias("p95"))


def perf_by_model(calls: DataFrame) -> DataFrame:
    """model_id, n_calls, errors, latency_ms_median, latency_ms_p95, total_usd, in_tokens, out_tokens.

    calls: model_id, is_error, latency_ms, usd, in_tokens, out_tokens. All but
    n_calls and errors are over calls without an error; p95 of none is 0.0.
    """
    ok = ~F.coalesce("is_error", F.lit(False))
    sums = calls.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(~ok).alias("errors"),
        F.coalesce(F.sum(F.when(ok, F.col("usd"))), F.lit(0.0)).alias("total_usd"),
        F.coalesce(F.sum(F.when(ok, F.col("in_tokens"))), F.lit(0)).alias("in_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("out_tokens"))), F.lit(0)).alias("out_tokens"),
    )
    ranks = median_and_p95(calls.where(ok), ["model_id"], "latency_ms")
    return sums.join(ranks, "model_id", "left").select("model_id", "n_calls", "errors", F.col("median").alias("latency_ms_median"), F.coalesce("p95", F.lit(0.0)).alias("latency_ms_p95"), "total_usd", "in_tokens", "out_tokens")
