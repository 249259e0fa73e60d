"""An extension: latency and token aggregates over a stream of calls, by event-time window and model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_perf(calls: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, model_id, n_calls, errors, in_tokens, latency_ms_mean of each window; calls: ts, model_id, is_error, latency_ms, in_tokens.

    Calls later than the watermark are left out of windows that have closed.
    """
    ok = ~F.coalesce("is_error", F.lit(False))
    return (
        calls.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", window), "model_id")
        .agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(~ok).alias("errors"), F.sum(F.when(ok, F.col("in_tokens"))).alias("in_tokens"), F.avg(F.when(ok, F.col("latency_ms"))).alias("latency_ms_mean"))
        .select(F.col("window.start").alias("start"), "model_id", "n_calls", "errors", "in_tokens", "latency_ms_mean")
    )
