"""Token cost from usage records and a rate card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATES = "endpoint string, lo_tokens long, hi_tokens long, tier string, dbu_in double, dbu_out double, dbu_cache_read double, dbu_cache_write double, promo double"
THRESHOLD = 200_000


def rate_table(spark: SparkSession, card: dict) -> DataFrame:
    """One row per endpoint and tier of prompt tokens, [lo, hi). A card is configuration; its size is that of a file read on the driver."""
    rows = []
    for endpoint, r in card.get("models", {}).items():
        if "short" in r and "long" in r:
            at = int(r.get("context_threshold_tokens", THRESHOLD))
            tiers = [(None, at, "short", r["short"]), (at, None, "long", r["long"])]
        else:
            tiers = [(None, None, "flat", r)]
        for lo, hi, tier, x in tiers:
            rows.append((endpoint, lo, hi, tier, *[float(x.get(k, 0)) for k in ("dbu_in", "dbu_out", "dbu_cache_read", "dbu_cache_write")], float(r.get("promo_multiplier", 1.0))))
    return spark.createDataFrame(rows, RATES)


def usage_tokens(usage: Column) -> dict[str, Column]:
    """Token counts of a usage record in JSON. The first path that is there wins, even at 0; prompt and completion at 0 give way to their other names."""
    at = lambda *path: F.get_json_object(usage, "$." + ".".join(path)).try_cast("double").cast("long")
    prompt = F.coalesce(F.nullif(at("prompt_tokens"), F.lit(0)), at("input_tokens"), F.lit(0))
    completion = F.coalesce(F.nullif(at("completion_tokens"), F.lit(0)), at("output_tokens"), F.lit(0))
    reasoning = F.coalesce(at("reasoning_tokens"), at("completion_tokens_details", "reasoning_tokens"), at("token_details", "output_reasoning_tokens"), F.lit(0))
    cached = F.coalesce(at("prompt_tokens_details", "cached_tokens"), at("token_details", "cache_read_input_tokens"), at("cache_read_input_tokens"), F.lit(0))
    return {
        "prompt": prompt,
        "completion": completion,
        "reasoning": reasoning,
        "cached": cached,
        "cache_write": F.coalesce(at("cache_creation_input_tokens"), F.lit(0)),
        "billable_in": F.greatest(F.lit(0), prompt - cached),
        "billable_out": completion + reasoning,
    }


def reasoning_tokens(usage: Column) -> Column:
    """Reasoning tokens as the smoke test reads them: top level, then the completion's details."""
    at = lambda p: F.get_json_object(usage, p).try_cast("double").cast("long")
    return F.coalesce(at("$.reasoning_tokens"), at("$.completion_tokens_details.reasoning_tokens"), F.lit(0))


def price(billable_in: Column, billable_out: Column, cached: Column, cache_write: Column, usd_per_dbu: float) -> Column:
    dbu = billable_in * F.col("dbu_in") + billable_out * F.col("dbu_out") + cached * F.col("dbu_cache_read") + cache_write * F.col("dbu_cache_write")
    return F.lit(usd_per_dbu) * dbu / F.lit(1e6) * F.col("promo")


def with_usd(calls: DataFrame, rates: DataFrame, usd_per_dbu: float, endpoint: str = "endpoint", usage: str = "usage") -> DataFrame:
    """calls with the token counts and usd; null for an endpoint that the card lacks."""
    t = usage_tokens(F.col(usage))
    c = calls.withColumns({f"tokens_{k}": v for k, v in t.items()}).alias("c")
    r = F.broadcast(rates.withColumnRenamed("endpoint", "_endpoint"))
    inside = (F.col("tokens_prompt") >= F.coalesce("lo_tokens", F.lit(-(1 << 62)))) & (F.col("tokens_prompt") < F.coalesce("hi_tokens", F.lit(1 << 62)))
    j = c.join(r, (F.col(f"c.{endpoint}") == F.col("_endpoint")) & inside, "left")
    usd = price(F.col("tokens_billable_in"), F.col("tokens_billable_out"), F.col("tokens_cached"), F.col("tokens_cache_write"), usd_per_dbu)
    return j.withColumn("usd", usd).select("c.*", "tier", "usd")


def cost_by_endpoint(calls: DataFrame, rates: DataFrame, usd_per_dbu: float) -> DataFrame:
    """endpoint, tier, counts and usd: whole tokens are summed first, so that the price is rounded once."""
    rows = with_usd(calls, rates, usd_per_dbu)
    sums = rows.groupBy("endpoint", "tier").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"tokens_{k}").alias(k) for k in ("billable_in", "billable_out", "cached", "cache_write")])
    r = F.broadcast(rates.select(F.col("endpoint").alias("_e"), F.col("tier").alias("_t"), "dbu_in", "dbu_out", "dbu_cache_read", "dbu_cache_write", "promo"))
    j = sums.join(r, (F.col("endpoint") == F.col("_e")) & (F.col("tier") == F.col("_t")), "left")
    return j.select("endpoint", "tier", "n", "billable_in", "billable_out", "cached", "cache_write", price(F.col("billable_in"), F.col("billable_out"), F.col("cached"), F.col("cache_write"), usd_per_dbu).alias("usd"))


#: Columns of a usage table that a lookup returns.
USAGE = ["request_id", "event_time", "endpoint_name", "status_code", "latency_ms", "time_to_first_byte_ms", "input_tokens", "output_tokens", "total_tokens", "token_details"]


def usage_of(usage: DataFrame, request_ids: DataFrame, key: str = "request_id") -> DataFrame:
    """The usage rows of the requests, newest first; of none where there are no requests. Columns that a table lacks are null."""
    have = [F.col(c) if c in usage.columns else F.lit(None).alias(c) for c in USAGE]
    wanted = request_ids.select(F.col(key).alias("request_id")).distinct()
    return usage.select(*have).join(wanted, "request_id", "left_semi").orderBy(F.desc_nulls_last("event_time"), "request_id")


def with_usage(results: DataFrame, usage: DataFrame, key: str = "request_id") -> DataFrame:
    """results, every row, with the usage of their requests where there is any."""
    have = [c for c in USAGE if c in usage.columns and c != "request_id" and c not in results.columns]
    return results.join(usage.select(F.col("request_id").alias(key), *have), key, "left")
