"""Seeded samples: the order is a hash of seed and key, so it depends on neither partitions nor engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in seeded order; 0: all of them."""
    ordered = rows.withColumn("_h", seeded_order(key, seed)).orderBy("_h", key)
    return (ordered.limit(n) if n else ordered).drop("_h")


def quotas(n: int, languages: list[str]) -> dict[str, int]:
    """max(1, n // k) each and the remainder to the first ones; for n below k that is more than n."""
    k = len(languages)
    return {lang: max(1, n // k) + (i < n % k) for i, lang in enumerate(languages)}


def language_quota_sample(rows: DataFrame, key: str, n: int, languages: list[str], seed: int = 42, lang: str = "lang") -> DataFrame:
    """The first rows of each language in seeded order, up to its quota.

    A language's rows are cut to its quota within hash ranges first, so no task orders a whole language.
    """
    quota = quotas(n, languages)
    limit = F.element_at(F.create_map(*[x for k, v in quota.items() for x in (F.lit(k), F.lit(v))]), F.col(lang))
    rows = rows.where(F.col(lang).isin(languages)).withColumn("_h", seeded_order(key, seed))
    part = Window.partitionBy(lang, F.substring("_h", 1, 2)).orderBy("_h", key)
    near = rows.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= limit)
    whole = Window.partitionBy(lang).orderBy("_h", key)
    return near.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= limit).drop("_h", "_r")


def balanced_pair(positives: DataFrame, negatives: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n // 2 positives and the rest negatives, in seeded order, with label; either side may be empty."""
    half = n // 2
    take = lambda df, m: seeded_sample(df, key, m, seed) if m else df.limit(0)
    both = take(positives, half).withColumn("label", F.lit(1)).unionByName(take(negatives, n - half).withColumn("label", F.lit(0)))
    return both.withColumn("_h", seeded_order(key, seed + 1)).orderBy("_h", "label", key).drop("_h")


def filtered_sample(rows: DataFrame, key: str, n: int, keep, factor: int = 3, least: int = 150, seed: int = 42) -> DataFrame:
    """The first n rows that keep(rows) leaves of the first max(factor n, least) in seeded order: a builder that drops rows reads ahead, and may still come out with fewer."""
    return seeded_sample(keep(seeded_sample(rows, key, max(factor * n, least), seed)), key, n, seed)
