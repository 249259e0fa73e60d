"""Ranks and order statistics by counting.

The range of a group's values is cut into ``DIGITS`` equal parts, and each part again, so that what must be ordered is a
few thousand counts, or the values of one part of a part: no task orders a group. Parts follow from values alone.
Values are numbers; nulls and NaN are left out, infinite ones come first and last. Groups whose key has a null are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 4096


def digit(value: Column, lo: Column, hi: Column) -> Column:
    """The part of lo to hi that a value lies in; it never falls as the value grows."""
    x = F.try_divide(value - lo, hi - lo) * DIGITS
    inner = F.when(F.isnan(x) | (x >= DIGITS), DIGITS - 1).otherwise(F.floor(x))
    return F.when(value == lo, 0).when(value == hi, DIGITS - 1).otherwise(F.coalesce(inner, F.lit(0))).cast("int")


def _ends(value: str) -> list[Column]:
    v = F.col(value).cast("double")
    return [F.min(v).alias("_lo"), F.max(v).alias("_hi")]


def _cut(rows: DataFrame, ends: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """rows with the part of the range of their group that they lie in; ends: by, _lo, _hi. Rows of groups without ends go."""
    v = F.col(value).cast("double")
    return rows.join(ends.select(*by, "_lo", "_hi"), by).withColumn(name, digit(v, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def _numbers(rows: DataFrame, value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def weight_before(rows: DataFrame, keys: list[str], value: str, weight: str, name: str = "before") -> DataFrame:
    """rows with the total weight of the rows of the same keys that have a smaller value.

    rows: one for each keys and value. The total is that of smaller parts, of smaller parts within the part, and of smaller values there.
    """
    rows = _numbers(rows, value).withColumn("_all", F.lit(0))
    by = [*keys, "_all"]
    before = lambda inside, order: F.coalesce(F.sum("_w").over(Window.partitionBy(*inside).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = _cut(rows, rows.groupBy(*by).agg(*_ends(value)), by, value, "_d1")
    one = rows.groupBy(*by, "_d1").agg(F.sum(weight).alias("_w"), *_ends(value))
    one = one.withColumn("_b1", before(by, "_d1")).drop("_w")
    v = F.col(value).cast("double")
    rows = rows.join(one, [*by, "_d1"]).withColumn("_d2", digit(v, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    two = rows.groupBy(*by, "_d1", "_d2").agg(F.sum(weight).alias("_w")).withColumn("_b2", before([*by, "_d1"], "_d2")).drop("_w")
    rows = rows.join(two, [*by, "_d1", "_d2"]).withColumn("_w", F.col(weight))
    return rows.withColumn(name, F.col("_b1") + F.col("_b2") + before([*by, "_d1", "_d2"], value)).drop("_all", "_d1", "_d2", "_b1", "_b2", "_w")


def order_statistics(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """keys and, by name, the value of exact rank. ranks: name -> rank from 0 as a function of _n, the number of values.

    Two rounds of counts narrow each rank to one part of a part; equal values are one row before anything is ordered.
    """
    rows = _numbers(rows, value).select(*keys, F.col(value).alias("_v"), F.lit(0).alias("_all"))
    by = [*keys, "_all"]
    ends = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *_ends("_v"))
    wants = ends.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), r.cast("long").alias("rank")) for n, r in ranks.items()])).alias("_w")).select(*by, "_w.*")

    def found(counts: DataFrame, wants: DataFrame, inside: list[str], order: str) -> DataFrame:
        """wants, each with the row of counts that holds its rank, and its rank within that."""
        upto = Window.partitionBy(*inside).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("_upto", F.sum("_c").over(upto))
        hit = wants.join(counts, inside).where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_c")))
        return hit.withColumn("rank", F.col("rank") - (F.col("_upto") - F.col("_c"))).drop("_upto", "_c")

    path = list(by)
    for d in ("_d1", "_d2"):
        rows = _cut(rows, ends, path, "_v", d)
        counts = rows.groupBy(*path, d).agg(F.count(F.lit(1)).alias("_c"), *_ends("_v"))
        wants = found(counts, wants, path, d)
        path = [*path, d]
        ends = wants.select(*path, "_lo", "_hi").distinct()
        wants = wants.drop("_lo", "_hi")
    left = rows.join(ends.select(*path), path, "left_semi").groupBy(*path, "_v").agg(F.count(F.lit(1)).alias("_c"))
    out = found(left, wants, path, "_v")
    return out.groupBy(*keys).agg(*[F.min(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in ranks])
