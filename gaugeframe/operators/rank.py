"""Representative metrics, winners and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The metrics that can stand for a task, in order.
PRIORITY = ["accuracy", "f1", "token_f1", "rouge1", "judge_mean", "judge_score_mean"]


def representative(scores: DataFrame) -> DataFrame:
    """model_id, task_id, reasoning_mode, ordinal, score, score_4 (rounded); scores: long form with metric and value. Groups without any are dropped."""
    keys = [c for c in ("model_id", "task_id", "reasoning_mode", "ordinal") if c in scores.columns]
    wide = scores.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in PRIORITY])
    return wide.select(*keys, F.coalesce(*PRIORITY).alias("score")).where("score is not null").withColumn("score_4", F.bround("score", 4))


def winners(rep: DataFrame) -> DataFrame:
    """task_id, reasoning_mode, winner, score_4: the largest rounded score; ties go to the model that comes first."""
    order = Window.partitionBy("task_id", "reasoning_mode").orderBy(F.desc("score_4"), "ordinal")
    return rep.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("task_id", "reasoning_mode", F.col("model_id").alias("winner"), "score_4")


def win_counts(won: DataFrame) -> DataFrame:
    return won.groupBy(F.col("winner").alias("model_id")).agg(F.count(F.lit(1)).alias("wins"))


def cheapest_fastest(perf: DataFrame) -> DataFrame:
    """kind, model_id: the least total_usd, and the least median latency that isn't null; ties by ordinal."""
    first = lambda kind, c: perf.where(F.col(c).isNotNull()).orderBy(c, "ordinal").limit(1).select(F.lit(kind).alias("kind"), "model_id")
    return first("cheapest", "total_usd").unionAll(first("fastest", "latency_ms_median"))


def quant_rows(scores: DataFrame) -> DataFrame:
    """key, and the first four metrics in order as text; scores: long form with position."""
    key = F.concat_ws("::", "model_id", "task_id", "reasoning_mode").alias("key")
    top = F.slice(F.array_sort(F.collect_list(F.struct("position", "metric", "value"))), 1, 4)
    text = F.array_join(F.transform(top, lambda x: F.concat(x["metric"], F.lit("="), F.format_string("%.3f", x["value"]))), ", ")
    return scores.groupBy(key).agg(text.alias("cell")).orderBy("key")
