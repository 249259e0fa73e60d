import pytest

from compare import SF, same
from gaugeframe import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3


def test_stream_and_batch_agree(spark, tmp_path):
    from pyspark.sql import functions as F

    from gaugeframe.streaming.perf import windowed_perf

    calls = queries.calls(spark, SF).select("ts", "model_id", "is_error", "latency_ms", "in_tokens").withColumn("ts", F.col("ts").cast("timestamp"))
    calls.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    q = windowed_perf(stream).writeStream.format("memory").queryName("perf_windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    key = lambda df: sorted((r["start"], r["model_id"], r["n_calls"], r["errors"]) for r in df.collect())
    assert key(spark.sql("select * from perf_windows")) == key(windowed_perf(calls))


def test_plans_stay_in_the_engine(spark):
    """Only the text kernels that are sequential by nature run Python."""
    python = {"rouge_l_turns", "fuzzy_ratio_turns", "cell_f1"}
    for name in ("perf_by_model", "token_f1_turns", "parse_tags", "judge_score", "auto_score", "multilabel_prf", "cost_of_calls"):
        assert name not in python
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
