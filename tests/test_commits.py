import os
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest

from compare import SF
from gaugeframe import queries
from gaugeframe.plans import provider
from gaugeframe.sources import commits
from pyspark.sql import functions as F

PLAN = "model_id string, task_id string, reasoning_mode string, sample_id long, endpoint string, prompt string"


def asked(log):
    return Counter(log.read_text().split()) if log.exists() else Counter()


def test_a_run_that_is_killed_asks_nothing_twice_that_it_has_committed(spark, tmp_path):
    planned = spark.createDataFrame([("m", "t", "full", i, f"e{i % 2}", f"p{i}") for i in range(60)], PLAN)
    log, ill, path = tmp_path / "log", tmp_path / "ill", str(tmp_path / "answers")
    ill.write_text("")

    def ask(endpoint, prompt, log=str(log), ill=str(ill)):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if os.path.exists(ill) and len(open(log).read().split()) > 30:
            os._exit(1)  # the worker is gone, and with it the task and the batch
        return {"text": prompt.upper(), "finish_reason": "stop"}

    with pytest.raises(Exception):
        provider.live(planned, ask, path, batch_rows=10, in_flight=2)
    kept = {f"p{r['sample_id']}" for b in commits.batches(spark, path) for r in spark.read.parquet(b).collect()}
    assert 0 < len(kept) < 60
    before = asked(log)
    ill.unlink()
    got = provider.live(planned, ask, path, batch_rows=10, in_flight=2)
    assert {r["sample_id"]: r["text"] for r in got.collect()} == {i: f"P{i}" for i in range(60)} and got.count() == 60
    assert all(asked(log)[p] == before[p] == 1 for p in kept)
    provider.live(planned, ask, path)
    assert sum(asked(log).values()) == sum(before.values()) + 60 - len(kept)  # nothing is left to ask


def test_calls_in_flight_are_bounded(spark, tmp_path):
    planned = spark.createDataFrame([("m", "t", "full", i, f"e{i % 3}", f"p{i}") for i in range(40)], PLAN)
    log = str(tmp_path / "log")

    def ask(endpoint, prompt):
        from pyspark import TaskContext

        with open(log, "a") as f:
            f.write(f"{endpoint}:{TaskContext.get().partitionId()}\n")
        return {"text": "x"}

    provider.live(planned, ask, str(tmp_path / "a"), in_flight=2)
    tasks = {}
    for line in open(log).read().split():
        endpoint, task = line.split(":")
        tasks.setdefault(endpoint, set()).add(task)
    assert set(tasks) == {"e0", "e1", "e2"} and max(map(len, tasks.values())) <= 2


def test_failed_calls_are_asked_again_if_wanted(spark, tmp_path):
    planned = spark.createDataFrame([("m", "t", "full", i, "e", f"p{i}") for i in range(4)], PLAN)
    path, well = str(tmp_path / "a"), tmp_path / "well"

    def ask(endpoint, prompt, well=str(well)):
        if prompt == "p1" and not os.path.exists(well):
            raise TimeoutError("late")
        return {"text": "ok"}

    outputs = lambda got: [r["model_output"] for r in provider.replay(planned, got).orderBy("sample_id").collect()]
    assert outputs(provider.live(planned, ask, path)) == ["ok", "__ERROR__: late", "ok", "ok"]
    well.write_text("")
    assert outputs(provider.live(planned, ask, path)) == ["ok", "__ERROR__: late", "ok", "ok"]
    assert outputs(provider.live(planned, ask, path, again=True)) == ["ok"] * 4


def test_live_answers_equal_replayed_ones(spark, tmp_path):
    """Over conversations: a function that knows the answers, and the table of the answers."""
    t = queries.turns(spark, SF).select(F.lit("m").alias("model_id"), F.lit("TXT-1").alias("task_id"), F.lit("full").alias("reasoning_mode"), (F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"), F.lit("e").alias("endpoint"), F.col("gold").alias("prompt"), "pred")
    known = {r["prompt"]: r["pred"] for r in t.groupBy("prompt").agg(F.min("pred").alias("pred")).collect()}
    planned = t.drop("pred")
    answers = planned.join(spark.createDataFrame(list(known.items()), "prompt string, text string"), "prompt").select(*provider.KEYS, "text", F.lit("stop").alias("finish_reason"))
    got = provider.live(planned, lambda endpoint, prompt: {"text": known[prompt], "finish_reason": "stop"}, str(tmp_path / "a"), batch_rows=25)
    rows = lambda df: sorted(map(repr, provider.replay(planned, df).select(*provider.KEYS, "model_output", "finish_reason", "usage").collect()))
    assert rows(got) == rows(answers) and planned.count() > 20


def test_two_writers_of_one_minute(spark, tmp_path):
    root = str(tmp_path / "runs")
    rows = lambda x: spark.createDataFrame([(x, ["b", "a"])], "who string, ref_set array<string>")
    one = commits.begin_run(spark, root, "2024-01-01T10-00_x")
    with pytest.raises(commits.RunExists):
        commits.begin_run(spark, root, "2024-01-01T10-00_x")
    two = commits.begin_run(spark, root, "2024-01-01T10-00_x", suffix=True)
    assert two.run_id == "2024-01-01T10-00_x-2"
    with ThreadPoolExecutor() as pool:
        list(pool.map(lambda x: x[0].write("samples", rows(x[1]), sets=("ref_set",)), [(one, "one"), (two, "two")]))
    # data without a manifest isn't there yet
    assert commits.committed_runs(spark, root) == [] and commits.read_runs(spark, root, "samples") is None
    two.commit({"seed": 42})
    assert [(r["who"], r["run_id"]) for r in commits.read_runs(spark, root, "samples").collect()] == [("two", two.run_id)]
    one.commit({})
    assert commits.committed_runs(spark, root) == [two.run_id, one.run_id]
    assert {r["who"]: (r["run_id"], r["ref_set"]) for r in commits.read_runs(spark, root, "samples").collect()} == {"one": (one.run_id, ["a", "b"]), "two": (two.run_id, ["a", "b"])}
    assert commits.read_runs(spark, root, "samples", [one.run_id]).count() == 1 and commits.read_runs(spark, root, "nothing") is None
    with pytest.raises(commits.RunExists):
        one.commit({})
    with pytest.raises(Exception):
        one.write("samples", rows("again"))
