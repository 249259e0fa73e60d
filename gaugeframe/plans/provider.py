"""Answers for planned samples: replayed from a table, or from a caller's function once per row."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits

KEYS = ["model_id", "task_id", "reasoning_mode", "sample_id"]
ERROR = "__ERROR__: "


def replay(planned: DataFrame, responses: DataFrame) -> DataFrame:
    """planned with model_output, finish_reason, usage and latency_ms. A call that failed, or has no answer, keeps its error as its output and is scored like any other.

    A sample that was asked about more than once has one answer: one that didn't fail before one that did, then by
    request_id and text, so that it is the same in every run.
    """
    r = responses.select(*KEYS, *[c for c in ("text", "error", "finish_reason", "usage", "latency_ms", "request_id") if c in responses.columns])
    for c, kind in (("error", "string"), ("finish_reason", "string"), ("usage", "string"), ("latency_ms", "double"), ("request_id", "string")):
        if c not in r.columns:
            r = r.withColumn(c, F.lit(None).cast(kind))
    failed = F.col("error").isNotNull() | F.col("text").isNull()
    columns = [c for c in r.columns if c not in KEYS]
    first = F.min_by(F.struct(*columns), F.struct(failed, F.col("request_id").isNull(), "request_id", "text", "error"))
    r = r.groupBy(*KEYS).agg(first.alias("r")).select(*KEYS, "r.*")
    joined = planned.join(r, KEYS, "left")
    return joined.withColumns(
        {
            "model_output": F.when(failed, F.concat(F.lit(ERROR), F.coalesce("error", F.lit("no response")))).otherwise(F.col("text")),
            "finish_reason": F.when(failed, "error").otherwise(F.col("finish_reason")),
            "usage": F.when(failed, "{}").otherwise(F.coalesce("usage", F.lit("{}"))),
        }
    ).drop("text", "error")


def live(planned: DataFrame, ask: Callable[[str, str], dict], path: str, batch_rows: int = 10_000, in_flight: int = 8, again: bool = False) -> DataFrame:
    """Calls ask(endpoint, prompt) -> {text, finish_reason, usage, latency_ms} for each row that path has no answer to, and gives all its answers.

    Answers are written in batches of about batch_rows; a run that breaks off has lost no whole batch, and one that is
    begun anew asks only what is left. A task that is run again within a batch asks again, so everything that follows reads the
    answers from path. Of each endpoint at most in_flight calls are made at a time: its rows are dealt to so many tasks, which ask one after the other. A failed
    call is an answer of its own kind; with again, those are asked once more, and replay prefers an answer that didn't fail.
    retried() gives ask a policy of retries.
    """
    spark = planned.sparkSession
    planned = planned.select(*KEYS, "endpoint", "prompt")
    schema = ", ".join(f"{k} {planned.schema[k].dataType.simpleString()}" for k in KEYS) + ", text string, error string, finish_reason string, usage string, latency_ms double"
    done = answered(spark, path, schema)
    # by key and not null-safe: a row with a null in its key is asked each time
    left = planned.join((done.where("error is null") if again else done).select(*KEYS), KEYS, "left_anti")
    rows, endpoints = left.agg(F.count(F.lit(1)), F.count_distinct(F.coalesce("endpoint", F.lit("")))).first()
    n = -(-rows // batch_rows)
    place = F.xxhash64(*KEYS)
    for i in range(n):
        part = left.where(F.pmod(place, F.lit(n)) == i).withColumn("slot", F.pmod(F.xxhash64(place), F.lit(in_flight)))
        commits.append_batch(part.repartition(in_flight * endpoints, "endpoint", "slot").mapInPandas(_asking(ask), schema), path)
    return answered(spark, path, schema)


def answered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The answers of all whole batches below path."""
    found = commits.batches(spark, path)
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def _asking(ask: Callable[[str, str], dict]):
    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                began = time.time()
                try:
                    got = ask(row.endpoint, row.prompt)
                    out.append((got.get("text"), None, got.get("finish_reason"), json.dumps(got.get("usage") or {}), got.get("latency_ms", (time.time() - began) * 1000)))
                except Exception as e:  # a failed call is an answer of its own kind
                    out.append((None, str(e), "error", "{}", (time.time() - began) * 1000))
            pdf = pdf[KEYS].copy()
            for i, c in enumerate(("text", "error", "finish_reason", "usage", "latency_ms")):
                pdf[c] = [o[i] for o in out]
            yield pdf

    return run


def offline(names: tuple[str, ...] = ("HF_HUB_OFFLINE", "GAUGEFRAME_OFFLINE"), env: dict | None = None) -> bool:
    """Whether one of these variables is '1'."""
    env = os.environ if env is None else env
    return "1" in [env.get(n) for n in names]


class CallFailed(Exception):
    """A call that is not worth repeating, or was repeated in vain."""


def retried(post: Callable[[str, str], tuple[int, dict]], attempts: int = 3, backoff: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable[[str, str], dict]:
    """An ask for live() from post(endpoint, prompt) -> (status, answer).

    Time-outs, status 429 and 500 or more are asked again after backoff,
    2 backoff, 4 backoff ... seconds; any other status but 200 fails at once.
    """

    def ask(endpoint: str, prompt: str) -> dict:
        last = ""
        for n in range(attempts):
            if n:
                sleep(backoff * 2 ** (n - 1))
            try:
                status, answer = post(endpoint, prompt)
            except TimeoutError as e:
                last = f"timeout: {e}"
                continue
            if status == 200:
                return answer
            last = f"status {status}"
            if status != 429 and status < 500:
                raise CallFailed(last)
        raise CallFailed(f"{last} after {attempts} attempts")

    return ask
