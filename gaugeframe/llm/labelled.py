"""Labelled rows for fitting, and sums of fixed-size arrays over all tasks."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null keys count as fold -1."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)), F.lit(-1)).cast("int")


def labelled_sample(labels: DataFrame, column: str, folds: int, held_out: int, per_label: int) -> tuple[list[tuple[int, int]], float]:
    """At most per_label (doc_id, label) of each label outside the held-out fold, and the share of label 1 among all of those rows.

    The sample is the first rows by hash of their id, so it does not depend on partitions.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (fold_of(F.col("doc_id"), folds) != held_out))
    rows = rows.groupBy("doc_id").agg(F.min(column).alias("y"), F.max(column).alias("y2")).where("y = y2")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked: list[tuple[int, int]] = []
    for y in (0, 1):
        picked += [(r["doc_id"], y) for r in rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(per_label).collect()]
    total = sum(counts.values())
    return picked, (counts.get(1, 0) / total if total else 0.5)


def sample_rows(docs: DataFrame, picked: list[tuple[int, int]], spark: SparkSession) -> DataFrame:
    """doc_id, text, y of the picked rows. The broadcast side has as many rows as the sample's bound."""
    ids = spark.createDataFrame(picked, "doc_id long, y int")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null")


def salts_of(spark: SparkSession, blocks: int) -> int:
    """Partial sums of each block: as many as the cluster has cores for, 8 at least."""
    return max(8, spark.sparkContext.defaultParallelism // blocks)


def sum_arrays(parts: DataFrame, spark: SparkSession, blocks: int) -> np.ndarray:
    """The sum of float32 arrays that tasks emit by emit_array as (block int, salt int, blob binary); the result has a fixed size.

    Each task streams over its rows and holds one array per block, so neither
    the number of tasks nor of rows matters for memory.
    """

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column("block").to_pylist(), b.column("blob")):
                x = np.frombuffer(zlib.decompress(blob.as_buffer()), np.float32)
                if k in held:
                    held[k] += x
                else:
                    held[k] = x.astype(np.float64)
        if held:
            keys = sorted(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([0] * len(keys), pa.int32()), pa.array([zlib.compress(held[k].astype(np.float32).tobytes(), 1) for k in keys], pa.binary())], ["block", "salt", "blob"])

    schema = "block int, salt int, blob binary"
    first = parts.repartition("block", "salt").mapInArrow(add, schema)
    rows = first.repartition("block").mapInArrow(add, schema).collect()
    got = {r["block"]: np.frombuffer(zlib.decompress(r["blob"]), np.float32) for r in rows}
    return np.concatenate([got[k] for k in range(blocks)]) if len(got) == blocks else None


def emit_array(x: np.ndarray, blocks: int, salt: int) -> pa.RecordBatch:
    cut = np.split(x.astype(np.float32), blocks)
    return pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([salt] * blocks, pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in cut], pa.binary())], ["block", "salt", "blob"])
