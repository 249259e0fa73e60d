"""Shared plumbing: reading tables, scratch tables in the shared folder, byte-level hashing."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: A-Z to a-z and nothing else; Spark's lower() would fold other letters too.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def importable(spark: SparkSession) -> None:
    """Python workers that see this folder find the package, whatever folder the driver was started in."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def free_name(name: str, taken: list[str]) -> str:
    """A column name that none of the taken ones clashes with."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def shielded(df: DataFrame, *own: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with the columns other than own under plain names, which clash with nothing an operator adds, and what gives a result its names back.

    Columns that the operator has added come last, and keep their names or get those given. A column of own that df has in another case is taken for it.
    """
    taken = {c.lower(): i for i, c in reversed(list(enumerate(df.columns)))} | {c: i for i, c in enumerate(df.columns)}
    place = {taken.get(c, taken.get(c.lower())): c for c in own}
    names = [place.get(i, f"column_{i}") for i in range(len(df.columns))]

    def back(out: DataFrame, *added: str) -> DataFrame:
        return out.toDF(*df.columns, *(added or out.columns[len(names) :]))

    return df.toDF(*names), back


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and driver and executors are one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gaugeframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded in bytes, so that long texts do not fill a Python worker; a bound already set is kept."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


_roots: list[str] = []


@atexit.register
def _forget() -> None:
    """What is left of this process's tables goes with it."""
    jvm = SparkContext._jvm
    with contextlib.suppress(Exception):  # at exit the JVM may be gone
        for root in _roots:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


class Scratch:
    """Written tables that cut lineage and survive the loss of executors.

    Tables live in the shared folder; ``drop`` removes one as soon as nothing
    reads it any more. Tables behind a returned (lazy) result stay until the
    driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bounded_batches(spark)
        self.root = f"{shared_dir(spark)}/gaugeframe/{name}-{uuid.uuid4().hex[:12]}"
        _roots.append(self.root)
        self.paths: dict[int, str] = {}
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop_but(self, *frames: DataFrame) -> None:
        """Removes all tables kept so far but these."""
        stay = {self.paths[id(f)] for f in frames}
        self._delete([p for p in self.paths.values() if p not in stay])
        self.paths = {k: p for k, p in self.paths.items() if p in stay}

    def drop(self, *frames: DataFrame) -> None:
        self._delete([self.paths.pop(id(df)) for df in frames])

    def _delete(self, paths: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished, unreferenced plans now rather than at the driver's next GC."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
