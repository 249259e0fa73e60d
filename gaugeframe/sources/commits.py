"""What is written once and read only when it is whole: batches of a table, and runs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class RunExists(Exception):
    """A run of this id has been begun by another writer."""


def _at(spark: SparkSession, path: str):
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return to, to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    to, fs = _at(spark, path)
    return fs.exists(to)


def children(spark: SparkSession, path: str) -> list[str]:
    """The folders below path by name, sorted; none if there is no such folder."""
    to, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(to) if s.isDirectory()) if fs.exists(to) else []


# ---- batches -----------------------------------------------------------------------------------------------


def append_batch(df: DataFrame, path: str) -> str:
    """Writes df as one more batch below path. Its success marker is Spark's last act, so a batch that breaks off is never read."""
    name = f"{path.rstrip('/')}/batch-{uuid.uuid4().hex}"
    df.write.parquet(name)
    return name


def batches(spark: SparkSession, path: str) -> list[str]:
    """The whole batches below path."""
    found = [f"{path.rstrip('/')}/{n}" for n in children(spark, path) if n.startswith("batch-")]
    return [b for b in found if exists(spark, f"{b}/_SUCCESS")]


# ---- runs --------------------------------------------------------------------------------------------------


class Run:
    """A run that is being written below root: tables first, its manifest last; without that no reader sees it."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.run_id = spark, run_id
        self.path = f"{root.rstrip('/')}/run_id={run_id}"

    def write(self, table: str, df: DataFrame, sets: tuple[str, ...] = ()) -> None:
        """A table as JSON lines; a table that is there already is an error."""
        from pyspark.sql import functions as F

        for c in sets:
            df = df.withColumn(c, F.array_sort(c)) if c in df.columns else df
        df.drop("run_id").write.json(f"{self.path}/{table}")

    def commit(self, manifest: dict) -> None:
        from .sinks import write_manifest

        if exists(self.spark, f"{self.path}/manifest.json"):
            raise RunExists(self.run_id)
        write_manifest(self.spark, manifest | {"run_id": self.run_id}, f"{self.path}/manifest.json")


def begin_run(spark: SparkSession, root: str, run_id: str, suffix: bool = False) -> Run:
    """Claims a run id, which has the minute it began in; an id that another writer has claimed, whole or not, is refused or,
    with suffix, gets -2, -3 and so on. The claim is a file that is created and never replaced: atomic where the file system's create is, as in HDFS."""
    for n in range(1, 1000 if suffix else 2):
        run = Run(spark, root, run_id if n == 1 else f"{run_id}-{n}")
        to, fs = _at(spark, f"{run.path}/_claim")
        token = uuid.uuid4().hex
        try:
            out = fs.create(to, False)
        except Exception as e:  # the gateway wraps the file system's error
            if "FileAlreadyExists" not in str(e):
                raise
            continue
        out.write(bytearray(json.dumps({"token": token}).encode()))
        out.close()
        return run
    raise RunExists(run_id)


def committed_runs(spark: SparkSession, root: str) -> list[str]:
    """The ids of the runs that are whole, newest first."""
    names = [n for n in children(spark, root) if n.startswith("run_id=") and exists(spark, f"{root.rstrip('/')}/{n}/manifest.json")]
    return [n.removeprefix("run_id=") for n in reversed(names)]


def read_runs(spark: SparkSession, root: str, table: str, run_ids: list[str] | None = None) -> DataFrame | None:
    """run_id and a table of the runs that are whole, or of some of them; None if there are none."""
    from pyspark.sql import functions as F

    whole = [r for r in committed_runs(spark, root) if run_ids is None or r in run_ids]
    paths = [f"{root.rstrip('/')}/run_id={r}/{table}" for r in whole]
    paths = [p for p in paths if exists(spark, p)]
    if not paths:
        return None
    rows = spark.read.json(paths)
    return rows.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), r"/run_id=([^/]+)/", 1))
