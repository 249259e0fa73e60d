"""Artifacts and run folders as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = """candidate string, harness string, model string, effective_model string, mode string, started_at string, finished_at string,
wall_seconds double, timed_out boolean, exit_code int, note string"""
#: Folder names that hold no candidate.
RESERVED = ("gallery", "screenshots", "results")


def candidates(spark: SparkSession, root: str, artifact: str = "slides.html", meta: str = "run_meta.json", names: list[str] | None = None) -> DataFrame:
    """candidate, html, meta of each folder that has an artifact or a run description; a description that isn't JSON is null."""
    part = F.element_at(F.split("path", "/"), -2).alias("candidate")
    # pathGlobFilter instead of a wildcard: an empty set of files is an empty table
    read = lambda name: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    html = read(artifact).select(part, F.col("value").alias("html"))
    desc = read(meta).select(part, F.from_json("value", META, {"mode": "PERMISSIVE"}).alias("meta"))
    both = html.join(desc, "candidate", "full").where(~F.col("candidate").isin(*RESERVED) & ~F.col("candidate").startswith("."))
    return both.where(F.col("candidate").isin(names)) if names else both


def artifact_config(spark: SparkSession, path: str) -> dict:
    """Slide counts and keywords of an artifact task."""
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def runs(spark: SparkSession, reports: str, results: str) -> DataFrame:
    """run_id of each report folder, newest first, with its manifest where there is one."""
    part = F.element_at(F.split("path", "/"), -2).alias("run_id")
    read = lambda root, name: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).format("binaryFile").load(root).select(part, "content")
    left = read(reports, "report.md").select("run_id")
    right = read(results, "manifest.json").select("run_id", F.from_json(F.decode("content", "UTF-8"), MANIFEST).alias("m"))
    return left.join(right, "run_id", "left").orderBy(F.desc("run_id"))


MANIFEST = "run_id string, created_at string, models array<struct<id:string,endpoint:string>>, reasoning_modes array<string>, task_ids array<string>, git_commit string, samples_per_task int, seed int, notes string"


def index_rows(runs_: DataFrame) -> DataFrame:
    """run_id and its columns of the index, '?' where the manifest has none."""
    or_q = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))
    return runs_.select(
        "run_id",
        F.substring(F.coalesce("m.created_at", F.lit("")), 1, 19).alias("created"),
        or_q(F.array_join("m.models.id", ",")).alias("models"),
        or_q(F.array_join("m.reasoning_modes", ",")).alias("modes"),
        F.coalesce(F.nullif(F.size("m.task_ids"), F.lit(0)).cast("string"), F.lit("?")).alias("n_tasks"),
        F.coalesce(F.col("m.samples_per_task").cast("string"), F.lit("?")).alias("samples"),
        or_q(F.col("m.git_commit")).alias("git"),
    )
