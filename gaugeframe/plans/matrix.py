"""The run plan: models x tasks x modes, and samples joined to it."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _image(task_id: Column) -> Column:
    return task_id.startswith("IMG-")


def all_cells(models: DataFrame, tasks: DataFrame, modes: DataFrame) -> DataFrame:
    """Every combination with supported: an image task needs the vision capability. The three sides are configuration."""
    cells = models.select("model_id", "endpoint", "capabilities", F.col("ordinal").alias("model_ordinal")).join(F.broadcast(tasks.select("task_id", F.col("ordinal").alias("task_ordinal")))).join(F.broadcast(modes))
    return cells.withColumn("supported", ~_image(F.col("task_id")) | F.array_contains("capabilities", "vision"))


def execution_matrix(models: DataFrame, tasks: DataFrame, modes: DataFrame, only_models: list[str] | None = None, only_modes: list[str] | None = None) -> DataFrame:
    """model_id, endpoint, task_id, reasoning_mode and ordinals of the cells to run."""
    if only_models:
        models = models.where(F.col("model_id").isin(only_models))
    if only_modes:
        modes = modes.where(F.col("reasoning_mode").isin(only_modes))
    return all_cells(models, tasks, modes).where("supported").drop("supported", "capabilities")


def not_applicable(models: DataFrame, tasks: DataFrame, modes: DataFrame) -> DataFrame:
    """n_na: combinations dropped for want of a capability."""
    return all_cells(models, tasks, modes).agg(F.count_if(~F.col("supported")).alias("n_na"))


def cells_per_model(cells: DataFrame) -> DataFrame:
    return cells.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_cells")).orderBy("model_id")


def reproducibility(tasks: DataFrame, registry: DataFrame) -> DataFrame:
    """dataset_key, hf_id, split, config of the data sets that tasks name (tasks.datasets: map of language to key)."""
    keys = tasks.select(F.explode("datasets").alias("lang", "dataset_key")).select("dataset_key").distinct()
    return keys.join(registry.select(F.col("key").alias("dataset_key"), "hf_id", "split", "config"), "dataset_key", "left")


def run_id(created: Column, suffix: str | None = None) -> Column:
    """YYYY-MM-DDTHH-MM and the suffix, in UTC. Runs of one minute share it; give a suffix where that matters."""
    stamp = F.date_format(created, "yyyy-MM-dd'T'HH-mm")
    return F.concat(stamp, F.lit(f"_{suffix}")) if suffix else stamp


def git_commit(folder: str = ".") -> str | None:
    """Short id of the commit that a folder is at, None where there is none."""
    try:
        out = subprocess.run(["git", "-C", folder, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return out.stdout.strip() or None if out.returncode == 0 else None


def planned_samples(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per cell and sample of its task."""
    return cells.join(samples, "task_id")


def skipped_cells(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Cells whose task has no samples."""
    return cells.join(samples.select("task_id").distinct(), "task_id", "left_anti")
