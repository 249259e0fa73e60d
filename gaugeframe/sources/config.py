"""Configuration files to dimension tables. They are read on the driver; all are of a file's size."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cost import rate_table


def read_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def tasks_table(spark: SparkSession, config: dict) -> DataFrame:
    """task_id, kind, is_vision, sensitive, datasets, ordinal: image tasks first, as listed."""
    rows = [
        (t["id"], t.get("kind"), group == "image_tasks", bool(t.get("sensitive", False)), {k: str(v) for k, v in (t.get("datasets") or {}).items()})
        for group in ("image_tasks", "text_tasks")
        for t in config.get(group) or []
    ]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "task_id string, kind string, is_vision boolean, sensitive boolean, datasets map<string,string>, ordinal int")


def task_defaults(config: dict) -> tuple[int, int]:
    """Samples per task and seed."""
    d = config.get("defaults") or {}
    return d.get("samples", 50), d.get("seed", 42)


def models_table(spark: SparkSession, config: dict) -> DataFrame:
    """model_id, endpoint, family, capabilities, reasoning (mode -> JSON), ordinal. A missing field, or one of the wrong kind, is an error."""
    rows = []
    for i, m in enumerate(config["models"]):
        if not all(isinstance(m[k], str) for k in ("id", "endpoint", "family")) or not isinstance(m["capabilities"], list):
            raise ValueError(f"model {i}: id, endpoint and family are strings, capabilities a list")
        rows.append((m["id"], m["endpoint"], m["family"], [str(c) for c in m["capabilities"]], {k: json.dumps(v) for k, v in (m.get("reasoning") or {}).items()}, i))
    return spark.createDataFrame(rows, "model_id string, endpoint string, family string, capabilities array<string>, reasoning map<string,string>, ordinal int")


def get_model(config: dict, model_id: str) -> dict:
    for m in config["models"]:
        if m["id"] == model_id:
            return m
    raise KeyError(model_id)


def runtime(config: dict) -> dict:
    return {"timeout_seconds": 15.0, "max_retries": 3, "backoff_initial_seconds": 0.5, "max_concurrency": 8, "max_tokens": 1024} | (config.get("runtime") or {})


def modes_table(spark: SparkSession, config: dict) -> DataFrame:
    return spark.createDataFrame([(m,) for m in config.get("reasoning_modes", ["minimal", "full"])], "reasoning_mode string")


def reasoning_params(mode: str):
    """The JSON parameters of a mode, {} where a model has none."""
    return F.coalesce(F.try_element_at("reasoning", F.lit(mode)), F.lit("{}"))


def registry_table(spark: SparkSession, registry: dict) -> DataFrame:
    """One row per data set; commercial_ok has three values and stays text."""
    word = lambda x: {True: "true", False: "false", None: None}.get(x, str(x)) if not isinstance(x, str) else x
    rows = [(k, v.get("hf_id"), v.get("config"), v.get("license"), word(v.get("commercial_ok")), list(v.get("languages") or []), v.get("split"), bool(v.get("sensitive", False)), v.get("label_column")) for k, v in registry.items()]
    return spark.createDataFrame(rows, "key string, hf_id string, config string, license string, commercial_ok string, languages array<string>, split string, sensitive boolean, label_column string")


def resolve(registry: dict, key: str) -> dict:
    if key not in registry:
        raise KeyError(key)
    return registry[key]


def is_sensitive(registry: dict, key: str) -> bool:
    return bool((registry.get(key) or {}).get("sensitive", False))


def label_names(features: dict, column: str) -> list[str] | None:
    """Class names at a dotted path of a features description, through nested sequences; None if there are none."""
    at = features
    for step in column.split("."):
        while isinstance(at, dict) and "feature" in at and step not in at:
            at = at["feature"]
        if not isinstance(at, dict) or step not in at:
            return None
        at = at[step]
    while isinstance(at, dict) and "names" not in at and "feature" in at:
        at = at["feature"]
    names = at.get("names") if isinstance(at, dict) else None
    return list(names) if names else None


def rates_table(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """The rate card and the price of a unit; a missing file is an error."""
    card = read_yaml(path)
    return rate_table(spark, card), float(card.get("usd_per_dbu", 0.07))


def rubrics_table(spark: SparkSession, rubrics: dict) -> DataFrame:
    rows = [(t, r.get("name") or r.get("task") or t, r.get("description", ""), int(a), str(x)) for t, r in rubrics.items() for a, x in (r.get("anchors") or r.get("scale") or {}).items()]
    return spark.createDataFrame(rows, "task_id string, name string, description string, anchor int, text string")
