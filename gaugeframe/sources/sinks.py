"""Sinks: tables as JSON lines or Parquet by run; small reports rendered on the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(results: DataFrame, path: str, run_id: str, sets: tuple[str, ...] = ("ref_set", "pred_set")) -> None:
    """Sample results as JSON lines in the run's partition; set columns are sorted. An earlier write of the same run is replaced; commits.begin_run is append-only."""
    for c in sets:
        if c in results.columns:
            results = results.withColumn(c, F.array_sort(c))
    results.drop("run_id").write.mode("overwrite").json(f"{path}/run_id={run_id}")


def write_scores(scores: DataFrame, path: str, run_id: str) -> None:
    scores.drop("run_id").write.mode("overwrite").json(f"{path}/run_id={run_id}")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file, in whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    write_text(spark, json.dumps(manifest, ensure_ascii=False, indent=2, default=str), path)


def index_text(rows: DataFrame) -> str:
    """The index of runs (artifacts.index_rows), newest first, as a Markdown table with a link to each report."""
    runs = sorted(rows.collect(), key=lambda r: r["run_id"], reverse=True)
    names = ["created", "models", "modes", "n_tasks", "samples", "git"]
    lines = ["# Runs", "", f"{len(runs)} runs, newest first.", "", "| run | " + " | ".join(names) + " |", "|---" * (len(names) + 1) + "|"]
    lines += [f"| [{r['run_id']}]({r['run_id']}/report.md) | " + " | ".join(r[c] for c in names) + " |" for r in runs]
    return "\n".join([*lines, ""])


def write_index(spark: SparkSession, reports: str, results: str) -> str:
    """Writes index.md of the runs below reports, with what their manifests below results tell; its path."""
    from .artifacts import index_rows, runs

    path = f"{reports.rstrip('/')}/index.md"
    write_text(spark, index_text(index_rows(runs(spark, reports, results))), path)
    return path


def write_grades(grades: DataFrame, path: str) -> None:
    grades.write.mode("overwrite").json(path)


def run_meta(candidate: str, **known) -> dict:
    """A run description with every field of the schema; those not known are None."""
    from .artifacts import META

    fields = [f.split()[0] for f in META.replace("\n", " ").split(",")]
    return {f: None for f in fields} | {"candidate": candidate} | known


def grades_text(grades: DataFrame) -> str:
    """A fixed-width table of grades; the number of candidates is that of folders graded."""
    cols = [("candidate", 12), ("harness", 14), ("model", 26), ("valid", 7), ("slide_count", 8), ("keywords", 10), ("console_errors", 9), ("auto_score", 7), ("wall_seconds", 9)]
    have = [(c, w) for c, w in cols if c in grades.columns]
    show = lambda v: "-" if v is None else str(v)
    lines = ["".join(f"{c[: w - 1]:<{w}}" for c, w in have)]
    lines += ["".join(f"{show(r[c])[: w - 1]:<{w}}" for c, w in have) for r in grades.orderBy("candidate").toLocalIterator()]
    return "\n".join(lines)


def gallery(title: str, grades: DataFrame) -> str:
    """A page to review candidates and export scores; every value is escaped."""
    e = lambda v: html.escape("" if v is None else str(v), quote=True)
    cards = []
    for r in (x.asDict() for x in grades.orderBy("candidate").toLocalIterator()):
        shown = " · ".join(f"{e(k)}={e(r[k])}" for k in ("valid", "slide_count", "keywords", "auto_score") if k in r)
        options = "".join(f"<option>{i}</option>" for i in range(1, 6))
        cards.append(f'<article data-name="{e(r["candidate"])}"><h2>{e(r["candidate"])}</h2><p>{shown}</p><p>{e(r.get("note"))}</p><select><option></option>{options}</select><input></article>')
    script = (
        "function save(){const o={};for(const a of document.querySelectorAll('article')){const s=a.querySelector('select').value,n=a.querySelector('input').value;"
        "if(s||n)o[a.dataset.name]={human_score:s?Number(s):null,human_note:n}}const l=document.createElement('a');"
        "l.href=URL.createObjectURL(new Blob([JSON.stringify(o)],{type:'application/json'}));l.download='human_scores.json';l.click()}"
    )
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{e(title)}</title></head><body><h1>{e(title)}</h1><button onclick="save()">export</button>{"".join(cards)}<script>{script}</script></body></html>'
