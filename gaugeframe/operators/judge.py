"""Judge prompts, scores and means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsers import judge_score, stripped
from ..functions.text import is_blank
from .metrics import by_language, judge_mean

KEYS = ["model_id", "task_id", "reasoning_mode"]

# Fixed value: the format of a judge prompt.
PROMPT = """You are an expert evaluator for the following task:

**Task:** {name}
**Description:** {description}

**Question/Context:**
{question}

**Reference (ground truth):**
{reference}

**Candidate output to evaluate:**
{candidate}

**Scoring rubric (1–5):**
{anchors}

Please evaluate the candidate output against the reference and provide a score from 1 to 5.
Include brief reasoning, then state your final score clearly (e.g., "Score: 4").
"""

# What a judge is asked about by task; a document question without its text is the question alone.
QUESTIONS = {
    "TXT-1": "Document text: {context}\n\nQuestion: {question}",
    "TXT-2": "Table:\n{table}\n\nQuestion: {question}",
    "TXT-4": "지문: {context}\n\n질문: {question}",
    "TXT-5": "Summarize the following document (language: {lang}):",
    "IMG-1": "Describe this image in one sentence.",
}
QUESTION_ONLY = "Question: {question}"

# Rubrics of tasks that the rubric file leaves out; TXT-5 has none.
FALLBACK = {
    "TXT-1": {
        "name": "Document QA",
        "description": "Extract accurate answers from document text",
        "anchors": {
            "1": "Answer is unrelated or completely incorrect",
            "2": "Answer reflects only partial document content or core is distorted",
            "3": "Answer accurately reflects most of document content but with minor errors or omissions",
            "4": "Answer is nearly identical to reference with only minor phrasing differences",
            "5": "Answer is identical or equivalent to reference with perfect accuracy",
        },
    },
    "TXT-2": {
        "name": "Table QA",
        "description": "Extract accurate cell values from tables",
        "anchors": {
            "1": "Extracted value does not match table or is completely wrong",
            "2": "Extracted value partially matches with errors in key values",
            "3": "Extracted value mostly correct but with minor cell errors or format issues",
            "4": "Extracted value nearly accurate with only minor format differences",
            "5": "Extracted value is accurate and perfectly matches reference cell values",
        },
    },
    "TXT-4": {
        "name": "한국어 독해 QA",
        "description": "주어진 지문에서 정확한 정답을 추출하는 능력 평가",
        "anchors": {
            "1": "답변이 지문과 무관하거나 완전히 잘못됨",
            "2": "답변이 지문의 일부만 반영하거나 핵심이 왜곡됨",
            "3": "답변이 대부분 정확하나 미세한 오류나 누락 있음",
            "4": "답변이 정답과 거의 동일하고 미세한 표현 차이만 있음",
            "5": "답변이 정답과 동일하거나 동등 수준의 정확성으로 전달",
        },
    },
    "IMG-1": {
        "name": "Image Captioning",
        "description": "Evaluate image captions for accuracy, completeness, and clarity.",
        "anchors": {
            "1": "Inaccurate or missing caption",
            "2": "Partially correct caption",
            "3": "Acceptable caption with minor issues",
            "4": "Good caption with minor omissions",
            "5": "Excellent, complete, and accurate caption",
        },
    },
}

#: Metric and policy by task. three: an answer without a score, or a failed call, counts 3; fail: a failed call
#: fails its group; skip: neither counts, and an empty candidate is not asked about.
STAGE = {"TXT-1": ("judge_mean", "three"), "TXT-2": ("judge_mean", "three"), "TXT-4": ("judge_mean", "three"), "TXT-5": ("judge_score_mean", "fail"), "IMG-1": ("judge_score_mean", "skip")}
#: Place among a group's metrics: after those of the task's own scorer.
POSITION = 50


def judge_prompt(name: Column, description: Column, question: Column, reference: Column, candidate: Column, anchors: Column) -> Column:
    """anchors: map of score to text, listed by score."""
    from ..plans.tasks import fill

    lines = F.transform(F.array_sort(F.map_entries(anchors)), lambda e: F.concat(F.lit("  "), e["key"].cast("string"), F.lit(": "), e["value"]))
    return fill(PROMPT, name=name, description=description, question=question, reference=reference, candidate=candidate, anchors=F.coalesce(F.array_join(lines, "\n"), F.lit("")))


def rubric(task_id: str, entry: dict | None, strict: bool = False) -> dict:
    """name, description, anchors of a rubric file's entry. The file says task and scale where the prompt reads name and anchors, so a file entry gives the bare task id and no anchors; strict maps them."""
    entry = entry or {}
    if strict:
        return {"name": entry.get("name", entry.get("task", task_id)), "description": entry.get("description", ""), "anchors": entry.get("anchors", entry.get("scale", {}))}
    return {"name": entry.get("name", task_id), "description": entry.get("description", ""), "anchors": entry.get("anchors", {})}


def judge_means(rows: DataFrame, keys: list[str], policy: str, text: str = "judge_text") -> DataFrame:
    """keys, judge_mean, n_parsed, n; policy as in metrics.judge_mean."""
    score = judge_score(F.col(text))
    return rows.groupBy(*keys).agg(judge_mean(score, policy).alias("judge_mean"), F.count(score).alias("n_parsed"), F.count(F.lit(1)).alias("n"))


def judge_by_language(rows: DataFrame, keys: list[str], languages: list[str] | None = None, text: str = "judge_text", lang: str = "lang", error: str = "judge_error") -> DataFrame:
    """keys, lang (null: all rows), judge_mean, n and error, from grouping sets.

    An answer without a score counts as 3, no rows as 3.0. A judge call that
    failed fails its group: every row of the group has the error and no mean.
    """
    score = judge_score(F.col(text))
    failed = F.min(F.col(error)) if error in rows.columns else F.lit(None).cast("string")
    out = by_language(rows, keys, [judge_mean(score, "three_else").alias("judge_mean"), F.count(F.lit(1)).alias("n"), failed.alias("error")], lang, languages)
    whole = out.where(F.col(lang).isNull()).select(*keys, F.col("error").alias("_error"))
    out = out.join(whole, keys).withColumns({"error": F.col("_error"), "n": F.coalesce("n", F.lit(0)), "judge_mean": F.coalesce("judge_mean", F.lit(3.0))}).drop("_error")
    return out.withColumn("judge_mean", F.when(F.col("error").isNull(), F.col("judge_mean")))


def _by_task(values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for task, c in values.items():
        out = F.when(F.col("task_id") == task, c).otherwise(out)
    return out


def judge_requests(results: DataFrame, endpoint: str, rubrics: dict | None = None, strict: bool = False) -> DataFrame:
    """KEYS, sample_id, lang, endpoint, prompt: what the judge is asked about the answers of a run, one row for each.

    results: KEYS, sample_id, lang, model_output, ref_text and, where a task has them, question, context and table. The first
    reference is the one shown. rubrics: by task as in a rubric file; tasks without an entry have the fallback.
    The rows go to provider.replay or provider.live like planned samples.
    """
    from ..plans.tasks import fill

    rows = results.where(F.col("task_id").isin(*STAGE))
    blank = is_blank(stripped(F.col("model_output")))
    skips = [t for t, (_, policy) in STAGE.items() if policy == "skip"]
    rows = rows.where(~(F.col("task_id").isin(*skips) & blank))
    given = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("question", "context", "table", "lang")}
    questions = {t: fill(q, **given) for t, q in QUESTIONS.items()}
    questions["TXT-1"] = F.when(F.coalesce(given["context"], F.lit("")) != "", questions["TXT-1"]).otherwise(fill(QUESTION_ONLY, **given))
    chosen = {t: rubric(t, (rubrics or {})[t], strict) if t in (rubrics or {}) else rubric(t, FALLBACK.get(t)) for t in STAGE}
    anchors = {t: F.create_map(*[F.lit(x) for k, v in r["anchors"].items() for x in (str(k), v)]) if r["anchors"] else F.create_map().cast("map<string,string>") for t, r in chosen.items()}
    prompts = {t: judge_prompt(F.lit(r["name"]), F.lit(r["description"]), questions[t], F.get("ref_text", F.lit(0)), stripped(F.col("model_output")), anchors[t]) for t, r in chosen.items()}
    return rows.select(*KEYS, "sample_id", "lang", F.lit(endpoint).alias("endpoint"), _by_task(prompts).alias("prompt"))


def stage_scores(results: DataFrame, answers: DataFrame, languages: list[str]) -> DataFrame:
    """Rows for scoring.score_groups' result: model_id, task_id, reasoning_mode, lang (null: all), n, metric, position, value, error.

    answers: KEYS, sample_id, model_output, finish_reason of the judge, as provider.replay gives them; one for each request.
    TXT-5 has a row for each language too, without a value where it has no rows.
    """
    lost = F.coalesce("finish_reason", F.lit("")) == "error"
    said = answers.select(*KEYS, "sample_id", F.when(~lost, judge_score(F.col("model_output"))).alias("score"), F.when(lost, F.col("model_output")).alias("failed"))
    rows = results.where(F.col("task_id").isin(*STAGE)).select(*KEYS, "sample_id", "lang").join(said, [*KEYS, "sample_id"], "left")
    three, skip = judge_mean(F.col("score"), "three"), F.coalesce(judge_mean(F.col("score"), "skip"), F.lit(0.0))
    wide = by_language(rows, KEYS, [three.alias("three"), skip.alias("skip"), F.count("score").alias("n_scored"), F.count(F.lit(1)).alias("n_all"), F.min("failed").alias("failed")], languages=languages)
    wide = wide.withColumns({"metric": _by_task({t: F.lit(m) for t, (m, _) in STAGE.items()}), "policy": _by_task({t: F.lit(p) for t, (_, p) in STAGE.items()})})
    fails = F.col("policy") == "fail"
    broken = wide.where(fails & F.col("lang").isNull() & F.col("failed").isNotNull())
    sound = wide.where(fails | F.col("lang").isNull()).join(broken.select(*KEYS), KEYS, "left_anti")
    skips = F.col("policy") == "skip"
    n = F.coalesce(F.when(skips, F.col("n_scored")).otherwise(F.col("n_all")), F.lit(0)).cast("long")
    row = lambda df, n, metric, value, error: df.select(*KEYS, "lang", n.alias("n"), metric.alias("metric"), F.lit(POSITION).alias("position"), value.cast("double").alias("value"), error.cast("string").alias("error"))
    none = F.lit(None)
    means = row(sound, n, F.col("metric"), F.when(skips, F.col("skip")).otherwise(F.col("three")), none)
    return means.unionAll(row(broken, F.col("n_all"), F.lit("error"), none, F.concat(F.lit("judge: "), "failed")))
