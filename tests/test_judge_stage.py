import pytest

from gaugeframe.operators import judge, rank, scoring
from gaugeframe.plans import provider

RUN = "model_id string, task_id string, reasoning_mode string, sample_id long, lang string, model_output string, ref_text array<string>, question string, context string"


def run(spark, rows):
    return spark.createDataFrame([("m0", t, "full", i, lang, out, ["gold", "other"], f"q{i}", c) for t, i, lang, out, c in rows], RUN)


def answers(spark, requests, said):
    """said: (task, sample) -> text or an exception's message."""
    rows = [("m0", t, "full", i, None if isinstance(x, Exception) else x, str(x) if isinstance(x, Exception) else None) for (t, i), x in said.items()]
    return provider.replay(requests, spark.createDataFrame(rows, "model_id string, task_id string, reasoning_mode string, sample_id long, text string, error string"))


def scores(spark, rows, said):
    r = run(spark, rows)
    out = judge.stage_scores(r, answers(spark, judge.judge_requests(r, "j"), said), ["en", "ko"])
    return {(x["task_id"], x["lang"], x["metric"]): (x["value"], x["n"], x["error"]) for x in out.collect()}


def test_policies_of_the_tasks(spark):
    down = Exception("status 500")
    rows = [(t, i, "en", "" if i == 4 else "answer", None) for t in judge.STAGE for i in range(1, 5)]
    said = {(t, i): x for t in judge.STAGE for i, x in ((1, "Score: 5"), (2, "no verdict"), (3, down), (4, "Score: 1")) if not (t == "TXT-5" and i == 3)}
    got = scores(spark, rows, said | {("TXT-5", 3): "Score: 2"})
    assert got["TXT-1", None, "judge_mean"] == got["TXT-4", None, "judge_mean"] == ((5 + 3 + 3 + 1) / 4, 4, None)
    # the empty caption isn't asked about, what has no score isn't counted
    assert got["IMG-1", None, "judge_score_mean"] == (5.0, 1, None)
    assert got["TXT-5", None, "judge_score_mean"] == got["TXT-5", "en", "judge_score_mean"] == ((5 + 3 + 2 + 1) / 4, 4, None)
    assert got["TXT-5", "ko", "judge_score_mean"] == (None, 0, None)


def test_a_failed_call_fails_its_group_only(spark):
    rows = [(t, i, "ko", "x", None) for t in ("TXT-5", "TXT-2") for i in (1, 2)]
    got = scores(spark, rows, {("TXT-5", 1): Exception("timeout"), ("TXT-5", 2): "Score: 4", ("TXT-2", 1): "Score: 4", ("TXT-2", 2): "Score: 2"})
    assert got == {("TXT-5", None, "error"): (None, 2, "judge: __ERROR__: timeout"), ("TXT-2", None, "judge_mean"): (3.0, 2, None)}


def test_requests_without_an_answer_failed(spark):
    got = scores(spark, [("TXT-1", 1, "en", "x", None), ("TXT-1", 2, "en", "x", None), ("IMG-1", 3, "en", "x", None)], {("TXT-1", 1): "Score: 1"})
    assert got == {("TXT-1", None, "judge_mean"): (2.0, 2, None), ("IMG-1", None, "judge_score_mean"): (0.0, 0, None)}


def test_prompts(spark):
    r = run(spark, [("TXT-1", 1, "en", " said ", "the text"), ("TXT-1", 2, "en", None, None), ("IMG-1", 3, "en", " \n", None), ("TXT-6", 4, "en", "x", None)])
    got = {x["sample_id"]: x["prompt"] for x in judge.judge_requests(r, "j").collect()}
    assert sorted(got) == [1, 2]
    assert "Document text: the text\n\nQuestion: q1" in got[1] and "\nsaid\n" in got[1] and "\ngold\n" in got[1] and "  5: Answer is identical" in got[1]
    assert "\nQuestion: q2\n" in got[2] and "Document text" not in got[2]
    entry = {"TXT-1": {"task": "T", "description": "d", "scale": {1: "bad", 5: "good"}}}
    plain, strict = (judge.judge_requests(r, "j", entry, strict=s).where("sample_id = 1").first()["prompt"] for s in (False, True))
    assert "**Task:** TXT-1\n" in plain and "bad" not in plain and "**Task:** T\n" in strict and "  1: bad\n  5: good" in strict


def test_judge_scores_stand_for_tasks_without_another(spark):
    r = run(spark, [("IMG-1", 1, "en", "x", None), ("TXT-1", 2, "en", "gold", None)])
    judged = judge.stage_scores(r, answers(spark, judge.judge_requests(r, "j"), {("IMG-1", 1): "Score: 4", ("TXT-1", 2): "Score: 1"}), ["en"])
    full = r.selectExpr("*", "cast(null as int) ref_label", "cast(null as array<string>) ref_set", "cast(null as string) ref_html")
    s = scoring.score_groups(full, judged=judged)
    got = {x["task_id"]: x["score"] for x in rank.representative(s.where("lang is null")).collect()}
    assert got == {"IMG-1": 4.0, "TXT-1": 1.0}  # token F1 comes before the judge


@pytest.mark.parametrize("order", [1, -1])
def test_repeated_answers_are_one(spark, order):
    planned = spark.createDataFrame([("m", "t", "full", 1), ("m", "t", "full", 2)], "model_id string, task_id string, reasoning_mode string, sample_id long")
    said = [(1, None, "down", "r0"), (1, "b", None, "r2"), (1, "a", None, "r3"), (2, None, "x", None), (2, None, "y", None)][::order]
    got = provider.replay(planned, spark.createDataFrame([("m", "t", "full", *x) for x in said], planned.schema.simpleString()[7:-1].replace(":", " ") + ", text string, error string, request_id string"))
    assert sorted((r["sample_id"], r["model_output"], r["request_id"]) for r in got.collect()) == [(1, "b", "r2"), (2, "__ERROR__: x", None)]
