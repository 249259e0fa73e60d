import json

import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import text
from gaugeframe.operators import artifacts, cost, judge, metrics, perf, rank, report, stats
from gaugeframe.plans import matrix, provider, sampling, tasks
from gaugeframe.sources import artifacts as artifact_source
from gaugeframe.sources import config, sinks

CARD = {
    "usd_per_dbu": 0.07,
    "models": {
        "flat": {"dbu_in": 20.0, "dbu_out": 62.857},
        "tiered": {"context_threshold_tokens": 200000, "short": {"dbu_in": 71.429, "dbu_out": 428.571, "dbu_cache_read": 7.143}, "long": {"dbu_in": 142.857, "dbu_out": 642.857}},
        "promo": {"promo_multiplier": 0.8, "short": {"dbu_in": 35.714, "dbu_out": 214.286}, "long": {"dbu_in": 71.429, "dbu_out": 321.429}},
    },
}
USD = [
    ("flat", {"prompt_tokens": 100000, "completion_tokens": 50000}, 0.07 * (100000 * 20 + 50000 * 62.857) / 1e6),
    ("flat", {"input_tokens": 100000, "output_tokens": 50000, "prompt_tokens": 0}, 0.07 * (100000 * 20 + 50000 * 62.857) / 1e6),
    ("flat", {"prompt_tokens": 0, "completion_tokens": 0, "reasoning_tokens": 5000}, 0.07 * 5000 * 62.857 / 1e6),
    ("flat", {"completion_tokens_details": {"reasoning_tokens": 5000}}, 0.07 * 5000 * 62.857 / 1e6),
    ("flat", {"reasoning_tokens": 0, "completion_tokens_details": {"reasoning_tokens": 5000}}, 0.0),
    ("tiered", {"prompt_tokens": 100000}, 0.07 * 100000 * 71.429 / 1e6),
    ("tiered", {"prompt_tokens": 200000}, 0.07 * 200000 * 142.857 / 1e6),
    ("tiered", {"prompt_tokens": 100000, "prompt_tokens_details": {"cached_tokens": 30000}}, 0.07 * (70000 * 71.429 + 30000 * 7.143) / 1e6),
    ("promo", {"prompt_tokens": 1000, "completion_tokens": 10}, 0.8 * 0.07 * (1000 * 35.714 + 10 * 214.286) / 1e6),
    ("unknown", {"prompt_tokens": 1}, None),
]


def test_usd(spark):
    calls = spark.createDataFrame([(i, e, json.dumps(u)) for i, (e, u, _) in enumerate(USD)], "i int, endpoint string, usage string")
    got = cost.with_usd(calls, cost.rate_table(spark, CARD), 0.07).orderBy("i").collect()
    for r, (_, _, want) in zip(got, USD):
        assert r["usd"] == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("values, p95, median", [(list(range(1, 13)), 11.0, 6.5), (list(range(1, 12)), 11.0 - 1 + 1, 6.0), ([5.0], 5.0, 5.0), ([2.0] * 40 + [1.0], 2.0, 2.0)])
def test_order_statistics(spark, values, p95, median):
    values = [float(v) for v in values]
    want = sorted(values)[min(len(values) - 1, round(0.95 * (len(values) - 1)))]
    got = perf.median_and_p95(spark.createDataFrame([("m", v) for v in values], "m string, v double"), ["m"], "v").first()
    assert (got["p95"], got["median"]) == (want, median)


def test_order_statistics_of_many(spark):
    rows = spark.range(60000).select((F.col("id") % 2).alias("m"), F.when(F.col("id") % 2 == 0, F.lit(1.0)).otherwise(F.hash("id").cast("double")).alias("v"))
    got = {r["m"]: r for r in perf.median_and_p95(rows, ["m"], "v").collect()}
    odd = sorted(r["v"] for r in rows.where("m = 1").collect())
    assert got[0]["median"] == got[0]["p95"] == 1.0
    assert got[1]["p95"] == odd[round(0.95 * (len(odd) - 1))] and got[1]["median"] == (odd[14999] + odd[15000]) / 2


def test_perf_of_a_model_with_errors_only(spark):
    calls = spark.createDataFrame([("m", True, 1.0, None, 5, 5)], "model_id string, is_error boolean, latency_ms double, usd double, in_tokens long, out_tokens long")
    r = perf.perf_by_model(calls).first()
    assert (r["n_calls"], r["errors"], r["latency_ms_median"], r["latency_ms_p95"], r["total_usd"], r["in_tokens"]) == (1, 1, None, 0.0, 0.0, 0)


def test_macro_f1(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (2, 0), (1, 1), (None, 1)], "pred int, gold int")
    r = metrics.macro_f1(rows, []).first()
    assert r["macro_f1"] == pytest.approx(0.4333333) and r["accuracy"] == pytest.approx(0.6) and r["n"] == 5


def test_multilabel(spark):
    df = lambda rows: spark.createDataFrame(rows, "p array<string>, g array<string>")
    cols = metrics.multilabel_columns(F.col("p"), F.col("g"))
    assert [df([([], [])]).agg(*cols).first()[c] for c in ("micro_f1", "macro_f1")] == [0.0, 0.0]
    r = df([(["a", "b"], ["b", "c"])]).agg(*cols).first()
    assert [r[c] for c in ("micro_precision", "micro_recall", "micro_f1", "macro_f1")] == [0.5] * 4
    assert df([]).agg(*cols).first()["micro_f1"] == 0.0


def test_binary_without_parsed_rows(spark):
    r = spark.createDataFrame([(None, 1)], "pred int, gold int").agg(*metrics.binary_columns(F.col("pred"), F.col("gold"))).first()
    assert (r["accuracy"], r["f1"], r["n_unparsed"]) == (0.0, 0.0, 1)


def test_judge_policies(spark):
    rows = spark.createDataFrame([("Score: 5",), ("no",)], "judge_text string")
    mean = lambda df, p: df.agg(metrics.judge_mean(judge.judge_score(F.col("judge_text")), p)).first()[0]
    assert [mean(rows, p) for p in ("three", "three_else", "skip")] == [4.0, 4.0, 5.0]
    assert [mean(rows.limit(0), p) for p in ("three", "three_else", "skip")] == [0.0, 3.0, None]


def test_rubric_shapes():
    entry = {"task": "T", "scale": {1: "bad"}}
    assert judge.rubric("X", entry) == {"name": "X", "description": "", "anchors": {}}
    assert judge.rubric("X", entry, strict=True) == {"name": "T", "description": "", "anchors": {1: "bad"}}


def test_wilcoxon(spark):
    pairs = lambda d: spark.createDataFrame([(float(x), 0.0) for x in d], "a double, b double")
    r = stats.signed_ranks(pairs([1, -2, 2, 3, 0]), []).first()
    assert (r["n"], r["n_nonzero"], r["w"]) == (5, 4, 2.5)
    assert stats.wilcoxon_test(pairs([1])) == {"pval": None, "significant": False, "n": 1}
    assert stats.wilcoxon_test(pairs([0, 0, 0]))["pval"] is None
    exact = stats.wilcoxon_test(pairs([1, 2, 3, 4, 5, 6, 7, 8]))
    assert exact["pval"] == pytest.approx(2 / 256) and exact["significant"]


def test_winners_ties_go_to_the_first(spark):
    rows = [("m1", 1, "t", "full", "accuracy", 0.50004, 0), ("m0", 0, "t", "full", "accuracy", 0.50001, 0), ("m0", 0, "u", "full", "cell_f1", 1.0, 0)]
    s = spark.createDataFrame(rows, "model_id string, ordinal int, task_id string, reasoning_mode string, metric string, value double, position int")
    assert [(r["task_id"], r["winner"]) for r in rank.winners(rank.representative(s)).collect()] == [("t", "m0")]


def test_report(spark):
    s = spark.createDataFrame([("m0", 0, "t", "full", "accuracy", 0.5, 0)], "model_id string, ordinal int, task_id string, reasoning_mode string, metric string, value double, position int")
    p = spark.createDataFrame([("m0", 3, 1, 10.0, 12.0, 0.25, 5, 6, 0)], "model_id string, n_calls long, errors long, latency_ms_median double, latency_ms_p95 double, total_usd double, in_tokens long, out_tokens long, ordinal int")
    page = report.markdown("run", s, p)
    assert "| m0::t::full | accuracy=0.500 |" in page and "Lowest cost: **m0** at 0.25 USD." in page and "**m0** leads with 1 task wins." in page
    assert report.markdown("run", s, p, ask=lambda f: " better words ").count("better words\n\n<sub>") == 1
    empty = {"win_counts": {}, "fastest_model": None, "cheapest_model": None, "perf": {}}
    assert report.summary(empty) == report.executive_summary(empty, ask=lambda f: 1 / 0) == report.executive_summary(empty, ask=lambda f: "") == "This run has no results."
    seen = []
    report.executive_summary(empty | {"x": "y" * 5000}, ask=seen.append)
    assert len(seen[0]) == 3000


DECK = '<!DOCTYPE html><html><head><link rel="stylesheet" href="https://x/y.css"><script src="a.js"></script></head><body>' + '<div class="slide x">lake</div>' * 3 + '<div class="slides">no</div><section>Spark</section></body></html>'


def test_grading(spark):
    df = spark.createDataFrame([("a", DECK), ("b", ""), ("c", None)], "candidate string, html string")
    keys = {"lake": ["lake", "pond"], "spark": ["SPARK"], "none": ["zebra"]}
    g = {r["candidate"]: r for r in artifacts.grade(artifacts.validate(df, keys, 2, 4)).collect()}
    a = g["a"]
    assert (a["has_doctype"], a["slide_count"], a["keywords"], a["external_refs"], a["valid"]) == (True, 3, "2/3", 1, True)
    assert a["auto_score"] == pytest.approx(0.567) and a["keywords_missing"] == ["none"]
    assert (g["b"]["auto_score"], g["b"]["valid"], g["c"]["keywords"]) == (0.0, False, "0/0")
    full = df.where("candidate = 'a'").withColumns({"rendered_ok": F.lit(True), "console_errors": F.lit(0), "render_note": F.lit("")})
    assert artifacts.grade(artifacts.validate(full, {"lake": ["lake"]}, 2, 4), do_render=True).first()["auto_score"] == 1.0


def test_quotas():
    assert sampling.quotas(5, ["a", "b"]) == {"a": 3, "b": 2}
    assert sampling.quotas(1, ["a", "b"]) == {"a": 2, "b": 1}


def test_sample_order_is_fixed(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    a = [r["k"] for r in sampling.seeded_sample(rows, "k", 20).collect()]
    assert a == [r["k"] for r in sampling.seeded_sample(rows.repartition(7), "k", 20).collect()] and len(set(a)) == 20
    assert sampling.seeded_sample(rows, "k", 0).count() == 500


def test_matrix_filters(spark):
    models = config.models_table(spark, {"models": [{"id": "a", "endpoint": "e", "family": "f", "capabilities": ["text"]}]})
    t = config.tasks_table(spark, {"image_tasks": [{"id": "IMG-1"}], "text_tasks": [{"id": "TXT-1"}]})
    modes = config.modes_table(spark, {})
    assert [(r["task_id"], r["reasoning_mode"]) for r in matrix.execution_matrix(models, t, modes, only_modes=["full"]).collect()] == [("TXT-1", "full")]
    assert matrix.not_applicable(models, t, modes).first()[0] == 2


def test_config(spark):
    cfg = {"models": [{"id": "a", "endpoint": "e", "family": "f", "capabilities": ["text"], "reasoning": {"full": {"x": 1}}}], "runtime": {"max_retries": 5}}
    m = config.models_table(spark, cfg)
    assert [r[0] for r in m.select(config.reasoning_params("full")).unionAll(m.select(config.reasoning_params("minimal"))).collect()] == ['{"x": 1}', "{}"]
    assert config.runtime(cfg)["max_retries"] == 5 and config.runtime({})["timeout_seconds"] == 15.0
    with pytest.raises(KeyError):
        config.get_model(cfg, "b")
    with pytest.raises(ValueError):
        config.models_table(spark, {"models": [{"id": 1, "endpoint": "e", "family": "f", "capabilities": []}]})
    with pytest.raises(KeyError):
        config.resolve({}, "x")
    with pytest.raises(FileNotFoundError):
        config.rates_table(spark, "/nowhere.yaml")
    assert config.label_names({"objects": {"feature": {"category": {"names": ["a"]}}}}, "objects.category") == ["a"]
    assert config.label_names({}, "x") is None and config.is_sensitive({"a": {"sensitive": True}}, "a") and not config.is_sensitive({}, "b")


def test_tasks_have_prompts_and_parsers(spark):
    row = spark.createDataFrame([("q", None, "c", "t", "d", "en", "x")], "question string, context string, table string, table_text string, document string, lang string, text string")
    cols = {c: F.col(c) for c in row.columns}
    got = row.select(*[t.prompt(cols).alias(i) for i, t in tasks.REGISTRY.items()]).first()
    assert len(got) == 13 and all(got) and got["TXT-1"].startswith("Answer the following question:") and not any("{" in p for p in got)
    row.select(*[t.parse(F.col("text")).alias(i) for i, t in tasks.REGISTRY.items()]).collect()


def test_samples(spark):
    qa = spark.createDataFrame([(1, "q", ["a"], ["w1", "w2"])], "sample_id int, question string, answers array<string>, words array<string>")
    assert tasks.samples_qa(qa, "TXT-1").first()["context"] == "w1 w2"
    kp = spark.createDataFrame([(1, "T", "A", "X  y; x y;z"), (2, "T", "A", "")], "sample_id int, title string, abstract string, keywords string")
    got = tasks.samples_keyphrase(kp).collect()
    assert len(got) == 1 and got[0]["document"] == "T\n\nA" and set(got[0]["ref_set"]) == {"x y", "z"}
    tx = spark.createDataFrame([(1, "en", "a", 1), (2, "en", None, 0), (3, "en", "b", None)], "sample_id int, lang string, text string, toxic int")
    assert [r["sample_id"] for r in tasks.samples_labelled(tx, "TXT-8", ["comment_text", "text"], ["toxic", "class"]).collect()] == [1]
    ob = spark.createDataFrame([(1, ([0, 3],)), (2, ([12],))], "sample_id int, objects struct<category:array<int>>")
    assert [r["ref_label"] for r in tasks.samples_objects(ob, "IMG-3").orderBy("sample_id").collect()] == [1, 1]
    assert [r["ref_label"] for r in tasks.samples_objects(ob, "IMG-5").orderBy("sample_id").collect()] == [1, 0]
    assert [r["ref_set"] for r in tasks.samples_objects(ob, "IMG-2").collect()] == [["car"]]


def test_live_answers_are_written_once(spark, tmp_path):
    planned = spark.createDataFrame([("m", "t", "full", 1, "e", "p"), ("m", "t", "full", 2, "e", "fail")], "model_id string, task_id string, reasoning_mode string, sample_id long, endpoint string, prompt string")

    def ask(endpoint, prompt):
        if prompt == "fail":
            raise TimeoutError("late")
        return {"text": "hi", "finish_reason": "stop", "usage": {"prompt_tokens": 1}}

    got = provider.replay(planned, provider.live(planned, ask, str(tmp_path / "a"))).orderBy("sample_id").collect()
    assert [(r["model_output"], r["finish_reason"]) for r in got] == [("hi", "stop"), ("__ERROR__: late", "error")]


def test_sources_and_sinks(spark, tmp_path):
    for name, page, meta in (("one", "<html>", '{"candidate":"one","wall_seconds":1.5}'), ("two", None, "{broken"), ("gallery", "<html>", None)):
        (tmp_path / "c" / name).mkdir(parents=True)
        if page:
            (tmp_path / "c" / name / "slides.html").write_text(page)
        if meta:
            (tmp_path / "c" / name / "run_meta.json").write_text(meta)
    got = {r["candidate"]: r for r in artifact_source.candidates(spark, str(tmp_path / "c")).collect()}
    assert sorted(got) == ["one", "two"] and got["one"]["meta"]["wall_seconds"] == 1.5 and got["two"]["html"] is None
    assert artifact_source.candidates(spark, str(tmp_path / "c"), names=["one"]).count() == 1
    rows = spark.createDataFrame([("a", ["z", "b"])], "model_id string, ref_set array<string>")
    for _ in range(2):
        sinks.write_results(rows, str(tmp_path / "r"), "x")
    assert spark.read.json(str(tmp_path / "r")).select("model_id", "ref_set", "run_id").collect() == [("a", ["b", "z"], "x")]
    g = spark.createDataFrame([("<b>", True, 3, "1/2", 0.5, "n&m")], "candidate string, valid boolean, slide_count int, keywords string, auto_score double, note string")
    page = sinks.gallery("t", g)
    assert "&lt;b&gt;" in page and "<b>" not in page and "<b>" in sinks.grades_text(g)
    (tmp_path / "rep" / "2024").mkdir(parents=True)
    (tmp_path / "rep" / "2023").mkdir()
    for y in ("2023", "2024"):
        (tmp_path / "rep" / y / "report.md").write_text("x")
    (tmp_path / "res" / "2024").mkdir(parents=True)
    sinks.write_manifest(spark, {"run_id": "2024", "models": [{"id": "a"}, {"id": "b"}], "task_ids": ["t"]}, str(tmp_path / "res" / "2024" / "manifest.json"))
    idx = artifact_source.index_rows(artifact_source.runs(spark, str(tmp_path / "rep"), str(tmp_path / "res"))).collect()
    assert [(r["run_id"], r["models"], r["n_tasks"]) for r in idx] == [("2024", "a,b", "1"), ("2023", "?", "?")]
    assert sinks.run_meta("c", model="m")["model"] == "m"
    for _ in range(2):  # an index is written anew
        at = sinks.write_index(spark, str(tmp_path / "rep"), str(tmp_path / "res"))
    index = (tmp_path / "rep" / "index.md").read_text()
    assert at.endswith("rep/index.md") and index.index("[2024](2024/report.md) |  | a,b |") < index.index("[2023]") and "2 runs" in index


def test_calls_are_tried_again():
    from gaugeframe.plans import provider

    def policy(*answers, **kw):
        left, waits = list(answers), []

        def post(endpoint, prompt):
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x, {"text": prompt}

        try:
            return provider.retried(post, sleep=waits.append, **kw)("e", "p")["text"], waits
        except provider.CallFailed as e:
            return str(e), waits

    assert policy(200) == ("p", []) and policy(429, TimeoutError("t"), 200) == ("p", [0.5, 1.0])
    assert policy(500, 503, 429) == ("status 429 after 3 attempts", [0.5, 1.0]) and policy(404) == ("status 404", [])
    assert policy(TimeoutError("x"), attempts=1) == ("timeout: x after 1 attempts", [])
    assert provider.offline(env={"HF_HUB_OFFLINE": "1"}) and not provider.offline(env={"HF_HUB_OFFLINE": "0"})


def test_discovery_leaves_failing_modules_out(tmp_path, monkeypatch):
    from gaugeframe.plans import tasks

    (tmp_path / "plug").mkdir()
    (tmp_path / "plug" / "__init__.py").write_text("")
    (tmp_path / "plug" / "bad.py").write_text("import nothing_of_the_kind")
    (tmp_path / "plug" / "good.py").write_text("from gaugeframe.plans import tasks\ntasks.register(tasks.Task('X-1', 'qa', lambda c: None, lambda c: c))")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setattr(tasks, "REGISTRY", dict(tasks.REGISTRY))
    failed = tasks.discover("plug")
    assert list(failed) == ["plug.bad"] and "nothing_of_the_kind" in failed["plug.bad"] and "X-1" in tasks.REGISTRY


def test_probe_image_and_commit(tmp_path):
    import base64
    import zlib

    from gaugeframe.plans import matrix, tasks

    raw = base64.b64decode(tasks.probe_image().partition(",")[2])
    at = raw.index(b"IDAT")
    assert raw.startswith(b"\x89PNG") and zlib.decompress(raw[at + 4 : at + 4 + int.from_bytes(raw[at - 4 : at], "big")]) == (b"\0" + b"\xff\0\0" * 8) * 8
    assert matrix.git_commit(str(tmp_path)) is None


def test_usage_of_no_requests(spark):
    from gaugeframe.operators import cost

    usage = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "request_id string, event_time int")
    ask = lambda *x: [r["request_id"] for r in cost.usage_of(usage, spark.createDataFrame([(i,) for i in x], "request_id string")).collect()]
    assert ask() == [] and ask("a", "c", "b", "b", "it's") == ["b", "a", "c"]


def test_overlap_of_rare_and_repeated_tokens(spark):
    import random
    from collections import Counter

    rng = random.Random(3)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randrange(6))], [rng.choice("abcd") for _ in range(rng.randrange(6))]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, p array<string>, g array<string>")
    got = {r["id"]: (r["rouge1"], r["rouge2"]) for r in text.rouge_table(df, ["id"], F.col("p"), F.col("g")).collect()}

    def f(p, g, n):
        a, b = ([tuple(x[i : i + n]) for i in range(len(x) - n + 1)] for x in (p, g))
        return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b)) if a and b else 0.0

    assert got == {i: (pytest.approx(f(p, g, 1)), pytest.approx(f(p, g, 2))) for i, p, g in rows}


def test_common_subsequence_and_ratio(spark):
    import random

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(80))) for _ in range(2))
        assert text.lcs(a, b) == plain(a, b)
        assert text.ratio(a, b) == (round(200 * plain(a, b) / (len(a) + len(b))) if a and b else (100 if a == b else 0))


def test_scores_of_a_run(spark):
    from gaugeframe.operators import scoring

    rows = [
        ("TXT-1", 1, "en", "a b", ["a b", "c"], None, None, None),
        ("TXT-1", 2, "en", "", [""], None, None, None),
        ("IMG-1", 1, "en", "a b", ["a c"], None, None, None),
        ("IMG-1", 2, "en", " ", ["a"], None, None, None),
        ("TXT-2", 1, "en", " A  b", ["x", "a b"], None, None, None),
        ("TXT-3", 1, "en", "<table><tr><td>a</td></tr></table>", None, None, None, "<table><tr><td>a</td><td>b</td></tr></table>"),
        ("TXT-5", 1, "en", "the cat", ["the cat"], None, None, None),
        ("TXT-6", 1, "en", "positive", None, 1, None, None),
        ("TXT-6", 2, "ko", "?", None, 1, None, None),
        ("TXT-7", 1, "en", "a, b", None, None, ["b", "c"], None),
        ("IMG-2", 1, "en", "aa, bb", None, None, ["bb", "cc"], None),
        ("IMG-2", 2, "en", "aa", None, None, [], None),
        ("IMG-4", 1, "en", "nsfw", None, 1, None, None),
        ("TXT-8", 1, "en", "__ERROR__: toxic reply", None, 0, None, None),
    ]
    df = spark.createDataFrame([("m", t, "full", *r) for t, *r in rows], "model_id string, task_id string, reasoning_mode string, sample_id long, lang string, model_output string, ref_text array<string>, ref_label int, ref_set array<string>, ref_html string")
    got = {(r["task_id"], r["lang"], r["metric"]): (r["value"], r["n"]) for r in scoring.score_groups(df).collect()}
    want = {
        ("TXT-1", None, "token_f1"): (0.5, 2),
        ("TXT-1", None, "exact_match"): (0.5, 2),
        ("IMG-1", None, "caption_token_f1"): (0.5, 1),
        ("TXT-2", None, "accuracy"): (1.0, 1),
        ("TXT-3", None, "cell_f1"): (pytest.approx(2 / 3), 1),
        ("TXT-5", None, "rougeL"): (1.0, 1),
        ("TXT-5", "ko", "rouge1"): (None, 0),
        ("TXT-6", None, "accuracy"): (1.0, 1),
        ("TXT-6", None, "n_unparsed"): (1.0, 1),
        ("TXT-6", "ko", "accuracy"): (None, 0),
        ("TXT-7", None, "f1"): (0.5, 1),
        ("TXT-7", "en", "precision"): (0.5, 1),
        ("IMG-2", None, "micro_f1"): (0.5, 1),
        ("IMG-4", None, "accuracy"): (1.0, 1),
        ("IMG-4", None, "nsfw"): (1.0, 1),
        ("TXT-8", None, "fp"): (1.0, 1),
        ("TXT-8", "ko", "f1"): (None, 0),
    }
    assert {k: got[k] for k in want} == want
    assert ("TXT-7", "ko", "f1") not in got


def test_answers_are_scored_in_their_rows(spark):
    """Scoring answers exchanges the sums of groups only, no texts and no tokens; scores are those of the short-text expressions."""
    from gaugeframe.operators import scoring

    said = ["a b b c", "", " \n", "b b b", "x y z a", None, "a-b. c!", "한국 a1"]
    rows = [("m", t, "full", i, "ko" if i % 2 else "en", x, gold) for t in ("TXT-1", "TXT-5") for i, x in enumerate(said) for gold in (["b b a", "x y"], [None, "a b"], [])]
    df = spark.createDataFrame(rows, "model_id string, task_id string, reasoning_mode string, sample_id int, lang string, model_output string, ref_text array<string>")
    for scores in (scoring.qa_scores(df), scoring.summary_scores(df, ["en", "ko"])):
        plan = scores._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") <= 4 and "posexplode" not in plan and "explode_outer" not in plan
    pairs = spark.createDataFrame([(x, y) for x in said for y in said], "a string, b string").na.fill("")
    p, g = text.rouge_tokens(F.col("a")), text.rouge_tokens(F.col("b"))
    got = pairs.select(text.rouge_of(p, g).alias("x"), *[text.rouge_n(F.col("a"), F.col("b"), n).alias(f"r{n}") for n in (1, 2)], text.rouge_l(F.col("a"), F.col("b")).alias("rl"), text.best_token_f1(text.tokens_space(F.col("a")), F.array(text.tokens_space(F.col("b")))).alias("f"), text.token_f1(F.col("a"), F.col("b")).alias("want")).collect()
    for r in got:
        assert tuple(r["x"]) == pytest.approx((r["r1"], r["r2"], r["rl"])) and r["f"] == pytest.approx(r["want"])


def test_a_run_is_read_once_by_each_scorer(spark):
    """Six passes over the answers (five scorers, and what can't be scored), no join; an unscored group is one row, and others keep theirs."""
    from gaugeframe.operators import scoring

    schema = "model_id string, task_id string, reasoning_mode string, sample_id int, lang string, model_output string, ref_text array<string>, ref_label int, ref_set array<string>, ref_html string"
    table = "<table><tr><td>a</td></tr></table>"
    rows = [("m", t, "full", i, lang, out, ["a b"], label, ["a"], table) for i, (lang, out, label) in enumerate([("en", "positive a b", 1), ("ko", "negative", 1), ("en", "?", 0)]) for t in ("TXT-1", "TXT-3", "TXT-5", "TXT-6", "TXT-7", "IMG-4", "X-1")]
    rows += [("n", "TXT-6", "full", 0, "en", "positive", None, None, None, None), ("n", "TXT-6", "full", 1, "en", "positive", None, 1, None, None)]
    scores = scoring.score_groups(spark.createDataFrame(rows, schema))
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 6 and "Join" not in plan
    got = {(r["model_id"], r["task_id"], r["lang"], r["metric"]): (r["n"], r["value"], r["error"]) for r in scores.collect()}
    assert {k: v for k, v in got.items() if k[0] == "n" or k[1] == "X-1"} == {("n", "TXT-6", None, "error"): (2, None, "1 of 2 samples without a reference"), ("m", "X-1", None, "error"): (3, None, "no scorer for X-1")}
    # one of two answers with a label is right; class 0 has none right, class 1 has 2 of 3
    assert got["m", "TXT-6", None, "accuracy"] == (2, 0.5, None) and got["m", "TXT-6", None, "macro_f1"][1] == pytest.approx(1 / 3)
    assert got["m", "TXT-6", "ko", "accuracy"] == (1, 0.0, None) and got["m", "TXT-6", None, "n_unparsed"][1] == 1.0
    assert got["m", "TXT-5", "ko", "rouge1"] == (1, 0.0, None) and got["m", "TXT-5", "en", "rouge1"][1] == pytest.approx((2 * 2 / 5 + 0) / 2)


def test_macro_f1_of_counts_is_that_of_rows(spark):
    import random

    rng = random.Random(4)
    rows = spark.createDataFrame([(f"g{rng.randrange(6)}", rng.choice([None, 0, 1, 2, 5]), rng.choice([0, 1, 3])) for _ in range(60)] + [("none", None, 1)], "k string, pred int, gold int")
    want = {r["k"]: r["macro_f1"] for r in metrics.macro_f1(rows, ["k"]).collect()} | {"none": 0.0}
    counts = rows.groupBy("k", "pred", "gold").agg(F.count(F.lit(1)).alias("times"))
    pairs = counts.groupBy("k").agg(metrics.pairs_column(F.col("pred"), F.col("gold"), F.col("times")).alias("x"))
    got = {r["k"]: r["f"] for r in pairs.select("k", metrics.macro_f1_of(F.col("x")).alias("f")).collect()}
    assert got == pytest.approx(want)
