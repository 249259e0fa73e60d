"""Scores of a run: answers parsed and aggregated by model, task and mode, overall and by language, in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsers, text
from ..plans.tasks import REGISTRY
from . import metrics

KEYS = ["model_id", "task_id", "reasoning_mode"]
LANGUAGES = ["en", "ko"]


def _long(wide: DataFrame, names: dict[str, str], count: str = "n") -> DataFrame:
    """One row per metric; names: column -> metric, in the order in which a report lists them."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(i).alias("position"), F.col(c).cast("double").alias("value")) for i, (c, m) in enumerate(names.items())]))
    return wide.select(*KEYS, "lang", F.coalesce(F.col(count), F.lit(0)).cast("long").alias("n"), each.alias("x")).select(*KEYS, "lang", "n", "x.*")


def _long_of(wide: DataFrame, names: list[tuple[Column, dict[str, str]]], count: str = "n") -> DataFrame:
    """The same where rows have the names of the first condition that holds, or none; in one pass, so that what is aggregated is so once."""
    each = [F.when(hit, F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(i).alias("position"), F.col(c).cast("double").alias("value")) for i, (c, m) in enumerate(of.items())])) for hit, of in names]
    return wide.select(*KEYS, "lang", F.coalesce(F.col(count), F.lit(0)).cast("long").alias("n"), F.explode(F.coalesce(*each)).alias("x")).select(*KEYS, "lang", "n", "x.*")


def _of(results: DataFrame, *task_ids: str) -> DataFrame:
    return results.where(F.col("task_id").isin(*task_ids))


def _label(rows: DataFrame) -> Column:
    """The answer's label by the task's own rules."""
    tasks = [t for t in REGISTRY.values() if t.kind in ("binary", "classification")]
    return reduce(lambda c, t: F.when(F.col("task_id") == t.task_id, t.parse(F.col("model_output"))).otherwise(c), tasks, F.lit(None).cast("int"))


def qa_scores(results: DataFrame) -> DataFrame:
    """TXT-1, TXT-2, TXT-4, IMG-1: means over best references; an empty answer counts 0, and for captions not at all. TXT-4 tells the backend of its tokens as a metric's name.

    Each answer is scored in its row, so that only sums by group are exchanged.
    """
    whole = lambda c: F.make_valid_utf8(c)
    r = _of(results, "TXT-1", "TXT-2", "TXT-4", "IMG-1").select(*KEYS, "lang", whole(parsers.stripped(F.col("model_output"))).alias("pred"), F.transform("ref_text", whole).alias("ref_text"))
    filled = F.coalesce(F.col("pred") != "", F.lit(False))
    task = lambda *ids: F.col("task_id").isin(*ids)
    # only the tasks that report a match look for one
    r = r.select(
        *KEYS,
        F.lit(None).cast("string").alias("lang"),
        filled.alias("filled"),
        text.best_token_f1(F.when(filled, F.col("pred")), F.when(filled, F.col("ref_text")), "lang").alias("f"),
        F.when(filled & task("TXT-1", "TXT-4"), text.best_of(F.col("ref_text"), lambda g: text.exact_match(F.col("pred"), g))).otherwise(F.lit(0.0)).alias("e"),
        F.when(filled & task("TXT-2"), text.accuracy_match(F.col("pred"), F.col("ref_text"))).otherwise(F.lit(0.0)).alias("a"),
    )
    keep = ~task("IMG-1") | F.col("filled")
    mean = lambda c: F.coalesce(F.avg(F.when(keep, F.col(c))), F.lit(0.0))
    g = r.groupBy(*KEYS, "lang").agg(mean("f").alias("f"), mean("e").alias("e"), mean("a").alias("a"), F.count_if(keep).alias("n")).withColumn("b", F.lit(1))
    names = {
        "IMG-1": {"f": "caption_token_f1"},
        "TXT-2": {"a": "accuracy", "f": "token_f1"},
        "TXT-1": {"f": "token_f1", "e": "exact_match"},
        "TXT-4": {"f": "token_f1", "e": "exact_match", "b": f"tokenizer_{text.KOREAN_BACKEND}"},
    }
    return _long_of(g, [(task(t), of) for t, of in names.items()])


def table_scores(results: DataFrame) -> DataFrame:
    """TXT-3: mean cell F1 of all answers."""
    cells = F.struct(parsers.table_cells(parsers.table_or_text(F.col("model_output"))).alias("p"), parsers.table_cells(F.col("ref_html")).alias("g"))
    # cells come as columns of their own: Spark takes no Python function whose arguments are nested lambdas
    r = _of(results, "TXT-3").select(*KEYS, F.lit(None).cast("string").alias("lang"), F.inline(F.array(cells))).withColumn("f", text.cell_f1("p", "g"))
    return _long(r.groupBy(*KEYS, "lang").agg(F.coalesce(F.avg("f"), F.lit(0.0)).alias("f"), F.count(F.lit(1)).alias("n")), {"f": "cell_f1"})


def summary_scores(results: DataFrame, languages: list[str]) -> DataFrame:
    """TXT-5: ROUGE means, empty answers included; a language without rows has nulls."""
    gold = F.coalesce(F.get("ref_text", F.lit(0)), F.lit(""))
    lower = lambda c: F.make_valid_utf8(F.lower(c))
    r = _of(results, "TXT-5").select(*KEYS, "lang", text.rouge_of(lower(F.col("model_output")), lower(gold)).alias("rouge")).select(*KEYS, "lang", "rouge.*")
    cols = [F.avg("rouge1").alias("r1"), F.avg("rouge2").alias("r2"), F.avg("rougeL").alias("rl"), F.count(F.lit(1)).alias("n")]
    return _long(metrics.by_language(r, KEYS, cols, languages=languages), {"r1": "rouge1", "r2": "rouge2", "rl": "rougeL"})


def label_scores(results: DataFrame, languages: list[str]) -> DataFrame:
    """TXT-6: accuracy and macro F1; TXT-8 and IMG-3 to 5: binary metrics and class balance; over answers with a label."""
    r = _of(results, "TXT-6", "TXT-8", "IMG-3", "IMG-4", "IMG-5").select(*KEYS, "lang", _label(results).alias("pred"), F.col("ref_label").alias("gold"))
    # all that follows is as small as the classes squared
    r = r.groupBy(*KEYS, "lang", "pred", "gold").agg(F.count(F.lit(1)).alias("times"))
    p, g, times = F.col("pred"), F.col("gold"), F.col("times")
    cols = [*metrics.binary_columns(p, g, times), *metrics.balance_columns(p, g, ("class_0", "class_1"), times), metrics.pairs_column(p, g, times).alias("pairs")]
    wide = metrics.by_language(r, KEYS, cols, languages=languages).withColumn("macro_f1", metrics.macro_f1_of(F.coalesce("pairs", F.array())))
    whole = F.col("lang").isNull()
    text_only = whole | F.col("task_id").startswith("TXT-")
    # a language without a single label has no accuracy
    none = F.col("lang").isNotNull() & (F.coalesce("n_evaluated", F.lit(0)) == 0)
    wide = wide.where(text_only).withColumns({c: F.when(~none, F.col(c)) for c in ("accuracy", "f1")})
    named = {"IMG-4": ("sfw", "nsfw")}  # what the balance is named by; other tasks by class
    counts = {c: c for c in ("accuracy", "f1", "tn", "fp", "fn", "tp", "n_unparsed")}
    sentiment = F.col("task_id") == "TXT-6"
    names = [
        (sentiment & whole, {c: c for c in ("accuracy", "macro_f1", "n_unparsed")}),
        (sentiment, {c: c for c in ("accuracy", "n_unparsed")}),
        *[(F.col("task_id") == task, {**counts, "class_0": zero, "class_1": one}) for task, (zero, one) in named.items()],
        (F.lit(True), {**counts, "class_0": "class_0", "class_1": "class_1"}),
    ]
    return _long_of(wide, names, "n_evaluated")


def set_scores(results: DataFrame, languages: list[str]) -> DataFrame:
    """TXT-7: key phrases, micro as headline, by language where there are rows; IMG-2: tags, over rows with a reference."""
    r = _of(results, "TXT-7", "IMG-2")
    pred = F.when(F.col("task_id") == "IMG-2", parsers.tags(F.col("model_output"))).otherwise(parsers.keyphrases(F.col("model_output")))
    # as rows of an array, the sets are made once for all that reads them
    r = r.select(*KEYS, "lang", F.inline(F.array(F.struct(pred.alias("p"), F.array_distinct("ref_set").alias("g")))))
    r = r.where((F.col("task_id") == "TXT-7") | (F.size("g") > 0))
    # three numbers of a row, not its sets, go into the sums
    r = r.select(*KEYS, "lang", *metrics.set_counts(F.col("p"), F.col("g")))
    wide = metrics.by_language(r, KEYS, metrics.multilabel_of(F.col("tp"), F.col("fp"), F.col("fn")))
    wide = wide.where(F.col("lang").isNull() | F.col("lang").isin(languages))
    micro = {"micro_precision": "precision", "micro_recall": "recall", "micro_f1": "f1"}
    macro = {c: c for c in ("macro_precision", "macro_recall", "macro_f1")}
    phrases, whole = F.col("task_id") == "TXT-7", F.col("lang").isNull()
    return _long_of(wide, [(phrases & whole, micro | macro), (phrases, micro), (whole, {c: c for c in (*micro, *macro)})])


def score_groups(results: DataFrame, languages: list[str] = LANGUAGES, judged: DataFrame | None = None) -> DataFrame:
    """model_id, task_id, reasoning_mode, lang (null: all), n, metric, position, value, error.

    results: KEYS, sample_id, lang, model_output and the references ref_text,
    ref_label, ref_set, ref_html. Failed calls are scored from their error text.
    Parsers are total and ratios null-safe, so no group can fail another; a group
    that cannot be scored is one row, of metric 'error', that tells why. Its scores
    are left out when only they and no answers remain, so answers are not joined for it.
    judged: rows of judge.stage_scores, which come with the others.
    """
    parts = [qa_scores(results), table_scores(results), summary_scores(results, languages), label_scores(results, languages), set_scores(results, languages)]
    out = reduce(DataFrame.unionAll, parts).withColumn("error", F.lit(None).cast("string")).unionByName(unscored(results))
    told = F.col("error").isNotNull()
    out = out.withColumn("_wrong", F.bool_or(told).over(Window.partitionBy(*KEYS))).where(told | ~F.col("_wrong")).drop("_wrong")
    return out if judged is None else out.unionByName(judged)


#: The reference that a task is scored against.
REFERENCE = {"TXT-3": "ref_html", "TXT-7": "ref_set", "IMG-2": "ref_set"} | dict.fromkeys(("TXT-1", "TXT-2", "TXT-4", "TXT-5", "IMG-1"), "ref_text") | dict.fromkeys(("TXT-6", "TXT-8", "IMG-3", "IMG-4", "IMG-5"), "ref_label")


def unscored(results: DataFrame) -> DataFrame:
    """A row for each group that has no scorer, or a sample without the reference that its scorer reads."""
    has = reduce(lambda c, t: F.when(F.col("task_id") == t[0], F.col(t[1]).isNotNull()).otherwise(c), REFERENCE.items(), F.lit(None).cast("boolean"))
    groups = results.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.bool_and(has).alias("ok"), F.count_if(~has).alias("bare"))
    said = F.when(F.col("ok").isNull(), F.concat(F.lit("no scorer for "), "task_id")).otherwise(F.concat(F.col("bare").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" samples without a reference")))
    return groups.where(F.col("ok").isNull() | ~F.col("ok")).select(*KEYS, F.lit(None).cast("string").alias("lang"), F.col("n").cast("long").alias("n"), F.lit("error").alias("metric"), F.lit(0).alias("position"), F.lit(None).cast("double").alias("value"), said.alias("error"))


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and side ('missing': in a only, 'extra': in b only)."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("missing")).unionAll(right.join(left, key, "left_anti").withColumn("side", F.lit("extra")))
