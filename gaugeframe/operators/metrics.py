"""Scorers: aggregates over any grouping; per-group and per-language values come from one pass of grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio0(num: Column, den: Column) -> Column:
    """num / den as double; 0.0 where den is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _rows(times: Column | None):
    """Counts the rows that a condition holds for; times: how many rows of the run each row stands for."""
    return F.count_if if times is None else lambda c: F.coalesce(F.sum(F.when(c, times)), F.lit(0))


def binary_columns(pred: Column, gold: Column, times: Column | None = None) -> list[Column]:
    """accuracy, f1 of class 1 (0 without any), tn, fp, fn, tp over rows with a prediction, and n and n_unparsed."""
    count = _rows(times)
    cell = lambda p, g: count((pred == p) & (gold == g))
    tn, fp, fn, tp = cell(0, 0), cell(1, 0), cell(0, 1), cell(1, 1)
    return [
        ratio0(count(pred == gold), count(pred.isNotNull())).alias("accuracy"),
        ratio0(2 * tp, 2 * tp + fp + fn).alias("f1"),
        tn.alias("tn"),
        fp.alias("fp"),
        fn.alias("fn"),
        tp.alias("tp"),
        count(pred.isNotNull()).alias("n_evaluated"),
        count(pred.isNull()).alias("n_unparsed"),
    ]


def balance_columns(pred: Column, gold: Column, names: tuple[str, str] = ("negative", "positive"), times: Column | None = None) -> list[Column]:
    """Numbers of gold classes among rows with a prediction."""
    return [_rows(times)(pred.isNotNull() & (gold == i)).alias(name) for i, name in enumerate(names)]


def by_language(rows: DataFrame, keys: list[str], columns: list[Column], lang: str = "lang", languages: list[str] | None = None) -> DataFrame:
    """keys, lang (null: all rows) and the columns; with languages, those without rows come with a null for every value.

    What is wanted of each language is picked from the aggregated rows, at most one of each, so the rows are read once.
    """
    sets = [[*keys], [*keys, lang]]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, lang]]).agg(*columns, F.grouping(lang).alias("_all"))
    out = out.where((F.col("_all") == 1) | F.col(lang).isNotNull()).drop("_all")
    if languages is None:
        return out
    values = [c for c in out.columns if c not in (*keys, lang)]
    wanted = F.array(F.lit(None).cast("string"), *[F.lit(x) for x in languages])
    of_all = F.col(lang).isNull() | F.col(lang).isin(languages)
    found = out.where(of_all).groupBy(*keys).agg(F.collect_list(F.struct(F.col(lang).alias("lang"), F.struct(*values).alias("of"))).alias("_found")).where(F.size("_found") > 0)
    each = found.select(*keys, "_found", F.explode(wanted).alias(lang))
    of = F.get(F.filter("_found", lambda x: x["lang"].eqNullSafe(F.col(lang))), F.lit(0))["of"]
    return each.select(*keys, lang, of.alias("_of")).select(*keys, lang, *[F.col("_of")[v].alias(v) for v in values])


def macro_f1(rows: DataFrame, keys: list[str], pred: str = "pred", gold: str = "gold") -> DataFrame:
    """keys, accuracy, macro_f1 over the union of classes predicted and labelled, n; rows without a prediction are left out.

    Pairs are counted first, so what follows is as small as the classes squared.
    """
    count = rows.where(F.col(pred).isNotNull()).groupBy(*keys, F.col(pred).alias("p"), F.col(gold).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    side = count.select(*keys, F.explode(F.array(F.struct(F.col("p").alias("cls"), F.lit(1).alias("as_p"), F.lit(0).alias("as_g")), F.struct(F.col("g").alias("cls"), F.lit(0).alias("as_p"), F.lit(1).alias("as_g")))).alias("s"), "p", "g", "n")
    per = side.groupBy(*keys, F.col("s.cls").alias("cls")).agg(F.sum(F.when((F.col("p") == F.col("g")) & (F.col("s.as_p") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("s.as_p")).alias("np"), F.sum(F.col("n") * F.col("s.as_g")).alias("ng"))
    per = per.groupBy(*keys).agg(F.avg(ratio0(2 * F.col("tp"), F.col("np") + F.col("ng"))).alias("macro_f1"), F.sum("tp").alias("hit"), F.sum("np").alias("n"))
    return per.select(*keys, ratio0(F.col("hit"), F.col("n")).alias("accuracy"), "macro_f1", "n")


def pairs_column(pred: Column, gold: Column, times: Column) -> Column:
    """Of rows that stand for so many of one prediction and label: those with a prediction, no more of a group than classes squared."""
    return F.collect_list(F.when(pred.isNotNull(), F.struct(pred.alias("p"), gold.alias("g"), times.alias("n"))))


def macro_f1_of(pairs: Column) -> Column:
    """macro_f1 of pairs_column; 0.0 without a prediction."""
    total = lambda hit: F.aggregate(F.filter(pairs, hit), F.lit(0).cast("long"), lambda n, x: n + x["n"])
    classes = F.array_distinct(F.concat(F.transform(pairs, lambda x: x["p"]), F.transform(pairs, lambda x: x["g"])))
    of = lambda c: ratio0(2 * total(lambda x: (x["p"] == c) & (x["g"] == c)), total(lambda x: x["p"] == c) + total(lambda x: x["g"].eqNullSafe(c)))
    return ratio0(F.aggregate(classes, F.lit(0.0), lambda f, c: f + of(c)), F.size(classes))


def set_counts(pred: Column, gold: Column) -> list[Column]:
    """tp, fp, fn of a row's two array sets."""
    return [F.size(f(a, b)).alias(c) for c, f, a, b in (("tp", F.array_intersect, pred, gold), ("fp", F.array_except, pred, gold), ("fn", F.array_except, gold, pred))]


def multilabel_columns(pred: Column, gold: Column) -> list[Column]:
    """multilabel_of the sets of each row."""
    return multilabel_of(*set_counts(pred, gold))


def multilabel_of(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Micro (summed counts) and macro (mean of rows) precision, recall and F1 of array sets; two empty sets give 0."""
    p, r = ratio0(tp, tp + fp), ratio0(tp, tp + fn)
    f = ratio0(2 * p * r, p + r)
    mp, mr = ratio0(F.sum(tp), F.sum(tp + fp)), ratio0(F.sum(tp), F.sum(tp + fn))
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    return [mp.alias("micro_precision"), mr.alias("micro_recall"), ratio0(2 * mp * mr, mp + mr).alias("micro_f1"), mean(p).alias("macro_precision"), mean(r).alias("macro_recall"), mean(f).alias("macro_f1"), F.count(F.lit(1)).alias("n")]


def mean_columns(scores: dict[str, Column], keep: Column | None = None) -> list[Column]:
    """Means of row scores over all rows, or over those that keep holds for; and n."""
    inside = (lambda c: F.when(keep, c)) if keep is not None else (lambda c: c)
    return [*[F.avg(inside(c)).alias(name) for name, c in scores.items()], F.count(inside(F.lit(1))).alias("n")]


def judge_mean(score: Column, policy: str) -> Column:
    """Mean judge score. 'three': unparsable counts as 3, no rows 0.0; 'three_else': no rows 3.0; 'skip': unparsable is left out."""
    if policy == "skip":
        return F.avg(score)
    return F.coalesce(F.avg(F.coalesce(score, F.lit(3))), F.lit(0.0 if policy == "three" else 3.0))
