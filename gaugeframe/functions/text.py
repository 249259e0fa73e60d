"""Text functions as Column expressions; Python's string semantics where Spark's differ."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What str.strip() and str.split() take for whitespace; Spark's trim knows only the space, and a pattern's class only what Unicode calls white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"
BLANKS = SEPARATORS + "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return c.isNull() | (py_strip(c) == "")


def single_spaces(c: Column) -> Column:
    """Each run of whitespace as one space. Separators are replaced beforehand: a class joined of theirs and of white space costs several times as much."""
    return F.regexp_replace(F.regexp_replace(c, f"[{SEPARATORS}]", " "), r"(?U)\s+", " ")


def normalize(c: Column) -> Column:
    """Lower case, no whitespace at the ends, single spaces: answers and key phrases."""
    return single_spaces(py_strip(F.lower(c)))


def tokens_space(c: Column) -> Column:
    return F.filter(F.split(single_spaces(c), " "), lambda x: x != "")


def tokens_syllable(c: Column) -> Column:
    """Without a morphological analyser: each Hangul syllable, each run of ASCII letters and digits."""
    return F.regexp_extract_all(c, F.lit("[가-힣]|[a-zA-Z0-9]+"), 0)


def tokenize(c: Column, lang: str | Column = "en") -> Column:
    if isinstance(lang, str):
        return tokens_syllable(c) if lang == "ko" else tokens_space(c)
    return F.when(lang == "ko", tokens_syllable(c)).otherwise(tokens_space(c))


#: Backend of the Korean tokenizer in this build.
KOREAN_BACKEND = "syllable"


def multiset_overlap(p: Column, g: Column) -> Column:
    times = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    return F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, t: acc + F.least(times(p, t), times(g, t)))


def overlap_f1(overlap: Column, n_pred: Column, n_gold: Column, both_empty: float) -> Column:
    """2 overlap / (n_pred + n_gold); 0 if one side is empty and both_empty if both are."""
    return F.when((n_pred == 0) & (n_gold == 0), F.lit(both_empty)).when((n_pred == 0) | (n_gold == 0), F.lit(0.0)).otherwise(2.0 * overlap / (n_pred + n_gold))


def token_f1(pred: Column, gold: Column, lang: str | Column = "en") -> Column:
    """Multiset token F1 in one expression, for short answers: it looks each token up in both. Whole texts go through token_f1_table."""
    p, g = tokenize(pred, lang), tokenize(gold, lang)
    return overlap_f1(multiset_overlap(p, g), F.size(p), F.size(g), 1.0)


def overlap_table(rows: DataFrame, keys: list[str], pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """keys and for each name of pairs the struct (o, p, g): multiset overlap and sizes of two token arrays.

    Tokens are counted by row, name and token, which is linear in the texts; keys name a row.
    """
    side = lambda name, i, tokens: F.struct(F.lit(name).alias("name"), F.lit(i).alias("side"), tokens.alias("t"))
    sides = rows.select(*keys, F.explode(F.array(*[side(n, i, t) for n, both in pairs.items() for i, t in enumerate(both)])).alias("s"))
    one = sides.select(*keys, F.col("s.name").alias("name"), F.col("s.side").alias("side"), F.explode_outer("s.t").alias("t"))
    known = F.col("t").isNotNull()
    count = one.groupBy(*keys, "name", "t").agg(F.count(F.when((F.col("side") == 0) & known, 1)).alias("p"), F.count(F.when((F.col("side") == 1) & known, 1)).alias("g"))
    total = lambda name: F.struct(*[F.coalesce(F.sum(F.when(F.col("name") == name, x)), F.lit(0)).alias(c) for c, x in (("o", F.least("p", "g")), ("p", F.col("p")), ("g", F.col("g")))])
    return count.groupBy(*keys).agg(*[total(n).alias(n) for n in pairs])


def f1_of(total: str, both_empty: float) -> Column:
    """F1 of a struct of overlap_table."""
    return overlap_f1(F.col(f"{total}.o"), F.col(f"{total}.p"), F.col(f"{total}.g"), both_empty)


def token_f1_table(pairs: DataFrame, keys: list[str], pred: str = "pred", gold: str = "gold", lang: str | Column = "en") -> DataFrame:
    """keys and token_f1; the same by counting tokens, which is linear in the text's length."""
    return overlap_table(pairs, keys, {"x": (tokenize(F.col(pred), lang), tokenize(F.col(gold), lang))}).select(*keys, f1_of("x", 1.0).alias("token_f1"))


def rouge_table(rows: DataFrame, keys: list[str], pred: Column, gold: Column) -> DataFrame:
    """keys, rouge1, rouge2 of two arrays of ROUGE tokens, by counting n-grams."""
    found = overlap_table(rows, keys, {f"rouge{n}": (n_grams(pred, n), n_grams(gold, n)) for n in (1, 2)})
    return found.select(*keys, *[f1_of(f"rouge{n}", 0.0).alias(f"rouge{n}") for n in (1, 2)])


def exact_match(pred: Column, gold: Column) -> Column:
    return (py_strip(F.lower(pred)) == py_strip(F.lower(gold))).cast("double")


def begin_alike(a: Column, b: Column) -> Column:
    """Whether two texts have the first character in common that is not whitespace, whatever its case: what texts that are alike when normalised have, and found out sooner."""
    first = lambda c: F.left(py_strip(F.lower(c)), F.lit(1))
    return first(a) == first(b)


def accuracy_match(pred: Column, golds: Column) -> Column:
    """1.0 if the normalised answer equals any normalised reference."""
    return F.coalesce(F.exists(golds, lambda g: begin_alike(pred, g) & (normalize(g) == normalize(pred))), F.lit(False)).cast("double")


def best_of(golds: Column, score) -> Column:
    """The largest score over the references; 0.0 without any."""
    return F.coalesce(F.array_max(F.transform(golds, score)), F.lit(0.0))


def seen_before(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """rows with name: whether a row of the same keys comes earlier in order. Keys shrink to their first row before they are joined, so no list of a group is held."""
    first = rows.groupBy(*keys).agg(F.min(order).alias("_first"))
    return rows.join(first, keys, "left").withColumn(name, F.coalesce(F.col("_first") < F.col(order), F.lit(False))).drop("_first")


def rouge_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def n_grams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    last = F.size(tokens) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " ")))


def rouge_n(pred: Column, gold: Column, n: int) -> Column:
    """ROUGE-N F-measure on [a-z0-9]+ tokens, which leaves out Hangul, of short texts; for supplied tokens see rouge_n_of, for whole texts rouge_table."""
    return rouge_n_of(rouge_tokens(pred), rouge_tokens(gold), n)


def rouge_n_of(pred_tokens: Column, gold_tokens: Column, n: int) -> Column:
    p, g = n_grams(pred_tokens, n), n_grams(gold_tokens, n)
    return overlap_f1(multiset_overlap(p, g), F.size(p), F.size(g), 0.0)


def lcs(a, b) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    match: dict = {}
    for i, x in enumerate(a):
        match[x] = match.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        at = match.get(x)
        if at:
            hit = row & at
            row = (row + hit) | (row ^ hit)
    return len(a) - (row & full).bit_count()


def shared(p: list, g: list, both_empty: float) -> float:
    """F1 of two multisets, as overlap_f1 has it."""
    if not p or not g:
        return both_empty if not p and not g else 0.0
    a, b = Counter(p), Counter(g)
    common = a.keys() & b.keys()
    return 2.0 * sum(map(min, map(a.get, common), map(b.get, common))) / (len(p) + len(g))


_HANGUL, _SYLLABLES = re.compile("[가-힣]"), re.compile("[가-힣]|[a-zA-Z0-9]+")
_ALNUM = bytes(i if chr(i).isalnum() and i < 128 else 32 for i in range(256))
_LOWER = bytes(i if chr(i).isalnum() and i < 128 and not chr(i).isupper() else 32 for i in range(256))


def ascii_runs(x: str, keep: bytes = _LOWER) -> list[str]:
    """Runs of ASCII letters, of lower case or any, and digits: a table of bytes blanks all else, several times as fast as a pattern."""
    return x.encode("ascii", "replace").translate(keep).decode().split()


def syllables(x: str) -> list[str]:
    """What tokens_syllable gives."""
    return _SYLLABLES.findall(x) if _HANGUL.search(x) else ascii_runs(x, _ALNUM)


def items(a, split=str.split) -> list:
    """Tokens of an array, or of a text by split."""
    return [] if a is None else split(a) if isinstance(a, str) else a.tolist()


@F.pandas_udf(T.DoubleType())
def best_token_f1(pred: pd.Series, golds: pd.Series, *lang: pd.Series) -> pd.Series:
    """Of each row the largest token F1 over the references, 0.0 without any: a table of answers is scored where its rows lie, without an exchange of tokens.

    Both sides are arrays of tokens, or texts and their language, which are split here as tokenize does: texts are a fraction of
    what their tokens are on the way. Neighbours that are alike, as where several tasks ask for one answer, are scored once.
    """
    out: list[float] = []
    last = None
    for p, gs, x in zip(pred, golds, lang[0] if lang else [None] * len(pred)):
        split = syllables if x == "ko" else str.split
        own = (p, [*gs], x) if isinstance(p, str) and gs is not None else None
        if own is None or own != last:
            tokens = items(p, split)
            out.append(max((shared(tokens, items(g, split), 1.0) for g in gs), default=0.0) if gs is not None else 0.0)
        else:
            out.append(out[-1])
        last = own
    return pd.Series(out, dtype=float)


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("rouge1", "rouge2", "rougeL")]))
def rouge_of(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """ROUGE F-measures of each row's two arrays of tokens, or lower-case texts, where the rows lie."""
    out = []
    for p, g in ((items(a, ascii_runs), items(b, ascii_runs)) for a, b in zip(pred, gold)):
        size = len(p) + len(g)
        out.append((shared(p, g, 0.0), shared([*zip(p, p[1:])], [*zip(g, g[1:])], 0.0), 2.0 * lcs(p, g) / size if p and g else 0.0))
    return pd.DataFrame(out, columns=["rouge1", "rouge2", "rougeL"], dtype=float)


def chain_len(places: Column) -> Column:
    """Length of the longest rising chain of an array of whole numbers: for each length the least number that ends such a chain, kept sorted."""
    later = lambda t, j: F.filter(t, lambda x: x >= j)
    step = lambda t, j: F.concat(F.filter(t, lambda x: x < j), F.array(j), F.slice(later(t, j), F.lit(2), F.greatest(F.size(t), F.lit(1))))
    return F.size(F.aggregate(places, F.array().cast("array<int>"), step))


def rouge_l(pred: Column, gold: Column) -> Column:
    """ROUGE-L F-measure in one expression, for short texts; whole texts go through rouge_l_table."""
    p, g = rouge_tokens(pred), rouge_tokens(gold)
    last = F.greatest(F.size(g), F.lit(1))
    places = F.flatten(F.transform(p, lambda x: F.filter(F.sequence(last, F.lit(1), F.lit(-1)), lambda j: F.get(g, j - 1) == x)))
    return overlap_f1(chain_len(places), F.size(p), F.size(g), 0.0)


def lcs_table(rows: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """keys and l, the length of the longest common subsequence of two token arrays.

    Tokens of both sides meet by value; a common subsequence is a chain of such points that rises on both sides, so the points are put in the order of a, later ones of b first, and the longest chain
    of their places in b is what counts. Rows without a common token have 0; keys name a row.
    """
    one = rows.select(*keys, F.posexplode(a).alias("i", "t"))
    two = rows.select(*keys, F.posexplode(b).alias("j", "t"))
    points = one.join(two, [*keys, "t"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", (-F.col("j")).alias("j")))).alias("points"))
    chains = points.select(*keys, chain_len(F.transform("points", lambda x: -x["j"])).alias("l"))
    return rows.select(*keys).join(chains, keys, "left").withColumn("l", F.coalesce("l", F.lit(0)))


def rouge_l_table(rows: DataFrame, keys: list[str], pred: Column, gold: Column) -> DataFrame:
    """keys and rougeL of two arrays of ROUGE tokens."""
    sized = rows.select(*keys, F.size(pred).alias("_p"), F.size(gold).alias("_g")).join(lcs_table(rows, keys, pred, gold), keys)
    return sized.select(*keys, overlap_f1(F.col("l"), F.col("_p"), F.col("_g"), 0.0).alias("rougeL"))


def ratio(a: str, b: str) -> int:
    """0 to 100: twice the common subsequence over both lengths; 0 if one is empty."""
    if not a or not b or a == b:
        return 100 if a == b else 0
    return round(200 * lcs(a, b) / (len(a) + len(b)))


@F.pandas_udf(T.IntegerType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="Int32")


#: Two cells are alike from this ratio on; characters are counted in so many classes, if there are more than so many pairs of cells.
ALIKE, CLASSES, FEW = 80, 64, 64


def profile(texts: list[str]) -> np.ndarray:
    """How often each text has characters of each class."""
    out = np.zeros((len(texts), CLASSES), np.int32)
    for i, x in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") % CLASSES, minlength=CLASSES)
    return out


def match_cells(pred: list, gold: list) -> float:
    """Greedy in the order of the gold cells: text at least 80 alike, then 0.7 text + 0.3 place; the first best wins.

    A ratio is at most that of the common characters whatever their order, and these are at most as many as the shorter text has: cells that
    stay below 80 by these counts are left out at once, all of a gold cell together, and so are those that cannot
    beat the best so far; only the others are compared. Of few cells lengths are bound enough.
    """
    if not pred or not gold:
        return float(not pred and not gold)
    texts, golds = [p["txt"].lower() for p in pred], [g["txt"].lower() for g in gold]
    free = np.ones(len(pred), bool)
    if len(pred) * len(gold) <= FEW:
        sizes = [len(x) for x in texts]

        def near_of(j: int) -> list[tuple[int, float, float]]:
            n, at = len(golds[j]), (gold[j]["r"], gold[j]["c"])
            most = [200 * min(m, n) / max(m + n, 1) for m in sizes]
            return [(i, top, 1.0 if (pred[i]["r"], pred[i]["c"]) == at else 0.5) for i, top in enumerate(most) if free[i] and top >= ALIKE - 1]
    else:
        have, own, size = profile(texts), profile(golds), np.array([len(x) for x in texts])
        place = np.array([(p["r"], p["c"]) for p in pred])

        def near_of(j: int) -> list[tuple[int, float, float]]:
            n = len(golds[j])
            near = np.flatnonzero(free & (200 * np.minimum(size, n) >= (ALIKE - 1) * (size + n)))
            most = 200 * np.minimum(have[near], own[j]).sum(axis=1) / np.maximum(size[near] + n, 1)
            bonus = np.where((place[near] == (gold[j]["r"], gold[j]["c"])).all(axis=1), 1.0, 0.5)
            return [*zip(near.tolist(), most.tolist(), bonus.tolist())]

    known: dict[tuple[str, str], int] = {}
    hits = 0
    for j, text in enumerate(golds):
        best, score = None, 0.0
        for i, top, b in near_of(j):
            if top < ALIKE - 1 or 0.7 * (top + 1) / 100 + 0.3 * b <= score:
                continue  # a ratio is rounded
            if (text, texts[i]) not in known:
                known[text, texts[i]] = ratio(text, texts[i])
            alike = known[text, texts[i]] / 100.0
            value = 0.7 * alike + 0.3 * b
            if alike >= ALIKE / 100 and value > score:
                best, score = i, value
        if best is not None:
            free[best] = False
            hits += 1
    if not hits:
        return 0.0
    precision, recall = hits / len(pred), hits / len(gold)
    return 2 * (precision * recall) / (precision + recall)


@F.pandas_udf(T.DoubleType())
def cell_f1(pred: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([match_cells(list(p), list(g)) if p is not None and g is not None else None for p, g in zip(pred, gold)])


def prompt_text(parts: Column) -> Column:
    """Stored form of a prompt's text parts: joined by newlines, cut to 2000 characters and an ellipsis."""
    text = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")
    return F.when(F.char_length(text) > 2000, F.concat(F.substring(text, 1, 2000), F.lit("…"))).otherwise(text)
