"""Toxicity: Levenshtein automata over a lexicon trie, and context windows.

*Lexicon.* Terms are learned from a bounded sample of labelled rows: words
whose presence tells toxic from clean documents, and stems (word beginnings)
where many different words with one beginning do.

*Automaton.* The trie of the words is intersected with the Levenshtein
automaton of distance ``EDITS`` = 1 by subset construction into one table
(state x class of byte); words of five bytes and more may be misspelled. All words of
a batch walk the table together and most leave it after two or three bytes.
Misspellings that clean documents of the sample hold as words of their own
don't count. Stems walk the plain trie.

*Context.* A hit within quotation marks, or near a reporting word, counts as
quotation and keeps ``QUOTED`` of its weight; one near a second person or
another hit is abuse and gains. Hits and their density feed a logistic
regression fitted on the sample, with the true share of label 1 restored.

Null and empty texts get the score of a document without hits; texts are read
whole; rows are scored one by one, so ties and repeated rows don't matter, and rows without an id
are scored too. Without labels of either kind every row has one score. Empty tables give
empty results; extra columns are left out, and pass through where rows are filtered.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shielded
from .labelled import fold_of, labelled_sample, sample_rows
from .tokens import FOLD, chunks, hash_ranges, mix, text_buffer

FOLDS, HELD_OUT = 3, 1
#: Bound of the labelled sample, for each label.
PER_LABEL = 2500
#: Least contexts of a term in toxic documents, and least log-odds against clean ones.
SUPPORT, WORD_ODDS, STEM_ODDS = 4, 2.5, 3.0
STEMS = range(4, 11)
FUZZY_BYTES = 5
WINDOW_BYTES = 60
QUOTED, DIRECTED = 0.15, 1.5
THRESHOLD = 0.7
#: Words that report speech, and second persons, of the four languages.
REPORTING = "said says wrote writes called quote quoted quotes term word phrase defined means headline replied cite cited dit mot cita dijo palabra sagte wort zitat".split()
SECOND = "you your youre tu vous toi du ihr dich usted vosotros te".split()

LETTER = np.zeros(256, bool)
LETTER[[*range(97, 123), *range(48, 58), *range(128, 256)]] = True


def fold(buf: np.ndarray) -> np.ndarray:
    """A-Z and the upper-case letters of Latin-1 (two bytes in UTF-8) to lower case."""
    out = FOLD[buf]
    if len(out) > 1:
        at = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
        out[at] += 0x20
    return out


def letter_runs(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = LETTER[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offs] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def trie(terms: list[bytes]) -> tuple[list[dict[int, int]], dict[int, int]]:
    """Children of each node, and the term that ends at a node."""
    kids: list[dict[int, int]] = [{}]
    ends = {}
    for i, t in enumerate(terms):
        n = 0
        for b in t:
            if b not in kids[n]:
                kids.append({})
                kids[n][b] = len(kids) - 1
            n = kids[n][b]
        ends[n] = i
    return kids, ends


def classes(terms: list[bytes]) -> tuple[np.ndarray, int]:
    """The class of each byte - 0 for those that no term holds - and the number of classes."""
    out = np.zeros(256, np.int32)
    used = sorted(set(b"".join(terms)))
    out[used] = np.arange(1, len(used) + 1)
    return out, len(used) + 1


def fuzzy_table(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition table (state x class of byte; 0: dead, 1: start), and per state the term accepted (-1: none) and its edits."""
    kids, ends = trie(terms)
    kind, n_kinds = classes(terms)
    deep = [0] * len(kids)  # the length of the longest term below decides whether a node may be misspelled
    depth = [0] * len(kids)
    for n, k in enumerate(kids):
        for to in k.values():
            depth[to] = depth[n] + 1
    for n in range(len(kids) - 1, -1, -1):  # a node comes after its parent
        deep[n] = max([depth[n] if n in ends else 0, *[deep[k] for k in kids[n].values()]])

    def close(items: set[tuple[int, int]]) -> frozenset:
        out = set(items)
        for n, e in items:
            if e == 0:
                out |= {(k, 1) for k in kids[n].values() if deep[k] >= FUZZY_BYTES}
        return frozenset((n, e) for n, e in out if e == 0 or (n, 0) not in out)

    states = {frozenset(): 0, close({(0, 0)}): 1}
    todo, rows = [close({(0, 0)})], {0: np.zeros(n_kinds, np.int32)}
    while todo:
        state = todo.pop()
        row = np.zeros(n_kinds, np.int32)
        other = {(k, 1) for n, e in state if e == 0 for k in kids[n].values() if deep[k] >= FUZZY_BYTES} | {(n, 1) for n, e in state if e == 0 and deep[n] >= FUZZY_BYTES}
        moves = {b for n, _ in state for b in kids[n]}
        for b in [None, *sorted(moves)]:
            nxt = close(other | ({(kids[n][b], e) for n, e in state if b in kids[n]} if b is not None else set()))
            if nxt not in states:
                states[nxt] = len(states)
                todo.append(nxt)
            if b is None:
                row[:] = states[nxt]
            else:
                row[kind[b]] = states[nxt]
        rows[states[state]] = row
    table = np.stack([rows[i] for i in range(len(states))])
    term, edits = np.full(len(states), -1, np.int32), np.zeros(len(states), np.int8)
    for state, i in states.items():
        found = [(e, ends[n]) for n, e in state if n in ends and (e == 0 or len(terms[ends[n]]) >= FUZZY_BYTES)]
        if found:
            edits[i], term[i] = min(found)
    return table, term, edits


def stem_table(stems: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The plain trie as a table of the same kind; a stem's last node is kept to the end of the word."""
    kids, ends = trie(stems)
    kind, n_kinds = classes(stems)
    table = np.zeros((len(kids) + 1, n_kinds), np.int32)
    term = np.full(len(kids) + 1, -1, np.int32)
    for n, k in enumerate(kids):
        if n in ends:
            table[n + 1] = n + 1
            term[n + 1] = ends[n]
        for b, to in k.items():
            table[n + 1, kind[b]] = to + 1
    return table, term


def walk(table: np.ndarray, kind: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that come through the table alive, and their last states. kind: the class of each byte."""
    at, state, pos = np.arange(len(starts)), np.ones(len(starts), np.int32), starts.copy()
    done_at, done_state = [], []
    while len(at):
        state = table[state, kind[buf[pos]]]
        pos = pos + 1
        live = state > 0
        at, state, pos = at[live], state[live], pos[live]
        over = pos >= ends[at]
        if over.any():
            done_at.append(at[over])
            done_state.append(state[over])
            at, state, pos = at[~over], state[~over], pos[~over]
    if not done_at:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate(done_at), np.concatenate(done_state)


def context_weight(low: np.ndarray, lo: int, hi: int, s: int, e: int, near: int) -> float:
    """The weight of the hit low[s:e] in the document low[lo:hi]; near: other hits within the window."""
    before, after = bytes(low[max(lo, s - WINDOW_BYTES) : s]), bytes(low[e : min(hi, e + WINDOW_BYTES)])
    around = set(re.findall(rb"[a-z]+", before + b" " + after))
    line_before, line_after = before.rpartition(b"\n")[2], after.partition(b"\n")[0]
    quoted = len(MARKS_TEXT.findall(line_before.decode(errors="ignore"))) % 2 == 1 and bool(MARKS_TEXT.search(line_after.decode(errors="ignore")))
    if quoted or around & REPORTING_SET:
        return QUOTED
    return DIRECTED if near or around & SECOND_SET else 1.0


MARKS_TEXT = re.compile('["“”„«»]')
REPORTING_SET, SECOND_SET = {x.encode() for x in REPORTING}, {x.encode() for x in SECOND}
N_FEATURES = 6


def features(model: dict, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each document: weighted hits as written, misspelled and of stems (log), their density, and whether any."""
    n = len(offs) - 1
    low = fold(buf)
    s, e, doc = letter_runs(low, offs)
    size = np.bincount(doc, minlength=n)
    sums = np.zeros((n, 3))
    if len(s):
        hits: list[tuple[int, int, int, float]] = []
        if model["words"]:
            at, state = walk(model["table"], model["kind"], low, s, e)
            term, edits = model["term"][state], model["edits"][state]
            for i, t, d in zip(at[term >= 0], term[term >= 0], edits[term >= 0]):
                if d == 0:
                    hits.append((i, 0, t, model["word_odds"][t]))
                elif bytes(low[s[i] : e[i]]) not in model["own_words"]:
                    hits.append((i, 1, t, model["word_odds"][t]))
        if model["stems"]:
            taken = {h[0] for h in hits}
            at, state = walk(model["stem_table"], model["stem_kind"], low, s, e)
            term = model["stem_term"][state]
            hits += [(i, 2, t, model["stem_odds"][t]) for i, t in zip(at[term >= 0], term[term >= 0]) if i not in taken]
        hits.sort()
        for k, (i, kind, _, odds) in enumerate(hits):
            d = doc[i]
            near = sum(1 for j in (k - 1, k + 1) if 0 <= j < len(hits) and doc[hits[j][0]] == d and abs(int(s[hits[j][0]]) - int(s[i])) <= WINDOW_BYTES)
            sums[d, kind] += odds / 4 * context_weight(low, offs[d], offs[d + 1], s[i], e[i], near)
    total = sums.sum(axis=1)
    return np.column_stack([np.log1p(sums), np.log1p(100 * total / np.maximum(size, 20)), np.minimum(total, 1), total > 0])


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def words_in_context(rows: DataFrame) -> DataFrame:
    """y, word, context (hash of the word and its neighbours) of the words of (y, text); each once within a chunk of texts."""

    def run(batches):
        pad = np.zeros(1, np.uint64)
        for b in batches:
            label = b.column("y").to_numpy()
            for i, _, buf, offs in chunks(b.column("text")):
                low = fold(buf)
                s, e, doc = letter_runs(low, offs)
                if not len(s):
                    continue
                h = hash_ranges(low, s, e)
                turn = doc[1:] != doc[:-1]
                context = mix(np.r_[pad, np.where(turn, 0, h[:-1])] * np.uint64(3) + h)
                context = mix(context * np.uint64(5) + np.r_[np.where(turn, 0, h[1:]), pad])
                y = label[i + doc]
                _, at = np.unique(context + y.astype(np.uint64), return_index=True)
                s, e, y, context = s[at], e[at], y[at], context[at]
                ends = np.cumsum(e - s)
                own = low[np.repeat(s - (ends - (e - s)), e - s) + np.arange(ends[-1])]
                word = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([pa.array(y), word, pa.array(context.view(np.int64))], ["y", "word", "context"])

    return rows.select("y", "text").mapInArrow(run, "y int, word binary, context long").distinct()


def telling(counts: DataFrame, n: tuple[int, int], least: float) -> DataFrame:
    """term, odds of the terms that are in many more contexts of toxic texts (t) than of clean ones (c). n: the number of texts of either."""
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
    return counts.where(F.col("t") >= SUPPORT).select("term", odds.alias("odds")).where(F.col("odds") >= least)


def learn(rows: DataFrame, share: float, spark: SparkSession) -> dict:
    """The model from a bounded number of labelled texts (text, y); share: that of label 1 among all labelled rows.

    A term counts once for each pair of words around it, so that copies of a
    document don't make its words tell. Texts and counts stay on the executors;
    the terms that tell, and the features of each text, come to the driver.
    """
    scratch = Scratch(spark, "toxicity")
    rows = scratch.keep(rows.select("text", "y"))
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = (size.get(0, 0), size.get(1, 0))
    model = {"words": [], "stems": [], "own_words": set()}
    counts = scratch.keep(words_in_context(rows).groupBy(F.col("word").alias("term")).agg(F.count(F.when(F.col("y") == 1, 1)).alias("t"), F.count(F.when(F.col("y") == 0, 1)).alias("c")))
    words = {bytes(r["term"]): r["odds"] for r in telling(counts.where(F.octet_length("term") >= 3), n, WORD_ODDS).collect()}
    if words:
        model["words"] = sorted(words)
        model["word_odds"] = [words[w] for w in model["words"]]
        model["kind"] = classes(model["words"])[0]
        model["table"], model["term"], model["edits"] = fuzzy_table(model["words"])
        model["own_words"] = misspelled(counts.where("c > 0"), model, spark) - set(words)
    others = counts.join(F.broadcast(spark.createDataFrame([(w,) for w in words], "term binary")), "term", "left_anti") if words else counts
    text = F.decode("term", "UTF-8")
    starts = F.explode(F.sequence(F.lit(STEMS[0]), F.least(F.length(text), F.lit(STEMS[-1])))).alias("k")
    begins = others.where(F.length(text) >= STEMS[0]).select("t", "c", "term", starts).groupBy(F.encode(F.substring(text, F.lit(1), F.col("k")), "UTF-8").alias("term")).agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    stems: dict[bytes, float] = {}
    found = [(bytes(r["term"]), r["odds"]) for r in telling(begins, n, STEM_ODDS).collect()]
    for stem, odds in sorted(found, key=lambda x: (len(x[0].decode()), x[0])):
        if not any(stem[:k] in stems for k in range(1, len(stem))):
            stems[stem] = odds
    if stems:
        model["stems"] = sorted(stems)
        model["stem_odds"] = [stems[p] for p in model["stems"]]
        model["stem_kind"] = classes(model["stems"])[0]
        model["stem_table"], model["stem_term"] = stem_table(model["stems"])
    model["beta"] = np.r_[np.zeros(N_FEATURES), np.log(max(share, 1e-6) / max(1 - share, 1e-6)) if sum(n) else -3.0]
    if all(n):
        seen = sorted((r["y"], tuple(r["features"])) for r in measured(rows, model, spark, ["y"]).collect())
        x, y = np.array([f for _, f in seen]), np.array([v for v, _ in seen], float)
        model["beta"] = logistic(x, y, np.where(y == 1, share / n[1], (1 - share) / n[0]) * len(y))
    scratch.drop(rows, counts)
    return model


def misspelled(counts: DataFrame, model: dict, spark: SparkSession) -> set[bytes]:
    """The terms that the table accepts."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            buf, offs = text_buffer(b.column("term"))
            at, state = walk(m["table"], m["kind"], buf, offs[:-1], offs[1:])
            yield b.take(pa.array(at[m["term"][state] >= 0]))

    return {bytes(r["term"]) for r in counts.select("term").mapInArrow(run, "term binary").collect()}


def measured(rows: DataFrame, model: dict, spark: SparkSession, keep: list[str]) -> DataFrame:
    """keep and features of each row."""
    shared = spark.sparkContext.broadcast(model)  # terms and tables, bounded by the sample

    def run(batches):
        for b in batches:
            x = np.zeros((len(b), N_FEATURES))
            for i, j, buf, offs in chunks(b.column("text")):
                x[i:j] = features(shared.value, buf, offs)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], lists], [*keep, "features"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "text").mapInArrow(run, f"{kinds}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, spark: SparkSession, column: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, per_label: int = PER_LABEL) -> dict:
    picked, share = labelled_sample(labels, column, folds, held_out, per_label)
    return learn(sample_rows(docs, picked, spark).select("doc_id", "text", "y").distinct(), share, spark)


def score(docs: DataFrame, model: dict, spark: SparkSession) -> DataFrame:
    """doc_id, score of every row."""
    shared = spark.sparkContext.broadcast(model)  # terms and tables, bounded by the sample

    def run(batches):
        m = shared.value
        for b in batches:
            out = np.empty(len(b))
            for i, j, buf, offs in chunks(b.column("text")):
                x = features(m, buf, offs)
                out[i:j] = 1 / (1 + np.exp(-np.clip(x @ m["beta"][:-1] + m["beta"][-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, spark: SparkSession) -> DataFrame:
    """docs, all columns, without the rows that score THRESHOLD or more; rows are judged where they lie, without a join."""
    docs, back = shielded(docs, "doc_id", "text")
    shared = spark.sparkContext.broadcast(fit(docs, labels, spark))

    def run(batches):
        m = shared.value
        for b in batches:
            clean = np.ones(len(b), bool)
            for i, j, buf, offs in chunks(b.column("text")):
                clean[i:j] = features(m, buf, offs) @ m["beta"][:-1] + m["beta"][-1] < np.log(THRESHOLD / (1 - THRESHOLD))
            yield b.filter(pa.array(clean))

    return back(docs.mapInArrow(run, docs.schema))


def classify(docs: DataFrame, labels: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels, spark)
    return score(docs, model, spark).select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
