"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The n-grams of ``SEED`` words of all items are looked for in all documents, and those that occur
   are counted: how often in documents, and how often in items. What a seed costs is the product of
   both, the number of rows that it joins.
2. An item's seeds are its rare n-grams: of those that occur, the cheaper half, and
   any other that costs at most ``RARE`` times what the dearest of that half does. So an edited copy is
   found wherever one rare n-gram of it is left; one that has kept none is not.
3. Seeds join documents to items by hash. Each hit proposes a diagonal; diagonals of one item that lie
   near each other are one window. A document and an item meet once, whatever the number of hits.
4. A document that holds too few of an item's words to reach the score is left out, and then so is each such window;
   both are upper bounds, so nothing is lost. The other windows and the whole item are aligned word by word (Smith-Waterman: match
   +2, substitution -1, gap -1), many at once.
5. A document holds an item when the alignment scores ``SHARE`` of the item's
   self-alignment or more, or ``LONG`` points or more: an edited copy of most of
   the item, or a long exact part of it. Items of fewer than ``LEAST`` words
   must be found whole.

Documents are read for n-grams, of which a filter of fixed size passes those of items and few others, and again for the texts with hits, which
such a filter picks too: no other text is shuffled.
The benchmark never goes through the driver. Texts are known by two digests of 64 bits, so copies of one text are judged alike.
Null and empty texts and items match nothing; items
with fewer words than a seed are one n-gram of their own length; equal items
are each reported, items without an id not at all; repeated rows, and rows without an id, are each reported; an empty table or
benchmark gives an empty result; extra columns are left out, and pass through where rows are filtered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shielded
from .search import term_filter
from .tokens import chunks, hash_ranges, ngrams, words

SEED = 3
MATCH, MISS, GAP = 2, -1, -1
SHARE, LONG, LEAST = 0.4, 60, 8
RARE = 16
#: Bits of the filter of the items' n-grams.
BITS = 24
#: Words of windows and items that are aligned at once.
AREA = 100_000
SLACK = 12
#: Words drop punctuation at their ends.
EDGE = np.zeros(256, bool)
EDGE[[x for x in range(33, 127) if not chr(x).isalnum()]] = True
PUNCTUATION = np.flatnonzero(EDGE).astype(np.uint8).tobytes()


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word without punctuation at its ends; words of punctuation only are left out."""
    s, e, doc = words(buf, offs)
    for _ in range(2):  # most words have a byte or two, all words at once
        if len(s):
            e = e - ((e > s) & EDGE[buf[np.maximum(e - 1, 0)]])
            s = s + ((e > s) & EDGE[buf[np.minimum(s, len(buf) - 1)]])
    keep = e > s
    s, e, doc = s[keep], e[keep], doc[keep]
    for i in np.flatnonzero(EDGE[buf[e - 1]] | EDGE[buf[s]]) if len(s) else ():
        left = buf[s[i] : e[i]].tobytes().rstrip(PUNCTUATION)
        e[i] = s[i] + len(left)
        s[i] = e[i] - len(left.lstrip(PUNCTUATION))
    keep = e > s
    s, e, doc = s[keep], e[keep], doc[keep]
    return hash_ranges(buf, s, e, fold=True), doc


def item_words(benchmark: DataFrame) -> DataFrame:
    """item (a number of its own), item_id, words (digests) of the items that have words."""

    def run(batches):
        for b in batches:
            for i, j, buf, offs in chunks(b.column("text")):
                h, doc = word_hashes(buf, offs)
                count = np.bincount(doc, minlength=j - i)
                filled = pa.array(i + np.flatnonzero(count))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count[count > 0])].astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("item").take(filled), b.column("item_id").take(filled), lists], ["item", "item_id", "words"])

    rows = benchmark.where("text is not null and item_id is not null").select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item long, item_id long, words array<long>")


def item_grams(items: DataFrame) -> DataFrame:
    """item, term (digest of an n-gram), place of each n-gram of the items, and its length."""

    def run(batches):
        for b in batches:
            out = []
            for item, ws in zip(b.column("item").to_pylist(), b.column("words")):
                h = ws.values.to_numpy().view(np.uint64)
                k = min(SEED, len(h))
                grams, place = ngrams(h, np.zeros(len(h), np.int64), k)
                out.append((np.full(len(grams), item), grams.view(np.int64), place.astype(np.int32), np.full(len(grams), k, np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["item", "term", "place", "size"])

    return items.select("item", "words").mapInArrow(run, "item long, term long, place int, size int")


KEY = ["t1", "t2"]


def keyed(docs: DataFrame) -> DataFrame:
    """text and two digests of it (KEY) of the documents that have any."""
    return docs.where("text <> ''").select(*digests(KEY), "text")


def digests(names: list[str]) -> list[Column]:
    return [F.xxhash64("text").alias(names[0]), F.xxhash64(F.lit(7), "text").alias(names[1])]


def occurrences(texts: DataFrame, sizes: list[int], keep: np.ndarray, spark: SparkSession) -> DataFrame:
    """term, KEY, pos of the n-grams of texts that the filter passes."""
    shared = spark.sparkContext.broadcast(np.packbits(keep))

    def run(batches):
        asked = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            keys = [b.column(c).to_numpy() for c in KEY]
            for i, _, buf, offs in chunks(b.column("text")):
                h, doc = word_hashes(buf, offs)
                first = np.searchsorted(doc, doc)
                for k in sizes:
                    grams, at = ngrams(h, doc, k)
                    some = asked[(grams >> np.uint64(64 - BITS)).astype(np.int64)]
                    grams, at = grams[some], at[some]
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), *[pa.array(c[i + doc[at]]) for c in keys], pa.array((at - first[at]).astype(np.int32))], ["term", *KEY, "pos"])

    return texts.mapInArrow(run, "term long, t1 long, t2 long, pos int")


def rare_seeds(grams: DataFrame, found: DataFrame) -> DataFrame:
    """term, item, place of the seeds: of an item's n-grams that occur the cheaper half, and those at most RARE times as dear."""
    cost = found.groupBy("term").agg(F.count(F.lit(1)).alias("f")).join(grams.groupBy("term").agg(F.count(F.lit(1)).alias("g")), "term").select("term", (F.col("f") * F.col("g")).alias("cost"))
    each = grams.select("item", "term").distinct().join(cost, "term")
    order = Window.partitionBy("item").orderBy("cost", "term")
    each = each.withColumns({"n": F.row_number().over(order), "of": F.count(F.lit(1)).over(Window.partitionBy("item"))})
    half = F.ceil(F.col("of") / 2)
    each = each.withColumn("middle", F.max(F.when(F.col("n") == half, F.col("cost"))).over(Window.partitionBy("item")))
    seeds = each.where((F.col("n") <= half) | (F.col("cost") <= RARE * F.col("middle"))).select("item", "term")
    return grams.select("item", "term", "place").join(seeds, ["item", "term"])


def proposals(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, scratch: Scratch) -> DataFrame:
    """KEY, items: array of (item_id, words, starts) that a text has seeds of."""
    items = scratch.keep(item_words(benchmark))
    grams = scratch.keep(item_grams(items))
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())
    found = occurrences(keyed(docs), sizes, term_filter(grams, BITS), spark)
    found = scratch.keep(found.join(grams.select("term").distinct(), "term"))
    hits = found.join(rare_seeds(grams, found), "term").groupBy(*KEY, "item").agg(F.collect_set(F.col("pos") - F.col("place")).alias("starts"))
    met = hits.join(items, "item").groupBy(*KEY).agg(F.collect_list(F.struct("item_id", "words", "starts")).alias("items"))
    return scratch.keep(met)


def align(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Best local alignment score of each row of left (windows) with the same row of right (items); 0 pads left, 1 pads right."""
    n, width = left.shape
    slope = GAP * np.arange(width + 1)
    row = np.zeros((n, width + 1), np.int32)
    best = np.zeros(n, np.int32)
    for j in range(right.shape[1]):
        hit = np.where(left == right[:, j : j + 1], MATCH, MISS)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + hit, row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        # gaps along the window: the best start of a gap, by a running maximum
        row = np.maximum(np.maximum.accumulate(new - slope, axis=1) + slope, 0)
        np.maximum(best, row.max(axis=1), out=best)
    return best


def by_area(width: np.ndarray, deep: np.ndarray) -> Iterator[np.ndarray]:
    """Windows to align at once, like by like: as many as AREA words have room for, or one."""
    order = np.lexsort((deep, width))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        most = int(width[order[lo]] + deep[order[lo]])
        while hi < len(order) and (hi + 1 - lo) * max(most, int(width[order[hi]] + deep[order[hi]])) <= AREA:
            most = max(most, int(width[order[hi]] + deep[order[hi]]))
            hi += 1
        yield order[lo:hi]
        lo = hi


def need(n: int) -> float:
    """The least score by which a document holds an item of n words."""
    return min(MATCH * n * (SHARE if n >= LEAST else 1), LONG)


def windows_of(starts: np.ndarray, n: int, size: int) -> list[tuple[int, int]]:
    """Ranges of a document of size words around diagonals: those within SLACK are one, and one longer than two items is cut into overlapping ones."""
    starts = np.sort(starts)
    first = np.flatnonzero(np.r_[True, np.diff(starts) > SLACK])
    last = np.r_[first[1:], len(starts)] - 1
    step, out = n + 2 * SLACK, []
    for lo, hi in zip((starts[first] - SLACK).tolist(), (starts[last] + n + SLACK).tolist()):
        at, hi = max(lo, 0), min(hi, size)
        while True:
            out.append((at, min(at + 2 * step, hi)))
            if at + 2 * step >= hi:
                break
            at += step
    return out


def scores_of(h: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """The best alignment of each item (words, starts) with a document's words h; 0 where bounds rule it out."""
    out = [0] * len(items)
    if not items:
        return out
    have = np.unique(h)
    size = [len(w) for w, _ in items]
    every = np.concatenate([w for w, _ in items])
    at = np.minimum(np.searchsorted(have, every), len(have) - 1)
    inside = np.add.reduceat(have[at] == every, np.r_[0, np.cumsum(size)[:-1]])
    spans: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(MATCH * inside >= [need(n) for n in size]):
        w, starts = items[i]
        # how many words of each range are some word of the item
        met = np.r_[0, np.cumsum(np.isin(h, w))]
        spans += [(int(i), lo, hi) for lo, hi in windows_of(starts, size[i], len(h)) if MATCH * (met[hi] - met[lo]) >= need(size[i])]
    if not spans:
        return out
    who, lo, hi = (np.array(x) for x in zip(*spans))
    width, deep = hi - lo, np.array(size)[who]
    for part in by_area(width, deep):
        left, right = np.zeros((len(part), int(width[part].max())), np.uint64), np.ones((len(part), int(deep[part].max())), np.uint64)
        for r, x in enumerate(part):
            left[r, : width[x]] = h[lo[x] : hi[x]]
            right[r, : deep[x]] = items[who[x]][0]
        for x, s in zip(part, align(left, right)):
            out[who[x]] = max(out[who[x]], int(s))
    return out


def passing(rows: DataFrame, bits: np.ndarray, spark: SparkSession, inside: bool = True) -> DataFrame:
    """The rows whose digest t1 the filter passes, or those that it rules out."""
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        asked = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            at = (b.column("t1").to_numpy().view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)
            yield b.filter(pa.array(asked[at] == inside))

    return rows.mapInArrow(run, rows.schema)


def held(docs: DataFrame, benchmark: DataFrame, spark: SparkSession) -> DataFrame:
    """KEY, item_id, score, share of each item that a text holds."""
    scratch = Scratch(spark, "leaks")
    met = proposals(docs, benchmark, spark, scratch)

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for r in range(len(b)):
                text = np.frombuffer(b.column("text")[r].as_buffer(), np.uint8)
                h, _ = word_hashes(text, np.array([0, len(text)]))
                own = b.column("items")[r].values
                ids, words_, starts = (own.field(c) for c in ("item_id", "words", "starts"))
                items = [(words_[i].values.to_numpy().view(np.uint64), starts[i].values.to_numpy().astype(np.int64)) for i in range(len(own))]
                for i, s in enumerate(scores_of(h, items)):
                    n = len(items[i][0])
                    if s and s >= need(n):
                        out.append((b.column("t1")[r].as_py(), b.column("t2")[r].as_py(), ids[i].as_py(), s, s / (MATCH * n)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], [*KEY, "item_id", "score", "share"])

    texts = passing(keyed(docs), term_filter(met.select(F.col("t1").alias("term")), BITS), spark)
    texts = texts.join(met, KEY).dropDuplicates(KEY)  # copies of one text are judged once
    return scratch.keep(texts.mapInArrow(run, "t1 long, t2 long, item_id long, score int, share double"))


def find(docs: DataFrame, benchmark: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, item_id, score, share of each item that a document holds."""
    rows = docs.where("text <> ''").select("doc_id", *digests(KEY))
    return rows.join(held(docs, benchmark, spark), KEY).select("doc_id", "item_id", "score", "share")


def clean(docs: DataFrame, benchmark: DataFrame, spark: SparkSession) -> DataFrame:
    """docs, all columns, without those that hold a benchmark item."""
    docs, back = shielded(docs, "text")
    bad = held(docs, benchmark, spark).select(*KEY).distinct()
    bits = term_filter(bad.select(F.col("t1").alias("term")), BITS)
    # a null text has digests of its own, which no text that holds an item has
    rows = docs.withColumns(dict(zip(KEY, digests(KEY))))
    left = passing(rows, bits, spark).join(bad, KEY, "left_anti").select(*rows.columns)
    return back(passing(rows, bits, spark, inside=False).unionAll(left).select(*docs.columns))
