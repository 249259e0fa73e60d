"""Ranked lexical search by Fagin's threshold algorithm over a sharded index.

The score of a document for an item is a sum over the item's terms (repeats
included) of w * ((10^9 tf) div (1000 tf + 8 m)), whole numbers throughout but
for the logarithm in a term's weight w; m grows with the document's length.
Every summand is zero or more and falls with m, which is what the algorithm needs.

1. *Index.* Each task turns the documents that it reads into shards of about
   ``SHARD`` postings: the forward index (terms of each document, with counts) of
   whole documents, one row a shard. Postings of terms that no item has are left out by a bitmap
   of fixed size; what it lets through beyond that does no harm.
2. *Statistics.* Documents, terms and the documents that hold a term are summed over all shards.
3. *Search.* In a shard each term's postings are sorted by impact. For each item
   its lists are read in rounds, all to the same depth; each document met is scored in full at
   once by lookups in the forward index, and the best ``TOP`` are kept. The
   threshold is the sum of the impacts at the depth reached, which no document unseen
   can exceed; a search stops when it falls strictly below the score of the last one kept, so that
   all ties are met. A task goes on from shard to shard with the scores it has.
4. *Bids.* One shard in ``SEEDS`` is searched first. The last score kept of each item is a lower bound
   for all, and the search of all shards starts from it: what tasks return then depends
   little on their number. The best of all tasks are the result.

Items are searched in blocks of about ``BLOCK`` terms, each of which is sent to the
executors and is a pass over the index, not over the documents. Terms are known by
64-bit digests.

Null and empty texts hold no terms. Documents without an id count in the
statistics and are not ranked; rows that repeat, or share an id, are ranked row by
row. Items without an id, a term or a document with a score above 0 have no row;
an item that is repeated in full is searched once, items that share an id each for itself. Long texts
are read whole; empty tables give an empty result; extra columns are left out by name.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import NO_TERM, chunks, hash_ranges, words

TOP = 10
#: Postings of a shard; a longer document is a shard of its own.
SHARD = 1 << 20
#: Terms of the items that are searched in one pass.
BLOCK = 200_000
SEEDS = 64
#: Bits of the filter of the items' terms.
BITS = 22
#: Lookups done at once, and cells (items by documents) of the table of documents met.
LOOKUPS, CELLS = 1 << 19, 1 << 25
#: Postings that each list gives in the first round; every round reads twice as many.
DEPTH = 8


def terms_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digest and document of each term."""
    s, e, doc = words(buf, offs, NO_TERM)
    return hash_ranges(buf, s, e, fold=True), doc


def counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) in order, and how often each occurs."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.r_[at, len(h)])


def item_terms(items: DataFrame) -> DataFrame:
    """item (a key), item_id, term, q of the items; q: how often the item has the term."""

    def run(batches):
        for b in batches:
            for i, _, buf, offs in chunks(b.column("text")):
                doc, h, q = counted(*terms_of(buf, offs))
                take = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays([b.column("item").take(take), b.column("item_id").take(take), pa.array(h.view(np.int64)), pa.array(q.astype(np.int64))], ["item", "item_id", "term", "q"])

    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return rows.select(F.sha2(F.concat(F.col("item_id").cast("string"), F.lit(" "), F.col("text")), 256).alias("item"), "item_id", "text").mapInArrow(run, "item string, item_id long, term long, q long")


def term_filter(asked: DataFrame, bits: int = BITS) -> np.ndarray:
    """One bit for each value of a digest's first bits: whether a term has it. Its size is fixed, whatever the number of terms."""
    bucket = F.shiftrightunsigned("term", 64 - bits)
    cells = asked.select(F.shiftright(bucket, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - bits}) & 63 as int))").alias("bit"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in cells.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        out[r["at"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


#: Stands for a null id within a shard.
NO_ID = -(1 << 63)
SHARD_SCHEMA = "seed boolean, n_docs long, n_terms long, ids binary, long binary, ends binary, vocab array<long>, df array<long>, term binary, tf binary"


def build(docs: DataFrame, keep: np.ndarray, spark: SparkSession, shard: int = SHARD) -> DataFrame:
    """The shards. ids, long: id and number of terms of each document; ends: of its postings; vocab: the shard's terms, df: documents that hold each; term (place in vocab), tf: of each posting."""
    shared = spark.sparkContext.broadcast(np.packbits(keep))

    def run(batches):
        asked = np.unpackbits(shared.value).astype(bool)
        held: list[tuple] = []
        n_docs = n_terms = size = 0

        def flush():
            ids, long, count, h, tf = (np.concatenate(c) for c in zip(*held)) if held else (np.empty(0, np.int64),) * 5
            vocab, term = np.unique(h, return_inverse=True)
            # a shard is drawn by the digest of what it holds, so that a task run again draws the same
            seed = bool(len(vocab)) and (int(vocab[0]) + len(h) + int(ids[0])) % SEEDS == 0
            blobs = [ids.astype(np.int64), long.astype(np.int64), np.cumsum(count).astype(np.int32)]
            more = [term.astype(np.int32), tf.astype(np.int32)]
            df = np.bincount(term, minlength=len(vocab)).astype(np.int64)
            row = [[seed], [n_docs], [n_terms], *[[x.tobytes()] for x in blobs], [vocab.view(np.int64)], [df], *[[x.tobytes()] for x in more]]
            kinds = [pa.bool_(), pa.int64(), pa.int64(), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 2]
            names = ["seed", "n_docs", "n_terms", "ids", "long", "ends", "vocab", "df", "term", "tf"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names)

        for b in batches:
            ids, known = b.column("doc_id").fill_null(0).to_numpy(), b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for i, j, buf, offs in chunks(b.column("text")):
                h, doc = terms_of(buf, offs)
                long = np.bincount(doc, minlength=j - i)
                n_docs, n_terms = n_docs + int((long > 0).sum()), n_terms + len(h)
                some = asked[(h >> np.uint64(64 - BITS)).astype(np.int64)]
                doc, h, tf = counted(h[some], doc[some])
                count = np.bincount(doc, minlength=j - i)
                own = np.flatnonzero(count > 0)
                # a document without an id is one of the statistics: its postings count, under an id that is left out later
                held.append((np.where(known[i:j], ids[i:j], NO_ID)[own], long[own], count[own], h, tf))
                size += len(h)
                if size >= shard:
                    yield flush()
                    held, n_docs, n_terms, size = [], 0, 0, 0
        if n_docs:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SHARD_SCHEMA)


class Shard:
    """One shard's forward index, and its postings by term and impact."""

    def __init__(self, row: dict, n_docs: int, n_terms: int, asked: np.ndarray):
        """asked: digests that are searched for, sorted."""
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, long, ends = get("ids", np.int64), get("long", np.int64), get("ends", np.int32)
        term, tf = get("term", np.int32).astype(np.int64), get("tf", np.int32).astype(np.int64)
        doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        self.vocab = row["vocab"].view(np.uint64)
        m = 25 + 75 * long * n_docs // n_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        some = np.isin(self.vocab, asked)[term] & (self.ids != NO_ID)[doc]
        doc, term, impact = doc[some], term[some], impact[some]
        self.key, self.impact = doc * len(self.vocab) + term, impact  # ascending: by document, then term
        order = np.lexsort((-impact, term))
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.vocab) + 1))

    def place(self, terms: np.ndarray) -> np.ndarray:
        """Place of each digest in the vocabulary, else -1."""
        if not len(self.vocab):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.vocab, terms), len(self.vocab) - 1)
        return np.where(self.vocab[at] == terms, at, -1)

    def lookup(self, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Impact of each term in each document, 0 where it isn't there."""
        want = doc * len(self.vocab) + term
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.impact[at], 0)


def expand(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of all places of the ranges lo to lo + n."""
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + lo[who]


class Best:
    """The best documents of each item so far: highest score first, then smallest id."""

    def __init__(self, n: int, top: int, bound: np.ndarray):
        self.n, self.top, self.bound = n, top, bound  # bound: scores below it can't be among the best of all
        self.item, self.doc, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.last = bound.copy()

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.last[item]
        if not good.any():
            return
        item, doc, score = (np.concatenate(x) for x in ((self.item, item[good]), (self.doc, doc[good]), (self.score, score[good])))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = rank < self.top
        self.item, self.doc, self.score = item[kept], doc[kept], score[kept]
        full = rank == self.top - 1
        self.last[item[full]] = np.maximum(self.last[item[full]], score[full])


def threshold_search(shard: Shard, first: np.ndarray, terms: np.ndarray, weight: np.ndarray, best: Best, depth: int = DEPTH) -> None:
    """Adds the shard's best documents of each item. first: where each item's terms start, and the end; weight: of each term, times its occurrences in the item."""
    place = shard.place(terms)
    has = (place >= 0) & (weight > 0)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    lists, owner, weight = place[has], owner[has], weight[has]
    size = shard.start[lists + 1] - shard.start[lists] if len(lists) else lists
    if not len(lists) or not len(shard.key):
        return
    group = max(1, CELLS // len(shard.ids))
    for lo in range(0, len(first) - 1, group):
        a, b = np.searchsorted(owner, [lo, lo + group])
        _search(shard, lo, min(group, len(first) - 1 - lo), lists[a:b], owner[a:b], weight[a:b], size[a:b], best, depth)


def _search(shard: Shard, lo: int, n: int, lists, owner, weight, size, best: Best, depth: int) -> None:
    met = np.zeros((n, len(shard.ids)), bool)
    begin = np.searchsorted(owner, np.arange(lo, lo + n + 1))
    live = np.ones(n, bool)
    read = 0
    while live.any():
        open_ = np.flatnonzero(live[owner - lo] & (size > read))
        who, at = expand(shard.start[lists[open_]] + read, np.minimum(depth, size[open_] - read))
        pair = np.unique((owner[open_][who] - lo) * len(shard.ids) + shard.list_doc[at])
        pair = pair[~met.ravel()[pair]]
        met.ravel()[pair] = True
        item, doc = np.divmod(pair, len(shard.ids))
        terms_of_item = begin[item + 1] - begin[item]
        edges = np.searchsorted(np.cumsum(terms_of_item), np.arange(0, terms_of_item.sum() + LOOKUPS, LOOKUPS), side="left")
        for x, y in zip(edges[:-1], edges[1:]):
            if x == y:
                continue
            who, at = expand(begin[item[x:y]], terms_of_item[x:y])
            part = shard.lookup(doc[x:y][who], lists[at]) * weight[at]
            score = np.add.reduceat(part, np.cumsum(terms_of_item[x:y]) - terms_of_item[x:y])
            best.add(lo + item[x:y], shard.ids[doc[x:y]], score)
        read += depth
        depth *= 2
        # what a document not met yet can still reach
        deep = np.where(size > read, shard.list_impact[np.minimum(shard.start[lists] + read, len(shard.list_impact) - 1)], 0) * weight
        threshold = np.zeros(n, np.int64)
        np.add.at(threshold, owner - lo, deep)
        live &= threshold >= np.maximum(best.last[lo : lo + n], 1)


def search(shards: DataFrame, block: dict, n_docs: int, n_terms: int, bound: np.ndarray, spark: SparkSession, top: int = TOP) -> DataFrame:
    """item (place in the block), doc_id, score: the best of each task."""
    shared = spark.sparkContext.broadcast(block | {"bound": bound})

    def run(batches):
        q = shared.value
        best = Best(len(q["first"]) - 1, top, q["bound"].copy())
        asked = np.unique(q["term"])
        for b in batches:
            for i in range(len(b)):
                row = {c: b.column(c)[i].as_buffer() for c in ("ids", "long", "ends", "term", "tf")} | {"vocab": b.column("vocab")[i].values.to_numpy()}
                threshold_search(Shard(row, n_docs, n_terms, asked), q["first"], q["term"], q["weight"], best)
        yield pa.RecordBatch.from_arrays([pa.array(best.item.astype(np.int32)), pa.array(best.doc), pa.array(best.score)], ["item", "doc_id", "score"])

    return shards.select("ids", "long", "ends", "vocab", "term", "tf").mapInArrow(run, "item int, doc_id long, score long")


def best_of(found: DataFrame, top: int) -> DataFrame:
    """The best of all tasks by item, with rank; tasks cut what they send to top rows an item first."""
    w = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def rank(docs: DataFrame, items: DataFrame, spark: SparkSession, top: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score of the top documents of each item."""
    scratch = Scratch(spark, "search")
    asked = scratch.keep(item_terms(items))
    n_asked = asked.count()
    path = f"{scratch.root}/shards"
    build(docs, term_filter(asked), spark, shard).write.partitionBy("seed").option("compression", "zstd").parquet(path)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    total = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = total["n"] or 0, total["l"] or 0
    df = shards.select(F.explode(F.arrays_zip("vocab", "df")).alias("x")).groupBy(F.col("x.vocab").alias("term")).agg(F.sum("x.df").alias("df"))
    known = scratch.keep(asked.join(df, "term"))  # an item's terms that some document holds
    blocks = max(1, -(-n_asked // block))
    out = []
    for i in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).toPandas().sort_values(["item", "term"])
        if not len(rows):
            continue
        new = (rows["item"] != rows["item"].shift()).to_numpy()
        ids = rows["item_id"].to_numpy()[new]
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in rows["df"]], np.int64)
        asks = {"first": np.r_[np.flatnonzero(new), len(rows)], "term": rows["term"].to_numpy().astype(np.int64).view(np.uint64), "weight": w * rows["q"].to_numpy()}
        bound = np.ones(len(ids), np.int64)
        bids = best_of(search(shards.where("seed"), asks, n_docs, n_terms, bound, spark, top), top).where(F.col("rank") == top)
        for r in bids.select("item", "score").collect():
            bound[r["item"]] = r["score"]
        found = scratch.keep(best_of(search(shards, asks, n_docs, n_terms, bound, spark, top), top))
        names = spark.createDataFrame([(k, int(x)) for k, x in enumerate(ids)], "item int, item_id long")
        out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, out) if out else empty


def oracle(top: int = TOP) -> str:
    return f"""
with d as materialized (select row_number() over () as r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as ts from documents),
s as materialized (select count(*)::bigint as n, sum(len(ts))::bigint as l from d where len(ts) > 0),
p as materialized (select r, any_value(doc_id) as doc_id, any_value(len(ts))::bigint as long, t, count(*)::bigint as tf from (select r, doc_id, ts, unnest(ts) as t from d) group by r, t),
f as materialized (select t, count(*)::bigint as df from p group by t),
i as materialized (select row_number() over () as b, item_id, list_transform(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as ts from (select distinct item_id, text from benchmark where item_id is not null)),
q as materialized (select b, any_value(item_id) as item_id, t, count(*)::bigint as q from (select b, item_id, unnest(ts) as t from i) group by b, t),
x as (select b, any_value(q.item_id) as item_id, r, any_value(p.doc_id) as doc_id, sum(q.q * floor(1000 * ln((2 * s.n + 2)::double / (2 * f.df + 1)::double))::bigint * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + ((75 * p.long * s.n) // s.l)))))::bigint as score from q join f using (t) join p using (t) cross join s where p.doc_id is not null group by b, r),
y as (select item_id, row_number() over (partition by b order by score desc, doc_id) as rank, doc_id, score from x where score > 0)
select item_id, rank::int as rank, doc_id, score from y where rank <= {top}"""
