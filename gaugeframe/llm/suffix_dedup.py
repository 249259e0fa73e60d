"""Suffix-array dedup by bucket-pointer refinement.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere -
in another document or at another place of the same - is removed. Suffixes are
never sorted whole: equality to depth LENGTH is all that counts, so buckets are
refined to that depth and no further, and only where they can still split.

1. *Buckets.* The bucket pointer of a position identifies its q-gram. Pointers follow
   from content, so tasks agree on a bucket's identifier without a global sort.
2. *Suffix sample.* Each string of LENGTH bytes is filed under one of its own
   positions, that of the smallest pointer, leftmost first. Equal strings have it
   at the same place, so comparing strings filed under equal pointers suffices;
   successive strings share positions, about one for 185 bytes of text.
3. *Refinement.* A bucket of depth d is split by the identifiers of the buckets at the
   later offset d; the refined identifiers are those that the next doubling reuses, up to depth ``depth``
   (256), and a span of text is named by these at its offsets. So a bucket's
   members are sorted by the identifiers at later offsets of all the text that
   the strings filed there span. A bucket of one member holds unique strings only; members
   that agree throughout are copies. The rest is split: the strings of a member,
   by their offset from its position, form cells, each a bucket of its own, named by the identifiers
   of the text that all of its strings share. The same step is applied to cells of 48,
   6 and at last 1 string, each round to what the round before could not decide.
   Members that agree throughout go on as a single one, which bears witness for all.
4. Strings found unique are gathered by document; all others repeat, and the
   bytes that they cover are removed.

The same is done, with words for bytes, for *passages*: runs of words each of
which is in a string of ``WORDS.length`` words (A-Z lower-cased, whatever stands between them) that occurs elsewhere. They
are reported and not removed: a passage of over 50 words is shorter than 400 bytes often enough.

All steps aggregate by hash with map-side combining; no bucket is collected,
and a hot bucket is never joined: a group of thousands of equal or nearly equal
documents is a handful of rows after the first aggregation. Strings are told
apart by two names of 64 bits each.

Null texts count as empty. Texts shorter than LENGTH keep all bytes. A row
repeated in full repeats each of its strings; rows without an id are judged like any other. Runs of one byte file every
string under its own start, which is linear in the text. Texts are judged
whole, a long one in overlapping blocks; ids are whole numbers; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release
from .tokens import BYTE, chunks, hash_ranges, words

@dataclass(frozen=True)
class Unit:
    """What strings are made of: their length, that of a q-gram, strings in a cell by round (the last has single ones), bytes of a symbol."""

    length: int
    q: int
    cells: tuple[int, ...]
    size: int

    def symbols(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of texts, and their offsets."""
        if self.size == 1:
            return buf, offs
        s, e, doc = words(buf, offs)
        return hash_ranges(buf, s, e, fold=True), np.searchsorted(doc, np.arange(len(offs)))

    def packed(self, text: pa.Scalar) -> memoryview:
        """The symbols of one text as bytes."""
        if self.size == 1:
            return memoryview(text.as_buffer())
        buf = np.frombuffer(text.as_buffer(), np.uint8)
        return memoryview(self.symbols(buf, np.array([0, len(buf)]))[0].tobytes())

    def names(self, symbols: np.ndarray) -> np.ndarray:
        return BYTE[symbols] if self.size == 1 else symbols

    def unpacked(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.uint8 if self.size == 1 else np.uint64)

    def depth(self) -> int:
        """The deepest identifiers that fit into what the strings of any cell share."""
        least = self.q + self.cells[0]
        if self.length < least:
            raise ValueError(f"strings of at least {least}")
        d = self.q
        while 2 * d <= self.length - self.cells[0] + 1:
            d *= 2
        return d


BYTES, WORDS = Unit(400, 32, (48, 6, 1), 1), Unit(51, 4, (8, 1), 8)
LENGTH = BYTES.length
KEY = ["doc", "h"]
#: Starts of a block of a long text, and bits for a position within a block.
BLOCK, BITS = 1 << 20, np.uint64(22)
#: Bytes of text that a worker hands over at once.
BATCH = 4 << 20


def refined(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Identifiers of the buckets that split those of near by those of far, at a later offset."""
    p = (near * np.uint64(0x9E3779B97F4A7C15)) ^ far
    p ^= p >> np.uint64(29)
    p *= np.uint64(0xBF58476D1CE4E5B9)
    p ^= p >> np.uint64(32)
    return p


def pointers(symbols: np.ndarray, unit: Unit) -> np.ndarray:
    """Bucket pointers of depth q at each position with q symbols left."""
    p, d = unit.names(symbols), 1
    while d < unit.q:
        p = refined(p[:-d], p[d:])
        d *= 2
    return p


def name_spans(ptr: np.ndarray, start: np.ndarray, end: np.ndarray, unit: Unit, seed: np.ndarray, salt: int) -> np.ndarray:
    """Names of the spans from start to end, of as many symbols as the deepest identifiers at least, by these at their offsets."""
    deep = unit.depth()
    out = refined(seed.astype(np.uint64) + np.uint64(salt), (end - start).astype(np.uint64))
    for k in range(-(-int((end - start).max(initial=0)) // deep)):
        at = np.minimum(start + k * deep, end - deep)
        ids = ptr[at[:, None] + np.arange(0, deep, unit.q)]
        while ids.shape[1] > 1:
            ids = refined(ids[:, ::2], ids[:, 1::2])
        out = refined(out, ids[:, 0])
    return out


def filed(symbols: np.ndarray, offs: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """document, position, first and last start of the strings of each member; and all pointers."""
    empty, length = np.empty(0, np.int64), unit.length
    if len(symbols) < length:
        return empty, empty, empty, empty, np.empty(0, np.uint64)
    ptr = pointers(symbols, unit)
    ranked = (ptr >> BITS << BITS) | np.arange(len(ptr), dtype=np.uint64)
    w = length - unit.q + 1
    size = -(-len(ptr) // w) * w
    pad = np.full(size, np.iinfo(np.uint64).max)
    pad[: len(ptr)] = ranked
    grid = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(ptr) - w + 1
    least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
    at = (least & ((np.uint64(1) << BITS) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    valid = np.arange(n) + length <= offs[doc + 1]
    start = np.flatnonzero(valid)
    if not len(start):
        return empty, empty, empty, empty, ptr
    at, doc = at[start], doc[start]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    return doc[new], at[new], start[new], start[np.r_[new[1:], len(start)] - 1], ptr


def blocks(symbols: np.ndarray, offs: np.ndarray, unit: Unit, block: int):
    """(block, first symbol, symbols, offsets) of the texts; a long one in blocks of starts, with what their strings need."""
    if len(offs) > 2 or len(symbols) <= block:
        yield 0, 0, symbols, offs
        return
    for part, lo in enumerate(range(0, len(symbols) - unit.length + 1, block)):
        own = symbols[lo : lo + block + unit.length - 1]
        yield part, lo, own, np.array([0, len(own)])


MEMBER = ["part", "at", "lo", "hi"]


def members(docs: DataFrame, unit: Unit, block: int) -> DataFrame:
    """bucket, rest (the identifiers at later offsets), doc, h, part (of a long text), at, lo, hi of each member; places count from the document's start."""

    def run(batches):
        for b in batches:
            ids, hs = b.column("doc").to_numpy(), b.column("h").to_numpy()
            for i, _, buf, offs in chunks(b.column("text")):
                for part, before, symbols, offs in blocks(*unit.symbols(buf, offs), unit, block):
                    doc, at, lo, hi, ptr = filed(symbols, offs, unit)
                    if not len(doc):
                        continue
                    rest = name_spans(ptr, lo, hi + unit.length, unit, (at - lo) * 1024 + (hi - lo), 1)
                    base = offs[doc] - before
                    cols = [ptr[at].view(np.int64), rest.view(np.int64), ids[i + doc], hs[i + doc], np.full(len(doc), part, np.int32), *[(x - base).astype(np.int32) for x in (at, lo, hi)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["bucket", "rest", *KEY, *MEMBER])

    return docs.select(*KEY, "text").mapInArrow(run, "bucket long, rest long, doc long, h long, part int, at int, lo int, hi int")


def refine(rows: DataFrame, scratch: Scratch, single: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """One refinement: (unique: doc, h, lo, hi; open: a member with weight).

    rows: bucket, rest, weight and a member. Members that agree in rest are one,
    with a weight of 2 at most; of a bucket with one such member, weight 1 tells that its strings are unique.
    single: a member is one string, so that bucket and rest decide together and nothing is left open.
    """
    me = F.struct(*KEY, *MEMBER)
    one = rows.groupBy("bucket", "rest").agg(F.least(F.sum("weight"), F.lit(2)).cast("int").alias("weight"), F.min(me).alias("m"))
    if single:
        return scratch.keep(one.where("weight = 1").select("m.doc", "m.h", "m.lo", "m.hi")), None
    one = scratch.keep(one)
    total = scratch.keep(one.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.sum("weight").alias("weight"), F.min("m").alias("m")))
    unique = total.where("weight = 1").select("m.doc", "m.h", "m.lo", "m.hi")
    split = total.where("kinds > 1").select("bucket")
    open_ = one.join(split, "bucket", "left_semi").select("m.*", "weight")
    return unique, open_


def with_context(open_: DataFrame, docs: DataFrame, unit: Unit) -> DataFrame:
    """A member, weight and text: the symbols from lo to hi + length, packed."""
    lists = open_.groupBy(*KEY).agg(F.collect_list(F.struct(*MEMBER, "weight")).alias("ms"))
    names = [*KEY, *MEMBER, "weight"]

    def run(batches):
        held, texts, size = [], [], 0
        for b in batches:
            for d, h, ms, text in zip(b.column("doc").to_pylist(), b.column("h").to_pylist(), b.column("ms"), b.column("text")):
                raw, ms = unit.packed(text), ms.values
                cols = [ms.field(c).to_numpy() for c in (*MEMBER, "weight")]
                for lo in range(0, len(ms), 2048):
                    part = [c[lo : lo + 2048] for c in cols]
                    held.append((np.full(len(part[0]), d), np.full(len(part[0]), h), *part))
                    own = [bytes(raw[x * unit.size : (y + unit.length) * unit.size]) for x, y in zip(part[2].tolist(), part[3].tolist())]
                    texts += own
                    size += sum(map(len, own))
                    if size > BATCH:
                        yield of(held, texts)
                        held, texts, size = [], [], 0
        if held:
            yield of(held, texts)

    def of(held, texts):
        return pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(c)) for c in zip(*held)], pa.array(texts, pa.binary())], [*names, "text"])

    # a row repeated in full is met twice and weighs more; its strings repeat anyway
    return docs.join(lists, KEY).select(*KEY, "ms", "text").mapInArrow(run, "doc long, h long, part int, at int, lo int, hi int, weight int, text binary")


def cells(rows: DataFrame, width: int, unit: Unit) -> DataFrame:
    """The cells of each member as members: bucket names what a cell's strings share, rest all that they span.

    rows: a member, weight, from (first symbol of text), text.
    """

    def run(batches):
        for whole in batches:
            size = np.r_[0, np.cumsum([len(x.as_buffer()) for x in whole.column("text")])]
            i = 0
            while i < len(whole):
                j = max(i + 1, int(np.searchsorted(size, size[i] + BATCH // 4, side="right")) - 1)
                yield split(whole.slice(i, j - i))
                i = j

    def split(b):
        raw = [x.as_buffer().to_pybytes() for x in b.column("text")]
        ptr = pointers(unit.unpacked(b"".join(raw)), unit)
        start = np.cumsum([0, *[len(x) // unit.size for x in raw]])[:-1]
        at, lo, hi, zero = (b.column(c).to_numpy().astype(np.int64) for c in ("at", "lo", "hi", "from"))
        first, last = (at - hi) // width, (at - lo) // width
        who = np.repeat(np.arange(len(b)), last - first + 1)
        x = np.arange(len(who)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[who]
        near, far = x * width, x * width + width - 1
        s, e = np.maximum(lo[who], at[who] - far), np.minimum(hi[who], at[who] - near)
        base = start[who] - zero[who]
        bucket = name_spans(ptr, base + at[who] - near, base + at[who] - far + unit.length, unit, x, 2)
        rest = name_spans(ptr, base + s, base + e + unit.length, unit, (at[who] - s) * 512 + at[who] - e, 3)
        take = pa.array(who)
        columns = [pa.array(bucket.view(np.int64)), pa.array(rest.view(np.int64)), *[b.column(c).take(take) for c in (*KEY, "part", "at", "weight")], pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "rest", *KEY, "part", "at", "weight", "lo", "hi"])

    return rows.select(*KEY, *MEMBER, "weight", "from", "text").mapInArrow(run, "bucket long, rest long, doc long, h long, part int, at int, weight int, lo int, hi int")


def unique_strings(docs: DataFrame, spark: SparkSession, unit: Unit = BYTES, block: int = BLOCK) -> DataFrame:
    """doc, h, lo, hi: ranges of starts whose strings occur nowhere else."""
    unit.depth()
    scratch = Scratch(spark, "suffixes")
    unique, open_ = refine(members(docs, unit, block).withColumn("weight", F.lit(1)), scratch)
    release(spark)
    context = scratch.keep(with_context(open_, docs, unit))
    release(spark)
    found = [unique]
    rows = context.withColumn("from", F.col("lo"))
    texts = context.select(*KEY, "part", "at", F.col("lo").alias("from"), F.col("text"))
    for width in unit.cells:
        unique, open_ = refine(cells(rows, width, unit), scratch, single=width == 1)
        found.append(unique)
        release(spark)
        if open_ is not None:
            rows = scratch.keep(open_).join(texts, [*KEY, "part", "at"])
    # by document already, so that the other tables can go
    out = scratch.keep(reduce(DataFrame.unionAll, found).groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("rs")))
    scratch.drop_but(out)
    release(spark)
    return out


def runs_of(n: int, length: int, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the bytes that strings cover whose starts are in none of the ranges lo to hi, in a text of n bytes."""
    starts = n - length + 1
    if starts <= 0:
        return []
    order = np.argsort(lo, kind="stable")
    reach = np.maximum.accumulate(np.r_[-1, hi[order]])
    a, b = reach + 1, np.r_[lo[order], starts] - 1
    a, b = a[a <= b], b[a <= b] + length
    new = np.r_[True, a[1:] > b[:-1]] if len(a) else np.empty(0, bool)
    return list(zip(a[new].tolist(), b[np.r_[new[1:], True]].tolist() if len(a) else []))


SPANS = "array<struct<start:int,end:int>>"


def cut(docs: DataFrame, spark: SparkSession, length: int = LENGTH, block: int = BLOCK, passage: int = WORDS.length) -> DataFrame:
    """doc_id, text (bytes), spans: array of (start, end) of the removed runs, passages: the same of repeated words, in words; one row per row of docs."""
    keyed = docs.select("doc_id", F.col("doc_id").cast("long").alias("_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    keyed = keyed.select("doc_id", F.coalesce("_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("h"), "text")
    units = {"spans": replace(BYTES, length=length), "passages": replace(WORDS, length=passage)}
    ranges = [unique_strings(keyed, spark, u, block).select(*KEY, F.lit(name).alias("name"), "rs") for name, u in units.items()]
    ranges = reduce(DataFrame.unionAll, ranges).groupBy(*KEY).agg(*[F.first(F.when(F.col("name") == name, F.col("rs")), ignorenulls=True).alias(name) for name in units])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        none = np.empty(0, np.int64)
        for b in batches:
            size = {"spans": [len(x.as_buffer()) for x in b.column("text")], "passages": []}
            for _, _, buf, offs in chunks(b.column("text")):
                size["passages"] += np.diff(WORDS.symbols(buf, offs)[1]).tolist()
            found = []
            for name, u in units.items():
                runs = []
                for rs, n in zip(b.column(name), size[name]):
                    lo, hi = (rs.values.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi")) if rs.is_valid else (none, none)
                    runs.append([{"start": s, "end": e} for s, e in runs_of(n, u.length, lo, hi)])
                found.append(pa.array(runs, kind))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), *found], ["doc_id", "text", *units])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.join(ranges, KEY, "left").select("doc_id", "text", *units).mapInArrow(run, f"doc_id {id_kind}, text binary, spans {SPANS}, passages {SPANS}")


def digest(cut_docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages and n_passage_words of the result of cut()."""
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words"]

    def run(batches):
        long = lambda spans: sum(s["end"] - s["start"] for s in spans)
        for b in batches:
            out: list[tuple] = []
            for text, spans, passages in zip(b.column("text"), b.column("spans").to_pylist(), b.column("passages").to_pylist()):
                raw = memoryview(text.as_buffer())
                h, at = hashlib.sha256(), 0
                for s in spans:
                    h.update(raw[at : s["start"]])
                    at = s["end"]
                h.update(raw[at:])
                out.append((len(raw), long(spans), len(spans), h.hexdigest(), len(passages), long(passages)))
            columns = [pa.array([o[i] for o in out], pa.string() if n == "kept_sha256" else pa.int64()) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *names])

    kind = cut_docs.schema["doc_id"].dataType.simpleString()
    return cut_docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {'string' if n == 'kept_sha256' else 'long'}" for n in names))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Removed runs of each text, by counting every string; for small fixtures."""
    from collections import Counter

    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        turn = np.flatnonzero(np.diff(np.r_[0, gone[: len(t)].view(np.int8), 0]))
        out.append(list(zip(turn[::2].tolist(), turn[1::2].tolist())))
    return out
