"""Substring dedup by compaction of a de Bruijn graph of token k-mers.

Every word covered by a window of ``WINDOW`` words that also starts anywhere else -
in another document or at another place of the same - is removed. Words are runs
of bytes other than space and 0x09-0x0D, compared as they are.

1. *Edges.* A window's k-mer is that of its ``K``-word runs with the smallest
   digest, leftmost first. These k-mers, about two in WINDOW - K + 2 words, are the
   edges of the graph; the words on to the next one of the document, and from the one
   before, are its ways out and in. Equal windows have their k-mer at the same
   place, so a window can only be repeated if its k-mer is.
2. *Compaction.* Edges are counted by k-mer; of a repeated one it is known whether all
   of its places go on with the same words, and whether all come from the same. Joined back to
   their places, successive k-mers compact to one path where the first has one
   way out and the second one way in. All places of such a path hold the same words and
   there are two at least, so every window within it is repeated: none of these is looked at again.
3. *Verification.* Windows of a repeated k-mer that leave their path - near its ends,
   where texts begin to differ - are decided by source coordinates: each is named by two
   digests of its words, and names met once tell the place of a unique window.
   No window within a path is equal to one outside, as a k-mer's path is the same at all of its places.
4. Windows within paths, and those outside that were not found unique, cover the words that are removed.

All counting combines in each task first; places of a k-mer are joined on plain
exchanges, which adaptive execution can split; lists are collected by document only and
are shorter than it. Names have 64 bits twice.

Null and empty texts hold no words; texts under WINDOW words keep all. A row repeated
in full repeats each of its windows; rows without an id are judged like any other.
Texts are judged whole; a text of 50 MB takes a Python worker about half a GB. A run of one
word files every window under its own start, which is linear in the text. ids are whole numbers; an
empty table gives an empty result; extra columns are left out by name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import chunks, hash_ranges, mix, ngrams, words

WINDOW, K = 35, 12
KEY = ["doc", "h"]
BASES = (np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA4C2B2AE35))
#: Words that are named at once, so that a long text takes no more memory.
STRETCH = 1 << 18


def word_names(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digest and document of each word."""
    s, e, doc = words(buf, offs)
    return hash_ranges(buf, s, e), doc


def span_names(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: np.uint64) -> np.ndarray:
    """A digest of the words lo to hi of each span; spans in ascending order of lo, short against STRETCH."""
    out = np.empty(len(lo), np.uint64)
    back = np.uint64(pow(int(base), -1, 1 << 64))
    done = 0
    while done < len(lo):
        begin = int(lo[done])
        upto = max(done + 1, int(np.searchsorted(lo, begin + STRETCH)))
        part = h[begin : int(hi[done:upto].max())]
        power, inverse = (np.cumprod(np.r_[np.uint64(1), np.full(len(part), b)], dtype=np.uint64) for b in (base, back))
        total = np.r_[np.uint64(0), np.cumsum(part * power[:-1], dtype=np.uint64)]
        a, b = lo[done:upto] - begin, hi[done:upto] - begin
        out[done:upto] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * BASES[0])
        done = upto
    return out


def edges_of(h: np.ndarray, doc: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """document, place, first and last start of the windows of each edge; and its k-mer's digest."""
    grams = ngrams(h, np.zeros(len(h), np.int64), k)[0]
    width, n = window - k + 1, len(h) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none, np.empty(0, np.uint64)
    # the smallest of each run of width k-mers: minima from block starts on, and back from block ends
    order = np.empty(len(grams), np.int64)
    order[np.argsort(grams, kind="stable")] = np.arange(len(grams))  # ranks; of equal k-mers the leftmost comes first
    pad = np.full(-(-len(order) // width) * width, len(order), np.int64)
    pad[: len(order)] = order
    ahead = np.minimum.accumulate(pad.reshape(-1, width), axis=1).ravel()
    back = np.minimum.accumulate(pad.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    at_rank = np.empty(len(order), np.int64)
    at_rank[order] = np.arange(len(order))
    at = at_rank[least]
    start = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(start):
        return start, start, start, start, np.empty(0, np.uint64)
    at = at[start]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[start[1:]] != doc[start[:-1]])])
    last = start[np.r_[new[1:], len(start)] - 1]
    return doc[start[new]], at[new], start[new], last, grams[at[new]]


EDGE = "kmer long, way_in long, way_out long, doc long, h long, at int, lo int, hi int"


def edges(docs: DataFrame, window: int, k: int) -> DataFrame:
    """The edges of all documents; places count from the document's first word. A way is 0 at a text's first and last edge."""

    def run(batches):
        for b in batches:
            ids, hs = b.column("doc").to_numpy(), b.column("h").to_numpy()
            for i, _, buf, offs in chunks(b.column("text")):
                h, of = word_names(buf, offs)
                doc, at, lo, hi, kmer = edges_of(h, of, window, k)
                if not len(doc):
                    continue
                way = np.zeros(len(doc) + 1, np.uint64)
                # two places are linked where the second one's windows follow on the first one's
                next_ = np.flatnonzero((doc[1:] == doc[:-1]) & (lo[1:] == hi[:-1] + 1))
                way[next_ + 1] = span_names(h, at[next_], at[next_ + 1] + k, BASES[0]) | np.uint64(1)
                base = np.searchsorted(of, doc)
                cols = [kmer.view(np.int64), way[:-1].view(np.int64), way[1:].view(np.int64), ids[i + doc], hs[i + doc], *[(x - base).astype(np.int32) for x in (at, lo, hi)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kmer", "way_in", "way_out", *KEY, "at", "lo", "hi"])

    return docs.select(*KEY, "text").mapInArrow(run, EDGE)


def repeated(found: DataFrame) -> DataFrame:
    """kmer, one_in, one_out of the k-mers met twice or more: whether all places have the same way in, or out."""
    one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    return found.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), one("way_in").alias("one_in"), one("way_out").alias("one_out")).where("n > 1").drop("n")


def path_ends(row: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, one_in: np.ndarray, one_out: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the path that each edge lies on; edges by row and place."""
    link = (row[1:] == row[:-1]) & (lo[1:] == hi[:-1] + 1) & one_out[:-1] & one_in[1:]
    path = np.cumsum(np.r_[True, ~link]) - 1 if len(row) else np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, ~link]) if len(row) else path
    last = np.r_[first[1:], len(row)] - 1 if len(row) else path
    return at[first][path], at[last][path] + k


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) of all values from lo to hi, both included."""
    n = np.maximum(hi - lo + 1, 0)
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + lo[who]


def listed(b: pa.RecordBatch, i: int, j: int, k: int) -> tuple[np.ndarray, ...]:
    """row (of the chunk), first and last start, path's first word and end of each edge in the lists of rows i to j, by row and place."""
    es = b.column("edges").slice(i, j - i)
    row = np.repeat(np.arange(j - i), es.value_lengths().fill_null(0).to_numpy().astype(np.int64))
    flat = es.flatten()
    at, lo, hi = (flat.field(c).to_numpy().astype(np.int64) for c in ("at", "lo", "hi"))
    one_in, one_out = (flat.field(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("one_in", "one_out"))
    # a row repeated in full has its edges listed as often
    order = np.lexsort((at, row))
    order = order[np.r_[True, (row[order][1:] != row[order][:-1]) | (at[order][1:] != at[order][:-1])]] if len(order) else order
    row, at, lo, hi, one_in, one_out = (x[order] for x in (row, at, lo, hi, one_in, one_out))
    return row, lo, hi, *path_ends(row, at, lo, hi, one_in, one_out, k)


def leaving(docs: DataFrame, window: int, k: int) -> DataFrame:
    """name, name2, doc, h, start of the windows of repeated k-mers that leave their path. docs: KEY, text, edges."""

    def run(batches):
        for b in batches:
            ids, hs = b.column("doc").to_numpy(), b.column("h").to_numpy()
            for i, j, buf, offs in chunks(b.column("text")):
                row, lo, hi, first, end = listed(b, i, j, k)
                who, start = ranges(lo, hi)
                out = (start < first[who]) | (start + window > end[who])
                row, start = row[who[out]], start[out]
                h, of = word_names(buf, offs)
                base = np.searchsorted(of, np.arange(j - i))
                for x in range(0, len(row), STRETCH):
                    r, s = row[x : x + STRETCH], start[x : x + STRETCH]
                    names = [span_names(h, base[r] + s, base[r] + s + window, p).view(np.int64) for p in BASES]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*names, ids[i + r], hs[i + r], s.astype(np.int32))], ["name", "name2", *KEY, "start"])

    return docs.mapInArrow(run, "name long, name2 long, doc long, h long, start int")


SPANS = "array<struct<start:int,end:int>>"


def cut(docs: DataFrame, spark: SparkSession, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, text (bytes), n_words, spans: array of (start, end) of the removed runs, in words; one row per row of docs."""
    if not 1 <= k < window:
        raise ValueError("k-mers shorter than a window")
    scratch = Scratch(spark, "debruijn")
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    keyed = keyed.select("doc_id", "doc", F.xxhash64("text").alias("h"), "text")
    found = edges(keyed, window, k)
    known = scratch.keep(repeated(found.select("kmer", "way_in", "way_out")))
    places = found.select("kmer", *KEY, "at", "lo", "hi").join(known, "kmer")
    lists = scratch.keep(places.groupBy(*KEY).agg(F.collect_list(F.struct("at", "lo", "hi", "one_in", "one_out")).alias("edges")))
    scratch.drop(known)
    names = leaving(keyed.select(*KEY, "text").join(lists, KEY), window, k)
    met = names.groupBy("name", "name2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "start")).alias("m"))
    alone = scratch.keep(met.where("n = 1").select("m.*").groupBy(*KEY).agg(F.collect_list("start").alias("unique")))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            n_words, spans = [], []
            for i, j, buf, offs in chunks(b.column("text")):
                n = np.bincount(words(buf, offs)[2], minlength=j - i)
                row, lo, hi, _, _ = listed(b, i, j, k)
                who, start = ranges(lo, hi)
                base = np.r_[0, np.cumsum(n + 1)]  # a gap between documents, so that no run goes on
                own = b.column("unique").slice(i, j - i)
                once = np.repeat(base[:-1], own.value_lengths().fill_null(0).to_numpy().astype(np.int64)) + own.flatten().to_numpy().astype(np.int64)
                at = np.setdiff1d(base[row[who]] + start, once)
                turn = np.zeros(base[-1] + 1, np.int64)
                np.add.at(turn, at, 1)
                np.add.at(turn, at + window, -1)
                edge = np.flatnonzero(np.diff(np.r_[0, np.cumsum(turn) > 0].astype(np.int8)))
                begin, end = edge[::2], edge[1::2]
                of = np.searchsorted(base, begin, side="right") - 1
                n_words += n.tolist()
                cuts = np.searchsorted(of, np.arange(j - i + 1))
                flat = pa.StructArray.from_arrays([pa.array((begin - base[of]).astype(np.int32)), pa.array((end - base[of]).astype(np.int32))], fields=list(kind.value_type))
                spans.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), flat, type=kind))
            if spans:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(n_words, pa.int64()), pa.concat_arrays(spans)], ["doc_id", "text", "n_words", "spans"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed.join(lists.join(alone, KEY, "left"), KEY, "left").select("doc_id", "text", "edges", "unique")
    return rows.mapInArrow(run, f"doc_id {id_kind}, text binary, n_words long, spans {SPANS}")


def digest(cut_docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 of the result of cut()."""

    def run(batches):
        for b in batches:
            removed, sha = [], []
            for text, spans in zip(b.column("text"), b.column("spans").to_pylist()):
                buf = np.frombuffer(text.as_buffer(), np.uint8)
                s, e, _ = words(buf, np.array([0, len(buf)]))
                keep = np.ones(len(s), bool)
                for x in spans:
                    keep[x["start"] : x["end"]] = False
                removed.append(int((~keep).sum()))
                sha.append(kept_sha(buf, s[keep], e[keep]))
            columns = [b.column("doc_id"), b.column("n_words"), pa.array(removed, pa.int64()), pc.list_value_length(b.column("spans")).cast(pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"])

    kind = cut_docs.schema["doc_id"].dataType.simpleString()
    return cut_docs.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, n_spans long, kept_sha256 string")


def kept_sha(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> str:
    """SHA-256 of the words joined by one space."""
    out = hashlib.sha256()
    for lo in range(0, len(s), STRETCH):
        a, b = s[lo : lo + STRETCH], e[lo : lo + STRETCH]
        size = b - a + 1  # with the space before it
        who = np.repeat(np.arange(len(a)), size)
        at = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
        joined = np.where(at == 0, np.uint8(32), buf[np.maximum(a[who] + at - 1, 0)]).astype(np.uint8)
        out.update(joined[0 if lo else 1 :].tobytes())
    return out.hexdigest()


def oracle(window: int = WINDOW) -> str:
    return f"""
with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
p as materialized (select r, i, md5(array_to_string(ws[i : i + {window - 1}], ' ')) as name from (select r, ws, unnest(range(1, len(ws) - {window} + 2)) as i from d)),
n as materialized (select name from p group by name having count(*) > 1),
g as materialized (select distinct r, unnest(range(i, i + {window})) as j from p join n using (name)),
l as materialized (select r, list(j) as js from g group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(len(js), 0)::bigint as n_removed, (select count(*) from g where g.r = d.r and not exists (select 1 from g b where b.r = g.r and b.j = g.j - 1))::bigint as n_spans,
  sha256(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda j: not list_contains(coalesce(js, []), j)), lambda j: ws[j]), ' ')) as kept_sha256
from d left join l using (r)"""
