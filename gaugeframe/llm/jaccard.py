"""N-gram Jaccard join by rare-first prefix filtering, and the components of its links.

Two texts link when their sets of distinct k-word shingles overlap by ``num`` /
``den`` of their union or more. Steps:

1. *Order.* A count sketch of fixed size over all documents estimates how often
   each shingle occurs; (estimate, hash) is one total order for all, rare first.
   Any total order keeps the prefix filter exact, so the sketch costs no link.
2. *Classes.* Texts with equal sets are one class, named by the digest of the set.
3. *Prefix join.* A class shows its n - ceil(t n) + 1 rarest shingles, once per
   task. Rows are dealt out by (shingle, salt) - shingles that the sketch calls
   frequent are salted - and streamed in order of size: each meets the first of
   its run, the run's leader, and the leaders of a salted shingle meet in a second
   round. A shingle of a single class is dropped here.
4. *Filters.* Length: sizes within the threshold. Prefix: the shared shingle lies
   within the prefixes that the two sizes ask for. Positional: the places of the
   shared shingle leave room for the overlap. Suffix: hash partitions of the two
   sets whose sizes differ in parity are a lower bound of the sets' difference.
5. *Verify once.* Each surviving pair is verified on its whole texts.
6. *The rest.* Components of the verified leader pairs are formed. ``ROUNDS``
   further rounds pair each class with a possible partner in another component
   near it in a random order of each run. At last all pairs of classes that share a prefix
   shingle and are in different components yet go through the same filters, in
   tiles of bounded size that emit only what passes, and are verified. A pair
   within a component cannot change the result, so a group of thousands of near
   copies costs a few rows per copy instead of all pairs, and no link between
   components is lost.

Ids are whole numbers. Rows without an id are counted and link with nothing.
Null texts and texts without words have an empty set and link with nothing;
shorter texts than k words have their whole sequence as one shingle; repeated
rows are one class; texts are read whole; an empty table gives an empty result;
extra columns are left out by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release, shielded
from .components import components, extended
from .labelled import emit_array, salts_of, sum_arrays
from .tokens import chunks, shingle_sets

K, NUM, DEN = 5, 75, 100
SKETCH_BITS, SKETCH_BLOCKS = 23, 64
#: Steps of the sketch's logarithmic scale for each doubling; counts to 2^40 fit into a byte.
STEPS = 6
#: A salted shingle has about so many rows per salt.
SALT_ROWS = 20_000
#: The suffix filter's partitions: two to four for each shingle, within these bounds (powers of two).
LEAST_PARTS, MOST_PARTS = 256, 1 << 16
ROUNDS, REACH, TILE = 2, 32, 1024


def sketch(docs: DataFrame, spark: SparkSession, k: int = K) -> np.ndarray:
    """Number of documents by hashed shingle on a logarithmic scale; 2^SKETCH_BITS bytes whatever the input."""

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            for _, _, buf, offs in chunks(b.column("text")):
                grams, _ = shingle_sets(buf, offs, k)
                np.add.at(total, cell(grams), np.uint32(1))
        yield emit_array(total, SKETCH_BLOCKS, TaskContext.get().partitionId() % salts)

    salts = salts_of(spark, SKETCH_BLOCKS)
    out = sum_arrays(docs.select("text").mapInArrow(run, "block int, salt int, blob binary"), spark, SKETCH_BLOCKS)
    return np.zeros(1 << SKETCH_BITS, np.uint8) if out is None else np.minimum(np.rint(STEPS * np.log2(1 + out)), 255).astype(np.uint8)


def cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def signature(grams: np.ndarray) -> bytes:
    """Parities of the sizes of hash partitions, as bits; the first 32 bytes' worth is folded from any size."""
    parts = min(MOST_PARTS, max(LEAST_PARTS, 1 << (2 * len(grams) - 1).bit_length())) if len(grams) else LEAST_PARTS
    return np.packbits(np.bincount((grams & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1).tobytes()


def folded(sig: bytes, size: int) -> np.ndarray:
    """The signature of the same set with fewer partitions, of size bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(sig, np.uint8).reshape(-1, size), axis=0)


def prefix_table(docs: DataFrame, counts: np.ndarray, spark: SparkSession, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, cls, of every row, and at a class's first row within the task its sig, that folded to the least size, and its prefix: token, place (n, then the place in the prefix, in 32 bits each) and salt (twice the salt, and 1 if there are several)."""
    shared = spark.sparkContext.broadcast(counts)  # 2^SKETCH_BITS bytes

    def run(batches):
        est = shared.value
        seen: set[int] = set()  # at most the task's documents
        for b in batches:
            size, cls, sig, mini = [], [], [], []
            token, place, salts = [], [], []
            named = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for first, _, buf, offs in chunks(b.column("text")):
                grams, n = shingle_sets(buf, offs, k)
                at = np.r_[0, np.cumsum(n)]
                df = est[cell(grams)]
                for d in range(len(n)):
                    lo, m = at[d], int(n[d])
                    own = grams[lo : lo + m]
                    key = class_of(own)
                    size.append(m)
                    cls.append(key)
                    show = m - -(-num * m // den) + 1 if m and named[first + d] and key not in seen else 0
                    sig.append(signature(own) if show else None)
                    mini.append(folded(sig[-1], LEAST_PARTS // 8).tobytes() if show else None)
                    if show:
                        seen.add(key)
                    rare = lo + np.argsort(df[lo : lo + m], kind="stable")[:show] if show else np.empty(0, np.int64)  # grams are sorted, so ties go by hash
                    many = np.maximum(1, 2.0 ** (df[rare] / STEPS) / SALT_ROWS).astype(np.int64)
                    token.append(grams[rare].view(np.int64))
                    place.append((m << 32) + np.arange(len(rare)))
                    salts.append(key % many * 2 + (many > 1))
            cuts = pa.array(np.r_[0, np.cumsum([len(t) for t in token])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x).astype(kind) if x else np.empty(0, kind))) for x, kind in ((token, np.int64), (place, np.int64), (salts, np.int32))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int32()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary()), pa.array(mini, pa.binary()), *lists], ["doc_id", "n", "cls", "sig", "mini", "token", "place", "salt"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, cls long, sig binary, mini binary, token array<long>, place array<long>, salt array<int>")


def class_of(grams: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(grams.tobytes()), "little", signed=True)


def runs(rows: DataFrame) -> DataFrame:
    """Streams sorted rows (token, salt, place, id): adds the first row of the run; single rows of unsalted runs vanish.

    Only the run's first row and the batch at hand are in memory. A run that
    ends a batch is held back by one row, until its next row shows whether it is single.
    """
    def columns_of(t):
        col = {c: t.column(c).to_numpy() for c in ("token", "salt", "place", "id")}
        return col | {"salted": col["salt"] % 2 == 1, "n": (col["place"] >> 32).astype(np.int32), "pos": (col["place"] & 0xFFFFFFFF).astype(np.int32)}

    def run(batches):
        held, lead = None, None  # the last row, if nothing tells yet whether it is alone; the leader of the open run
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            col = columns_of(t)
            m = t.num_rows
            again = np.zeros(m, bool)  # a class that several tasks show
            again[1:] = (col["token"][1:] == col["token"][:-1]) & (col["id"][1:] == col["id"][:-1])
            if again.any():
                t = t.filter(pa.array(~again))
                col = {c: v[~again] for c, v in col.items()}
                m = len(col["id"])
            new = np.ones(m, bool)
            new[1:] = (col["token"][1:] != col["token"][:-1]) | (col["salt"][1:] != col["salt"][:-1])
            cont = held is None and lead is not None and lead[0] == col["token"][0] and lead[1] == col["salt"][0]
            if cont:
                new[0] = False
            start = np.maximum.accumulate(np.where(new, np.arange(m), -1))
            single = new.copy()
            single[:-1] &= new[1:]
            out = {c: col[c][np.maximum(start, 0)] for c in ("n", "id", "pos")}
            if cont:
                early = start < 0
                for c, v in zip(("n", "id", "pos"), lead[2:]):
                    out[c][early] = v
            keep = ~single | col["salted"]
            held = None
            if single[-1]:  # its run may go on in the next batch
                held = t.slice(m - 1)
                keep[-1] = False
                lead = None
            else:
                lead = (col["token"][-1], col["salt"][-1], out["n"][-1], out["id"][-1], out["pos"][-1])
            yield result(col, out, keep)
        if held is not None and held.column("salt")[0].as_py() % 2:
            col = columns_of(held)
            yield result(col, col, np.ones(1, bool))

    def result(col, lead, keep):
        arrays = [pa.array(col[c][keep]) for c in ("token", "salted", "n", "id", "pos")] + [pa.array(lead[c][keep]) for c in ("id", "n", "pos")]
        return pa.RecordBatch.from_arrays(arrays, ["token", "salted", "n", "id", "pos", "lead", "lead_n", "lead_pos"])

    return rows.mapInArrow(run, "token long, salted boolean, n int, id long, pos int, lead long, lead_n int, lead_pos int")


def need(a: Column, b: Column, num: int, den: int) -> Column:
    """Least overlap of linked sets of these sizes."""
    return F.ceil((a + b) * num / (num + den))


def plausible(na: Column, pa_: Column, nb: Column, pb: Column, num: int, den: int) -> Column:
    """Length, prefix and positional filters of a shared shingle at places pa_ and pb (from 0).

    Linked sets share a shingle within the prefixes that their own overlap asks
    for, which are shorter than those for partners of any size.
    """
    fits = F.least(na, nb) * den >= F.greatest(na, nb) * num
    least = need(na, nb, num, den)
    return fits & (pa_ <= na - least) & (pb <= nb - least) & (F.least(na - pa_, nb - pb) + F.least(pa_, pb) >= least)


def suffix_filter(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Keeps (a, b) of (a, na, sig_a, b, nb, sig_b) whose signatures allow the overlap."""

    def run(batches):
        for b in batches:
            keep = np.zeros(len(b), bool)
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            for i, (x, y) in enumerate(zip(b.column("sig_a").to_pylist(), b.column("sig_b").to_pylist())):
                size, total = min(len(x), len(y)), int(na[i]) + int(nb[i])
                differ = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
                keep[i] = differ <= total - 2 * -(-total * num // (num + den))
            yield pa.RecordBatch.from_arrays([pc.filter(b.column(c), pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return pairs.select("a", "na", "sig_a", "b", "nb", "sig_b").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole texts. texts: cls, text of one row per class.

    Both joins read one exchange of the texts; a class with thousands of
    partners is split by adaptive execution.
    """
    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 64):  # so many pairs' sets are held at once
                batch = whole.slice(at, 64)
                keep = np.zeros(len(batch), bool)
                sets: dict[str, list] = {"ta": [], "tb": []}
                for name, found in sets.items():
                    for _, _, buf, offs in chunks(batch.column(name)):
                        grams, n = shingle_sets(buf, offs, k)
                        found += np.split(grams, np.cumsum(n)[:-1])
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                for i, (x, y) in enumerate(zip(sets["ta"], sets["tb"])):
                    # ids that repeat with other texts bring other sets along
                    if class_of(x) == a[i] and class_of(y) == b[i]:
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep[i] = both > 0 and den * both >= num * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([pc.filter(batch.column(c), pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return both.select("a", "ta", "b", "tb").mapInArrow(run, "a long, b long")


ROW = ["token", "id", "n", "pos", "component", "mini"]


def columns(t) -> dict[str, np.ndarray]:
    out = {c: t.column(c).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(c).to_numpy() for c in ROW[:-1]}
    raw = t.column("mini")
    raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
    out["mini"] = np.frombuffer(b"".join(raw.to_pylist()), np.uint64).reshape(-1, LEAST_PARTS // 64)
    return out


def possible(c: dict, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """All filters on the pairs of rows i and j, the suffix filter by the folded signature."""
    ni, nj = c["n"][i].astype(np.int64), c["n"][j].astype(np.int64)
    pi, pj = c["pos"][i], c["pos"][j]
    least = -(-(ni + nj) * num // (num + den))
    ok = (c["component"][i] != c["component"][j]) & (np.minimum(ni, nj) * den >= np.maximum(ni, nj) * num)
    ok &= (pi <= ni - least) & (pj <= nj - least) & (np.minimum(ni - pi, nj - pj) + np.minimum(pi, pj) >= least)
    at = np.flatnonzero(ok)
    ok[at] = np.bitwise_count(c["mini"][i[at]] ^ c["mini"][j[at]]).sum(axis=1) <= (ni + nj - 2 * least)[at]
    return ok


def pair_batch(c: dict, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    a, b = np.minimum(c["id"][i], c["id"][j]), np.maximum(c["id"][i], c["id"][j])
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        a, b = a[new], b[new]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def neighbours(rows: DataFrame, seed: int, num: int, den: int) -> DataFrame:
    """For each row the first possible pair with one of the REACH rows before it in a random order of its run."""

    def run(batches):
        for b in batches:
            if len(b) < 2:
                continue
            c = columns(b)
            first = np.maximum.accumulate(np.where(np.r_[True, c["token"][1:] != c["token"][:-1]], np.arange(len(b)), 0))
            left = np.arange(len(b))
            found_i, found_j = [], []
            for back in range(1, REACH + 1):
                left = left[left - back >= first[left]]
                ok = possible(c, left, left - back, num, den)
                found_i.append(left[ok])
                found_j.append(left[ok] - back)
                left = left[~ok]
            yield pair_batch(c, np.concatenate(found_i), np.concatenate(found_j))

    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("salts"))).repartition("token", "salt").sortWithinPartitions("token", "salt", F.xxhash64("id", F.lit(seed)))
    return dealt.select(*ROW).mapInArrow(run, "a long, b long")


def tiles(rows: DataFrame, num: int, den: int) -> DataFrame:
    """All possible pairs of rows of one token in different components, from tiles of about TILE by TILE rows."""
    cut = rows.withColumn("cut", F.pmod(F.xxhash64("id", F.lit(0)), F.col("salts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other")
    dealt = cut.select(*ROW, "cut", other).select(*ROW, F.least("cut", "other").alias("x"), F.greatest("cut", "other").alias("y"), (F.col("cut") <= F.col("other")).alias("left"), (F.col("cut") >= F.col("other")).alias("right"))
    dealt = dealt.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "id")

    def pairs_of(t: pa.Table) -> pa.RecordBatch:
        c = columns(t)
        left, right, x, y = (t.column(v).to_numpy() for v in ("left", "right", "x", "y"))
        edge = np.flatnonzero(np.r_[True, (c["token"][1:] != c["token"][:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        end = np.repeat(np.r_[edge[1:], t.num_rows], np.diff(np.r_[edge, t.num_rows]))
        found_i, found_j = [], []
        # rows of short runs against all later rows of their runs, many runs at once
        at = np.arange(t.num_rows)
        after = end - at - 1
        bounds = np.r_[0, np.cumsum(after)]
        lo = 0
        while lo < t.num_rows:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 200_000, side="right")) - 1)
            reps = after[lo:hi]
            i = np.repeat(at[lo:hi], reps)
            j = i + 1 + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            role = (left[i] & right[j]) | (right[i] & left[j])
            i, j = i[role], j[role]
            ok = possible(c, i, j, num, den)
            found_i.append(i[ok])
            found_j.append(j[ok])
            lo = hi
        return pair_batch(c, np.concatenate(found_i), np.concatenate(found_j))

    def run(batches):
        held = None
        for b in batches:
            t = (pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])).combine_chunks()
            if not t.num_rows:
                continue
            token, x, y = (t.column(v).to_numpy() for v in ("token", "x", "y"))
            edge = np.flatnonzero((token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            last = int(edge[-1]) + 1 if len(edge) else 0
            if last:
                yield pairs_of(t.slice(0, last))
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield pairs_of(held)

    return dealt.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, spark: SparkSession, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id of an equal set), component_id; one row per row of docs."""
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    full = scratch.keep(prefix_table(docs, sketch(docs, spark, k), spark, k, num, den))
    base = scratch.keep(full.select("doc_id", "n", "cls"))
    # a class without a signature of its own rows is not possible: its first row in each task has one
    sets = scratch.keep(full.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.max("sig").alias("sig"), F.max("mini").alias("mini")))
    prefix = full.where(F.size("token") > 0).select(F.col("cls").alias("id"), F.explode(F.arrays_zip("token", "salt", "place")).alias("z")).select("z.token", "z.salt", "z.place", "id")
    posting = scratch.keep(runs(prefix.repartition("token", "salt").sortWithinPartitions("token", "salt", "place", "id")))
    scratch.drop(full)
    release(spark)

    texts = docs.join(sets.select("doc_id", "cls"), "doc_id").select("cls", "text")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        p = pairs.join(sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sig_a")), "a").join(sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sig_b")), "b")
        left = scratch.keep(suffix_filter(p, num, den))
        release(spark)
        out = scratch.keep(verify(left, texts, k, num, den))
        scratch.drop(left)
        release(spark)
        return out

    fits = plausible(F.col("n"), F.col("pos"), F.col("lead_n"), F.col("lead_pos"), num, den)
    place = F.shiftleft(F.col("lead_n").cast("long"), 32) + F.col("lead_pos")
    leads = posting.where("salted").select("token", F.lit(0).alias("salt"), place.alias("place"), F.col("lead").alias("id")).distinct()
    second = runs(leads.repartition("token").sortWithinPartitions("token", "place", "id"))
    star = posting.unionByName(second).where(fits).select(F.col("lead").alias("a"), F.col("id").alias("b"))
    groups = scratch.keep(components(linked(star), scratch))

    rows = posting.select("token", "id", "n", "pos").join(sets.select(F.col("cls").alias("id"), "mini"), "id")
    for step in range(ROUNDS + 1):
        rows = rows.join(groups.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left").withColumn("component", F.coalesce("c", "id")).drop("c")
        rows = scratch.keep(rows)
        # tokens whose classes are in one component have done their part
        mixed = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("salts")).where("lo <> hi").select("token", "salts")
        # a table of its own, so that the join is of two plain exchanges and a token of very many rows can be split
        mixed = scratch.keep(mixed)
        open_ = scratch.keep(rows.join(mixed, "token"))
        scratch.drop(rows, mixed)
        if open_.isEmpty():
            break
        found = linked(neighbours(open_, step, num, den) if step < ROUNDS else tiles(open_, num, den))
        if not found.isEmpty():
            groups = scratch.keep(extended(groups, found, scratch))
        rows = open_.drop("component", "salts")

    member = sets.select("cls", F.col("doc_id").alias("class_id")).join(groups.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    member = scratch.keep(member)
    least = member.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = member.join(least, "component").select("cls", "class_id", "component_id")
    out = base.join(named, "cls", "left")
    linked_ = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(linked_, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(linked_, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """docs, all columns, with one document of each group: the one of the smallest id.

    Rows without an id link with nothing and stay; of rows repeated with id and text one stays.
    """
    docs, back = shielded(docs, "doc_id", "text")
    kept = classes(docs, spark).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return back(named.select(*docs.columns).unionAll(docs.where("doc_id is null")))


def oracle(k: int = K, num: int = NUM, den: int = DEN) -> str:
    """The contract's columns as DuckDB SQL."""
    return f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select doc_id, case when len(w) = 0 then [] when len(w) < {k} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) end as g from w),
n as (select doc_id, len(g) as n from g),
t as materialized (select doc_id, unnest(g) as t from g),
o as materialized (select a.doc_id as a, b.doc_id as b, count(*) as c from t a join t b on a.t = b.t and a.doc_id < b.doc_id group by all),
l as materialized (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where {den} * c >= {num} * (x.n + y.n - c)),
e as materialized (select a, b from l union select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select doc_id, n::bigint as n_shingles, coalesce(least(doc_id, (select min(b) from r where r.a = n.doc_id)), doc_id)::bigint as component_id from n"""
