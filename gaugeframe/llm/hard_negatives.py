"""Hard-negative mining over a vector-approximation file.

Rows are vectors of whole numbers, floor(SCALE x) of each component; a row's score for
an anchor is their inner product. An anchor's positives are the ``POSITIVES`` other rows of its
label with the highest scores, and its hard negatives for a positive the first ``NEGATIVES`` rows of
other labels whose scores lie within LOW to HIGH hundredths of the positive's. Steps:

1. *Rows.* Of equal vectors of a label only the ``NEGATIVES`` with the smallest ids can be
   in any list, so no more are kept: a vector that a third of all rows share is
   that many rows. Each task cuts its own first. Equal anchors are one query.
2. *Approximation file.* Each dimension is cut into ``CELLS`` cells at quantiles of a sample
   of ``SAMPLE`` rows; its outer cells end at the least and greatest component of all rows. A row
   is one byte for each dimension.
3. *Bounds.* The cells' ends, looked up in the table of each dimension, give a lower and an upper
   bound of a row's score for an anchor. A task goes through its rows with the bounds,
   and scores exactly only rows that may enter a list yet: for positives, an upper bound that reaches the last
   score kept; for negatives, bounds that reach into a positive's window and to the last
   score kept there.
4. The lists of all tasks are cut to the best by anchor, and those of an anchor are
   read off the lists of its vector, the anchor itself left out.

Anchors are searched in blocks of ``BLOCK_BYTES``, each sent to the executors, against all rows;
no link or candidate leaves a task but what is in a list. Lists of a task have a fixed
size for each anchor.

Null labels, vectors that are null or hold null or non-finite components, and rows
without an id take no part; vectors of different lengths have no score with each other, and empty ones none at all. Scores are exact as long as
they fit into 64 bits. Rows that repeat in full count once; rows that share an id are
rows of their own, but none is a positive of an anchor of the same id. Ties go to the smaller id. An empty table
gives an empty result; extra columns are left out by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
LOW, HIGH = 30, 90
CELLS, SAMPLE = 64, 4096
#: Bytes of the anchors that are searched in one pass.
BLOCK_BYTES = 4 << 20
#: Rows and anchors that are bounded at once.
ROWS, ANCHORS = 2048, 512
#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)


def usable(v: Column) -> Column:
    return F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of one length as whole numbers."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), -1)


class Grid:
    """The cells of each dimension: outer[d] to outer[d + 1] of ends, by a row's byte."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, cells: int = CELLS):
        cuts = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="higher").T if len(sample) else np.repeat(most[:, None], cells - 1, axis=1)
        self.cuts = np.sort(cuts.astype(np.int64), axis=1)  # a component from a cut on is in the next cell
        # a cell's least and greatest whole numbers; those of cells that nothing is in don't matter
        self.low = np.concatenate([least[:, None], np.maximum(self.cuts, least[:, None])], axis=1).astype(float)
        self.high = np.concatenate([np.minimum(self.cuts - 1, most[:, None]), most[:, None]], axis=1).astype(float)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, d], side="right") for d, c in enumerate(self.cuts)], axis=1).astype(np.uint8) if x.shape[1] else np.empty((len(x), 0), np.uint8)

    def ends(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.arange(cell.shape[1])
        return self.low[d, cell], self.high[d, cell]


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the score of each row (columns) for each anchor: a component of an anchor meets the lower or the upper end of a cell by its sign."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    lower, upper = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    size = np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T
    slack = np.where(size < EXACT, 0, size * 2.0**-40)  # for sums that doubles don't hold exactly
    return lower - slack, upper + slack


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the same rows of a and b."""
    return np.einsum("ij,ij->i", a, b)


class Lists:
    """For each of n lists its best entries: highest score first, then smallest id."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.list, self.id, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.last = np.full(n, -np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.last[at]
        if not good.any():
            return
        at, ids, score = (np.concatenate(x) for x in ((self.list, at[good]), (self.id, ids[good]), (self.score, score[good])))
        order = np.lexsort((ids, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < self.size
        self.list, self.id, self.score = at[kept], ids[kept], score[kept]
        full = place == self.size - 1
        self.last[at[full]] = score[full]


class Anchors:
    """A block of queries of one length: ids, label codes, vectors, and the scores of the positives of each (windows: query, score)."""

    def __init__(self, ids, label, v, windows=None):
        self.ids, self.label, self.v = np.asarray(ids, np.int64), np.asarray(label), v
        self.real = v.astype(float)
        if windows is not None:
            self.query, self.positive = windows
            self.lo = -((-LOW * self.positive) // 100)
            self.hi = HIGH * self.positive // 100
            self.begin = np.searchsorted(self.query, np.arange(len(self.ids) + 1))


def positives(q: Anchors, ids: np.ndarray, label: np.ndarray, cell: np.ndarray, v: np.ndarray, grid: Grid, lists: Lists) -> int:
    """Takes rows into the lists of the same label; the number of exact scores."""
    done = 0
    for lo in range(0, len(q.ids), ANCHORS):
        part = slice(lo, lo + ANCHORS)
        lower, upper = bounds(q.real[part], *grid.ends(cell))
        same = q.label[part][:, None] == label[None, :]
        floor = lists.last[part]
        if len(ids) > lists.size:  # the lower bounds of this batch alone already rule rows out
            least = np.where(same, lower, -np.inf)
            floor = np.maximum(floor, np.partition(least, len(ids) - lists.size, axis=1)[:, len(ids) - lists.size])
        a, r = np.nonzero(same & (upper >= floor[:, None]))
        done += len(a)
        lists.add(lo + a, ids[r], exact(q.v[lo + a], v[r]))
    return done


def negatives(q: Anchors, ids: np.ndarray, label: np.ndarray, cell: np.ndarray, v: np.ndarray, grid: Grid, lists: Lists) -> int:
    """Takes rows of other labels into the lists of the windows that they score in; the number of exact scores."""
    done = 0
    for lo in range(0, len(q.ids), ANCHORS):
        hi = min(lo + ANCHORS, len(q.ids))
        lower, upper = bounds(q.real[lo:hi], *grid.ends(cell))
        other = q.label[lo:hi][:, None] != label[None, :]
        may = np.zeros_like(other)
        for w in range(q.begin[lo], q.begin[hi]):  # a handful for each query
            at = q.query[w] - lo
            may[at] |= other[at] & (lower[at] <= q.hi[w]) & (upper[at] >= max(q.lo[w], lists.last[w]))
        a, r = np.nonzero(may)
        done += len(a)
        score = exact(q.v[lo + a], v[r])
        first, n = q.begin[lo + a], q.begin[lo + a + 1] - q.begin[lo + a]
        who = np.repeat(np.arange(len(a)), n)
        w = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + first[who]
        inside = (score[who] >= q.lo[w]) & (score[who] <= q.hi[w])
        lists.add(w[inside], ids[r[who[inside]]], score[who[inside]])
    return done


def scan(rows: DataFrame, q: Anchors, grid: Grid, take, n: int, size: int, spark: SparkSession) -> DataFrame:
    """list, id, score: the lists of each task."""
    shared = spark.sparkContext.broadcast((q, grid))

    def run(batches):
        q, grid = shared.value
        lists = Lists(n, size)
        for b in batches:
            for lo in range(0, len(b), ROWS):
                x = b.slice(lo, ROWS)
                cell = np.frombuffer(b"".join(x.column("cell").to_pylist()), np.uint8).reshape(len(x), -1)
                take(q, x.column("vec_id").to_numpy(), x.column("code").to_numpy(), cell, matrix(x.column("v")), grid, lists)
        yield pa.RecordBatch.from_arrays([pa.array(lists.list), pa.array(lists.id), pa.array(lists.score)], ["list", "id", "score"])

    return rows.mapInArrow(run, "list long, id long, score long")


def best_of(found: DataFrame, size: int) -> DataFrame:
    w = Window.partitionBy("list").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= size)


def taking_part(rows: DataFrame, label: Column) -> DataFrame:
    """vec_id, code (a label's digest), v (whole numbers) of the rows that take part, each once."""
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    return good.select("vec_id", F.xxhash64("label").alias("code"), whole.alias("v"))


def shifted(rows: DataFrame) -> Column:
    """The label, of every seventh vec_id the next of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))


def grid_of(rows: DataFrame, dim: int) -> Grid:
    """Cells of the rows of one length; rows: code, v."""

    def ends(batches):
        least = most = None
        for b in batches:
            if len(b):
                x = matrix(b.column("v"))
                least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
                most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(least), pa.array(most)], ["d", "least", "most"])

    end = {r["d"]: (r["least"], r["most"]) for r in rows.select("v").mapInArrow(ends, "d int, least long, most long").groupBy("d").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()}
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    x = np.array([r["v"] for r in sample], np.int64).reshape(len(sample), dim)
    return Grid(x, *(np.array([end[d][i] for d in range(dim)], np.int64) for i in (0, 1)))


def mine(rows: DataFrame, spark: SparkSession, label: Column | None = None, anchor: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. label, anchor: of rows; by default those of the contract."""
    scratch = Scratch(spark, "negatives")
    label = shifted(rows) if label is None else label
    anchor = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    good = taking_part(rows, label)
    asked = taking_part(rows.where(anchor), label).distinct()
    asked = scratch.keep(asked.withColumn("query", F.min("vec_id").over(Window.partitionBy("code", "v"))))
    first = Window.partitionBy("code", "v").orderBy("vec_id")
    points = scratch.keep(good.dropDuplicates(["vec_id", "code", "v"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= max(NEGATIVES, POSITIVES + 1)).drop("n").withColumn("dim", F.size("v")))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    for (dim,) in sorted(asked.select(F.size("v")).distinct().collect()):
        if dim:
            out = out.unionAll(_of_length(asked.where(F.size("v") == dim), points.where(F.col("dim") == dim), dim, spark, scratch))
    return out


def _of_length(asked: DataFrame, points: DataFrame, dim: int, spark: SparkSession, scratch: Scratch) -> DataFrame:
    grid = grid_of(points, dim)
    shared = spark.sparkContext.broadcast(grid)

    def approximate(batches):
        for b in batches:
            cell = shared.value.cell(matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in cell], pa.binary())], [*b.schema.names, "cell"])

    va = scratch.keep(points.select("vec_id", "code", "v").mapInArrow(approximate, "vec_id long, code long, v array<long>, cell binary"))
    queries = asked.where("vec_id = query").select("query", "code", "v").dropDuplicates(["query", "code", "v"])
    queries = scratch.keep(queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(1, -(-queries.count() * dim * 8 // BLOCK_BYTES))))))
    found = None
    for (block,) in sorted(queries.select("block").distinct().collect()):
        rows = queries.where(F.col("block") == block).orderBy("query", "code", "v").collect()
        v = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), dim)
        q = Anchors([r["query"] for r in rows], [r["code"] for r in rows], v)
        # one more than the positives, as the anchor itself may be among them
        near = best_of(scan(va, q, grid, positives, len(rows), POSITIVES + 1, spark), POSITIVES + 1).orderBy("list", "place").collect()
        windows = sorted({(r["list"], r["score"]) for r in near})
        query, score = (np.array([w[i] for w in windows], np.int64) for i in (0, 1))
        q = Anchors(q.ids, q.label, v, (query, score))
        hard = best_of(scan(va, q, grid, negatives, len(windows), NEGATIVES, spark), NEGATIVES).select(F.col("list").cast("int").alias("window"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        number = {w: i for i, w in enumerate(windows)}
        of = [(rows[r["list"]]["query"], rows[r["list"]]["code"], rows[r["list"]]["v"], r["id"], r["score"], r["place"], number[r["list"], r["score"]]) for r in near]
        own = spark.createDataFrame(of, "query long, code long, v array<long>, positive_id long, positive_score long, place int, window int")
        mined = asked.select("vec_id", "query", "code", "v").join(own, ["query", "code", "v"]).where("vec_id <> positive_id")
        w = Window.partitionBy("vec_id", "code", "v").orderBy("place")
        mined = mined.withColumn("n", F.row_number().over(w)).where(F.col("n") <= POSITIVES).join(hard, "window")
        w = Window.partitionBy("vec_id", "code", "v", "n").orderBy(F.desc("negative_score"), "negative_id")
        mined = scratch.keep(mined.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.row_number().over(w).alias("rank"), "negative_id", "positive_score", "negative_score"))
        found = mined if found is None else found.unionAll(mined)
    return found


def oracle() -> str:
    return f"""
with e as materialized (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as materialized (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint as score from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 100 = 0),
p as (select a, b, score from (select *, row_number() over (partition by a order by score desc, b) as n from s where same) where n <= {POSITIVES})
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from (
  select p.a as anchor_id, p.b as positive_id, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as rank, s.b as negative_id, p.score as positive_score, s.score as negative_score
  from p join s on s.a = p.a and not s.same and {LOW} * p.score <= 100 * s.score and 100 * s.score <= {HIGH} * p.score) where rank <= {NEGATIVES}"""
