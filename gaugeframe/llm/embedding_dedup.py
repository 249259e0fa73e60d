"""Embedding near-dedup as an exact metric range join.

Vectors of one label link when their cosine is at least ``COSINE``, which on
unit vectors is a distance of at most r = sqrt(2 - 2 COSINE). Steps:

1. Equal vectors of a label become one point with a count. The points of one
   label and length are a space.
2. *Pivots.* A space of many points has pivots of its own, the first by hash, at most
   ``PIVOTS`` for all spaces together; a point's cell is that of its nearest pivot. A space of few points is one cell.
3. *Boundary replication.* Of any two cells one, by their numbers, has the other's points as guests.
   A point is a guest of such a cell only if a partner
   may be there: by the triangle inequality, when d(x, p_j) - d(x, p_i) <= 2 r and
   d(x, p_j) <= R_j + r for the cell's radius R_j; and when its distance to the
   hyperplane between the two pivots is at most r. Each of the three is
   necessary, so no link is lost.
4. Cells join independently. A cell's members are dealt to chunks, its guests to larger ones; a
   task holds one tile, which is two chunks or one with itself, multiplies it in single precision, decides in
   double what rounding could have changed, and emits the
   number of links of each of its points and a spanning forest of the links, not
   the links themselves.
5. Components of the forests name the classes.

Any two points meet in one tile at most, so no link counts twice. Copies of points are made
in batches of bounded size and go straight to their tiles; chunks are bounded in rows and numbers. Null labels, and vectors that are null, zero or hold null or
non-finite components, link with nothing and are kept; so do rows without an id. Repeated rows are
points of their own; rows that share an id are one vector, whose links are those of all of them; lengths that differ never link; ids are whole numbers; an empty table gives an
empty result; extra columns are left out by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .components import components

COSINE = 0.93
#: Bound of the pivots that are broadcast, and points for each pivot below it.
PIVOTS, CELL = 256, 16384
#: Bounds of a chunk of members in rows and in numbers, and how many of these a chunk of guests has.
TILE, NUMBERS, GUESTS = 16384, 1 << 21, 4
#: Rows of copies in a batch, and pairs looked at together.
BATCH, PAIRS = 8192, 1 << 22
#: Slack of the filters against rounding; the last test is on the cosine itself.
SLACK = 1e-7


def usable(v):
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length; scaled by the largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact_hits(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the cosine of each row of a with the same row of b reaches the threshold, in extended precision."""
    u, w = (x.astype(np.longdouble) for x in (a, b))
    u, w = (x / np.abs(x).max(axis=1, keepdims=True) for x in (u, w))
    return ((u * w).sum(axis=1) / np.sqrt((u * u).sum(axis=1) * (w * w).sum(axis=1))).astype(float) >= cosine


def decided(raw: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the rows i and j of raw link, by their cosine in double precision; what is too near to trust the order of summation by exact_hits."""
    out = np.empty(len(i), bool)
    step = max(1, (1 << 20) // raw.shape[1])
    for lo in range(0, len(i), step):
        a, b = (raw[k[lo : lo + step]].astype(float) for k in (i, j))
        cos = (unit(a) * unit(b)).sum(axis=1)
        hit = cos >= cosine
        near = np.abs(cos - cosine) < SLACK
        hit[near] = exact_hits(a[near], b[near], cosine)
        out[lo : lo + step] = hit
    return out


def meets(raw: np.ndarray, u: np.ndarray, w: np.ndarray | None, cosine: float):
    """(rows, columns, hit): which rows of a part of u link with which of w, or of u from there on where w is None, no two of these twice; in blocks of a bounded number of pairs."""
    x = np.concatenate([unit(raw[lo : lo + BATCH].astype(float)).astype(np.float32) for lo in range(0, len(raw), BATCH)])
    doubt = np.float32((raw.shape[1] + 8) * 2.0**-23)  # twice what rounding can do to a product of unit vectors in single precision
    other = u if w is None else w
    y = x[other].T
    step = max(1, PAIRS // max(1, len(other)))
    for lo in range(0, len(u), step):
        part, start = u[lo : lo + step], lo if w is None else 0
        cos = x[part] @ y[:, start:]
        hit = cos >= np.float32(cosine) - doubt
        if w is None:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        unsure = np.flatnonzero(cos[i, j] < np.float32(cosine) + doubt)
        i, j = i[unsure], j[unsure]
        hit[i, j] = decided(raw, part[i], other[start + j], cosine)
        yield part, other[start:], hit


def spanning(hit: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) that connect what hit connects, one for each component that a row finds among the columns; comp: the columns' components so far, updated."""
    rows, cols = [], []
    for i in np.flatnonzero(hit.any(axis=1)):
        at = np.flatnonzero(hit[i])
        kinds, first = np.unique(comp[at], return_index=True)
        rows.append(np.full(len(first), i))
        cols.append(at[first])
        if len(kinds) > 1:
            comp[np.isin(comp, kinds)] = kinds[0]
    none = np.empty(0, np.int64)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (none, none)


def matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def handed_on(b: pa.RecordBatch, rows: np.ndarray, cell: np.ndarray, own: np.ndarray):
    """The points of a batch that go to these cells, in batches of bounded size."""
    step = max(1, min(BATCH, NUMBERS * len(b) // max(1, len(b.column("v").flatten()))))
    for lo in range(0, len(rows), step):
        part = slice(lo, lo + step)
        take = pa.array(rows[part])
        yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in ("label", "dim")], pa.array(cell[part].astype(np.int32)), pa.array(own[part]), *[b.column(c).take(take) for c in ("id", "copies", "v")]], ["label", "dim", "cell", "own", "id", "copies", "v"])


def near_duplicates(rows: DataFrame, spark: SparkSession, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    scratch = Scratch(spark, "embeddings")
    # single precision stays what it is, at half the bytes
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast(kind).alias("v"))
    good = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("v")))
    points = scratch.keep(good.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v")))
    placed, pivots = with_pivots(points, spark)
    found = scratch.keep(cells(placed, pivots, cosine, spark))
    counts = found.where("b is null").groupBy(F.col("label"), F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    forest = found.where("b is not null").select("a", "b")
    named = components(forest, scratch)
    classes = points.join(counts, ["label", "id"], "left").join(named.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    linked = good.join(classes, ["label", "v"]).select("vec_id", "links", "component")
    alone = rows.where(~(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("v")))).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    out = linked.unionAll(alone)
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))


def with_pivots(points: DataFrame, spark: SparkSession) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """points with their space's number, null where it has no pivots; and the pivots, unit vectors, by space."""
    large = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * CELL).orderBy(F.desc("n"), "dim", "label").limit(PIVOTS).collect()
    share = min(1.0, PIVOTS / max(1, sum(x["n"] // CELL for x in large)))
    kinds = T.StructType([points.schema["label"], points.schema["dim"], T.StructField("space", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("wanted", T.IntegerType())])
    spaces = spark.createDataFrame([(x["label"], x["dim"], i, x["n"], max(1, int(share * (x["n"] // CELL)))) for i, x in enumerate(large)], kinds)
    placed = points.join(F.broadcast(spaces), ["label", "dim"], "left")
    # by hash some four times as many as wanted are looked at, so that no space is put in order whole
    place = F.xxhash64("v")
    few = placed.where(F.pmod(place, F.lit(1 << 40)) < F.col("wanted") * 4 / F.col("n") * (1 << 40)).withColumn("place", place)
    picked = few.withColumn("k", F.row_number().over(Window.partitionBy("space").orderBy("place", "id"))).where("k <= wanted").select("space", "v").collect()
    by: dict[int, list] = {}
    for x in picked:
        by.setdefault(x["space"], []).append(x["v"])
    return placed.drop("n", "wanted"), {k: unit(np.array(v, float)) for k, v in by.items()}


def cells(points: DataFrame, pivots: dict[int, np.ndarray], cosine: float, spark: SparkSession) -> DataFrame:
    """label, a, b, links: counts of a point's links (b null) and links of spanning forests. pivots: by the points' space."""
    shared = spark.sparkContext.broadcast(pivots)
    r = float(np.sqrt(2 - 2 * cosine))

    def by_space(b):
        """(space, rows, distances to pivots) of the rows whose space has pivots; and (None, rows, None) of the others."""
        space = b.column("space").to_numpy(zero_copy_only=False).astype(float)
        known = np.isin(space, list(shared.value))
        if not known.all():
            yield None, np.flatnonzero(~known), None
        for s in np.unique(space[known]).astype(int).tolist():
            at = np.flatnonzero(space == s)
            x = unit(matrix(b.column("v").take(pa.array(at))).astype(float))
            yield s, at, np.sqrt(np.maximum(0, 2 - 2 * x @ shared.value[s].T))

    def radii(batches):
        out = {s: np.full(len(p), -1.0) for s, p in shared.value.items()}
        for b in batches:
            for s, _, dist in by_space(b):
                if s is not None:
                    # a point that rounding may put into either of two cells widens both
                    i, j = np.nonzero(dist <= dist.min(axis=1, keepdims=True) + SLACK)
                    np.maximum.at(out[s], j, dist[i, j])
        for s, v in out.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), s, np.int32)), pa.array(range(len(v)), pa.int32()), pa.array(v)], ["space", "cell", "radius"])

    radius = {s: np.full(len(p), -1.0) for s, p in pivots.items()}
    if pivots:
        for x in points.where("space is not null").select("space", "v").mapInArrow(radii, "space int, cell int, radius double").groupBy("space", "cell").agg(F.max("radius").alias("radius")).collect():
            radius[x["space"]][x["cell"]] = x["radius"]

    def copies(b):
        """(rows, cells, own) of the points of a batch: each in its own cell, and as a guest in those of other cells that are to look for its partners there."""
        for s, rows, dist in by_space(b):
            if s is None:
                yield rows, np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
                continue
            gap = np.sqrt(np.maximum(0, 2 - 2 * shared.value[s] @ shared.value[s].T))
            home = dist.argmin(axis=1)
            near = dist[np.arange(len(dist)), home][:, None]
            copy = (dist - near <= 2 * r + SLACK) & (dist <= radius[s] + r + SLACK)
            copy &= dist**2 - near**2 <= 2 * r * gap[home] + SLACK
            other = np.arange(dist.shape[1])[None, :]
            # of two cells with an even sum the first looks, else the second, so that each looks for about half
            copy &= ((home[:, None] + other) % 2 == 0) == (other < home[:, None])
            copy[np.arange(len(dist)), home] = True
            at, cell = np.nonzero(copy)
            yield rows[at], cell, home[at] == cell

    def counted(batches):
        out = {s: np.zeros((len(p), 2), np.int64) for s, p in shared.value.items()}
        for b in batches:
            for s in np.unique(b.column("space").to_numpy()).tolist():
                part = b.filter(pa.array(b.column("space").to_numpy() == s))
                for _, cell, own in copies(part):
                    np.add.at(out[s], (cell, (~own).astype(int)), 1)
        for s, v in out.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), s, np.int32)), pa.array(range(len(v)), pa.int32()), pa.array(v[:, 0]), pa.array(v[:, 1])], ["space", "cell", "members", "guests"])

    def place(batches):
        for b in batches:
            for rows, cell, own in copies(b):
                yield from handed_on(b, rows, cell, own)

    label, v = (points.schema[c].dataType.simpleString() for c in ("label", "v"))
    space = ["label", "dim", "cell"]
    with_cells = F.coalesce(F.col("space").isin(list(pivots)), F.lit(False))
    sizes = points.where(~with_cells).groupBy("label", "dim").agg(F.lit(0).alias("cell"), F.count(F.lit(1)).alias("members"), F.lit(0).cast("long").alias("guests"))
    if pivots:
        named = points.where(with_cells).groupBy("space").agg(F.first("label").alias("label"), F.first("dim").alias("dim"))
        each = points.where(with_cells).select("space", "v").mapInArrow(counted, "space int, cell int, members long, guests long").groupBy("space", "cell").agg(F.sum("members").alias("members"), F.sum("guests").alias("guests"))
        sizes = sizes.unionByName(each.join(named, "space").select(*space, "members", "guests"))
    rows = F.least(F.lit(TILE), F.greatest(F.lit(1), F.floor(F.lit(NUMBERS) / F.col("dim"))))
    cuts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    sizes = sizes.where("members > 0 and members + guests > 1").select(*space, cuts("members", rows).alias("inner"), cuts("guests", GUESTS * rows).alias("outer"))
    placed = points.mapInArrow(place, f"label {label}, dim int, cell int, own boolean, id long, copies long, v {v}")
    # chunks of members come first; a tile is two chunks, of which the first holds members and asks
    cut = placed.join(sizes, space).withColumn("chunk", F.pmod(F.xxhash64("v"), F.when(F.col("own"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    cut = cut.withColumn("chunk", F.when(F.col("own"), F.col("chunk")).otherwise(F.col("inner") + F.col("chunk")))
    last = F.when(F.col("own"), F.col("inner") + F.col("outer") - 1).otherwise(F.col("inner") - 1)
    tiles = F.transform(F.sequence(F.lit(0), last), lambda x: F.struct(F.least(x, "chunk").alias("row"), F.greatest(x, "chunk").alias("col"), (x >= F.col("chunk")).alias("ask")))
    dealt = cut.select(*space, "id", "copies", "v", F.explode(tiles).alias("t")).select(*space, "t.*", "id", "copies", "v")

    def tile(t: pa.Table) -> pa.Table:
        ask = t.column("ask").to_numpy()
        ids, copies = t.column("id").to_numpy(), t.column("copies").to_numpy()
        raw = matrix(t.column("v").combine_chunks())
        u = np.flatnonzero(ask)
        w = None if t.column("row")[0] == t.column("col")[0] else np.flatnonzero(~ask)
        links, left, right = np.zeros(len(ids), np.int64), [], []
        comp = np.arange(len(u) if w is None else len(w))
        for rows, cols, hit in meets(raw, u, w, cosine):
            i, j = np.nonzero(hit)
            i, j = i[ids[rows[i]] != ids[cols[j]]], j[ids[rows[i]] != ids[cols[j]]]
            np.add.at(links, rows[i], copies[cols[j]])
            np.add.at(links, cols[j], copies[rows[i]])
            i, j = spanning(hit, comp[len(comp) - len(cols) :])
            left.append(ids[rows[i]])
            right.append(ids[cols[j]])
        own = np.flatnonzero(links)
        a, b = np.concatenate([ids[own], *left]), np.concatenate([np.zeros(len(own), np.int64), *right])
        count = np.arange(len(a)) < len(own)
        n = np.concatenate([links[own], np.zeros(len(a) - len(own), np.int64)])
        name = t.column("label")[0].as_py()
        return pa.table({"label": pa.array([name] * len(a), t.schema.field("label").type), "a": pa.array(a), "b": pa.array(b, mask=count), "links": pa.array(n, mask=~count)})

    return dealt.groupBy(*space, "row", "col").applyInArrow(tile, f"label {label}, a long, b long, links long")


def oracle(cosine: float = COSINE) -> str:
    return f"""
with recursive e as materialized (select vec_id, label, embedding::double[] as v from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= {cosine}::double),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select vec_id, (select count(*) from l where l.a = vec_id)::bigint as n_links, coalesce(least(vec_id, (select min(b) from r where r.a = vec_id)), vec_id)::bigint as component_id from embeddings)
select vec_id, n_links, component_id, vec_id = component_id as kept from c"""
