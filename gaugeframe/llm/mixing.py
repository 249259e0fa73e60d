"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks. Block j (from 0) of a source of weight w is
released at slot floor(j / w) and due at ceil((j + 1) / w); earliest deadline
first over released blocks then meets every deadline, so at each slot every
source is within one block of its share of the weights as given: a weight is
the exact value of its number, and releases and deadlines are whole-number
arithmetic on these, without rounding and without a period.

A source that has run out ends a *phase*; the next phase shares the slots among
the sources that are left. So every row is placed exactly once, and the bound
holds in each phase for the weights of that phase.

The schedule is laid out on the driver, block by block. A block has
``BLOCK_ROWS`` rows, and more where a table would have over ``MOST_BLOCKS``
blocks: the schedule has at most that many slots, and one more for each source,
whatever the number of rows, and so have the arrays that are broadcast.

A row's block is its rank in its source by hash of its id and content, found by counts per
(source, hash range) and ranks within ranges; a source with a third of all rows
is dealt to as many ranges as it needs. Null sources form a source named '';
rows without an id are placed as well; repeated rows are placed one by one; an empty
table gives an empty result; all columns pass through, whatever their names,
but for the four that this adds (``ADDED``), which are replaced.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_ROWS, MOST_BLOCKS = 64, 1 << 20
#: Rows of a range of hashes, in which ranks are found by sorting.
RANGE_ROWS = 4_000
ADDED = ["mix_phase", "mix_block", "mix_slot", "mix_position"]


def target_weights(counts: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Shares raised to a power below 1: small sources are seen more often than in proportion."""
    total = sum(n**power for n in counts.values())
    return {s: n**power / total for s, n in counts.items()}


def whole(weights: dict[str, float | Fraction]) -> dict[str, int]:
    """Whole numbers in the exact proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if bad := sorted(s for s, w in exact.items() if w <= 0):
        raise ValueError(f"weights must be above 0: {bad[:5]}")
    scale = lcm(*[w.denominator for w in exact.values()])
    return {s: int(w * scale) for s, w in exact.items()}


def phases(blocks: dict[str, int], weights: dict[str, float | Fraction]) -> list[dict]:
    """For each phase its first slot and, by source, its first block and the slots of its blocks, counted from the phase's first; ties by name.

    A phase ends with the slot at which a source places its last block.
    """
    share = whole({s: w for s, w in weights.items() if blocks.get(s)})
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    start, out = 0, []
    while left:
        total = sum(share[s] for s in left)
        due = lambda s, j: -(-(j + 1) * total // share[s])  # noqa: E731, B023
        waiting = [(0, due(s, 0), s, 0) for s in sorted(left)]
        heapq.heapify(waiting)
        ready: list[tuple[int, str, int]] = []
        at: dict[str, list[int]] = {s: [] for s in left}
        slot, over = 0, False
        while not over:
            while waiting and waiting[0][0] <= slot:
                _, d, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (d, s, j))
            _, s, j = heapq.heappop(ready)  # shares add up to 1: a released block is always there
            at[s].append(slot)
            heapq.heappush(waiting, ((j + 1) * total // share[s], due(s, j + 1), s, j + 1))
            over = len(at[s]) == left[s]
            slot += 1
        out.append({"phase": len(out), "slot": start, "first": {s: done[s] for s in left}, "at": at})
        start += slot
        for s in list(left):
            done[s] += len(at[s])
            left[s] -= len(at[s])
            if not left[s]:
                del left[s]
    return out


def ranked(docs: DataFrame, counts: dict[str, int], spark: SparkSession, source: str = "source", key: str = "doc_id") -> DataFrame:
    """source, rank, row: each row as a struct, with its rank (from 0) in its source by hash of its key and content.

    A source is dealt to as many ranges of hashes as its number of rows asks for.
    """
    ranges = spark.createDataFrame([(s, max(1, -(-n // RANGE_ROWS))) for s, n in counts.items()], "source string, ranges int")
    known = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = docs.select(name_of(source).alias("source"), F.col(key).alias("id"), F.xxhash64(key, *known).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(F.broadcast(ranges), "source")
    # a rising function of the hash, so that ranks follow the hash across ranges
    share = F.col("hash").cast("double") / float(1 << 64) + 0.5
    rows = rows.withColumn("range", F.least(F.floor(share * F.col("ranges")), F.col("ranges") - 1).cast("int"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("source", "range").orderBy("hash", "id"))
    rows = rows.withColumn("in", inside).join(sizes.drop("n"), ["source", "range"])
    return rows.select("source", (F.col("before") + F.col("in") - 1).alias("rank"), "row")


def name_of(source: str):
    return F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))


def mix(docs: DataFrame, spark: SparkSession, weights: dict[str, float | Fraction] | None = None, block_rows: int = BLOCK_ROWS, source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with mix_phase, mix_block (of its source), mix_slot and mix_position (slot, then place in the block)."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED])
    counts = {r[0]: r[1] for r in docs.groupBy(name_of(source)).count().limit(MOST_BLOCKS + 1).collect()}
    if len(counts) > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} sources")
    if weights is None:
        weights = target_weights(counts)
    if missing := sorted(set(counts) - set(weights)):
        raise ValueError(f"no target weight for {missing[:5]}")
    block_rows = max(block_rows, -(-sum(counts.values()) // MOST_BLOCKS))
    plan = phases({s: -(-n // block_rows) for s, n in counts.items()}, weights)
    table = [(s, p["phase"], p["first"][s], p["slot"], p["at"][s]) for p in plan for s in p["first"]]
    columns = [pa.array([t[c] for t in table], kind) for c, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())))]
    spread = spark.createDataFrame(pa.Table.from_arrays(columns, ["source", "mix_phase", "first", "slot", "at"]))
    rows = ranked(docs, counts, spark, source, key).withColumn("mix_block", F.floor(F.col("rank") / block_rows))
    place = F.col("mix_block") - F.col("first")
    rows = rows.alias("r").join(F.broadcast(spread).alias("p"), (F.col("r.source") == F.col("p.source")) & (place >= 0) & (place < F.size("at")))
    rows = rows.withColumn("mix_slot", F.col("slot") + F.get("at", place.cast("int")))
    return rows.select("row.*", "mix_phase", "mix_block", "mix_slot", (F.col("mix_slot") * block_rows + F.col("rank") % block_rows).alias("mix_position"))
