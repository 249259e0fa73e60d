"""Connected components by repeated contraction, without links on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node with a link; component: the smallest node reachable.

    links: columns a, b; order, repeats and self-links don't matter. Each round
    draws a random order of the nodes, from digests of the round and the node; every node hooks to
    the first of itself and its neighbours, and the links are rewritten to
    hooked nodes. Whatever the links are like, a round leaves at most some three quarters of the
    nodes that still have one in expectation - half of them on a path - so the number of rounds grows with the logarithm
    of the nodes. The rounds' maps, each smaller than the one before, are composed backwards, and a
    component is named by the smallest of its nodes at the end.
    Joins are by node on two plain exchanges, so that adaptive execution can
    split the partition of a node with very many links.
    """
    both = lambda df: df.select("a", "b").unionAll(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.keep(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        place = lambda c, n=len(maps): F.struct(F.xxhash64(F.lit(n), c).alias("place"), F.col(c).alias("to"))
        first = both(edges).groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("near"))
        hook = scratch.keep(first.select("node", F.least("near", place("node"))["to"].alias("to")))
        maps.append(hook)
        left = edges.join(hook.select(F.col("node").alias("a"), F.col("to").alias("na")), "a").select("na", "b")
        left = left.join(hook.select(F.col("node").alias("b"), F.col("to").alias("nb")), "b").select("na", "nb").where("na <> nb")
        after = scratch.keep(left.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
        scratch.drop(edges)
        edges = after
    scratch.drop(edges)
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)

    def compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
        nxt = later.select(F.col("node").alias("to"), F.col("component"))
        return earlier.join(nxt, "to", "left").select("node", F.coalesce("component", "to").alias("component"))

    first, *rest = [maps[-1].withColumnRenamed("to", "component"), *reversed(maps[:-1])]
    rooted = scratch.keep(reduce(compose, rest, first))
    scratch.drop(*maps)
    names = scratch.keep(rooted.groupBy("component").agg(F.min("node").alias("name")))
    return rooted.join(names, "component").select("node", F.col("name").alias("component"))


def extended(named: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components (node, component) after more links (a, b): these join components, so only a link of each pair of components matters."""
    of = lambda side: named.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    both = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(both, scratch)
    met = links.select(F.col("a").alias("node")).unionAll(links.select("b")).distinct().join(named, "node", "left_anti").select("node", F.col("node").alias("component"))
    old = named.unionAll(met).select("node", F.col("component").alias("old"))
    return old.join(top.select(F.col("node").alias("old"), "component"), "old", "left").select("node", F.coalesce("component", "old").alias("component"))
