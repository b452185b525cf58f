"""Connected components by alternating large-star and small-star steps; edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

MOST_ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: u > v. Large: each node's larger neighbours go to its least neighbour. Small: a node and its smaller neighbours do."""
    if small:
        ways = edges
    else:
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.keep(ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")  # kept, so that the join with a hub's many edges can be split
    met = ways.join(least, "u")
    if small:
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))
    else:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def connected(links: DataFrame, label: str) -> DataFrame:
    """links: a, b. Returns node, component (the least node), for every node that is in a link with another."""
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = mark(edges)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        edges = scratch.keep(_star(_star(edges, small=False), small=True), label)
        after = mark(edges)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
