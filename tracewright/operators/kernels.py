"""The frontier loops of all traversals. Their states differ and are not to be mixed:

- ``reach``: one row for each (source, node), least depth wins.
- ``reach_ways``: one row for each (anchor, node, direction), least depth wins, with the least of the parents that lead there.
- ``walk_paths``: no visited set; one row for each distinct (node, depth, kinds of edges so far, context).

Every level is a table in the shared folder, so plans stay small and a lost executor costs one level at most. A level's
frontier joins the edges on their end: a shuffle join that Spark turns into a broadcast where the frontier is small. A node or
edge whose id is null is never reached; repeated edges count once; empty tables give the anchors alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import keep

#: Levels that are read one by one before they are put into one table.
LEVELS = 16


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst in both directions."""
    return edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).unionByName(edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst")))


def reach(anchors: DataFrame, steps: DataFrame, depth: int | None) -> DataFrame:
    """anchors: source, node. steps: src, dst. Returns source, node, depth, anchors at 0, up to `depth` (None: as far as it goes)."""
    level = keep(anchors.select("source", "node").distinct().withColumn("depth", F.lit(0)), "reach")
    seen, d = level, 0
    while depth is None or d < depth:
        d += 1
        found = level.join(steps, level["node"] == steps["src"]).select("source", F.col("dst").alias("node")).distinct()
        level = keep(found.join(seen, ["source", "node"], "left_anti").withColumn("depth", F.lit(d)), "reach")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        if d % LEVELS == 0:
            seen = keep(seen, "reach-seen")
    return seen


def reach_ways(anchors: DataFrame, steps: DataFrame, depth: int, carry: list[str], allowed: Column | None = None, again: Column | None = None) -> DataFrame:
    """anchors: anchor, node, dir and context columns that stay with the anchor. steps: src, dst, dir, the columns `carry` and others that
    `allowed` reads. Returns anchors' columns, depth, the least parent of the least depth, and `carry`: of the (least) step from that parent,
    or, where all are null there, what the parent carried. allowed: on a step and the context. again: anchors that a way back
    finds once more."""
    context = [c for c in anchors.columns if c != "node"]
    start = anchors.withColumn("depth", F.lit(0)).withColumn("parent", F.lit(None).cast("string"))
    for c in carry:
        start = start.withColumn(c, F.lit(None).cast(steps.schema[c].dataType))
    level = keep(start, "ways")
    seen, visited = level, level if again is None else level.where(~again)
    for d in range(1, depth + 1):
        at = level.select(*context, F.col("node").alias("parent"), *(F.col(c).alias(f"was_{c}") for c in carry))
        met = at.join(steps, (at["parent"] == steps["src"]) & (at["dir"] == steps["dir"])).drop(steps["dir"])
        if allowed is not None:
            met = met.where(allowed)
        way = F.min(F.struct("parent", *carry, *(f"was_{c}" for c in carry))).alias("way")
        found = met.withColumn("node", F.col("dst")).groupBy(*context, "node").agg(way)
        none = F.lit(True)
        for c in carry:
            none = none & F.col(f"way.{c}").isNull()
        fresh = found.join(visited.select("anchor", "node", "dir"), ["anchor", "node", "dir"], "left_anti")
        rows = fresh.select(*anchors.columns, F.lit(d).alias("depth"), "way.parent", *(F.when(none, F.col(f"way.was_{c}")).otherwise(F.col(f"way.{c}")).alias(c) for c in carry))
        level = keep(rows.select(seen.columns), "ways")
        if level.isEmpty():
            break
        seen, visited = seen.unionByName(level), visited.unionByName(level)
    return seen


def walk_paths(anchors: DataFrame, steps: DataFrame, depth: int, admit: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """anchors: node and state columns. steps: src, dst, kind and columns that replace state columns of the same name. Returns anchors'
    columns, depth and edge_kinds (in the order of the steps, comma-joined). admit: filters a level's candidates, where columns
    of the step before are called prev_<name>. Rows grow with the distinct sequences of kinds, at most the kinds' number to the power of
    the depth for each node."""
    state = [c for c in anchors.columns if c != "node"]
    new = [c for c in steps.columns if c in state]
    level = keep(anchors.withColumn("depth", F.lit(0)).withColumn("edge_kinds", F.lit("")).distinct(), "paths")
    found = level
    for d in range(1, depth + 1):
        before = level.select(*(F.col(c).alias(f"prev_{c}") for c in level.columns))
        met = before.join(steps, F.col("prev_node") == F.col("src"))
        if admit is not None:
            met = admit(met)
        kinds = F.when(F.col("prev_edge_kinds") == "", F.col("kind")).otherwise(F.concat_ws(",", "prev_edge_kinds", "kind"))
        rows = met.select(F.col("dst").alias("node"), *(F.col(c if c in new else f"prev_{c}").alias(c) for c in state), F.lit(d).alias("depth"), kinds.alias("edge_kinds"))
        level = keep(rows.select(found.columns).distinct(), "paths")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found
