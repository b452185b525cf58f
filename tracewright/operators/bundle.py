"""Answers put together from several operators. A part that cannot be had is left out; the others stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import callgraph, relations, scan, trace


def context(nodes: DataFrame, edges: DataFrame, summary: DataFrame, origins: DataFrame, anchor: str, depth: int = 4, steps: DataFrame | None = None) -> dict[str, DataFrame]:
    """What there is to know of a symbol: itself, direct callers and callees, fields, the main chain and value trace of its node, and
    marks of dispatch."""
    spark, steps = nodes.sparkSession, trace.prepare(nodes, edges) if steps is None else steps
    one = spark.createDataFrame([(anchor,)], "id string")
    out = {
        "symbol": scan.node_by_id(nodes, anchor),
        "callers": callgraph.callers(edges, one),
        "callees": callgraph.callees(edges, one),
        "fields": scan.function_fields(summary, origins, anchor),
        "dispatch": scan.dispatch_targets(edges).where(F.col("target_id") == anchor),
    }
    values = nodes.where((F.col("func_id") == anchor) & F.col("kind").isin("parameter", "receiver", "result", "field_access")).orderBy("id").select("id").limit(1).collect()
    start = anchor if not values else values[0][0]
    out["chain"] = trace.summary_chain(nodes, edges, start, steps)
    out["trace"] = trace.marked(trace.value_trace(nodes, edges, spark.createDataFrame([(start,)], "id string"), depth, steps=steps), edges)
    return out


def er(nodes: DataFrame, edges: DataFrame, found: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables with their columns, and the relations to draw between them. found: relations that are known already."""
    shown = relations.dedup(relations.best_of(relations.infer(nodes, edges) if found is None else found))
    return {"tables": relations.er_tables(nodes), "columns": relations.table_columns(nodes, edges), "relations": relations.shown(shown)}


def stale(builds: DataFrame, head: str) -> DataFrame:
    """The latest build with `stale`: whether it was made from another commit than the present one."""
    return scan.latest_build(builds).withColumn("stale", F.coalesce(F.col("commit_sha") != head, F.lit(True)))
