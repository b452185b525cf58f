"""Lookups and scans over the graph's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import affinity as A

HIDDEN_KINDS = ("field_access", "ssa_value", "external_summary")


def node_by_id(nodes: DataFrame, id_: str) -> DataFrame:
    return nodes.where(F.col("id") == id_)


def search(nodes: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Exact names; only if there are none, names or ids that contain the text, but for case. In order of name, the first 50."""
    shown = nodes.where(~F.col("kind").isin(*HIDDEN_KINDS))
    exact = shown.where(F.col("name") == name)
    text = "%" + name.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    part = shown.where(F.col("name").ilike(text) | F.col("id").ilike(text)).join(exact.select(F.lit(1).alias("_hit")).limit(1), how="left_anti", on=F.lit(True))
    return exact.unionByName(part).orderBy("name", "id").limit(limit)


def all_summaries(summary: DataFrame) -> DataFrame:
    return summary.orderBy("field_path", "access_kind", "function_id")


def function_fields(summary: DataFrame, origins: DataFrame, function_id: str | None = None) -> DataFrame:
    """Summaries, each with its origins in order of call line. function_id None: of all functions."""
    keys = ["function_id", "access_kind", "field_path"]
    if function_id is not None:
        summary, origins = summary.where(F.col("function_id") == function_id), origins.where(F.col("function_id") == function_id)
    nested = origins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("call_line", "callee_id"))).alias("origins"))
    return summary.join(nested, keys, "left").withColumn("origins", F.coalesce("origins", F.expr("cast(array() as array<struct<call_line: int, callee_id: string>>)")))


def with_dispatch(fields: DataFrame, edges: DataFrame) -> DataFrame:
    """function_fields, each origin with the origin and confidence of the dispatch that leads to its callee (null: none)."""
    keys = ["function_id", "access_kind", "field_path"]
    targets = dispatch_targets(edges).select(F.col("target_id").alias("callee_id"), "origin", "confidence")
    flat = fields.select(*keys, F.explode("origins").alias("o")).select(*keys, "o.*").join(targets, "callee_id", "left")
    nested = flat.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("call_line", "callee_id", "origin", "confidence"))).alias("origins"))
    none = F.expr("cast(array() as array<struct<call_line: int, callee_id: string, origin: string, confidence: double>>)")
    return fields.drop("origins").join(nested, keys, "left").withColumn("origins", F.coalesce("origins", none))


def edges_from(edges: DataFrame, kind: str, source_id: str | None = None) -> DataFrame:
    """indirect_write, dispatch_to, ... edges, of one source or of all."""
    found = edges.where(F.col("kind") == kind)
    return found if source_id is None else found.where(F.col("source_id") == source_id)


def dispatch_targets(edges: DataFrame) -> DataFrame:
    """target_id, origin, confidence: of the dispatch_to edge of the highest confidence (then the least origin and source)."""
    best = F.max_by(F.struct("origin", "confidence"), F.struct("confidence", "source_id")).alias("b")
    return edges.where(F.col("kind") == "dispatch_to").groupBy("target_id").agg(best).select("target_id", "b.origin", "b.confidence")


def field_reads(nodes: DataFrame, full_path: str | None = None) -> DataFrame:
    reads = nodes.where((F.col("kind") == "field_access") & (F.col("access_kind") == "read"))
    if full_path is not None:
        reads = reads.where(F.col("full_path") == full_path)
    return reads.orderBy("line_start", "id")


def latest_build(builds: DataFrame) -> DataFrame:
    """The row of the latest timestamp; of equal ones, the greatest build_id."""
    return builds.orderBy(F.col("timestamp").desc(), F.col("build_id").desc()).limit(1)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, F.lit(True))  # one row each


def is_column_node() -> Column:
    """A database column that the extractors made a node of, named table.column."""
    return (F.col("kind") == "field_access") & (F.col("is_external") == "true") & F.col("type_string").isin(*S.SQL_TYPES)


def table_names(nodes: DataFrame) -> DataFrame:
    named = nodes.where(is_column_node() & F.col("name").rlike(r"^[^.]+\.[^.]*$"))
    return named.select(A.table_of(F.col("name")).alias("table_name")).distinct().orderBy("table_name")


def resolve_table(tables: DataFrame, name: str) -> DataFrame:
    """The table of that exact name, else the only one that equals it but for case, else nothing."""
    same = tables.where(F.lower("table_name") == name.lower())
    ranked = same.withColumn("exact", F.col("table_name") == name).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lower("table_name"))))
    return ranked.where(F.col("exact") | ((F.col("n") == 1))).select("table_name")


def field_index(summary: DataFrame) -> DataFrame:
    """field_path with the functions that write it (producers) and read it (consumers), each in order."""
    side = lambda *kinds: F.array_sort(F.collect_set(F.when(F.col("access_kind").isin(*kinds), F.col("function_id"))))
    return summary.groupBy("field_path").agg(side("direct_write", "indirect_write").alias("producers"), side("direct_read").alias("consumers"))


def grouped_fields(summary: DataFrame) -> DataFrame:
    """function_id with its fields by kind of access."""
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("access_kind") == kind, F.col("field_path"))))
    return summary.groupBy("function_id").agg(*(of(k).alias(f"{k}s") for k in S.SUMMARY_ACCESS))
