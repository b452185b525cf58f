"""Fixpoints over extracted facts: who writes a field through calls, and what may point to the same allocation.

Both are semi-naive: a round joins only what the round before found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..storage import keep


def indirect_writes(direct: DataFrame, calls: DataFrame, excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summaries, origins and edges of indirect writes.

    direct: function_id, field_path (written there). calls: caller_id, callee_id, call_line, arg_paths (struct paths of what is passed
    on), arg_names. A write of the callee is one of the caller, once for each call line, when the call passes the field's struct,
    unless excluded (caller_id, callee_id, field_path) has it. Summaries: function_id, access_kind, field_path, call_line. Origins:
    with callee_id. Edges: source_id, target_id, kind, call_line, call_args (of the first call line)."""
    sites = keep(calls.select("caller_id", "callee_id", "call_line", F.explode("arg_paths").alias("owner"), F.array_join("arg_names", ", ").alias("args")).distinct(), "closure-sites")
    level = keep(direct.select("function_id", "field_path").distinct(), "closure")
    known, found = level, None
    while not level.isEmpty():
        met = level.select(F.col("function_id").alias("callee_id"), "field_path", ids.struct_path(F.col("field_path")).alias("owner")).join(sites, ["callee_id", "owner"])
        new = met.select("caller_id", "callee_id", "field_path", "call_line", "args")
        if excluded is not None:
            new = new.join(excluded, ["caller_id", "callee_id", "field_path"], "left_anti").select(new.columns)
        new = keep(new.distinct(), "closure-found")
        found = new if found is None else found.unionByName(new)
        level = keep(new.select(F.col("caller_id").alias("function_id"), "field_path").distinct().join(known, ["function_id", "field_path"], "left_anti"), "closure")
        known = known.unionByName(level)
    if found is None:
        found = sites.select("caller_id", "callee_id", F.lit("").alias("field_path"), "call_line", "args").limit(0)
    found = found.distinct()
    kind = F.lit("indirect_write")
    summaries = found.select(F.col("caller_id").alias("function_id"), kind.alias("access_kind"), "field_path", "call_line").distinct()
    origins = found.select(F.col("caller_id").alias("function_id"), kind.alias("access_kind"), "field_path", "call_line", "callee_id").distinct()
    first = F.min_by("args", F.struct("call_line", "args")).alias("call_args")
    edges = found.groupBy(F.col("caller_id").alias("source_id"), F.col("callee_id").alias("target_id")).agg(F.min("call_line").alias("call_line"), first).withColumn("kind", kind)
    return summaries, origins, edges.select("source_id", "target_id", "kind", "call_line", "call_args")


def may_alias(allocations: DataFrame, flows: DataFrame, rounds: int = 20) -> DataFrame:
    """value, allocation: all allocations that a value may point to. allocations: value, allocation. flows: src, dst (assignments,
    arguments to parameters, returns to results). `rounds` bounds the hops, as in the extractor. The rounds run on numbers, so that what
    each of them moves does not grow with the length of the ids."""
    ids_ = allocations.select(F.explode(F.array("value", "allocation")).alias("id")).unionByName(flows.select(F.explode(F.array("src", "dst")).alias("id"))).where("id is not null").distinct()
    places = keep(ids_.withColumn("n", F.monotonically_increasing_id()), "alias-places")

    def swap(df: DataFrame, end: str, have: str, want: str) -> DataFrame:
        return df.join(places.select(F.col(have).alias(end), F.col(want).alias("_swapped")), end, "left").drop(end).withColumnRenamed("_swapped", end)

    level = keep(swap(swap(allocations.select("value", "allocation").distinct(), "value", "id", "n"), "allocation", "id", "n"), "alias")
    steps = keep(swap(swap(flows.select("src", "dst").distinct(), "src", "id", "n"), "dst", "id", "n"), "alias-steps")
    known = level
    for _ in range(rounds):
        new = level.join(steps, level["value"] == steps["src"]).select(F.col("dst").alias("value"), "allocation").distinct()
        level = keep(new.join(known, ["value", "allocation"], "left_anti"), "alias")
        if level.isEmpty():
            break
        known = known.unionByName(level.select(known.columns))
    return swap(swap(known, "value", "n", "id"), "allocation", "n", "id").select("value", "allocation")


def alias_pairs(points: DataFrame) -> DataFrame:
    """value_a, value_b (a < b): values of one function (func_id) that share an allocation. points: func_id, value, allocation."""
    a = points.select("func_id", "allocation", F.col("value").alias("value_a"))
    b = points.select("func_id", "allocation", F.col("value").alias("value_b"))
    return a.join(b, ["func_id", "allocation"]).where("value_a < value_b").select("func_id", "value_a", "value_b").distinct()


def disjoint_writes(arguments: DataFrame, writers: DataFrame) -> DataFrame:
    """What indirect_writes excludes: caller_id, callee_id, field_path where the passed value's allocations (arguments: caller_id,
    callee_id, allocation) share none with those written (writers: callee_id, field_path, allocation)."""
    pairs = arguments.select("caller_id", "callee_id").distinct().join(writers.select("callee_id", "field_path").distinct(), "callee_id")
    shared = arguments.join(writers, ["callee_id", "allocation"]).select("caller_id", "callee_id", "field_path").distinct()
    return pairs.join(shared, ["caller_id", "callee_id", "field_path"], "left_anti").select("caller_id", "callee_id", "field_path")


def dispatch_edges(calls: DataFrame, registered: DataFrame, methods: DataFrame) -> DataFrame:
    """dispatch_to edges of interface calls. calls: function_id, interface, method. registered: interface, type, site (types seen in a
    registration). methods: interface, method, type, function_id (all that implement it). A registered type's method has 0.9,
    another one 0.7."""
    seen = registered.groupBy("interface", "type").agg(F.min("site").alias("register_site"))
    met = calls.select(F.col("function_id").alias("source_id"), "interface", "method").distinct().join(methods.withColumnRenamed("function_id", "target_id"), ["interface", "method"]).join(seen, ["interface", "type"], "left")
    hit = F.col("register_site").isNotNull()
    rows = met.select("source_id", "target_id", F.lit("dispatch_to").alias("kind"), F.when(hit, 0.9).otherwise(0.7).alias("confidence"), F.when(hit, "register").otherwise("enum").alias("origin"), F.col("interface").alias("interface"), F.col("method").alias("interface_method"), "register_site")
    return rows.groupBy("source_id", "target_id", "kind").agg(F.max_by(F.struct("confidence", "origin", "interface", "interface_method", "register_site"), F.struct("confidence", "interface")).alias("b")).select("source_id", "target_id", "kind", "b.*")


def owned_fields(fields: DataFrame, depth: int = 4) -> DataFrame:
    """owner, path, type: the fields of each struct with those of the structs inside it, to a depth. fields: owner, name, type (the type's name,
    without '*')."""
    level = keep(fields.select("owner", F.col("name").alias("path"), "type").distinct(), "fields")
    out, own = level, fields.select(F.col("owner").alias("type"), F.col("name"), F.col("type").alias("inner"))
    for _ in range(1, depth):
        level = keep(level.join(own, "type").select("owner", F.concat_ws(".", "path", "name").alias("path"), F.col("inner").alias("type")).distinct(), "fields")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out
