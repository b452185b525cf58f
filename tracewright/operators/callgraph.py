"""Questions about calls: callers and callees, impact, entry points, neighbourhoods, shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import ids
from ..storage import keep
from .kernels import LEVELS, both_ways, reach

DEFAULT_CONFIDENCE = 0.8


def _calls(edges: DataFrame, confidence: float) -> DataFrame:
    return edges.where(F.col("kind").isin(*S.CALLS) & (F.col("confidence") >= confidence))


def _walk(edges: DataFrame, anchors: DataFrame, near: str, far: str, depth: int, confidence: float) -> DataFrame:
    calls = _calls(edges, confidence)
    steps = calls.select(F.col(near).alias("src"), F.col(far).alias("dst"))
    nodes = reach(anchors.select(F.col("id").alias("source"), F.col("id").alias("node")), steps, max(depth, 1) - 1)
    return calls.join(nodes, calls[near] == nodes["node"]).select("source", *calls.columns).dropDuplicates(["source", "source_id", "target_id", "kind"])


def callees(edges: DataFrame, anchors: DataFrame, depth: int = 1, confidence: float = DEFAULT_CONFIDENCE) -> DataFrame:
    """Distinct calls edges within `depth` hops from each anchor (column id), with the anchor as `source`; every hop has the confidence."""
    return _walk(edges, anchors, "source_id", "target_id", depth, confidence)


def callers(edges: DataFrame, anchors: DataFrame, depth: int = 1, confidence: float = DEFAULT_CONFIDENCE) -> DataFrame:
    return _walk(edges, anchors, "target_id", "source_id", depth, confidence)


def impact(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, depth: int = 3, limit: int | None = None) -> DataFrame:
    """source, id, depth: existing nodes within `depth` hops over edges of any kind and either direction. The start itself is
    among them, at 2, if it has a neighbour to come back from."""
    steps = both_ways(edges)
    found = reach(anchors.select(F.col("id").alias("source"), F.col("id").alias("node")), steps, depth)
    back = found.where("depth = 1").select("source").distinct().select("source", F.col("source").alias("node"), F.lit(2).alias("depth")) if depth >= 2 else found.limit(0)
    loop = edges.where("source_id = target_id").select(F.col("source_id").alias("source"), F.col("source_id").alias("node"), F.lit(1).alias("depth")).join(anchors.select(F.col("id").alias("source")), "source", "left_semi")
    own = back.unionByName(loop).groupBy("source", "node").agg(F.min("depth").alias("depth"))
    out = found.where("depth > 0").unionByName(own).join(nodes.select(F.col("id").alias("node")), "node", "left_semi").select("source", F.col("node").alias("id"), "depth")
    return out if limit is None else out.orderBy("depth", "id").limit(limit)


def entry_points(nodes: DataFrame) -> DataFrame:
    """main functions (but not a test's) and servers, outside of tests and of other trees."""
    own = ~F.coalesce(F.col("file_path"), F.lit("")).endswith("_test.go") & ~F.coalesce(F.col("file_path"), F.lit("")).startswith("../")
    main = (F.col("name") == "main") & ~F.col("id").endswith(".test:main")
    serves = F.coalesce(F.col("properties")["serves_http"], F.col("properties")["serves_grpc"]) == "true"
    return nodes.where(F.col("kind").isin("function", "method") & own & (main | F.coalesce(serves, F.lit(False))))


def framework_structs(nodes: DataFrame, edges: DataFrame, limit: int = 2000) -> DataFrame:
    """Structs, the first 2000 by name, with a method, none of whose methods is called from another file."""
    own = ~F.col("file_path").endswith("_test.go") & ~F.col("file_path").startswith("../")
    structs = nodes.where((F.col("kind") == "struct") & own).orderBy("name", "id").limit(limit)
    methods = nodes.where(F.col("kind") == "method").select("id", "file_path", ids.struct_of_method(F.col("id")).alias("struct_id")).where("struct_id is not null")
    calls = edges.where(F.col("kind").isin(*S.CALLS)).select("source_id", "target_id")
    callers_of = calls.join(nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("caller_file")), "source_id")
    outside = methods.join(callers_of, methods["id"] == callers_of["target_id"]).where(F.col("file_path") != F.col("caller_file")).select("struct_id").distinct()
    return structs.join(methods.select(F.col("struct_id").alias("id")), "id", "left_semi").join(outside.select(F.col("struct_id").alias("id")), "id", "left_anti")


def roots(nodes: DataFrame, edges: DataFrame, limit: int = 200) -> DataFrame:
    """id, kind, name, framework: at most `limit` entry points by name, and the framework structs."""
    entry = entry_points(nodes).orderBy("name", "id").limit(limit).select("id", "kind", "name", F.lit(False).alias("framework"))
    return entry.unionByName(framework_structs(nodes, edges).select("id", "kind", "name", F.lit(True).alias("framework"))).dropDuplicates(["id"])


def expand(nodes: DataFrame, edges: DataFrame, id_: str, limit: int = 500) -> DataFrame:
    """The incident edges of 17 kinds with the other end's kind and name: parameters, results, then the rest by their ends; a
    parameter value adds the edge from its function."""
    mine = edges.where(F.col("kind").isin(*S.EXPAND))
    out = mine.where(F.col("source_id") == id_).withColumn("other_id", F.col("target_id"))
    into = mine.where((F.col("target_id") == id_) & (F.col("source_id") != id_)).withColumn("other_id", F.col("source_id"))
    place = F.when(F.col("kind") == "has_param", 0).when(F.col("kind") == "has_result", 1).otherwise(2)
    first = out.unionByName(into).select("source_id", "target_id", "kind", "other_id", place.alias("place")).orderBy("place", "source_id", "target_id", "kind").limit(limit)
    values = nodes.where((F.col("kind") == "ssa_value") & (F.col("func_id") == id_) & (F.col("origin_kind") == "parameter"))
    made = values.select(F.lit(id_).alias("source_id"), F.col("id").alias("target_id"), F.lit("has_param").alias("kind"), F.col("id").alias("other_id"), F.lit(0).alias("place"))
    names = nodes.select(F.col("id").alias("other_id"), F.col("kind").alias("other_kind"), F.col("name").alias("other_name"))
    return first.unionByName(made).distinct().join(names, "other_id", "left")


def shortest_path(edges: DataFrame, start: str, end: str, via: str = "data", depth: int = 50) -> DataFrame:
    """step, id, edge_kinds (of the step before): the path of fewest edges, the least ids from the end on among equals; one row where
    the ends are one; no row where there is none within `depth`. A frontier row carries its least parent, whatever the length of its way;
    the way is looked up from the end, a row for each level."""
    spark = edges.sparkSession
    level = spark.createDataFrame([(start,)], "node string")
    used = edges.where(F.col("kind").isin(*(S.PATH_CALLS if via == "calls" else S.PATH_DATA)))
    steps = keep(used.groupBy("source_id", "target_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kind")), "path-steps") if start != end else None
    seen, levels, arrived = level, [], start == end
    while not arrived and len(levels) < depth:
        met = level.join(steps, level["node"] == steps["source_id"]).groupBy("target_id").agg(F.min(F.struct("source_id", "kind")).alias("w"))
        rows = met.join(seen, met["target_id"] == seen["node"], "left_anti")
        levels.append(keep(rows.select(F.col("target_id").alias("node"), F.col("w.source_id").alias("parent"), "w.kind"), "path"))
        n, arrived = levels[-1].agg(F.count(F.lit(1)), F.max(F.col("node") == end)).first()
        if arrived or not n:
            break
        level = levels[-1].select("node")
        seen = seen.unionByName(level)
        if len(levels) % LEVELS == 0:
            seen = keep(seen, "path-seen")
    way, at = [], end
    for found in reversed(levels if arrived else []):
        parent, kind = found.where(F.col("node") == at).select("parent", "kind").first()
        way.append((at, kind))
        at = parent
    return spark.createDataFrame([(i, *w) for i, w in enumerate([(start, ""), *reversed(way)] if arrived else [])], "step int, id string, edge_kinds string")


def symbol_detail(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, confidence: float = DEFAULT_CONFIDENCE) -> DataFrame:
    """Nodes of the anchors (column id), with their direct callers and callees in order."""
    calls = _calls(edges, confidence)
    into = calls.groupBy(F.col("target_id").alias("id")).agg(F.array_sort(F.collect_set("source_id")).alias("callers"))
    out = calls.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_set("target_id")).alias("callees"))
    mine = nodes.join(anchors.select("id"), "id", "left_semi").select("id", "kind", "name", "file_path", "line_start")
    return mine.join(into, "id", "left").join(out, "id", "left")


def resolve_symbol(nodes: DataFrame, text: str) -> str:
    """The id a text means: an id as it is, else the only node of that name. Several are an error that lists them."""
    if text.startswith(("symbol:", "file:", "commit:")):
        found = [r[0] for r in nodes.where(F.col("id") == text).select("id").limit(1).collect()]
    else:
        found = [r[0] for r in nodes.where((F.col("name") == text) & ~F.col("kind").isin("field_access", "ssa_value", "external_summary")).orderBy("id").select("id").limit(20).collect()]
    if len(found) > 1:
        raise LookupError(f"{text} is ambiguous: {', '.join(found)}")
    if not found:
        raise LookupError(f"no symbol {text}")
    return found[0]


def resolve_anchor(nodes: DataFrame, text: str) -> str:
    """A symbol, or the first read of a field path."""
    try:
        return resolve_symbol(nodes, text)
    except LookupError:
        read = nodes.where((F.col("kind") == "field_access") & (F.col("full_path") == text) & (F.col("access_kind") == "read")).orderBy("line_start", "id").select("id").first()
        if read is None:
            raise
        return read[0]


def mark_dispatch(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Trace rows (func_id) with dispatch_candidate, dispatch_origin, dispatch_conf. targets: of scan.dispatch_targets."""
    marks = targets.select(F.col("target_id").alias("func_id"), F.col("origin").alias("dispatch_origin"), F.col("confidence").alias("dispatch_conf"), F.lit(True).alias("dispatch_candidate"))
    return rows.join(marks, "func_id", "left").withColumn("dispatch_candidate", F.coalesce("dispatch_candidate", F.lit(False)))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
