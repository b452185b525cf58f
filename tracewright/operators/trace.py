"""Field traces (path-enumerating) and value traces (least depth for each node and direction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import ids
from ..storage import keep
from . import scan
from .callgraph import first_by, mark_dispatch
from .kernels import reach_ways, walk_paths

DEPTH, MULTI_DEPTH, TRAMPOLINE_READS = 8, 4, 8


def prepare(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The steps of all traces over a graph, both ways, with what is known of the node each leads to: made once for a graph and given
    to the traces as `steps`, so that a level is one join. src, dst, dir (1: forward), kind, the edge's candidate, dst's facts."""
    used = edges.where(F.col("kind").isin(*{*S.TRACE_BACK, *S.VALUE_TRACE}))
    edge = [F.col("interface").alias("edge_iface"), F.col("candidate_origin").alias("edge_origin"), F.col("cand_confidence").alias("edge_conf")] if "candidate_origin" in edges.columns else [F.lit(None).cast(t).alias(c) for c, t in (("edge_iface", "string"), ("edge_origin", "string"), ("edge_conf", "double"))]
    ends = F.array(F.struct(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), F.lit(0).alias("dir")), F.struct(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.lit(1).alias("dir")))
    both = used.select(F.explode(ends).alias("e"), "kind", *edge).select("e.*", "kind", "edge_iface", "edge_origin", "edge_conf")
    more = ("full_path", "access_kind", "type_string", "func_id", "is_external")
    known = _facts(nodes, *more, F.coalesce("instance_path", "full_path").alias("inst")).withColumnRenamed("id", "dst")
    return keep(both.join(known, "dst"), "steps", ["dir"])


def _facts(nodes: DataFrame, *more: str | Column) -> DataFrame:
    return nodes.select("id", "name", F.col("line_start").alias("line"), F.col("kind").alias("node_kind"), *more)


def _steps(steps: DataFrame | None, nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...], forward: bool, *more: str) -> DataFrame:
    """src, dst, kind, and what is known of the node a step leads to."""
    steps = prepare(nodes, edges) if steps is None else steps
    return steps.where((F.col("dir") == int(forward)) & F.col("kind").isin(*kinds)).select("src", "dst", "kind", "name", "line", "node_kind", *more)


def trace_backward(nodes: DataFrame, edges: DataFrame, field: str, func: str, depth: int = DEPTH, steps: DataFrame | None = None) -> DataFrame:
    """id, depth, name, edge_kinds, line: all ways back from the accesses of the field in the function; a row for each distinct way's
    kinds."""
    anchors = _facts(nodes.where((F.col("kind") == "field_access") & (F.col("full_path") == field) & (F.col("func_id") == func))).withColumnRenamed("id", "node").drop("node_kind")
    found = walk_paths(anchors, _steps(steps, nodes, edges, S.TRACE_BACK, False), depth)
    return found.select(F.col("node").alias("id"), "depth", "name", "edge_kinds", "line")


def trace_forward(nodes: DataFrame, edges: DataFrame, field: str, func: str, depth: int = DEPTH, steps: DataFrame | None = None) -> DataFrame:
    """The same forward, with is_usage. Starts: accesses of the field; values and parameters of the field's type in the function, or
    globals of it; accesses of fields of that type. A step onto another field is taken only from a value, onto a read of a field of
    the same last name or of a type of the same package."""
    last, owner = field.rsplit(".", 1)[-1], field.rsplit(".", 1)[0] if "." in field else field
    parts = field.split(".")
    package = ".".join(parts[:-2]) if len(parts) > 2 else field
    in_func, of_type = F.col("func_id") == func, F.col("type_string").isin(owner, f"*{owner}")
    own = nodes.where((F.col("kind") == "field_access") & (F.col("full_path") == field) & in_func).withColumn("is_usage", F.lit(True))
    values = nodes.where(F.col("kind").isin("ssa_value", "parameter") & (in_func | (F.col("origin_kind") == "global")) & of_type).withColumn("is_usage", F.lit(False))
    holders = nodes.where((F.col("kind") == "field_access") & in_func & of_type).withColumn("is_usage", F.lit(False))
    anchors = _facts(own.unionByName(values).unionByName(holders), "is_usage").withColumnRenamed("id", "node").distinct()
    usage = F.coalesce((F.col("node_kind") == "field_access") & (F.col("full_path") == field), F.lit(False))
    steps = _steps(steps, nodes, edges, S.TRACE_FORWARD, True, "full_path", "access_kind", "type_string").withColumn("is_usage", usage)
    same = F.coalesce(F.col("full_path").endswith("." + last), F.lit(False)) | F.coalesce(F.col("type_string").contains(package + "."), F.lit(False))
    admitted = (F.col("node_kind") != "field_access") | F.coalesce(F.col("full_path") == field, F.lit(False)) | ((F.col("prev_node_kind") != "field_access") & F.coalesce(F.col("access_kind") == "read", F.lit(False)) & same)
    found = walk_paths(anchors, steps, depth, lambda met: met.where(admitted))
    return found.select(F.col("node").alias("id"), "depth", "name", "edge_kinds", "line", "is_usage").distinct()


def _writers(origins: DataFrame, field: str, func: str, most: int) -> DataFrame:
    """func_id: the function and what it calls to write the field, and they in turn, in queue order (each one's callees by name), until there
    are `most`: then nothing further is called. The queue is a few names on the driver; a level is one join."""
    spark = origins.sparkSession
    calls = keep(origins.where((F.col("access_kind") == "indirect_write") & (F.col("field_path") == field) & F.col("callee_id").isNotNull()).select("function_id", "callee_id").distinct(), "indirect")
    chain, level, last = [func], [func], None
    while level and len(chain) < most:
        at = F.broadcast(spark.createDataFrame(list(enumerate(level)), "place int, function_id string"))  # fewer than `most` rows
        found = keep(calls.join(at, "function_id").where(~F.col("callee_id").isin(*chain)).groupBy("callee_id").agg(F.min("place").alias("place")), "indirect")
        counts = dict(found.groupBy("place").count().collect())  # a row for each name of the queue
        taken, place = len(chain), -1
        while taken < most and place + 1 < len(level):
            place += 1
            taken += counts.get(place, 0)
        new = found.where(F.col("place") <= place)
        if taken >= most:
            last = new.select(F.col("callee_id").alias("func_id"))
            break
        level = [r[0] for r in new.orderBy("place", "callee_id").select("callee_id").collect()]
        chain += level
    functions = spark.createDataFrame([(f,) for f in chain], "func_id string")
    return functions if last is None else functions.unionByName(last)


def trace_indirect(nodes: DataFrame, edges: DataFrame, origins: DataFrame, field: str, func: str, depth: int = DEPTH, steps: DataFrame | None = None) -> DataFrame:
    """Backward over data_flows_to from the writes of the field in the function and in what it calls to write it; the chain of
    functions stops growing at four times the depth."""
    functions = _writers(origins, field, func, 4 * depth)
    writes = nodes.where((F.col("kind") == "field_access") & (F.col("full_path") == field) & (F.col("access_kind") == "write")).join(functions, "func_id", "left_semi")
    more = ("access_kind", "func_id", "full_path")
    anchors = _facts(writes, *more).withColumnRenamed("id", "node")
    found = walk_paths(anchors, _steps(steps, nodes, edges, S.TRACE_INDIRECT, False, *more), depth)
    return found.select(F.col("node").alias("id"), "depth", "name", ids.sorted_edge_kinds(F.col("edge_kinds")).alias("edge_kinds"), "line", F.col("node_kind").alias("kind"), F.col("access_kind").alias("access"), "func_id", "full_path")


def function_flows(nodes: DataFrame, edges: DataFrame, func: str, depth: int = DEPTH, steps: DataFrame | None = None) -> DataFrame:
    """Flows of all fields accessed in a function, inside it: dir 0 towards producers, 1 towards users. Steps onto a field are
    those of the start's field; rows that differ only in the start's field stay apart."""
    more = ("access_kind", "full_path")
    inside = (prepare(nodes, edges) if steps is None else steps).where(F.col("func_id") == func)
    start = _facts(nodes.where((F.col("func_id") == func) & (F.col("kind") == "field_access")), *more).withColumnRenamed("id", "node").withColumn("ctx", F.col("full_path"))
    same = (F.col("node_kind") != "field_access") | F.coalesce(F.col("full_path") == F.col("prev_ctx"), F.lit(False))
    back, ahead = (walk_paths(start.withColumn("dir", F.lit(d)), _steps(inside, nodes, edges, S.FLOWS, bool(d), *more), depth, lambda met: met.where(same)) for d in (0, 1))
    return back.unionByName(ahead.where("depth > 0")).select(F.col("node").alias("id"), "depth", "name", "edge_kinds", "line", "dir", F.col("node_kind").alias("kind"), F.col("access_kind").alias("access"), F.lit(func).alias("func_id"), "full_path")


def _value_filter(container: bool, confidence: float) -> Column:
    """Whether a step is taken: no candidate below the confidence; and onto a field, the anchor's own field, a bridge in the direction, a database column, or an anchor that is
    no field."""
    no = F.lit(False)
    ok = F.coalesce(F.col("full_path") == F.col("ctx"), no) | (F.col("ctx") == "") | F.coalesce(F.col("is_external") == "true", no)
    ok = ok | F.coalesce(F.when(F.col("dir") == 0, F.col("access_kind") == "read").otherwise(F.col("access_kind") == "write"), no)
    if container:
        ok = ok | ((F.col("ctx") != "") & F.coalesce(F.col("inst").startswith(F.col("ctx_inst")) | F.col("ctx_inst").startswith(F.col("inst")), no))
    sure = F.col("edge_origin").isNull() | (F.col("edge_conf") >= confidence)
    return F.col("kind").isin(*S.VALUE_TRACE) & sure & ((F.col("node_kind") != "field_access") | ok)


def _value_rows(nodes: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """Trace rows of (anchor, node, dir, depth, ...): names, files, and the kinds of the edges on the row's side."""
    used = edges.where(F.col("kind").isin(*S.VALUE_TRACE))
    kinds = lambda end, d: used.groupBy(F.col(end).alias("node"), F.lit(d).alias("dir")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("edge_kinds"))
    sides = kinds("target_id", 0).unionByName(kinds("source_id", 1))
    files = nodes.where(F.col("kind").isin("function", "method")).select(F.col("id").alias("func_id"), F.col("file_path").alias("func_file"))
    known = nodes.select(F.col("id").alias("node"), "name", F.col("line_start").alias("line"), "kind", "file_path", F.col("access_kind").alias("access"), "func_id", "full_path")
    rows = found.join(known, "node").join(sides, ["node", "dir"], "left").join(files, "func_id", "left")
    return rows.withColumn("edge_kinds", F.coalesce("edge_kinds", F.lit(""))).withColumn("file_path", F.coalesce(F.when(F.col("file_path") != "", F.col("file_path")), "func_file")).drop("func_file").withColumnRenamed("node", "id")


def value_trace(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, depth: int = DEPTH, confidence: float = 0.0, container: bool = False, steps: DataFrame | None = None) -> DataFrame:
    """Where the values of the anchors (column id) come from (dir 0) and go to (dir 1): a row for each anchor, node and direction, with
    the least depth, the least parent of that depth, and the last dispatch candidate's interface, origin and confidence on
    the way. Candidate edges below the confidence are not followed. Both directions share the levels."""
    info = nodes.select("id", F.when(F.col("kind") == "field_access", F.col("full_path")).alias("p"), F.when(F.col("kind") == "field_access", F.coalesce("instance_path", "full_path")).alias("i"))
    start = anchors.select("id").distinct().join(info, "id", "left").select(F.col("id").alias("anchor"), F.col("id").alias("node"), F.coalesce("p", F.lit("")).alias("ctx"), F.coalesce("i", F.lit("")).alias("ctx_inst"), F.explode(F.array(F.lit(0), F.lit(1))).alias("dir"))
    steps = prepare(nodes, edges) if steps is None else steps
    found = reach_ways(start, steps, depth, ["edge_iface", "edge_origin", "edge_conf"], _value_filter(container, confidence), F.col("dir") == 1)
    return _value_rows(nodes, edges, found.where("dir = 0 or depth > 0").drop("ctx", "ctx_inst"))


def value_trace_multi(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, field: str, depth: int = MULTI_DEPTH, steps: DataFrame | None = None) -> DataFrame:
    """Forward from many anchors (column id) at once, for one field: a row for each node and direction."""
    start = anchors.select("id").distinct().join(nodes.select("id"), "id", "left_semi").select(F.lit("*").alias("anchor"), F.col("id").alias("node"), F.lit(field).alias("ctx"), F.lit(1).alias("dir"))
    steps = prepare(nodes, edges) if steps is None else steps
    found = reach_ways(start, steps, depth, [], _value_filter(False, float("-inf")), F.lit(True))
    starts = found.where("depth = 0").withColumn("dir", F.lit(0))
    return _value_rows(nodes, edges, starts.unionByName(found.where("depth > 0")).drop("ctx", "anchor", "parent"))


def trampoline(nodes: DataFrame, edges: DataFrame, anchor: str, steps: DataFrame | None = None) -> DataFrame:
    """Behind a field write: the first reads of the same field, and where their values go. Empty for any other anchor."""
    own = nodes.where((F.col("id") == anchor) & (F.col("kind") == "field_access") & (F.col("access_kind") == "write")).select("full_path").first()
    empty_field = own is None or not own[0]
    field = "" if empty_field else own[0]
    reads = scan.field_reads(nodes, field).where(F.col("id") != anchor).limit(0 if empty_field else TRAMPOLINE_READS)
    reads = keep(reads, "trampoline")
    first = reads.select("id", F.lit(0).alias("depth"), "name", F.lit("").alias("edge_kinds"), F.col("line_start").alias("line"), F.lit(1).alias("dir"), "kind", "file_path", F.lit("read").alias("access"), "func_id", "full_path", F.lit(0).alias("part"))
    ahead = value_trace_multi(nodes, edges, reads, field, steps=steps).withColumn("part", F.lit(1))
    return first.unionByName(ahead.select(first.columns))


def lifecycle(nodes: DataFrame, edges: DataFrame, anchor: str, steps: DataFrame | None = None) -> DataFrame:
    """The value trace of the anchor and its trampoline, the first row of each node."""
    start = nodes.sparkSession.createDataFrame([(anchor,)], "id string")
    steps = prepare(nodes, edges) if steps is None else steps
    rows = value_trace(nodes, edges, start, steps=steps).withColumn("part", F.lit(-1))
    extra = trampoline(nodes, edges, anchor, steps)
    both = rows.select(extra.columns).unionByName(extra)
    return first_by(both, ["id"], ["part", "dir", "depth", "id"]).drop("part")


def summary_chain(nodes: DataFrame, edges: DataFrame, anchor: str, steps: DataFrame | None = None) -> DataFrame:
    """step, step_kind, name, file_path, line, func: one node of each depth from the sources to the anchor and on to the uses, as entry,
    compute, write and consume; repeated places once."""
    start = nodes.sparkSession.createDataFrame([(anchor,)], "id string")
    steps = prepare(nodes, edges) if steps is None else steps
    spine = keep(first_by(value_trace(nodes, edges, start, steps=steps), ["dir", "depth"], ["id"]), "spine")
    producers = spine.where("dir = 0").withColumn("place", -F.col("depth")).withColumn("part", F.lit(0))
    consumers = spine.where("dir = 1").withColumn("place", F.col("depth")).withColumn("part", F.lit(1))
    few = consumers.groupBy().agg((F.count(F.lit(1)) <= 1).alias("few")).first()[0]
    columns = ["id", "name", "kind", "access", "line", "func_id", "file_path", "part", "place", "sub", "dir"]
    chain = producers.unionByName(consumers).withColumn("sub", F.lit(0)).select(columns)
    if few:
        extra = trampoline(nodes, edges, anchor, steps).withColumn("sub", F.col("part")).withColumn("part", F.lit(2)).withColumn("place", F.col("depth"))
        chain = chain.unionByName(extra.select(columns))
    order = Window.orderBy("part", "sub", "place", "id")  # a chain of some tens of rows
    numbered = chain.withColumn("n", F.row_number().over(order)).withColumn("last", F.count(F.lit(1)).over(Window.partitionBy()))
    field = F.col("kind") == "field_access"
    step_kind = (
        F.when(F.col("n") == 1, "entry").when(F.col("name").startswith("sql.") | F.col("name").startswith("metric"), "write").when(field & (F.col("access") == "write"), "write")
        .when(field & (F.col("access") == "read"), "consume").when(F.col("n") == F.col("last"), "consume").otherwise("compute")
    )
    named = numbered.withColumn("step_kind", step_kind).withColumn("func", ids.short_name(F.coalesce("func_id", F.lit(""))))
    own = Window.partitionBy("name", "file_path", "line", "func").orderBy("n")
    better = F.first(F.when(F.col("step_kind").isin("write", "consume"), F.col("step_kind")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    once = named.withColumn("first", F.row_number().over(own)).withColumn("step_kind", F.when(F.col("step_kind") == "compute", F.coalesce(better, F.col("step_kind"))).otherwise(F.col("step_kind"))).where("first = 1")
    return once.select(F.col("n").alias("step"), "step_kind", "name", "file_path", "line", "func")


#: Lines of a file that are looked up together.
LINES = 64


def path_conditions(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (file_path, line and more) with `condition`: of the innermost range around the line, '' without one. ranges, as extracted from the
    sources: file_path, from_line, to_line, condition. Lines meet ranges by blocks of lines, so a long file is not one group; a null file
    or line is in no range."""
    block = lambda c: F.floor(F.col(c) / LINES)
    blocks = ranges.where("to_line >= from_line").select("*", F.explode(F.sequence(block("from_line"), block("to_line"))).alias("_block"))
    places = rows.select("file_path", "line").distinct().withColumn("_block", block("line"))
    met = places.join(blocks, ["file_path", "_block"]).where(F.col("line").between(F.col("from_line"), F.col("to_line")))
    inner = met.groupBy("file_path", "line").agg(F.min_by("condition", F.struct(F.col("to_line") - F.col("from_line"), "condition")).alias("condition"))
    return rows.join(inner, ["file_path", "line"], "left").select(*(F.col(c) for c in rows.columns), F.coalesce("condition", F.lit("")).alias("condition"))


def marked(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Trace rows with the marks of dispatch candidates."""
    return mark_dispatch(rows, scan.dispatch_targets(edges))
