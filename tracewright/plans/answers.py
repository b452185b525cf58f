"""Questions in the command line's words, answered as one JSON text in the contract's form.

``answer`` resolves what is asked about, runs the operator, and puts its rows into the object that the contract names for the
command. An answer is for a reader, so its rows are bounded by the question (one symbol, field or table, or a limit), and come to the
driver; ``relations`` of all tables are exported by sources.sinks instead. Empty values are left out, as in the contract.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import affinity as A
from ..operators import bundle, callgraph, deadcode, modules, relations, scan, trace
from ..sources.sinks import as_json
from . import shop


def _rows(df: DataFrame, *columns: str) -> list[dict]:
    """The rows as objects. Columns may be given as `name:shown`."""
    if columns:
        pairs = [c.partition(":") for c in columns]
        df = df.select(*(F.col(a).alias(b or a) for a, _, b in pairs))
    return [json.loads(r[0]) for r in as_json(df).collect()]


def _one(g: shop.Graph, id_: str) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(id_,)], "id string")


_NODE = ("id", "name", "kind", "file_path:file", "line_start:line")
_FLOW = ("id", "name", "depth", "dir", "edge_kinds:edge", "line", "kind", "access", "func_id")


def _symbol(g, name):
    id_ = callgraph.resolve_symbol(g.nodes, name)
    shown = _rows(scan.node_by_id(g.nodes, id_), *_NODE)[0]
    ends = {"callers": (callgraph.callers, "source_id"), "callees": (callgraph.callees, "target_id")}
    return shown | {part: _rows(f(g.edges, _one(g, id_)).orderBy(end), f"{end}:id", "confidence") for part, (f, end) in ends.items()}


def _around(f: Callable) -> Callable:
    def ask(g, name, depth=1):
        id_ = callgraph.resolve_symbol(g.nodes, name)
        end = "source_id" if f is callgraph.callers else "target_id"
        found = f(g.edges, _one(g, id_), depth).select(F.col(end).alias("id")).distinct()
        return {"target": id_, "rows": _rows(g.nodes.join(found, "id", "left_semi").orderBy("name", "id"), *_NODE)}

    return ask


def _impact(g, name, depth=3):
    id_ = callgraph.resolve_symbol(g.nodes, name)
    found = callgraph.impact(g.nodes, g.edges, _one(g, id_), depth, limit=2000).select("id")
    return {"target": id_, "nodes": _rows(g.nodes.join(found, "id", "left_semi").orderBy("name", "id"), *_NODE)}


def _fields(g, name):
    id_ = callgraph.resolve_symbol(g.nodes, name)
    fields = scan.with_dispatch(scan.function_fields(g.summary, g.origins, id_), g.edges)
    return {"name": _rows(scan.node_by_id(g.nodes, id_), "name")[0]["name"], "rows": _rows(fields.orderBy("field_path", "access_kind"), "access_kind", "field_path", "line_start:line", "origins")}


def _context(g, name):
    parts = bundle.context(g.nodes, g.edges, g.summary, g.origins, callgraph.resolve_symbol(g.nodes, name), steps=g.steps)
    fields = {k: _rows(parts["fields"].where(F.col("access_kind") == k).orderBy("field_path"), "field_path", "origins") for k in ("direct_read", "direct_write", "indirect_write")}
    lists = {"chain": _rows(parts["chain"].orderBy("step")), "traces": _rows(parts["trace"].orderBy("dir", "depth", "id"), *_FLOW), "dispatch": _rows(parts["dispatch"]), "callers": _rows(parts["callers"].orderBy("source_id"), "source_id:id", "confidence"), "callees": _rows(parts["callees"].orderBy("target_id"), "target_id:id", "confidence")}
    return {"symbol": _rows(parts["symbol"], *_NODE)[0]} | ({"fields": {k: v for k, v in fields.items() if v}} if any(fields.values()) else {}) | {k: v for k, v in lists.items() if v}


def _field_trace(f: Callable, *more: str) -> Callable:
    def ask(g, field, func, depth=trace.DEPTH):
        found = f(g.nodes, g.edges, field, callgraph.resolve_symbol(g.nodes, func), depth, g.steps)
        return {"flows": _rows(found.orderBy("depth", "id", "edge_kinds"), "id", "name", "depth", "edge_kinds:edge", "line", *more)}

    return ask


def _value_trace(g, anchor, depth=trace.DEPTH, confidence=0.0, container=False):
    start = _one(g, callgraph.resolve_anchor(g.nodes, anchor))
    found = trace.marked(trace.value_trace(g.nodes, g.edges, start, depth, confidence, container, g.steps), g.edges)
    return {"flows": _rows(found.orderBy("dir", "depth", "id"), *_FLOW, "dispatch_candidate:dispatch", "edge_origin:edge_candidate")}


def _summary(g, field):
    rows = g.summary.where(F.col("field_path") == field)
    sides = {"producers": rows.where("access_kind <> 'direct_read'"), "consumers": rows.where("access_kind = 'direct_read'")}
    return {k: _rows(v.orderBy("function_id"), "function_id:function", "access_kind:access", "line_start:line") for k, v in sides.items()}


def _table(g, name):
    tables = scan.resolve_table(scan.table_names(g.nodes), name)
    return _rows(relations.table_columns(g.nodes, g.edges, tables).orderBy("column_name"))


def _relations(g, name):
    tables = scan.resolve_table(scan.table_names(g.nodes), name)
    return _rows(relations.shown(relations.dedup(relations.best_of(relations.infer(g.nodes, g.edges, tables)))))


def _table_path(g, start, end, max_hops=6):
    steps = _rows(relations.table_path(relations.infer(g.nodes, g.edges), start, end, max_hops).orderBy("path_no", "step"))
    first = [s for s in steps if s["path_no"] == 1]
    return {"path": first, "candidates": [s for s in steps if s["path_no"] > 1], "hops": len(first), "reachable": bool(first) or start == end}


def _path(g, start, end, via="data"):
    return {"path": _rows(callgraph.shortest_path(g.edges, start, end, via).orderBy("step"))}


def _unused(g, limit=0):
    dead = deadcode.uncalled(g.nodes, g.edges).orderBy("file_path", "line_start", "id")
    return {"unused": _rows(dead.limit(limit) if limit else dead, *_NODE, "exported", "referenced"), "total": dead.count()}


def _module_calls(g, module_table):
    calls = modules.module_calls(g.nodes, g.edges, module_table)
    service = F.when(F.col("kind") == "grpc_call", A.column_after_table(F.substring_index("target_id", ":", -1)))
    return {"calls": _rows(calls.select("from_module", "to_module", service.alias("service"), "method", F.split("kind", "_")[0].alias("transport"), F.col("source_id").alias("caller"), "line").orderBy("from_module", "to_module", "caller", "line"))}


COMMANDS: dict[str, Callable] = {
    "symbol": _symbol, "context": _context, "fields": _fields, "callers": _around(callgraph.callers), "callees": _around(callgraph.callees), "impact": _impact,
    "trace-backward": _field_trace(trace.trace_backward), "trace-forward": _field_trace(trace.trace_forward, "is_usage"), "value-trace": _value_trace, "summary": _summary, "table": _table,
    "relations": _relations, "table-path": _table_path, "path": _path, "unused": _unused, "module-calls": _module_calls,
    "search": lambda g, name: _rows(scan.search(g.nodes, name), *_NODE),
}


def answer(g: shop.Graph, command: str, *args, **options) -> str:
    """The JSON text of a command's answer. A command or symbol that does not exist, or several symbols of one name, are a LookupError."""
    if command not in COMMANDS:
        raise LookupError(f"no command {command}; there are {', '.join(sorted(COMMANDS))}")
    return json.dumps(COMMANDS[command](g, *args, **options), ensure_ascii=False)
