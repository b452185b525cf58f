"""The graph's data model: record types, enumerations, and the edge kinds that each traversal follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_KINDS = (
    "file", "package", "function", "method", "struct", "interface", "commit", "object", "field_access", "ssa_value",
    "external_summary", "parameter", "receiver", "result", "grpc_service", "http_route",
)
EDGE_KINDS = (
    "calls", "imports", "depends_on", "implements", "modified_by", "references", "data_flows_to", "tests", "initializes", "uses",
    "passes_to", "passes_result", "of_type", "has_method", "argument", "returns", "alias", "phi_operand", "indirect_write",
    "dispatch_to", "summary_io", "has_param", "has_result", "grpc_call", "grpc_impl", "http_call",
)
TOOL_SOURCES = ("scip", "codegraph", "git", "ssa")
SUMMARY_ACCESS = ("direct_read", "direct_write", "indirect_write")
COLUMN_ACCESS = ("read", "write", "filter")
RELATION_RANK = {"read": 0, "write": 1, "query": 2, "fk": 3}
BUILD_STATUS = ("success", "degraded", "failed")
SQL_TYPES = ("sql", "gorm", "xorm")

#: Each traversal has its own set; they are not to be unified.
CALLS = ("calls",)
TRACE_BACK = ("data_flows_to", "argument", "returns", "alias", "phi_operand")
TRACE_FORWARD = TRACE_BACK
TRACE_INDIRECT = ("data_flows_to",)
FLOWS = ("data_flows_to", "phi_operand")
VALUE_TRACE = ("data_flows_to", "argument", "returns", "phi_operand", "summary_io")
PATH_DATA = VALUE_TRACE
PATH_CALLS = ("calls", "passes_to", "passes_result")
RELATIONS = ("data_flows_to", "argument", "returns", "summary_io", "alias", "phi_operand")
CROSSING = ("argument", "returns")
EXPAND = (
    "calls", "imports", "implements", "initializes", "uses", "passes_to", "passes_result", "has_method", "data_flows_to", "argument",
    "returns", "dispatch_to", "has_param", "has_result", "grpc_call", "grpc_impl", "http_call",
)
CALLED_BY = ("calls", "passes_result")
REFERENCED_BY = ("passes_to", "dispatch_to", "initializes")

#: Property keys that queries read; they are columns of their own, so that filters on them reach the scan.
PROMOTED_NODE = ("full_path", "instance_path", "access_kind", "type_string", "func_id", "origin_kind", "is_external", "signature")
PROMOTED_EDGE = {
    "line_num": "int", "call_line": "int", "method": "string", "path": "string", "interface": "string", "candidate_origin": "string", "cand_confidence": "double",
    "origin": "string", "interface_method": "string", "register_site": "string",
}

_S, _I, _D, _L = T.StringType(), T.IntegerType(), T.DoubleType(), T.LongType()
_PROPS = T.MapType(_S, _S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


NODE = _struct(id=_S, kind=_S, name=_S, file_path=_S, line_start=_I, line_end=_I, properties=_PROPS)
EDGE = _struct(source_id=_S, target_id=_S, kind=_S, tool_source=_S, confidence=_D, metadata=_PROPS)
SUMMARY = _struct(function_id=_S, access_kind=_S, field_path=_S, instance_path=_S, line_start=_I, code_snippet=_S)
ORIGIN = _struct(function_id=_S, access_kind=_S, field_path=_S, call_line=_I, callee_id=_S)
BUILD = _struct(build_id=_S, commit_sha=_S, tool_name=_S, status=_S, duration_ms=_L, error_message=_S, nodes_count=_I, edges_count=_I, timestamp=_L)
RULE = _struct(id=_L, from_table=_S, from_col=_S, to_table=_S, to_col=_S, created_at=_L)
RELATION = _struct(from_table=_S, from_col=_S, to_table=_S, to_col=_S, hops=_I, type=_S)
#: One element of an ingest stream: exactly one of its parts is set.
ITEM = _struct(node=NODE, fact=EDGE, summary=SUMMARY, origins=T.ArrayType(ORIGIN))


def promote_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with the promoted keys as columns. A JSON boolean is_external counts as its string."""
    return nodes.select("*", *(F.col("properties")[k].alias(k) for k in PROMOTED_NODE if k not in nodes.columns))


def promote_edges(edges: DataFrame) -> DataFrame:
    keys = {k: ("confidence" if k == "cand_confidence" else k) for k in PROMOTED_EDGE}
    return edges.select("*", *(F.col("metadata")[keys[k]].cast(t).alias(k) for k, t in PROMOTED_EDGE.items() if k not in edges.columns))
