"""Small literal graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from tracewright import render
from tracewright import schema as S
from tracewright.operators import callgraph, closure, deadcode, ingest, modules, relations, scan, trace, virtual_columns
from tracewright.sources import readers, sinks
from tracewright.streaming import items

PROPS = ("full_path", "instance_path", "access_kind", "type_string", "func_id", "origin_kind", "is_external")


def nodes_of(spark, rows):
    """rows: id, kind, name, file_path, line_start and properties."""
    made = [{"id": i, "kind": k, "name": n, "file_path": f, "line_start": line, "line_end": line + 1, "properties": {a: str(b) for a, b in p.items()}} for i, k, n, f, line, p in rows]
    return S.promote_nodes(spark.createDataFrame(made, S.NODE))


def edges_of(spark, rows):
    """rows: source, target, kind, confidence and metadata."""
    made = [{"source_id": a, "target_id": b, "kind": k, "tool_source": "ssa", "confidence": float(c), "metadata": {x: str(y) for x, y in (m[0] if m else {}).items()}} for a, b, k, c, *m in rows]
    return S.promote_edges(spark.createDataFrame(made, S.EDGE))


def fn(i, name=None, file="a.go", **props):
    return (i, "function", name or i, file, 1, props)


def field(i, func, path, access, line=1, name=None, **props):
    return (i, "field_access", name or path, "a.go", line, {"full_path": path, "func_id": func, "access_kind": access, **props})


def value(i, func, **props):
    return (i, "ssa_value", i, "a.go", 1, {"func_id": func, **props})


def anchors(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_callers_and_callees(spark):
    edges = edges_of(spark, [("a", "b", "calls", 0.5), ("b", "c", "calls", 0.9)])
    assert callgraph.callees(edges, anchors(spark, "a"), 2, 0.8).count() == 0
    assert callgraph.callees(edges, anchors(spark, "a"), 1, 0.1).count() == 1
    assert callgraph.callees(edges, anchors(spark, "a"), 0, 0.1).count() == 1
    assert callgraph.callees(edges, anchors(spark, "a"), 2, 0.1).count() == 2
    assert callgraph.callers(edges, anchors(spark, "c"), 2, 0.1).count() == 2


def test_impact(spark):
    nodes = nodes_of(spark, [fn(x) for x in "abcd"])
    edges = edges_of(spark, [("a", "b", "calls", 1), ("b", "c", "calls", 1), ("a", "d", "imports", 1), ("c", "gone", "calls", 1)])
    found = {r.id: r.depth for r in callgraph.impact(nodes, edges, anchors(spark, "b"), 2).collect()}
    assert found == {"a": 1, "c": 1, "d": 2, "b": 2}


def test_roots(spark):
    nodes = nodes_of(spark, [fn("m", "main"), fn("p.test:main", "main"), fn("h", serves_http="true"), fn("g", serves_grpc="true"), fn("o", "main", "../x.go"), fn("t", "main", "a_test.go"), fn("helper")])
    assert ids(callgraph.entry_points(nodes)) == ["g", "h", "m"]


def test_framework_structs(spark):
    p = "symbol:go:p:"
    nodes = nodes_of(spark, [(p + "T", "struct", "T", "t.go", 1, {}), (p + "U", "struct", "U", "u.go", 1, {}), (p + "(T).m", "method", "(T).m", "t.go", 2, {}), (p + "(U).m", "method", "(U).m", "u.go", 2, {}), (p + "f", "function", "f", "f.go", 1, {})])
    edges = edges_of(spark, [(p + "f", p + "(U).m", "calls", 1), (p + "(T).m", p + "(T).m", "calls", 1)])
    assert ids(callgraph.framework_structs(nodes, edges)) == [p + "T"]


def test_path(spark):
    edges = edges_of(spark, [("a#v0", "a#f.write@2", "data_flows_to", 1), ("a#f.write@2", "b#f.read@3", "argument", 1), ("b#f.read@3", "b#v1", "data_flows_to", 1), ("b#v1", "a#v0", "returns", 1)])
    path = callgraph.shortest_path(edges, "a#v0", "b#v1").orderBy("step").collect()
    assert [(r.id, r.edge_kinds) for r in path] == [("a#v0", ""), ("a#f.write@2", "data_flows_to"), ("b#f.read@3", "argument"), ("b#v1", "data_flows_to")]
    assert callgraph.shortest_path(edges, "b#v1", "b#v1").count() == 1
    assert callgraph.shortest_path(edges, "a#v0", "nowhere").count() == 0
    assert callgraph.shortest_path(edges, "a#v0", "b#v1", "calls").count() == 0


def test_symbols(spark):
    nodes = nodes_of(spark, [fn("symbol:go:p:f", "f"), fn("symbol:go:q:f", "f"), fn("symbol:go:p:g", "g"), field("p#x.read@3", "p", "T.X", "read", 3)])
    assert callgraph.resolve_symbol(nodes, "g") == callgraph.resolve_symbol(nodes, "symbol:go:p:g") == "symbol:go:p:g"
    with pytest.raises(LookupError, match="ambiguous"):
        callgraph.resolve_symbol(nodes, "f")
    assert callgraph.resolve_anchor(nodes, "T.X") == "p#x.read@3"
    assert ids(scan.search(nodes, "P:G")) == ["symbol:go:p:g"]
    assert ids(scan.search(nodes, "f")) == ["symbol:go:p:f", "symbol:go:q:f"]
    assert ids(scan.search(nodes, "_")) == []


def flows_graph(spark):
    nodes = nodes_of(spark, [field("f#x.A.write@3", "f", "T.A", "write", 3), value("f#t1", "f"), field("f#x.A.read@5", "f", "T.A", "read", 5), field("g#y.B.write@9", "g", "U.B", "write", 9)])
    edges = edges_of(spark, [("f#x.A.write@3", "f#t1", "data_flows_to", 1), ("f#t1", "f#x.A.read@5", "data_flows_to", 1), ("f#x.A.write@3", "g#y.B.write@9", "data_flows_to", 1)])
    return nodes, edges


def test_flows(spark):
    rows = trace.function_flows(*flows_graph(spark), "f").collect()
    found = {(r.id, r.dir, r.depth) for r in rows}
    assert len(rows) == 6 and "g#y.B.write@9" not in {r.id for r in rows}
    assert {("f#t1", 1, 1), ("f#x.A.read@5", 1, 2), ("f#x.A.write@3", 0, 2)} <= found


def test_trace_backward_and_forward(spark):
    nodes, edges = flows_graph(spark)
    back = trace.trace_backward(nodes, edges, "T.A", "f").collect()
    assert {(r.id, r.depth, r.edge_kinds) for r in back} == {("f#x.A.write@3", 0, ""), ("f#x.A.read@5", 0, ""), ("f#t1", 1, "data_flows_to"), ("f#x.A.write@3", 2, "data_flows_to,data_flows_to")}
    ahead = trace.trace_forward(nodes, edges, "T.A", "f").collect()
    assert {(r.id, r.depth) for r in ahead} == {("f#x.A.write@3", 0), ("f#x.A.read@5", 0), ("f#t1", 1), ("f#x.A.read@5", 2)}
    assert all(r.is_usage == (r.id != "f#t1") for r in ahead)
    origins = spark.createDataFrame([("f", "indirect_write", "U.B", 1, "g"), ("g", "indirect_write", "U.B", 1, "f")], S.ORIGIN)
    far = trace.trace_indirect(nodes, edges, origins, "U.B", "f").collect()
    assert {(r.id, r.depth) for r in far} == {("g#y.B.write@9", 0), ("f#x.A.write@3", 1)}


def test_value_trace(spark):
    nodes = nodes_of(spark, [value("g#t0", "g"), ("f#a", "parameter", "a", "", 1, {"func_id": "f"}), field("f#a.X.read@3", "f", "T.X", "read", 3), fn("f", file="f.go"), fn("g", file="g.go")])
    edges = edges_of(spark, [("g#t0", "f#a", "argument", 1, {"candidate_origin": "register", "interface": "I", "confidence": 0.7}), ("f#a", "f#a.X.read@3", "data_flows_to", 1)])
    rows = {r.id: r for r in trace.value_trace(nodes, edges, anchors(spark, "f#a.X.read@3")).collect()}
    assert len(rows) == 3
    assert (rows["f#a"].depth, rows["f#a"].dir, rows["f#a"].file_path) == (1, 0, "f.go")
    assert (rows["g#t0"].depth, rows["g#t0"].func_id, rows["g#t0"].parent) == (2, "g", "f#a")
    assert (rows["g#t0"].edge_iface, rows["g#t0"].edge_origin, rows["g#t0"].edge_conf) == ("I", "register", 0.7)
    assert trace.value_trace(nodes, edges, anchors(spark, "f#a.X.read@3"), confidence=0.8).count() == 2
    text = render.trace_tree(trace.value_trace(nodes, edges, anchors(spark, "f#a.X.read@3")))
    assert "  T.X:3" in text and "a:1" in text


def test_value_trace_multi_and_lifecycle(spark):
    nodes = nodes_of(spark, [field("f#w", "f", "T.A", "write", 1), field("f#r1", "f", "T.A", "read", 2), field("f#r2", "f", "T.A", "read", 3), value("f#v1", "f"), value("f#v2", "f"), value("f#out", "f")])
    edges = edges_of(spark, [("f#r1", "f#v1", "data_flows_to", 1), ("f#v1", "f#out", "data_flows_to", 1), ("f#r2", "f#v2", "data_flows_to", 1), ("f#v2", "f#out", "data_flows_to", 1)])
    multi = {(r.id, r.dir, r.depth) for r in trace.value_trace_multi(nodes, edges, anchors(spark, "f#r1", "f#r2"), "T.A").collect()}
    assert multi == {("f#r1", 0, 0), ("f#r2", 0, 0), ("f#v1", 1, 1), ("f#v2", 1, 1), ("f#out", 1, 2)}
    assert ids(trace.lifecycle(nodes, edges, "f#w")) == ["f#out", "f#r1", "f#r2", "f#v1", "f#v2", "f#w"]
    chain = [r.step_kind for r in trace.summary_chain(nodes, edges, "f#w").orderBy("step").collect()]
    assert chain[0] == "entry" and "consume" in chain


def test_conditions_take_the_innermost_range(spark):
    rows = spark.createDataFrame([("a.go", n) for n in range(3, 9)], "file_path string, line int")
    ranges = spark.createDataFrame([("a.go", 4, 7, "a > 0"), ("a.go", 5, 6, "b")], "file_path string, from_line int, to_line int, condition string")
    assert {r.line: r.condition for r in trace.path_conditions(rows, ranges).collect()} == {3: "", 4: "a > 0", 5: "b", 6: "b", 7: "a > 0", 8: ""}


def test_uncalled(spark):
    g = "symbol:go:p:var.G"
    nodes = nodes_of(spark, [*(fn(x) for x in ("dead", "calleeOnly", "reg", "impl", "ctor", "initRef", "main")), value("initRef#t0", "initRef")])
    edges = edges_of(spark, [("main", "calleeOnly", "calls", 1), ("main", "reg", "passes_to", 1), ("main", "impl", "dispatch_to", 1), ("main", "ctor", "initializes", 1), ("initRef#t0", g, "data_flows_to", 1)])
    flags = {r.id: (r.called, r.referenced) for r in deadcode.functions_with_flags(nodes, edges).collect()}
    assert flags == {"dead": (False, False), "calleeOnly": (True, False), "reg": (False, True), "impl": (False, True), "ctor": (False, True), "initRef": (False, True)}


def test_isolated_chains(spark):
    nodes = nodes_of(spark, [fn(x) for x in ("a", "b", "c", "x", "y", "z", "main", "p", "q", "solo")])
    edges = edges_of(spark, [("a", "b", "calls", 1), ("b", "c", "calls", 1), ("x", "y", "calls", 1), ("main", "z", "calls", 1), ("z", "y", "calls", 1), ("p", "q", "calls", 1), ("q", "p", "calls", 1)])
    chains = {}
    for r in deadcode.isolated_chains(nodes, edges).collect():
        chains.setdefault((r.head, r.is_cycle), set()).add(r.id)
    assert chains == {("a", False): {"a", "b", "c"}, ("x", False): {"x"}, ("solo", False): {"solo"}, ("p", True): {"p", "q"}}
    dead, isolated = deadcode.unused_report(nodes, edges)
    assert deadcode.fails(dead, isolated, "unused") and deadcode.fails(dead, isolated, "isolated")


def column(i, name, access, line=1):
    return (i, "field_access", name, "a.go", line, {"full_path": name, "access_kind": access, "func_id": i.split("#")[0], "type_string": "sql", "is_external": "true"})


def related(df):
    return {(r.from_table, r.from_col, r.to_table, r.to_col): (r.hops, r.type) for r in df.collect()}


def test_simple_relation(spark):
    nodes = nodes_of(spark, [column("f#a", "table_a.id", "read", 6), value("f#t4", "f"), value("f#x", "f"), column("f#b", "table_b.a_id", "filter", 9), column("f#c", "table_c.z", "read")])
    edges = edges_of(spark, [("f#a", "f#t4", "summary_io", 1), ("f#t4", "f#x", "data_flows_to", 1), ("f#x", "f#b", "summary_io", 1)])
    one = spark.createDataFrame([("table_a",)], "table_name string")
    found = related(relations.infer(nodes, edges, one))
    assert found == {("table_a", "id", "table_b", "a_id"): (3, "fk")}
    assert not any(k[0] == "table_c" for k in related(relations.infer(nodes, edges)))


def test_taint_decides_the_type(spark):
    nodes = nodes_of(spark, [column("f#a", "table_a.id", "read"), value("f#o1", "f", type_string="*T"), field("f#o1.Id", "f", "T.Id", "read", name="T.Id"), value("f#v1", "f"), column("f#b", "table_b.item_id", "filter"), value("f#o2", "f", type_string="*U"), field("f#o2.B", "f", "U.BuyerId", "read", name="U.BuyerId"), value("f#v2", "f"), column("f#c", "table_c.member_id", "filter")])
    edges = edges_of(spark, [("f#a", "f#o1", "summary_io", 1), ("f#o1", "f#o1.Id", "data_flows_to", 1), ("f#o1.Id", "f#v1", "data_flows_to", 1), ("f#v1", "f#b", "summary_io", 1), ("f#a", "f#o2", "summary_io", 1), ("f#o2", "f#o2.B", "data_flows_to", 1), ("f#o2.B", "f#v2", "data_flows_to", 1), ("f#v2", "f#c", "summary_io", 1)])
    found = related(relations.infer(nodes, edges, spark.createDataFrame([("table_a",)], "table_name string")))
    assert found[("table_a", "id", "table_b", "item_id")][1] == "fk"
    assert found[("table_a", "id", "table_c", "member_id")][1] == "query"


def test_filter_columns_raise_writes(spark):
    rows, links = [], []
    for k, (start, end, end_table) in enumerate([("biz_id", "biz_id", "b_tab"), ("biz_id", "order_id", "c_tab"), ("create_time", "create_time", "b_tab")]):
        rows += [column(f"f#s{k}", f"a_tab.{start}", "read"), value(f"f#v{k}", "f"), column(f"f#e{k}", f"{end_table}.{end}", "write")]
        links += [(f"f#s{k}", f"f#v{k}", "summary_io", 1), (f"f#v{k}", f"f#e{k}", "summary_io", 1)]
    rows += [column("g#1", "b_tab.biz_id", "filter"), column("g#2", "b_tab.create_time", "filter")]
    found = related(relations.infer(nodes_of(spark, rows), edges_of(spark, links), spark.createDataFrame([("a_tab",)], "table_name string")))
    assert found[("a_tab", "biz_id", "b_tab", "biz_id")][1] == "fk"
    assert found[("a_tab", "biz_id", "c_tab", "order_id")][1] == "write"
    assert found[("a_tab", "create_time", "b_tab", "create_time")][1] == "write"


def test_tables(spark):
    nodes = nodes_of(spark, [column("1", "table_a.id", "read"), column("2", "table_a.title", "read"), column("3", "table_b.id", "read"), ("4", "field_access", "table_c.z", "a.go", 1, {"type_string": "sql", "is_external": "false"}), column("5", "a.b.c", "read")])
    assert ids(scan.table_names(nodes), "table_name") == ["table_a", "table_b"]
    assert {r.table_name: r.columns for r in relations.er_tables(nodes).collect()} == {"table_a": ["id", "title"], "table_b": ["id"]}


def test_rules_and_paths(spark):
    nodes = nodes_of(spark, [column("1", "users.id", "read"), column("2", "orders.user_id", "filter"), column("3", "carts.user_id", "read"), column("4", "users.name", "read")])
    stated = relations.of_rules(nodes, readers.rules(spark, ["user_id -> users", "carts.user_id to users.id", "carts.none -> users.id"]))
    assert sorted(related(stated)) == [("carts", "user_id", "users", "id"), ("orders", "user_id", "users", "id")]
    weak = spark.createDataFrame([("carts", "user_id", "users", "id", 3, "read")], S.RELATION)
    assert [(r.type, r.is_rule) for r in relations.with_rules(weak, stated).where("from_table = 'carts'").collect()] == [("fk", True)]
    path = relations.table_path(stated, "orders", "carts").orderBy("step").collect()
    assert [(r.from_table, r.to_table) for r in path] == [("orders", "users"), ("users", "carts")]
    assert relations.table_path(stated, "orders", "carts", max_hops=1).count() == 0
    with pytest.raises(ValueError, match="no rule"):
        readers.rules(spark, ["nonsense"])


def test_upserts(spark):
    rows = [("a", "function", "a", "x.go", 1, 2, {"k": "1", "gone": "x"}, 1), ("a", "method", "b", "y.go", 9, 9, {"k": "2", "gone": None, "n": "3"}, 2)]
    nodes = spark.createDataFrame([dict(zip([*S.NODE.fieldNames(), "seq"], r, strict=True)) for r in rows], "id string, kind string, name string, file_path string, line_start int, line_end int, properties map<string,string>, seq long")
    only = ingest.upsert_nodes(nodes).collect()
    assert [(r.kind, r.file_path, r.properties) for r in only] == [("function", "x.go", {"k": "2", "n": "3"})]
    edges = spark.createDataFrame([("a", "b", "calls", "one", 0.5, 1), ("a", "b", "calls", "two", 0.9, 2), ("a", "b", "calls", "three", 0.9, 3), ("a", "c", "calls", "four", None, 4)], "source_id string, target_id string, kind string, tool_source string, confidence double, seq long")
    assert {(r.target_id, r.tool_source, r.confidence) for r in ingest.upsert_edges(edges).collect()} == {("b", "two", 0.9), ("c", "four", 0.5)}


def test_status_and_cache(spark):
    assert [ingest.build_status(e) for e in ({"scip": "x"}, {"git": "x", "scip": None}, {})] == ["failed", "degraded", "success"]
    assert ingest.needs_full_build("a", "b") and not ingest.needs_full_build("a", "a")
    rules = spark.createDataFrame([], S.RULE)
    one = ingest.add_rule(ingest.add_rule(rules, "a_id", "t"), "b_id", "u", from_table="x")
    assert [(r.id, r.to_col) for r in one.orderBy("id").collect()] == [(1, "id"), (2, "id")]
    assert ingest.remove_rule(one, 1).count() == 1
    repos = spark.createDataFrame([("/a", "a", None), ("/a/w", "w", "/a")], "path string, name string, main_path string")
    assert [r.name for r in ingest.upsert_repos(repos, spark.createDataFrame([("/a", "new", None)], repos.schema)).where("path = '/a'").collect()] == ["new"]
    assert ingest.remove_repo(repos, "/a").count() == 0


def test_incremental_build(spark):
    nodes = spark.createDataFrame([dict(zip(S.NODE.fieldNames(), r, strict=True)) for r in [("f", "function", "f", "f.go", 1, 2, {}), ("g", "function", "g", "g.go", 1, 2, {})]], S.NODE)
    edges = spark.createDataFrame([("f", "g", "calls", "t", 1.0, {}), ("g", "f", "calls", "t", 1.0, {})], S.EDGE)
    summary = spark.createDataFrame([("f", "direct_read", "T.A", "", 1, "")], S.SUMMARY)
    origins = spark.createDataFrame([("f", "indirect_write", "T.A", 1, "g")], S.ORIGIN)
    fresh_nodes = nodes.where("id = 'g'").unionByName(nodes.where("id = 'f'").withColumn("line_start", F.lit(7)))
    files = spark.createDataFrame([("f.go",)], "file_path string")
    n, e, s, o = ingest.incremental((nodes, edges, summary, origins), (fresh_nodes, edges.where("source_id = 'f'"), summary, origins), files)
    assert {r.id: r.line_start for r in n.collect()} == {"f": 7, "g": 1}
    assert [(r.source_id, r.target_id) for r in e.collect()] == [("f", "g")] and s.count() == o.count() == 1


def test_indirect_writes(spark):
    direct = spark.createDataFrame([("leaf", "p.T.A"), ("leaf", "p.U.B")], "function_id string, field_path string")
    calls = spark.createDataFrame([("mid", "leaf", 3, ["p.T"], ["x"]), ("top", "mid", 5, ["p.T"], ["y"]), ("top", "mid", 8, ["p.T"], ["z"]), ("leaf", "top", 9, ["p.T"], ["w"])], "caller_id string, callee_id string, call_line int, arg_paths array<string>, arg_names array<string>")
    summaries, origins, edges = closure.indirect_writes(direct, calls)
    assert {(r.function_id, r.field_path, r.call_line) for r in summaries.collect()} == {("mid", "p.T.A", 3), ("top", "p.T.A", 5), ("top", "p.T.A", 8), ("leaf", "p.T.A", 9)}
    assert {(r.source_id, r.target_id, r.call_line, r.call_args) for r in edges.collect()} == {("mid", "leaf", 3, "x"), ("top", "mid", 5, "y"), ("leaf", "top", 9, "w")}
    out = spark.createDataFrame([("mid", "leaf", "p.T.A")], "caller_id string, callee_id string, field_path string")
    assert closure.indirect_writes(direct, calls, out)[1].count() == 0


def test_aliases_and_dispatch(spark):
    points = closure.may_alias(spark.createDataFrame([("a", "o1"), ("b", "o2")], "value string, allocation string"), spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "a")], "src string, dst string"))
    assert {(r.value, r.allocation) for r in points.collect()} == {("a", "o1"), ("a", "o2"), ("b", "o2"), ("c", "o1"), ("c", "o2")}
    assert closure.alias_pairs(points.withColumn("func_id", F.lit("f"))).count() == 3
    calls = spark.createDataFrame([("f", "I", "m")], "function_id string, interface string, method string")
    methods = spark.createDataFrame([("I", "m", "T", "T.m"), ("I", "m", "U", "U.m")], "interface string, method string, type string, function_id string")
    seen = spark.createDataFrame([("I", "T", "x.go:3")], "interface string, type string, site string")
    assert {(r.target_id, r.confidence, r.origin) for r in closure.dispatch_edges(calls, seen, methods).collect()} == {("T.m", 0.9, "register"), ("U.m", 0.7, "enum")}
    fields = spark.createDataFrame([("A", "b", "B"), ("B", "c", "C"), ("C", "a", "A")], "owner string, name string, type string")
    assert sorted(r.path for r in closure.owned_fields(fields, 3).where("owner = 'A'").collect()) == ["b", "b.c", "b.c.a"]


def test_orm_columns(spark):
    fields = spark.createDataFrame([("Order", "ID", 'gorm:"primaryKey"'), ("Order", "BuyerID", 'gorm:"column:buyer"'), ("Order", "Skip", 'gorm:"-"')], "entity string, field string, tag string")
    mapping = virtual_columns.orm_mapping(fields, spark.createDataFrame([], "entity string, tbl string"))
    assert {(r.tbl, r.col) for r in mapping.collect()} == {("orders", "id"), ("orders", "buyer")}
    facts = spark.createDataFrame([("f", 4, "Find", "gorm", "Order", "f#o", "buyer = ?", ["f#b"])], "func_id string, line int, method string, orm string, entity string, object string, condition string, args array<string>")
    nodes, edges = virtual_columns.from_orm(facts, mapping, spark.createDataFrame([("Find", "gorm", "read")], "method string, orm string, action string"))
    assert ids(nodes) == ["f#ext.gorm.orders.buyer.filter@4", "f#ext.gorm.orders.buyer.read@4", "f#ext.gorm.orders.id.read@4"]
    assert ("f#b", "f#ext.gorm.orders.buyer.filter@4") in {(r.source_id, r.target_id) for r in edges.collect()}


def test_sql_columns(spark):
    facts = spark.createDataFrame([("f", 2, "UPDATE users SET name = ? WHERE id = ?", ["n", "i"], None), ("f", 5, "SELECT u.x FROM users u JOIN orders o ON u.id = o.uid WHERE o.k = $1", ["k"], "r")], "func_id string, line int, sql string, args array<string>, result string")
    nodes, edges = virtual_columns.from_sql(facts)
    pairs = {(r.source_id, r.target_id) for r in edges.collect()}
    e = "f#ext.sql."
    assert pairs == {("n", e + "users.name.write@2"), ("i", e + "users.id.filter@2"), (e + "users.x.read@5", "r"), ("k", e + "users.k.filter@5"), (e + "users.id.filter@5", e + "orders.uid.filter@5")}
    assert nodes.count() == 6


def test_module_calls(spark):
    nodes = nodes_of(spark, [("symbol:proto:x:svc.S", "grpc_service", "S", "", 1, {}), ("symbol:go:m/gen:svc.S", "grpc_service", "S", "", 1, {})])
    edges = edges_of(spark, [("symbol:go:m/a:f", "symbol:proto:x:svc.S", "grpc_call", 1, {"method": "Get"}), ("symbol:go:m/gen:svc.S", "symbol:go:m/b/c:(T).Get", "grpc_impl", 1)])
    mods = spark.createDataFrame([("m", "root"), ("m/b", "bee"), ("m/bx", "no")], "prefix string, name string")
    calls = modules.module_calls(nodes, edges, mods)
    assert [(r.from_module, r.to_module, r.method) for r in calls.collect()] == [("root", "bee", "Get")]
    assert 'root -->|"grpc Get"| bee' in render.modules_mermaid(modules.module_edges(calls))


def test_routes(spark):
    urls = spark.createDataFrame([("http://h/api/orders/12?x=1",), ("/static/a/b.js",), ("h2",)], "url string")
    routes = spark.createDataFrame([("/api/orders/{id}",), ("/static/",), ("/api/orders/12",), ("/api/{x}",)], "route string")
    assert {(r.url, r.host, r.route) for r in modules.match_routes(urls, routes).collect()} == {("http://h/api/orders/12?x=1", "h", "/api/orders/{id}"), ("http://h/api/orders/12?x=1", "h", "/api/orders/12"), ("/static/a/b.js", "", "/static/")}


def test_config_texts(spark):
    specs = readers.field_summaries(spark, "summaries:\n  - func: a.B\n    kind: write\n    id_arg: 0\n    writes: [x, y]\n  - iface: I\n    method: Get\n")
    rows = specs.collect()
    assert (rows[0].id_arg, rows[0].writes, rows[1].id_arg) == (0, ["x", "y"], None)
    assert [tuple(r) for r in readers.modules(spark, "modules:\n  - prefix: m/a\n    name: a\n").collect()] == [("m/a", "a")]
    assert [r.route for r in readers.routes(spark, "routes:\n  - path: /x/{id}\n    handler: h\n").collect()] == ["/x/{id}"]


def test_streamed_items(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"node": {"id": "a", "kind": "function", "name": "a", "properties": {"k": "1"}}}\n{"fact": {"source_id": "a", "target_id": "b", "kind": "calls", "confidence": 0.5}}\n')
    out = str(tmp_path / "graph")
    items.ingest_stream(spark, str(source), out, str(tmp_path / "ck")).awaitTermination()
    (source / "2.json").write_text('{"node": {"id": "a", "kind": "method", "name": "z", "properties": {"k": "2"}}}\n{"fact": {"source_id": "a", "target_id": "b", "kind": "calls", "confidence": 0.9}}\n{"origins": [{"function_id": "a", "access_kind": "indirect_write", "field_path": "T.A", "call_line": 3, "callee_id": "b"}]}\n')
    items.ingest_stream(spark, str(source), out, str(tmp_path / "ck")).awaitTermination()
    now = items.latest(spark, out)
    assert [(r.name, r.properties) for r in now["nodes"].collect()] == [("a", {"k": "2"})]
    assert [r.confidence for r in now["edges"].collect()] == [0.9] and now["origins"].count() == 1
    last = items.versions(spark, out)[-1]
    items.merge_batch(readers.items(spark, str(source / "2.json")).drop("seq"), last, out)
    assert items.latest(spark, out)["edges"].count() == 1


def test_sinks(spark, tmp_path):
    summary = spark.createDataFrame([("f", "direct_write", "T.A", "", 1, ""), ("g", "direct_read", "T.A", "", 1, "")], S.SUMMARY)
    sinks.export_index(summary, str(tmp_path / "index"))
    assert [(r.producers, r.consumers) for r in spark.read.json(str(tmp_path / "index")).collect()] == [(["f"], ["g"])]
    edges = edges_of(spark, [("a", "b", "calls", 1)]).select(S.EDGE.fieldNames())
    sinks.write_graph(str(tmp_path / "g"), edges=edges)
    assert readers.graph_table(spark, str(tmp_path / "g"), "edges").where("kind = 'calls'").count() == 1
    assert '"a" -> "b"' in render.dot(edges) and "flowchart" in render.mermaid(edges)
    relation = spark.createDataFrame([("a", "x", "b", "id", 1, "fk")], S.RELATION)
    assert relations.cached(relation, str(tmp_path / "cache"), "b1").count() == relations.cached(relation.limit(0), str(tmp_path / "cache"), "b1").count() == 1
