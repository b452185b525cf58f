"""Answers in the contract's form, builds, and rings that no longer need a part of the graph in one task."""

import json

import pytest
from test_graph_fixtures import edges_of, nodes_of

from tracewright import schema as S
from tracewright.operators import build, deadcode, ingest, trace
from tracewright.plans import answers, shop

P = "symbol:go:p:"


@pytest.fixture(scope="module")
def graph(spark):
    column = lambda name, access: {"full_path": name, "access_kind": access, "type_string": "sql", "is_external": "true", "func_id": P + "f"}
    nodes = nodes_of(spark, [
        (P + "f", "function", "f", "a.go", 1, {}), (P + "g", "function", "g", "b.go", 5, {}), (P + "h", "function", "h", "b.go", 9, {}),
        (P + "f#w", "field_access", "T.A", "a.go", 2, {"full_path": "p.T.A", "access_kind": "write", "func_id": P + "f", "is_external": "false"}),
        (P + "f#r", "field_access", "T.A", "a.go", 3, {"full_path": "p.T.A", "access_kind": "read", "func_id": P + "f", "is_external": "false"}),
        (P + "f#v", "ssa_value", "v", "a.go", 4, {"func_id": P + "f"}),
        (P + "f#c1", "field_access", "orders.id", "a.go", 6, column("orders.id", "read")), (P + "f#c2", "field_access", "lines.order_id", "a.go", 7, column("lines.order_id", "filter")),
    ])
    edges = edges_of(spark, [(P + "f", P + "g", "calls", 0.9), (P + "g", P + "h", "calls", 0.9), (P + "f#r", P + "f#v", "data_flows_to", 1.0), (P + "f#v", P + "f#w", "data_flows_to", 1.0), (P + "f#c1", P + "f#c2", "summary_io", 1.0)])
    summary = spark.createDataFrame([(P + "f", "direct_write", "p.T.A", "", 2, "")], S.SUMMARY)
    origins = spark.createDataFrame([(P + "f", "direct_write", "p.T.A", 2, P + "g")], S.ORIGIN)
    return shop.Graph(nodes, edges, summary, origins, spark.createDataFrame([], S.BUILD), trace.prepare(nodes, edges))


def test_answers(spark, graph):
    ask = lambda *a, **o: json.loads(answers.answer(graph, *a, **o))
    assert ask("symbol", "g") == {"id": P + "g", "name": "g", "kind": "function", "file": "b.go", "line": 5, "callers": [{"id": P + "f", "confidence": 0.9}], "callees": [{"id": P + "h", "confidence": 0.9}]}
    assert [r["name"] for r in ask("callees", "f", depth=2)["rows"]] == ["g", "h"] and [r["name"] for r in ask("callers", "h")["rows"]] == ["g"]
    assert ask("impact", "g")["target"] == P + "g"
    assert ask("fields", "f")["rows"][0]["origins"] == [{"call_line": 2, "callee_id": P + "g"}]
    assert {"symbol", "fields", "callees", "traces", "chain"} <= set(ask("context", "f"))
    assert [f["id"] for f in ask("trace-backward", "p.T.A", "f")["flows"]][:2] == [P + "f#r", P + "f#w"]
    assert len(ask("trace-forward", "p.T.A", "f")["flows"]) >= 3
    assert [(f["id"], f["dir"]) for f in ask("value-trace", "p.T.A")["flows"]] == [(P + "f#r", 0), (P + "f#v", 1), (P + "f#w", 1)]
    assert ask("summary", "p.T.A") == {"producers": [{"function": P + "f", "access": "direct_write", "line": 2}], "consumers": []}
    assert ask("table", "ORDERS")[0]["column_name"] == "id"
    assert ask("relations", "orders") == [{"from_table": "orders", "from_col": "id", "to_table": "lines", "to_col": "order_id", "hops": 1, "type": "fk"}]
    assert ask("table-path", "lines", "orders") | {"path": 0} == {"path": 0, "candidates": [], "hops": 1, "reachable": True}
    assert [s["id"] for s in ask("path", P + "f#r", P + "f#w")["path"]] == [P + "f#r", P + "f#v", P + "f#w"]
    assert ask("unused", limit=1)["total"] == 1 and ask("module-calls", spark.createDataFrame([], "prefix string, name string")) == {"calls": []}
    assert [r["id"] for r in ask("search", "h")] == [P + "h"]
    for wrong in (("nonsense",), ("symbol", "nobody")):
        with pytest.raises(LookupError):
            ask(*wrong)


def item_rows(spark, names, seq=0):
    node = lambda i, n: (i, "function", n, f"{i}.go", 1, 2, {})
    rows = [(node(i, n), None, None, None, k) for k, (i, n) in enumerate(names)] + [(None, ("a", "b", "calls", "ssa", 0.5, None), None, None, 90), (None, ("a", "x", "calls", "ssa", 0.5, None), None, None, 91)]
    return spark.createDataFrame(rows, S._struct(**{f.name: f.dataType for f in S.ITEM}, seq=S._L))


def test_builds(spark, tmp_path):
    folder = str(tmp_path / "g")
    assert build.builds(spark, folder).count() == 0 and build.stored_analyzer(spark, folder) is None
    files = spark.createDataFrame([("a.go",)], "file_path string")
    first = build.update(item_rows(spark, [("a", "a"), ("b", "b")]), files, folder, build.Run("1", "s1", "x1", 10)).first()  # nothing to update
    assert (first.status, first.nodes_count, first.edges_count, first.commit_sha) == ("success", 2, 1, "s1")
    build.update(item_rows(spark, [("a", "a2"), ("b", "b2"), ("c", "c2")]), files, folder, build.Run("2", "s2", "x1", 20, errors={"git": "none"}))
    names = lambda b: {r.id: r["name"] for r in spark.read.parquet(f"{folder}/build={b}/nodes").collect()}
    assert names(2) == {"a": "a2", "b": "b"}
    build.update(item_rows(spark, [("a", "a3"), ("b", "b3")]), files, folder, build.Run("3", "s3", "x2", 30))  # another analyzer
    assert names(3) == {"a": "a3", "b": "b3"} and build.stored_analyzer(spark, folder) == "x2"
    assert sorted((r.build_id, r.status) for r in build.builds(spark, folder).collect()) == [("1", "success"), ("2", "degraded"), ("3", "success")]


def test_streams_and_old_rows_keep_their_order(spark):
    nodes = spark.createDataFrame([("n", "function", "b", "f", 1, 2, {"k": "1", "gone": "1"}, 2), ("n", "function", "a", "f", 1, 2, {"k": "2", "gone": None}, 5)], S._struct(**{f.name: f.dataType for f in S.NODE}, seq=S._L))
    assert [(r["name"], r.properties) for r in ingest.upsert_nodes(nodes.unionByName(nodes.limit(0))).collect()] == [("b", {"k": "2"})]


def test_rings(spark):
    """A ring with a chord, one with a caller outside, one behind another ring, one of referenced functions only, a function that calls itself."""
    ids = ["p", "q", "r", "x", "y", "out", "s", "t", "u", "v", "me"]
    nodes = nodes_of(spark, [(i, "function", i, "a.go", k, {}) for k, i in enumerate(ids)])
    links = [("p", "q"), ("q", "r"), ("r", "p"), ("q", "p"), ("x", "y"), ("y", "x"), ("out", "x"), ("r", "s"), ("s", "t"), ("t", "s"), ("u", "v"), ("v", "u"), ("me", "me")]
    edges = edges_of(spark, [(a, b, "calls", 1.0) for a, b in links] + [("p", "u", "passes_to", 1.0), ("p", "v", "passes_to", 1.0)])
    found = {(r.head, r.id) for r in deadcode.isolated_chains(nodes, edges).where("is_cycle").collect()}
    assert found == {("p", "p"), ("p", "q"), ("p", "r")}
