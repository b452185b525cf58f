"""Values across calls and what library functions do, on literal facts."""

import pytest

from tracewright.operators import callfacts
from tracewright.sources import readers

CALLS = "call_id long, callee_id string, result string, interface string, candidate_origin string, confidence double"
ARGUMENTS = "call_id long, position int, value string, is_const boolean"
PARAMETERS = "func_id string, position int, value string"
RETURNS = "func_id string, statement int, position int, value string"
EXTRACTS = "call_id long, position int, value string"


def _flow(spark, calls, arguments=(), parameters=(), returns=(), extracts=()):
    tables = [spark.createDataFrame(list(r), s) for r, s in ((calls, CALLS), (arguments, ARGUMENTS), (parameters, PARAMETERS), (returns, RETURNS), (extracts, EXTRACTS))]
    return sorted((r.source_id, r.target_id, r.kind, r.confidence) for r in callfacts.value_flow(*tables).collect())


def test_static_call(spark):
    arguments = [(1, 0, "a", False), (1, 1, "const", True), (1, 2, "too many", False), (1, 0, None, False)]
    found = _flow(spark, [(1, "f", "r", None, None, None)] * 2, arguments, [("f", 0, "p0"), ("f", 1, "p1")], [("f", 0, 0, "x"), ("f", 1, 0, "y"), ("f", 2, 0, None)])
    assert found == [("a", "p0", "argument", None), ("x", "r", "returns", None), ("y", "r", "returns", None)]


def test_candidate_has_a_receiver(spark):
    found = _flow(spark, [(1, "m", None, "I", "register", 0.9)], [(1, 0, "a", False)], [("m", 0, "self"), ("m", 1, "p")], [("m", 0, 0, "x")])
    assert found == [("a", "p", "argument", 0.9)]  # the result is not used


@pytest.mark.parametrize("candidate", [False, True])
def test_several_results(spark, candidate):
    marks = ("I", "enum", 0.7) if candidate else (None, None, None)
    returns = [("f", 0, 0, "x0"), ("f", 0, 1, "x1"), ("f", 1, 0, "y0"), ("f", 1, 1, "y1")]
    call = [(1, "f", "r", *marks)]
    assert _flow(spark, call, returns=returns) == []  # nothing is taken out
    found = _flow(spark, call, returns=returns, extracts=[(1, 1, "second")])
    expected = [(v, "r", "returns", marks[2]) for v in ("x0", "x1", "y0", "y1")]
    expected.append(("x1", "second", "returns", 0.7) if candidate else ("r", "second", "data_flows_to", None))
    assert found == sorted(expected)


def test_no_calls(spark):
    assert _flow(spark, []) == []


def test_specifications_in_force(spark):
    text = (
        "summaries:\n  - func: fmt.Printf\n    reads: [A]\n  - func: fmt.Printf\n    reads: [B]\n  - iface: a.Store\n    method: Put\n    kind: write\n    obj_arg: 0\n"
        "  - iface: a.Store\n  - kind: write\n  - func: a.Save\n    orm_write: true\n    kind: read\n"
    )
    library = callfacts.library(spark)
    assert library.count() == library.select("key").distinct().count()
    specs = {r.key: r for r in callfacts.with_user_specs(library, readers.field_summaries(spark, text)).collect()}
    assert len(specs) == library.count() + 2
    assert (specs["fmt.Printf"].effect, specs["fmt.Printf"].reads, specs["fmt.Printf"]["all"]) == ("arguments", ["A"], None)
    assert (specs["iface:a.Store.Put"].effect, specs["iface:a.Store.Put"].obj_arg) == ("write", 0)
    assert specs["a.Save"].effect == "orm_write"
    assert specs["database/sql.(DB).Exec"].sql_write and not specs["database/sql.(Tx).Query"].sql_write
    assert (specs["iface:xorm.io/xorm.(Session).Get"].obj_arg, specs["xorm.io/xorm.(Session).Get"].obj_arg) == (0, 1)
    assert callfacts.with_user_specs(library, readers.field_summaries(spark, "")).count() == library.count()


def test_argument_effects(spark):
    calls = spark.createDataFrame([(1, "f", "ext:j", 7, "encoding/json.Unmarshal"), (2, "f", "ext:p", 8, "net/http.(Request).ParseForm"), (3, "f", "ext:?", 9, "nobody.Knows")], "call_id long, func_id string, callee_id string, line int, key string")
    arguments = spark.createDataFrame([(1, 0, "raw", None, "b"), (1, 1, "v", "a.T", "t"), (1, 2, "w", None, "u"), (2, 0, None, None, None), (3, 0, "z", "a.T", "t")], "call_id long, position int, value string, type string, instance string")
    fields = spark.createDataFrame([("a.T", "Id"), ("a.T", "In.Size")], "owner string, path string")
    nodes, edges = callfacts.argument_effects(callfacts.known_calls(calls, callfacts.library(spark)), arguments, fields)
    assert sorted((r.id, r.instance_path, r.access_kind) for r in nodes.collect()) == [
        ("f#ext.Form.write@8", ".Form", "write"), ("f#ext.a.T.Id.write@7", "t.Id", "write"), ("f#ext.a.T.Size.write@7", "t.Size", "write"),
    ]
    found = {(r.source_id, r.target_id, r.kind) for r in edges.collect()}
    own = {("f", n, "indirect_write") for n in ("f#ext.Form.write@8", "f#ext.a.T.Id.write@7", "f#ext.a.T.Size.write@7")}
    assert found == own | {("ext:p", "f#ext.Form.write@8", "summary_io")} | {e for n in ("f#ext.a.T.Id.write@7", "f#ext.a.T.Size.write@7") for e in (("ext:j", n, "summary_io"), ("v", n, "data_flows_to"))}
