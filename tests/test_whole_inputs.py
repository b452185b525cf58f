"""Queries of the catalogue read all of their input."""

import pytest

from tracewright.operators import relations
from tracewright.plans import catalogue


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Keys from 850 on, most of them beyond 900."""
    d = str(tmp_path_factory.mktemp("whole"))
    made = [(k, (k * 31 + k // 7) % 40, "OFP"[k % 3]) for k in range(850, 1600)]
    spark.createDataFrame(made, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{d}/orders.parquet")
    return d, made


def test_relations_of_all_orders(spark, orders):
    d, made = orders
    from_col = lambda o: ["id", f"b{o % 5}_id", "title"][o % 3]
    to_col = lambda o, c: ["id", f"a{c % 4}_id", "name", "name"][o % 4]
    plain = [(f"a{c % 4}", from_col(o), f"a{o % 5}", to_col(o, c), o % 7, ["read", "write", "query", "fk"][c % 4]) for o, c, _ in made]
    want = spark.createDataFrame(plain, "from_table string, from_col string, to_table string, to_col string, hops int, type string")
    ways = {"relation_merge": relations.merge, "relation_best": relations.best_of, "relation_key_noise": relations.without_key_noise, "relation_dedup": relations.dedup, "relation_counts": relations.count_by_type, "table_path": lambda c: relations.table_path(c, "a0", "a4")}
    for name, way in ways.items():
        found = rows(catalogue.QUERIES[name](spark, d))
        assert found and found == rows(way(want)), name
    assert sum(r["n"] for r in catalogue.QUERIES["relation_counts"](spark, d).collect()) == len(made)
    least = {}
    for *key, hops, _ in plain:
        least[tuple(key)] = min(hops, least.get(tuple(key), hops))
    assert {tuple(r)[:4]: r["hops"] for r in catalogue.QUERIES["relation_merge"](spark, d).collect()} == least


def test_node_upsert_of_all_orders(spark, orders):
    d, made = orders
    names, values = {}, {}
    for o, c, status in sorted(made):
        names.setdefault(f"n{c}", status)
        values.setdefault(f"n{c}", {})[f"k{o % 3}"] = str(o) if o % 7 else ""
    want = {n: (names[n], ",".join(f"{k}={v}" for k, v in sorted(values[n].items()) if v)) for n in names}
    assert {r["id"]: (r["name"], r["props"]) for r in catalogue.QUERIES["node_upsert"](spark, d).collect()} == want
    assert any(int(n[1:]) % 5 for n in want)


def test_indirect_writes_of_all_calls(spark, orders):
    d, made = orders
    customers = [*range(1, 41, 7), 50, 61]
    spark.createDataFrame([(c,) for c in customers], "c_custkey long").write.mode("overwrite").parquet(f"{d}/customer.parquet")
    calls = {(f"f{c}", f"f{o * 7919 % len(customers)}", o % 9, f"T{o % 3}.F") for o, c, _ in made}
    writes, before = {(f"f{c}", f"T{c % 3}.F") for c in customers}, 0
    while len(writes) > before:
        before = len(writes)
        writes |= {(caller, path) for caller, callee, _, path in calls if (callee, path) in writes}
    want = sorted((caller, path, str(line), callee) for caller, callee, line, path in calls if (callee, path) in writes)
    assert want and rows(catalogue.QUERIES["indirect_writes"](spark, d)) == sorted(set(want))


def test_context_bundle_has_all_callees(spark):
    from test_graph_fixtures import edges_of, nodes_of

    nodes = nodes_of(spark, [("f", "function", "f", "a.go", 1, {})] + [(f"c{i}", "function", f"c{i}", "a.go", i, {}) for i in range(150)])
    edges = edges_of(spark, [("f", f"c{i}", "calls", 1.0) for i in range(150)])
    none = spark.createDataFrame([], "function_id string, access_kind string, field_path string, call_line int, callee_id string")
    parts = catalogue.bundle.context(nodes, edges, none.drop("call_line", "callee_id"), none, "f")
    assert parts["callees"].count() == 150


def test_items_keep_the_order_of_file_names(spark, tmp_path):
    """A small first file and a large second one, which Spark packs first."""
    from tracewright.operators import ingest
    from tracewright.sources import readers

    item = '{"node": {"id": "%s", "kind": "function", "name": "%s", "properties": {"k": "%s"}}}\n'
    (tmp_path / "a.json").write_text(item % ("n", "first", "1"))
    (tmp_path / "b.json").write_text(item % ("n", "second", "2") + "".join(item % (f"x{i}", "x" * 50, "3") for i in range(20_000)) + item % ("n", "third", "4"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        nodes, *_ = ingest.split_items(readers.items(spark, str(tmp_path)))
        got = ingest.upsert_nodes(nodes).where("id = 'n'").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["name"], r["properties"]) for r in got] == [("first", {"k": "4"})]
