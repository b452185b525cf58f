"""What joins, the driver and a task's memory are given when tables grow."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators import callgraph, closure, deadcode, ingest
from tracewright.plans import shop
from tracewright.storage import keep


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def many(spark):
    """60,000 nodes of ids that compress well, and edges between them; a table of three nodes."""
    columns = ["kind", "name", "file_path", "full_path", "instance_path", "access_kind", "type_string", "func_id", "origin_kind", "is_external", "serves_http", "handler_id"]
    n = spark.range(60_000).select(F.concat(F.lit("symbol:go:shop/user:u"), F.col("id") % 1500, F.lit("#v"), "id").alias("id"), *(F.lit(None).cast("string").alias(c) for c in columns), F.lit(1).alias("line_start"))
    nodes = keep(n.withColumn("kind", F.lit("field_access")), "many-nodes")
    edges = keep(nodes.select(F.col("id").alias("source_id"), F.col("id").alias("target_id"), F.lit("calls").alias("kind")), "many-edges")
    return nodes, edges, keep(nodes.limit(3), "few-nodes")


def test_ids_of_all_nodes_are_not_broadcast(spark, many):
    """F1 to F9, F20: compressed files of ids are far below Spark's bound for a broadcast, the ids in memory are not."""
    nodes, edges, few = many
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "250k")  # the ids are some MB, their files some 10 KB
    try:
        files = spark.createDataFrame([("f.go",)], "file_path string")
        joined = [ingest.with_endpoints(edges, nodes), ingest.skipped_edges(edges, nodes), ingest.delete_files(nodes, edges, edges.withColumnRenamed("source_id", "function_id"), edges.withColumnRenamed("source_id", "function_id"), files.limit(0))[1]]
        for df in joined:
            assert "SortMergeJoin" in plan(df)
            assert not [line for line in plan(df).splitlines() if "BroadcastHashJoin" in line and "_id" in line]
        assert "BroadcastHashJoin" in plan(ingest.with_endpoints(edges, few))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_question_about_calls_makes_no_steps(spark, tmp_path, monkeypatch):
    """a table of the derived graph is made when it is asked for."""
    import duckdb

    con = duckdb.connect()
    for t in shop.TABLES:
        con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    asked = []
    monkeypatch.setattr(shop, "keep", lambda df, label, *by: asked.append(label) or df)
    monkeypatch.setattr(shop.trace, "prepare", lambda *_: asked.append("steps"))
    g = shop.graph(spark, str(tmp_path))
    assert g.nodes.where("kind = 'function'").count() and asked == ["shop-events", "shop-nodes"]
    assert g.edges is g.edges and g.steps is None and asked[2:] == ["shop-edges", "steps"]


def kept_schemas(monkeypatch, module):
    """The schemas of the tables that a module keeps, by label."""
    seen, real = {}, module.keep
    monkeypatch.setattr(module, "keep", lambda df, label, *by: (seen.setdefault(label, dict(df.dtypes)), real(df, label, *by))[1])
    return seen


def test_rounds_of_aliases_run_on_numbers(spark, monkeypatch):
    """what a round joins and compares has no ids in it; nulls and repeated rows as before."""
    seen = kept_schemas(monkeypatch, closure)
    allocations = spark.createDataFrame([("a", "o"), ("a", "o"), (None, "p"), ("z", None)], "value string, allocation string")
    flows = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), (None, "d"), ("z", "y")], "src string, dst string")
    got = sorted(map(repr, (tuple(r) for r in closure.may_alias(allocations, flows).collect())))
    assert got == sorted(map(repr, [("a", "o"), ("b", "o"), ("c", "o"), (None, "p"), ("z", None), ("y", None)]))
    assert set(seen["alias"].values()) == set(seen["alias-steps"].values()) == {"bigint"}


def test_a_frontier_does_not_carry_ways(spark, monkeypatch):
    """a row of a level has its parent only; of equal ways the least ids from the end on, kinds in order."""
    seen = kept_schemas(monkeypatch, callgraph)
    ends = [("s", "b"), ("s", "a"), ("a", "d"), ("b", "c"), ("a", "c"), ("d", "e"), ("c", "e")]
    edges = spark.createDataFrame([(x, y, "calls") for x, y in ends] + [("a", "c", "passes_to"), ("s", "s", "calls")], "source_id string, target_id string, kind string")
    ask = lambda *a: [tuple(r) for r in callgraph.shortest_path(edges, *a).orderBy("step").collect()]
    assert ask("s", "e", "calls") == [(0, "s", ""), (1, "a", "calls"), (2, "c", "calls,passes_to"), (3, "e", "calls")]
    assert ask("s", "e", "calls", 2) == [] and ask("s", "s", "calls") == [(0, "s", "")] and ask("s", "e", "data") == []
    assert seen["path"] == {"node": "string", "parent": "string", "kind": "string"}


def test_chains_run_on_numbers(spark, monkeypatch):
    """rounds move numbers. a, b and c are a chain, d and e a ring; f has a caller that is no node, g one without an id."""
    seen = kept_schemas(monkeypatch, deadcode)
    nodes = spark.createDataFrame([(i, "function", i, "a.go", 1, 2, None) for i in "abcdefg"], "id string, kind string, name string, file_path string, line_start int, line_end int, func_id string")
    calls = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "d"), ("gone", "f"), (None, "g")]
    edges = spark.createDataFrame([(x, y, "calls") for x, y in calls], "source_id string, target_id string, kind string")
    got = sorted(tuple(r) for r in deadcode.isolated_chains(nodes, edges).collect())
    assert got == [("a", "a", False), ("a", "b", False), ("a", "c", False), ("d", "d", True), ("d", "e", True)]
    for label in ("chain", "chain-calls", "chain-counted", "chain-among", "chain-tops", "chain-members"):
        assert "string" not in seen[label].values(), label
