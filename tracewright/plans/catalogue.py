"""Every operator as a named query over the derived graph, with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import affinity as A
from ..functions import anchors, gittext, ids, naming
from ..functions.sqltext import condition_columns_udf, parse_sql
from ..operators import build, bundle, callfacts, callgraph, closure, deadcode, ingest, modules, relations, scan, trace, virtual_columns
from ..sources import readers, sinks
from ..storage import shared_folder
from . import answers, shop

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

CUSTOMER, METHOD = "symbol:go:shop/cust:f1", "symbol:go:shop/supp:(S0).m1"
ASKED = "symbol:go:shop/cust:f10"
USER, FIELD = "symbol:go:shop/user:u5", "shop/user.T1.F1"


def query(name: str, sql: str | None = None, bare: bool = False) -> Callable[[Query], Query]:
    """Register a query. sql: with the derived tables g_nodes, g_edges, ... in scope, unless bare."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            text = sql.strip()
            if not bare:
                text = f"WITH RECURSIVE {shop.duckdb_ctes()}" + (",\n" + text[5:] if text.startswith("WITH ") else "\n" + text)
            ORACLE[name] = text
        return f

    return add


def _ids(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "id string")


# --- scans ---------------------------------------------------------------------------------------------------------


@query("node_by_id", f"SELECT id, kind, name, file_path FROM g_nodes WHERE id = '{CUSTOMER}'")
def _(spark, d):
    return scan.node_by_id(shop.graph(spark, d).nodes, CUSTOMER).select("id", "kind", "name", "file_path")


_SEARCH = """
WITH shown AS (SELECT * FROM g_nodes WHERE kind NOT IN ('field_access', 'ssa_value', 'external_summary')),
exact AS (SELECT * FROM shown WHERE name = '{0}'),
both_ AS (SELECT * FROM exact UNION ALL SELECT * FROM shown WHERE (name ILIKE '%{0}%' OR id ILIKE '%{0}%') AND NOT EXISTS (SELECT 1 FROM exact))
SELECT id, name FROM both_ ORDER BY name, id LIMIT 50
"""


@query("search_exact", _SEARCH.format("f12"))
def _(spark, d):
    return scan.search(shop.graph(spark, d).nodes, "f12").select("id", "name")


@query("search_part", _SEARCH.format("SUPP:S1"))
def _(spark, d):
    return scan.search(shop.graph(spark, d).nodes, "SUPP:S1").select("id", "name")


@query("summary_scan", "SELECT function_id, access_kind, field_path, line_start FROM g_summary ORDER BY field_path, access_kind, function_id")
def _(spark, d):
    return scan.all_summaries(shop.graph(spark, d).summary).select("function_id", "access_kind", "field_path", "line_start")


@query("function_fields", """
WITH o AS (SELECT function_id, access_kind, field_path, string_agg(call_line || ':' || callee_id, ';' ORDER BY call_line, callee_id) AS origins FROM g_origins GROUP BY ALL)
SELECT s.function_id, s.access_kind, s.field_path, coalesce(origins, '') AS origins FROM g_summary s LEFT JOIN o ON s.function_id = o.function_id AND s.access_kind = o.access_kind AND s.field_path = o.field_path
""")
def _(spark, d):
    g = shop.graph(spark, d)
    text = F.array_join(F.transform("origins", lambda o: F.concat_ws(":", o["call_line"], o["callee_id"])), ";")
    return scan.function_fields(g.summary, g.origins).select("function_id", "access_kind", "field_path", text.alias("origins"))


@query("field_origins", """
WITH t AS (SELECT target_id, arg_max(origin, (confidence, source_id)) AS origin, max(confidence) AS c FROM g_edges WHERE kind = 'dispatch_to' GROUP BY 1),
o AS (SELECT function_id, access_kind, field_path, string_agg(call_line || ':' || coalesce(t.origin || t.c, ''), ';' ORDER BY call_line, callee_id) AS origins
  FROM (SELECT * REPLACE ('symbol:go:shop/user:u' || (call_line % 60) AS callee_id) FROM g_origins) g LEFT JOIN t ON t.target_id = g.callee_id GROUP BY ALL)
SELECT s.function_id, s.access_kind, s.field_path, coalesce(origins, '') AS origins FROM g_summary s LEFT JOIN o ON s.function_id = o.function_id AND s.access_kind = o.access_kind AND s.field_path = o.field_path
""")
def _(spark, d):
    g = shop.graph(spark, d)
    origins = g.origins.withColumn("callee_id", F.concat(F.lit("symbol:go:shop/user:u"), F.col("call_line") % 60))
    marked = scan.with_dispatch(scan.function_fields(g.summary, origins), g.edges)
    text = F.array_join(F.transform("origins", lambda o: F.concat(o["call_line"].cast("string"), F.lit(":"), F.coalesce(F.concat(o["origin"], o["confidence"].cast("string")), F.lit("")))), ";")
    return marked.select("function_id", "access_kind", "field_path", text.alias("origins"))


@query("answer_callees", f"""
SELECT format('{{{{"target": "{ASKED}", "rows": [{{}}]}}}}', string_agg(format('{{{{"id": "{{}}", "name": "{{}}", "kind": "{{}}", "file": "{{}}", "line": {{}}}}}}', id, name, kind, file_path, line_start), ', ' ORDER BY name, id)) AS json
FROM g_nodes WHERE id IN (SELECT target_id FROM g_edges WHERE kind = 'calls' AND confidence >= 0.8 AND source_id = '{ASKED}')
""")
def _(spark, d):
    return spark.createDataFrame([(answers.answer(shop.graph(spark, d), "callees", ASKED),)], "json string")


_LINES = """
SELECT k, CASE k % 6 WHEN 0 THEN '  u.Brands = brands' || k || '.All()' WHEN 1 THEN 'v' || k || ' := svc.Get(x)' WHEN 2 THEN 'Email: req.Email' || k || ', // kept' WHEN 3 THEN 'return' WHEN 4 THEN 'a.b.c = d' || k || '(1)' ELSE 'Key: x' END AS line,
  CASE k % 6 WHEN 0 THEN 'u' WHEN 1 THEN 'v' || k WHEN 4 THEN 'a.b' ELSE '' END AS target, CASE k % 6 WHEN 0 THEN 'brands' || k WHEN 1 THEN 'svc' WHEN 2 THEN 'req.Email' || k WHEN 4 THEN 'd' || k WHEN 5 THEN 'x' ELSE '' END AS value
FROM (SELECT s_suppkey AS k FROM {supplier}) s
"""


@query("anchor_sides", f"""
SELECT k, target, value, CASE WHEN k % 7 > 0 AND k % 2 = 1 AND value <> '' THEN 'value' WHEN k % 7 > 0 AND k % 2 = 0 AND target <> '' THEN 'object' ELSE 'source' END AS side, CASE WHEN k % 5 = 0 THEN '（未知函数）' ELSE 'f' || k END || '#n' AS anchor FROM ({_LINES.format(supplier='supplier')})
""", bare=True)
def _(spark, d):
    rows = spark.sql(_LINES, supplier=spark.read.parquet(f"{d}/supplier.parquet"))
    k, line = F.col("k"), F.col("line")
    name = F.when(k % 2 == 1, F.col("value")).otherwise(F.col("target"))
    func = F.when(k % 5 != 0, F.concat(F.lit("symbol:go:p:f"), k))
    return rows.select("k", anchors.assigned_to(line).alias("target"), anchors.assigned_value(line).alias("value"), anchors.source_side(F.when(k % 7 > 0, 1).otherwise(2), name, line).alias("side"), anchors.short_anchor(func, F.lit("n")).alias("anchor"))


@query("dispatch_edges", "SELECT source_id, target_id, origin FROM g_edges WHERE kind = 'dispatch_to'")
def _(spark, d):
    return scan.edges_from(shop.graph(spark, d).edges, "dispatch_to").select("source_id", "target_id", "origin")


@query("dispatch_targets", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY confidence DESC, source_id DESC) AS n FROM g_edges WHERE kind = 'dispatch_to')
SELECT target_id, origin, confidence FROM r WHERE n = 1
""")
def _(spark, d):
    return scan.dispatch_targets(shop.graph(spark, d).edges)


@query("field_reads", f"SELECT id, line_start FROM g_nodes WHERE kind = 'field_access' AND access_kind = 'read' AND full_path = '{FIELD}' ORDER BY line_start, id")
def _(spark, d):
    return scan.field_reads(shop.graph(spark, d).nodes, FIELD).select("id", "line_start")


@query("latest_build", "SELECT build_id, status FROM g_builds ORDER BY timestamp DESC, build_id DESC LIMIT 1")
def _(spark, d):
    return scan.latest_build(shop.graph(spark, d).builds).select("build_id", "status")


@query("counts", "SELECT (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(*) FROM g_edges) AS edges")
def _(spark, d):
    g = shop.graph(spark, d)
    return scan.counts(g.nodes, g.edges)


@query("table_names", "SELECT DISTINCT split_part(name, '.', 1) AS table_name FROM g_nodes WHERE kind = 'field_access' AND is_external = 'true' AND type_string IN ('sql', 'gorm', 'xorm') AND regexp_full_match(name, '[^.]+\\.[^.]*')")
def _(spark, d):
    return scan.table_names(shop.graph(spark, d).nodes)


@query("resolve_table", "SELECT DISTINCT split_part(name, '.', 1) AS table_name FROM g_nodes WHERE is_external = 'true' AND split_part(name, '.', 1) = 't3'")
def _(spark, d):
    return scan.resolve_table(scan.table_names(shop.graph(spark, d).nodes), "T3")


@query("field_index", """
SELECT field_path, coalesce(string_agg(DISTINCT function_id, ',' ORDER BY function_id) FILTER (access_kind <> 'direct_read'), '') AS producers,
  coalesce(string_agg(DISTINCT function_id, ',' ORDER BY function_id) FILTER (access_kind = 'direct_read'), '') AS consumers FROM g_summary GROUP BY 1
""")
def _(spark, d):
    return scan.field_index(shop.graph(spark, d).summary).select("field_path", F.array_join("producers", ",").alias("producers"), F.array_join("consumers", ",").alias("consumers"))


@query("grouped_fields", """
SELECT function_id, coalesce(string_agg(DISTINCT field_path, ',' ORDER BY field_path) FILTER (access_kind = 'direct_read'), '') AS direct_reads,
  coalesce(string_agg(DISTINCT field_path, ',' ORDER BY field_path) FILTER (access_kind = 'direct_write'), '') AS direct_writes,
  coalesce(string_agg(DISTINCT field_path, ',' ORDER BY field_path) FILTER (access_kind = 'indirect_write'), '') AS indirect_writes FROM g_summary GROUP BY 1
""")
def _(spark, d):
    return scan.grouped_fields(shop.graph(spark, d).summary).select("function_id", *(F.array_join(c, ",").alias(c) for c in ("direct_reads", "direct_writes", "indirect_writes")))


@query("json_export", """SELECT format('{{"function_id":"{}","access_kind":"{}","field_path":"{}","line_start":{}}}', function_id, access_kind, field_path, line_start) AS json FROM g_summary""")
def _(spark, d):
    return sinks.as_json(shop.graph(spark, d).summary)


# --- ingestion -----------------------------------------------------------------------------------------------------


def _versions(spark, d):
    """Orders as repeated nodes: one id for each customer, in order of arrival."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    key = F.concat(F.lit("k"), F.col("o_orderkey") % 3)
    value = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey").cast("string"))
    return o.select(F.concat(F.lit("n"), F.col("o_custkey")).alias("id"), F.lit("function").alias("kind"), F.col("o_orderstatus").alias("name"), F.lit("f.go").alias("file_path"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), F.create_map(key, value).alias("properties"), F.col("o_orderkey").alias("seq"))


@query("node_upsert", """
WITH v AS (SELECT 'n' || o_custkey AS id, o_orderstatus AS name, 'k' || (o_orderkey % 3) AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey::VARCHAR END AS v, o_orderkey AS seq FROM orders),
l AS (SELECT id, k, arg_max(coalesce(v, ''), seq) AS v FROM v GROUP BY id, k),
p AS (SELECT id, string_agg(k || '=' || v, ',' ORDER BY k) AS props FROM l WHERE v <> '' GROUP BY id)
SELECT f.id, f.name, coalesce(p.props, '') AS props FROM (SELECT id, arg_min(name, seq) AS name FROM v GROUP BY id) f LEFT JOIN p USING (id)
""")
def _(spark, d):
    up = ingest.upsert_nodes(_versions(spark, d))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("properties"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return up.select("id", "name", text.alias("props"))


@query("item_files", """
WITH v AS (SELECT 'n' || o_custkey AS id, o_orderstatus AS name, 'k' || (o_orderkey % 3) AS k, o_orderkey::VARCHAR AS v, o_orderkey AS seq FROM orders),
l AS (SELECT id, k, arg_max(v, seq) AS v FROM v GROUP BY id, k)
SELECT f.id, f.name, p.props FROM (SELECT id, arg_min(name, seq) AS name FROM v GROUP BY id) f JOIN (SELECT id, string_agg(k || '=' || v, ',' ORDER BY k) AS props FROM l GROUP BY id) p USING (id)
""", bare=True)
def _(spark, d):
    """Orders written as item files, whose names follow the order of arrival, and read again."""
    rows = _versions(spark, d).withColumn("properties", F.create_map(F.concat(F.lit("k"), F.col("seq") % 3), F.col("seq").cast("string")))
    folder = f"{shared_folder(spark)}/items-{uuid.uuid4().hex[:12]}"
    rows.repartitionByRange("seq").sortWithinPartitions("seq").select(F.struct("id", "kind", "name", "file_path", "line_start", "line_end", "properties").alias("node")).write.json(folder)
    up = ingest.upsert_nodes(ingest.split_items(readers.items(spark, folder))[0])
    return up.select("id", "name", F.array_join(F.array_sort(F.transform(F.map_entries("properties"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("props"))


def _items(spark, d):
    """Customers as nodes and orders as facts, some of them to customers that do not exist."""
    c, o = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in S.ITEM}
    node = F.struct(F.concat(F.lit("c"), "c_custkey"), F.lit("function"), "c_name", F.concat(F.lit("m"), "c_nationkey", F.lit(".go")), F.lit(1), F.lit(2), F.create_map(F.lit("segment"), "c_mktsegment")).cast(S.NODE)
    fact = F.struct(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("c"), F.col("o_orderkey") % 2000), F.lit("calls"), F.lit("ssa"), F.lit(0.8), F.lit(None)).cast(S.EDGE)
    nodes = c.select(node.alias("node"), none["fact"], none["summary"], none["origins"], F.col("c_custkey").alias("seq"))
    return nodes.unionByName(o.select(none["node"], fact.alias("fact"), none["summary"], none["origins"], F.col("o_orderkey").alias("seq")))


@query("full_build", """
SELECT 'b1' AS build_id, 'degraded' AS status, 'git: no repository' AS error_message, (SELECT count(*) FROM customer) AS nodes_count,
  (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderkey % 2000 AS t FROM orders) e WHERE o_custkey IN (SELECT c_custkey FROM customer) AND t IN (SELECT c_custkey FROM customer)) AS edges_count
""", bare=True)
def _(spark, d):
    folder = f"{shared_folder(spark)}/build-{uuid.uuid4().hex[:12]}"
    done = build.full(_items(spark, d), folder, build.Run("b1", "abc", "a1", 1, errors={"git": "no repository", "ssa": None}))
    return _longs(done.select("build_id", "status", "error_message", "nodes_count", "edges_count"))


@query("incremental_build", """
WITH e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'c' || (o_orderkey % 2000) AS b FROM orders)
SELECT n.status, (SELECT count(*) FROM customer) AS nodes_count, (SELECT count(*) FROM e WHERE a IN (SELECT 'c' || c_custkey FROM customer) AND b IN (SELECT 'c' || c_custkey FROM customer)) AS edges_count,
  (SELECT count(*) FROM customer WHERE c_nationkey = 3) AS renamed FROM (SELECT 'success' AS status) n
""", bare=True)
def _(spark, d):
    """All nodes get other names, but only those of one changed file are taken over."""
    folder = f"{shared_folder(spark)}/build-{uuid.uuid4().hex[:12]}"
    items = _items(spark, d)
    build.full(items, folder, build.Run("b1", "abc", "a1", 1))
    renamed = items.withColumn("node", F.when(F.col("node").isNotNull(), F.col("node").withField("name", F.lit("new"))))
    row = build.update(renamed, spark.createDataFrame([("m3.go",)], "file_path string"), folder, build.Run("b2", "abd", "a1", 2))
    new = spark.read.parquet(f"{folder}/build=b2/nodes").where("name = 'new'").agg(F.count(F.lit(1)).alias("renamed"))
    return _longs(row.select("status", "nodes_count", "edges_count").join(new, F.lit(True)))  # one row each


@query("registry", """
WITH r AS (SELECT '/src/n' || n_nationkey AS path, 'm' || (n_nationkey % 5) AS module, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS head_commit, 'old' AS registered_at FROM nation)
SELECT path, module, CASE WHEN path = '/src/n4' THEN 'h4' ELSE head_commit END AS head_commit, registered_at FROM r WHERE path <> '/src/n7'
""", bare=True)
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    rows = lambda at: n.select(F.concat(F.lit("/src/n"), "n_nationkey").alias("path"), F.concat(F.lit("m"), F.col("n_nationkey") % 5).alias("module"), F.lit(at).alias("head_commit"), F.lit(at).alias("build_id"), F.lit(at).alias("last_built_at"), F.lit("").alias("main_path"), F.lit(at).alias("registered_at"), "n_nationkey")
    repos = build.register(rows("old").drop("n_nationkey"), rows("new").where("n_nationkey % 3 = 0").drop("n_nationkey"))
    repos = build.refresh(ingest.remove_repo(repos, "/src/n7"), "/src/n4", "h4", "b4", "now")
    return repos.select("path", "module", "head_commit", "registered_at")


@query("repo_reference", """
WITH r AS (SELECT '/src/n' || n_nationkey AS path, 'n' || n_nationkey AS base, 'm' || (n_nationkey % 5) AS module FROM nation)
SELECT path FROM r WHERE module = 'm3'
""", bare=True)
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    return build.referred(n.select(F.concat(F.lit("/src/n"), "n_nationkey").alias("path"), F.concat(F.lit("m"), F.col("n_nationkey") % 5).alias("module")), "m3")


@query("edge_upsert", """
WITH e AS (SELECT l_partkey % 50 AS s, l_suppkey AS t, l_quantity AS q, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY q DESC, seq) AS n FROM e)
SELECT 'p' || s AS source_id, 's' || t AS target_id, q / 50 AS confidence, seq::VARCHAR AS tool_source FROM r WHERE n = 1
""")
def _(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    edges = li.select(F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("source_id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target_id"), F.lit("calls").alias("kind"), (F.col("l_quantity") / 50).alias("confidence"), seq.cast("string").alias("tool_source"), seq.alias("seq"))
    return ingest.upsert_edges(edges).select("source_id", "target_id", "confidence", "tool_source")


@query("summary_upsert", """
WITH s AS (SELECT 'f' || o_custkey AS function_id, 'T.F' || (o_orderkey % 4) AS field_path, o_orderkey % 1000 AS line_start, o_orderkey AS seq FROM orders)
SELECT function_id, field_path, arg_max(line_start, seq)::BIGINT AS line_start FROM s GROUP BY 1, 2
""")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    rows = o.select(F.concat(F.lit("f"), "o_custkey").alias("function_id"), F.lit("direct_read").alias("access_kind"), F.concat(F.lit("T.F"), F.col("o_orderkey") % 4).alias("field_path"), (F.col("o_orderkey") % 1000).alias("line_start"), F.col("o_orderkey").alias("seq"))
    return ingest.upsert_summaries(rows).select("function_id", "field_path", "line_start")


@query("origin_upsert", "SELECT DISTINCT o_orderpriority AS function_id, o_orderstatus AS field_path, (o_orderkey % 5)::BIGINT AS call_line FROM orders WHERE o_orderkey % 3 <> 0")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    path = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).otherwise("")
    rows = o.select(F.col("o_orderpriority").alias("function_id"), F.lit("indirect_write").alias("access_kind"), path.alias("field_path"), (F.col("o_orderkey") % 5).alias("call_line"), F.lit("c").alias("callee_id"))
    return ingest.upsert_origins(rows).select("function_id", "field_path", "call_line")


@query("edges_with_endpoints", "SELECT e.source_id, e.target_id, e.kind FROM g_edges e WHERE source_id IN (SELECT id FROM g_nodes) AND target_id IN (SELECT id FROM g_nodes)")
def _(spark, d):
    g = shop.graph(spark, d)
    return ingest.with_endpoints(g.edges, g.nodes).select("source_id", "target_id", "kind")


@query("skipped_edges", "SELECT count(*) AS skipped FROM g_edges WHERE source_id NOT IN (SELECT id FROM g_nodes) OR target_id NOT IN (SELECT id FROM g_nodes)")
def _(spark, d):
    g = shop.graph(spark, d)
    return ingest.skipped_edges(g.edges, g.nodes)


def _changed(spark):
    return spark.createDataFrame([("cust/m3.go",), ("user/u1.go",), ("supp/s4.go",)], "file_path string")


_CHANGED = "('cust/m3.go', 'user/u1.go', 'supp/s4.go')"


@query("delete_by_file", f"""
WITH k AS (SELECT id FROM g_nodes WHERE file_path IS NULL OR file_path NOT IN {_CHANGED})
SELECT 'nodes' AS part, (SELECT count(*) FROM k) AS n UNION ALL SELECT 'edges', (SELECT count(*) FROM g_edges WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k))
UNION ALL SELECT 'summary', (SELECT count(*) FROM g_summary WHERE function_id IN (SELECT id FROM k)) UNION ALL SELECT 'origins', (SELECT count(*) FROM g_origins WHERE function_id IN (SELECT id FROM k))
""")
def _(spark, d):
    g = shop.graph(spark, d)
    parts = ingest.delete_files(g.nodes, g.edges, g.summary, g.origins, _changed(spark))
    out = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, p in zip(("nodes", "edges", "summary", "origins"), parts, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("incremental_keep", f"""
WITH c AS (SELECT id FROM g_nodes WHERE file_path IN {_CHANGED})
SELECT source_id, target_id, kind FROM g_edges WHERE source_id IN (SELECT id FROM c) OR target_id IN (SELECT id FROM c) OR source_id NOT IN (SELECT id FROM g_nodes) OR target_id NOT IN (SELECT id FROM g_nodes)
""")
def _(spark, d):
    g = shop.graph(spark, d)
    return ingest.of_changed_files(g.nodes, g.edges, g.summary, g.origins, _changed(spark))[1].select("source_id", "target_id", "kind")


@query("package_cache", "SELECT p_brand AS package, p_type AS hash FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size % 2 = 0) WHERE (p_brand, p_type) IN (SELECT p_brand, p_type FROM part WHERE p_size % 3 = 0)")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("package"), F.col("p_type").alias("hash"), "p_size")
    cache = p.where("p_size % 3 = 0").select("package", "hash", F.lit("a1").alias("analyzer"))
    return ingest.unchanged_packages(p.where("p_size % 2 = 0").select("package", "hash").distinct(), cache, "a1")


# --- call graph ----------------------------------------------------------------------------------------------------

_WALK = """
WITH c AS (SELECT * FROM g_edges WHERE kind = 'calls' AND confidence >= {conf}),
r(node, d) AS (SELECT '{anchor}', 0 UNION SELECT c.{far}, d + 1 FROM r JOIN c ON c.{near} = r.node WHERE d + 1 < {depth})
SELECT DISTINCT c.source_id, c.target_id, c.confidence FROM c JOIN r ON c.{near} = r.node
"""


@query("callees", _WALK.format(conf=0.7, anchor=CUSTOMER, near="source_id", far="target_id", depth=3))
def _(spark, d):
    return callgraph.callees(shop.graph(spark, d).edges, _ids(spark, CUSTOMER), 3, 0.7).select("source_id", "target_id", "confidence")


@query("callers", _WALK.format(conf=0.6, anchor=CUSTOMER, near="target_id", far="source_id", depth=3))
def _(spark, d):
    return callgraph.callers(shop.graph(spark, d).edges, _ids(spark, CUSTOMER), 3, 0.6).select("source_id", "target_id", "confidence")


@query("impact", f"""
WITH u AS (SELECT source_id AS a, target_id AS b FROM g_edges UNION SELECT target_id, source_id FROM g_edges),
r(id, d) AS (SELECT '{CUSTOMER}', 0 UNION SELECT u.b, d + 1 FROM r JOIN u ON u.a = r.id WHERE d < 3)
SELECT r.id, min(d)::BIGINT AS depth FROM r JOIN g_nodes n ON n.id = r.id WHERE d > 0 GROUP BY r.id
""")
def _(spark, d):
    g = shop.graph(spark, d)
    return callgraph.impact(g.nodes, g.edges, _ids(spark, CUSTOMER), 3).select("id", F.col("depth").cast("long").alias("depth"))


_ENTRY = """SELECT id, kind, name, false AS framework FROM g_nodes WHERE kind IN ('function', 'method') AND coalesce(file_path, '') NOT LIKE '%\\_test.go' ESCAPE '\\' AND coalesce(file_path, '') NOT LIKE '../%'
  AND ((name = 'main' AND id NOT LIKE '%.test:main') OR serves_http = 'true') ORDER BY name, id LIMIT 200"""
_FRAMEWORK = """SELECT s.id, s.kind, s.name, true AS framework FROM (SELECT * FROM g_nodes WHERE kind = 'struct' AND file_path NOT LIKE '%\\_test.go' ESCAPE '\\' AND file_path NOT LIKE '../%' ORDER BY name, id LIMIT 2000) s
  WHERE s.id IN (SELECT regexp_replace(id, ':\\(([^()]+)\\)\\..*$', ':\\1') FROM g_nodes WHERE kind = 'method')
  AND s.id NOT IN (SELECT regexp_replace(m.id, ':\\(([^()]+)\\)\\..*$', ':\\1') FROM g_nodes m JOIN g_edges e ON e.target_id = m.id AND e.kind = 'calls' JOIN g_nodes c ON c.id = e.source_id WHERE m.kind = 'method' AND c.file_path <> m.file_path)"""


@query("framework_structs", f"SELECT id, name FROM ({_FRAMEWORK})")
def _(spark, d):
    g = shop.graph(spark, d)
    return callgraph.framework_structs(g.nodes, g.edges).select("id", "name")


@query("roots", f"SELECT * FROM ({_ENTRY}) UNION ALL SELECT * FROM ({_FRAMEWORK})")
def _(spark, d):
    g = shop.graph(spark, d)
    return callgraph.roots(g.nodes, g.edges)


@query("expand", f"""
WITH k AS (SELECT * FROM g_edges WHERE kind IN ('calls', 'imports', 'implements', 'initializes', 'uses', 'passes_to', 'passes_result', 'has_method', 'data_flows_to', 'argument', 'returns', 'dispatch_to', 'has_param', 'has_result', 'grpc_call', 'grpc_impl', 'http_call')),
i AS (SELECT source_id, target_id, kind, target_id AS other_id FROM k WHERE source_id = '{METHOD}' UNION ALL SELECT source_id, target_id, kind, source_id FROM k WHERE target_id = '{METHOD}' AND source_id <> '{METHOD}')
SELECT i.*, n.kind AS other_kind, n.name AS other_name FROM i LEFT JOIN g_nodes n ON n.id = other_id
""".replace("(S0).m1", "(S' || (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1) || ').m1"))
def _(spark, d):
    g = shop.graph(spark, d)
    nation = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey = 1").select("s_nationkey").first()[0]
    return callgraph.expand(g.nodes, g.edges, METHOD.replace("S0", f"S{nation}")).drop("place")


_PATH = """
WITH e AS (SELECT source_id AS a, target_id AS b, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM g_edges WHERE kind IN {kinds} GROUP BY 1, 2),
z AS ({ends}),
r(id, d) AS (SELECT z.a, 0 FROM z UNION SELECT e.b, d + 1 FROM r JOIN e ON e.a = r.id WHERE d < {depth}),
l AS (SELECT id, min(d) AS d FROM r GROUP BY 1),
w(id, d) AS (SELECT l.id, l.d FROM l JOIN z ON z.b = l.id UNION ALL SELECT (SELECT min(e.a) FROM e JOIN l ON l.id = e.a AND l.d = w.d - 1 WHERE e.b = w.id), w.d - 1 FROM w WHERE w.d > 0)
SELECT w.d::BIGINT AS step, w.id, coalesce(e.kinds, '') AS edge_kinds FROM w LEFT JOIN w v ON v.d = w.d - 1 LEFT JOIN e ON e.a = v.id AND e.b = w.id
"""


@query("shortest_path_calls", _PATH.format(kinds="('calls', 'passes_to', 'passes_result')", ends=f"SELECT '{CUSTOMER}' AS a, 'symbol:go:shop/cust:f13' AS b", depth=12))
def _(spark, d):
    return _longs(callgraph.shortest_path(shop.graph(spark, d).edges, CUSTOMER, "symbol:go:shop/cust:f13", "calls", 12))


#: The first and the 13th event of the user, by time.
_ENDS = "SELECT min(CASE WHEN n = 1 THEN id END) AS a, min(CASE WHEN n = 13 THEN id END) AS b FROM (SELECT id, row_number() OVER (ORDER BY ts, event_id) AS n FROM (SELECT 'symbol:go:shop/user:u' || user_id || CASE WHEN event_id % 10 = 0 THEN '#ext.sql.' ELSE '#v' END || event_id AS id, ts, event_id FROM {events} WHERE user_id = 5) u) o"


@query("shortest_path_data", _PATH.format(kinds="('data_flows_to', 'argument', 'returns', 'phi_operand', 'summary_io')", ends=_ENDS.format(events="events"), depth=20))
def _(spark, d):
    ends = spark.sql(_ENDS, events=spark.read.parquet(f"{d}/events.parquet")).first()
    return _longs(callgraph.shortest_path(shop.graph(spark, d).edges, ends[0], ends[1], "data", 20))


@query("symbol_detail", f"""
SELECT n.id, n.name, coalesce((SELECT string_agg(DISTINCT source_id, ',' ORDER BY source_id) FROM g_edges WHERE kind = 'calls' AND confidence >= 0.8 AND target_id = n.id), '') AS callers,
  coalesce((SELECT string_agg(DISTINCT target_id, ',' ORDER BY target_id) FROM g_edges WHERE kind = 'calls' AND confidence >= 0.8 AND source_id = n.id), '') AS callees
FROM g_nodes n WHERE n.kind = 'function' AND n.name LIKE 'F%'
""")
def _(spark, d):
    g = shop.graph(spark, d)
    some = g.nodes.where((F.col("kind") == "function") & F.col("name").startswith("F"))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return callgraph.symbol_detail(g.nodes, g.edges, some).select("id", "name", text("callers"), text("callees"))


@query("resolve_symbol", "SELECT id FROM g_nodes WHERE name = 'f12' AND kind NOT IN ('field_access', 'ssa_value', 'external_summary')")
def _(spark, d):
    return _ids(spark, callgraph.resolve_symbol(shop.graph(spark, d).nodes, "f12"))


# --- traces --------------------------------------------------------------------------------------------------------

_TRACE_COLUMNS = ("id", "depth", "name", "edge_kinds", "line")
_NEXT = "CASE WHEN r.edge_kinds = '' THEN e.kind ELSE r.edge_kinds || ',' || e.kind END"


@query("trace_backward", f"""
WITH r(id, depth, name, edge_kinds, line) AS (
  SELECT id, 0, name, '', line_start FROM g_nodes WHERE kind = 'field_access' AND full_path = '{FIELD}' AND func_id = '{USER}'
  UNION SELECT e.source_id, r.depth + 1, n.name, {_NEXT}, n.line_start FROM r JOIN g_edges e ON e.target_id = r.id JOIN g_nodes n ON n.id = e.source_id
  WHERE e.kind IN ('data_flows_to', 'argument', 'returns', 'alias', 'phi_operand') AND r.depth < 8)
SELECT id, depth::BIGINT AS depth, name, edge_kinds, line::BIGINT AS line FROM r
""")
def _(spark, d):
    g = shop.graph(spark, d)
    return _longs(trace.trace_backward(g.nodes, g.edges, FIELD, USER, steps=g.steps))


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


@query("trace_forward", f"""
WITH r(id, depth, name, edge_kinds, line, is_usage, kind) AS (
  SELECT id, 0, name, '', line_start, true, kind FROM g_nodes WHERE kind = 'field_access' AND full_path = '{FIELD}' AND func_id = '{USER}'
  UNION SELECT id, 0, name, '', line_start, false, kind FROM g_nodes WHERE kind IN ('ssa_value', 'parameter') AND (func_id = '{USER}' OR origin_kind = 'global') AND type_string IN ('shop/user.T1', '*shop/user.T1')
  UNION SELECT id, 0, name, '', line_start, false, kind FROM g_nodes WHERE kind = 'field_access' AND func_id = '{USER}' AND type_string IN ('shop/user.T1', '*shop/user.T1')
  UNION SELECT e.target_id, r.depth + 1, n.name, {_NEXT}, n.line_start, n.kind = 'field_access' AND coalesce(n.full_path = '{FIELD}', false), n.kind
  FROM r JOIN g_edges e ON e.source_id = r.id JOIN g_nodes n ON n.id = e.target_id
  WHERE e.kind IN ('data_flows_to', 'argument', 'returns', 'phi_operand', 'alias') AND r.depth < 8
    AND (n.kind <> 'field_access' OR coalesce(n.full_path = '{FIELD}', false) OR (r.kind <> 'field_access' AND coalesce(n.access_kind = 'read', false) AND (coalesce(n.full_path LIKE '%.F1', false) OR coalesce(n.type_string LIKE '%shop/user.%', false)))))
SELECT DISTINCT id, depth::BIGINT AS depth, name, edge_kinds, line::BIGINT AS line, is_usage FROM r
""")
def _(spark, d):
    g = shop.graph(spark, d)
    return _longs(trace.trace_forward(g.nodes, g.edges, FIELD, USER, steps=g.steps))


@query("trace_indirect", f"""
WITH f AS (SELECT 'symbol:go:shop/user:u' || u AS id FROM (VALUES (5), (7), (9)) v(u)),
r(id, depth, name, kinds, line, kind, access, func_id, full_path) AS (
  SELECT n.id, 0, name, '', line_start, kind, access_kind, func_id, full_path FROM g_nodes n JOIN f ON f.id = func_id WHERE kind = 'field_access' AND full_path = '{FIELD}' AND access_kind = 'write'
  UNION SELECT n.id, r.depth + 1, n.name, CASE WHEN r.kinds = '' THEN e.kind ELSE r.kinds || ',' || e.kind END, n.line_start, n.kind, n.access_kind, n.func_id, n.full_path
  FROM r JOIN g_edges e ON e.target_id = r.id AND e.kind = 'data_flows_to' JOIN g_nodes n ON n.id = e.source_id WHERE r.depth < 8)
SELECT id, depth::BIGINT AS depth, name, kinds AS edge_kinds, line::BIGINT AS line, kind, access, func_id, full_path FROM r
""")
def _(spark, d):
    g = shop.graph(spark, d)
    u = "symbol:go:shop/user:u{}".format
    chain = [(u(5), "indirect_write", FIELD, 3, u(7)), (u(7), "indirect_write", FIELD, 4, u(9)), (u(7), "indirect_write", FIELD, 4, u(5)), (u(7), "direct_write", FIELD, 4, u(11)), (u(9), "indirect_write", "shop/user.T0.F0", 4, u(13))]
    origins = spark.createDataFrame(chain, "function_id string, access_kind string, field_path string, call_line int, callee_id string")
    return _longs(trace.trace_indirect(g.nodes, g.edges, origins, FIELD, USER, steps=g.steps))


@query("function_flows", f"""
WITH n AS (SELECT * FROM g_nodes WHERE func_id = '{USER}'), e AS (SELECT * FROM g_edges WHERE kind IN ('data_flows_to', 'phi_operand')),
b(id, depth, name, edge_kinds, line, ctx) AS (SELECT id, 0, name, '', line_start, full_path FROM n WHERE kind = 'field_access'
  UNION SELECT e.source_id, r.depth + 1, n.name, {_NEXT}, n.line_start, r.ctx FROM b r JOIN e ON e.target_id = r.id JOIN n ON n.id = e.source_id WHERE r.depth < 8 AND (n.kind <> 'field_access' OR n.full_path = r.ctx)),
f(id, depth, name, edge_kinds, line, ctx) AS (SELECT id, 0, name, '', line_start, full_path FROM n WHERE kind = 'field_access'
  UNION SELECT e.target_id, r.depth + 1, n.name, {_NEXT}, n.line_start, r.ctx FROM f r JOIN e ON e.source_id = r.id JOIN n ON n.id = e.target_id WHERE r.depth < 8 AND (n.kind <> 'field_access' OR n.full_path = r.ctx))
SELECT id, depth::BIGINT AS depth, name, edge_kinds, line::BIGINT AS line, 0::BIGINT AS dir FROM b UNION ALL SELECT id, depth, name, edge_kinds, line, 1 FROM f WHERE depth > 0
""")
def _(spark, d):
    g = shop.graph(spark, d)
    return _longs(trace.function_flows(g.nodes, g.edges, USER, steps=g.steps).select(*_TRACE_COLUMNS, "dir"))


_DATA = "('data_flows_to', 'argument', 'returns', 'phi_operand', 'summary_io')"
#: The value trace of the nodes in table a (id, ctx, inst): anchor, id, dir, depth, parent and the rest of a row, as table vt.
_VT = """
e AS (SELECT * FROM g_edges WHERE kind IN ('data_flows_to', 'argument', 'returns', 'phi_operand', 'summary_io') AND (candidate_origin IS NULL OR cand_confidence >= {conf})),
b(anchor, id, depth, parent) AS (SELECT id, id, 0, NULL::VARCHAR FROM a
  UNION SELECT r.anchor, e.source_id, r.depth + 1, r.id FROM b r JOIN a ON a.id = r.anchor JOIN e ON e.target_id = r.id JOIN g_nodes n ON n.id = e.source_id WHERE r.depth < 8
    AND (n.kind <> 'field_access' OR coalesce(n.full_path = ctx, false) OR ctx = '' OR n.is_external = 'true' OR coalesce(n.access_kind = 'read', false) {cont})),
f(anchor, id, depth, parent) AS (SELECT id, id, 0, NULL::VARCHAR FROM a
  UNION SELECT r.anchor, e.target_id, r.depth + 1, r.id FROM f r JOIN a ON a.id = r.anchor JOIN e ON e.source_id = r.id JOIN g_nodes n ON n.id = e.target_id WHERE r.depth < 8
    AND (n.kind <> 'field_access' OR coalesce(n.full_path = ctx, false) OR ctx = '' OR n.is_external = 'true' OR coalesce(n.access_kind = 'write', false) {cont})),
u AS (SELECT anchor, id, 0 AS dir, depth, parent FROM b UNION ALL SELECT anchor, id, 1, depth, parent FROM f WHERE depth > 0),
m AS (SELECT anchor, id, dir, min(depth) AS depth, min(parent) AS parent FROM (SELECT *, rank() OVER (PARTITION BY anchor, id, dir ORDER BY depth) AS k FROM u) WHERE k = 1 GROUP BY 1, 2, 3),
s0 AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY interface NULLS FIRST, candidate_origin NULLS FIRST, cand_confidence NULLS FIRST) AS k FROM e),
c(anchor, id, dir, depth, edge_iface, edge_origin, edge_conf) AS (SELECT id, id, d, 0, NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE FROM a, (VALUES (0), (1)) v(d)
  UNION ALL SELECT m.anchor, m.id, m.dir, m.depth, CASE WHEN candidate_origin IS NULL THEN c.edge_iface ELSE interface END, coalesce(candidate_origin, c.edge_origin), CASE WHEN candidate_origin IS NULL THEN c.edge_conf ELSE cand_confidence END
  FROM c JOIN m ON m.anchor = c.anchor AND m.dir = c.dir AND m.depth = c.depth + 1 AND m.parent = c.id JOIN s0 ON k = 1 AND source_id = CASE WHEN m.dir = 0 THEN m.id ELSE c.id END AND target_id = CASE WHEN m.dir = 0 THEN c.id ELSE m.id END),
k0 AS (SELECT target_id AS id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM g_edges WHERE kind IN ('data_flows_to', 'argument', 'returns', 'phi_operand', 'summary_io') GROUP BY 1),
k1 AS (SELECT source_id AS id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM g_edges WHERE kind IN ('data_flows_to', 'argument', 'returns', 'phi_operand', 'summary_io') GROUP BY 1),
vt AS (SELECT m.anchor, m.id, m.dir::BIGINT AS dir, m.depth::BIGINT AS depth, m.parent, n.name, coalesce(CASE WHEN m.dir = 0 THEN k0.kinds ELSE k1.kinds END, '') AS edge_kinds, coalesce(nullif(n.file_path, ''), w.file_path) AS file_path,
    n.kind, n.line_start::BIGINT AS line, n.access_kind AS access, n.func_id, n.full_path, c.edge_iface, c.edge_origin, c.edge_conf
  FROM m JOIN g_nodes n ON n.id = m.id LEFT JOIN c ON c.anchor = m.anchor AND c.id = m.id AND c.dir = m.dir AND c.depth = m.depth LEFT JOIN k0 ON k0.id = m.id LEFT JOIN k1 ON k1.id = m.id LEFT JOIN g_nodes w ON w.id = n.func_id AND w.kind IN ('function', 'method'))
"""
_CONTAINER = "OR (ctx <> '' AND coalesce(starts_with(coalesce(n.instance_path, n.full_path), inst) OR starts_with(inst, coalesce(n.instance_path, n.full_path)), false))"
_VT_COLUMNS = ("anchor", "id", "dir", "depth", "parent", "name", "edge_kinds", "file_path", "edge_iface", "edge_origin", "edge_conf")
_ANCHORS = "WITH a AS (SELECT id, coalesce(CASE WHEN kind = 'field_access' THEN full_path END, '') AS ctx, coalesce(CASE WHEN kind = 'field_access' THEN coalesce(instance_path, full_path) END, '') AS inst FROM g_nodes WHERE {pick}),"
_OWN = _ANCHORS.format(pick=f"func_id = '{USER}' AND kind <> 'function'")
_VT_SHOWN = f"SELECT {', '.join(_VT_COLUMNS)} FROM vt"


def _own_values(g: shop.Graph, pick: str = "true") -> DataFrame:
    return g.nodes.where((F.col("func_id") == USER) & (F.col("kind") != "function")).where(pick).select("id")


@query("value_trace", _OWN + _VT.format(conf=0.0, cont="") + _VT_SHOWN)
def _(spark, d):
    g = shop.graph(spark, d)
    return _longs(trace.value_trace(g.nodes, g.edges, _own_values(g), steps=g.steps).select(*_VT_COLUMNS))


@query("value_trace_container", _OWN + _VT.format(conf=0.8, cont=_CONTAINER) + _VT_SHOWN)
def _(spark, d):
    g = shop.graph(spark, d)
    return _longs(trace.value_trace(g.nodes, g.edges, _own_values(g), confidence=0.8, container=True, steps=g.steps).select(*_VT_COLUMNS))


@query("value_trace_multi", f"""
WITH f(id, dir, depth) AS (SELECT id, 0, 0 FROM g_nodes WHERE func_id = '{USER}' AND kind = 'field_access' AND access_kind = 'read'
  UNION SELECT e.target_id, 1, f.depth + 1 FROM f JOIN g_edges e ON e.source_id = f.id JOIN g_nodes n ON n.id = e.target_id WHERE f.depth < 4 AND e.kind IN {_DATA}
    AND (n.kind <> 'field_access' OR coalesce(n.full_path = '{FIELD}', false) OR n.is_external = 'true' OR coalesce(n.access_kind = 'write', false)))
SELECT f.id, f.dir::BIGINT AS dir, min(f.depth)::BIGINT AS depth, any_value(n.name) AS name FROM f JOIN g_nodes n ON n.id = f.id GROUP BY f.id, f.dir
""")
def _(spark, d):
    g = shop.graph(spark, d)
    return _longs(trace.value_trace_multi(g.nodes, g.edges, _own_values(g, "kind = 'field_access' and access_kind = 'read'"), FIELD, steps=g.steps).select("id", "dir", "depth", "name"))


def _write_anchor(g: shop.Graph) -> str:
    return g.nodes.where("kind = 'field_access' and access_kind = 'write' and is_external = 'false'").orderBy("line_start", "id").select("id").first()[0]


_WRITTEN = "WITH o AS (SELECT * FROM g_nodes WHERE kind = 'field_access' AND access_kind = 'write' AND is_external = 'false' ORDER BY line_start, id LIMIT 1),"
#: Behind the anchor in table o: t0, the first reads of its field; tr, the rows of the trampoline.
_TRAMPOLINE = f"""
t0 AS (SELECT n.* FROM g_nodes n JOIN o ON o.kind = 'field_access' AND o.access_kind = 'write' AND n.full_path = o.full_path AND n.id <> o.id WHERE n.kind = 'field_access' AND n.access_kind = 'read' ORDER BY n.line_start, n.id LIMIT 8),
t1(id, dir, depth) AS (SELECT id, 0, 0 FROM t0 UNION SELECT e.target_id, 1, t1.depth + 1 FROM t1 JOIN g_edges e ON e.source_id = t1.id AND e.kind IN {_DATA} JOIN g_nodes n ON n.id = e.target_id WHERE t1.depth < 4
    AND (n.kind <> 'field_access' OR coalesce(n.full_path = (SELECT full_path FROM o), false) OR n.is_external = 'true' OR coalesce(n.access_kind = 'write', false))),
i0 AS (SELECT target_id AS id, 0 AS dir, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM g_edges WHERE kind IN {_DATA} GROUP BY 1 UNION ALL SELECT source_id, 1, string_agg(DISTINCT kind, ',' ORDER BY kind) FROM g_edges WHERE kind IN {_DATA} GROUP BY 1),
tr AS (SELECT 0 AS part, id, 0::BIGINT AS depth, name, '' AS edge_kinds, line_start::BIGINT AS line, 1::BIGINT AS dir, kind, file_path, 'read' AS access, func_id, full_path FROM t0
  UNION ALL SELECT 1, x.id, x.depth::BIGINT, n.name, coalesce(i0.kinds, ''), n.line_start::BIGINT, x.dir::BIGINT, n.kind, coalesce(nullif(n.file_path, ''), w.file_path), n.access_kind, n.func_id, n.full_path
  FROM (SELECT id, dir, min(depth) AS depth FROM t1 GROUP BY 1, 2) x JOIN g_nodes n ON n.id = x.id LEFT JOIN i0 ON i0.id = x.id AND i0.dir = x.dir LEFT JOIN g_nodes w ON w.id = n.func_id AND w.kind IN ('function', 'method'))
"""
_WRITE = _WRITTEN + _TRAMPOLINE.strip() + "," + _ANCHORS.format(pick="id = (SELECT id FROM o)").removeprefix("WITH") + _VT.format(conf=0.0, cont="")


@query("downstream_trampoline", _WRITTEN + _TRAMPOLINE.strip() + "\nSELECT * EXCLUDE (part) FROM tr")
def _(spark, d):
    g = shop.graph(spark, d)
    return _longs(trace.trampoline(g.nodes, g.edges, _write_anchor(g), g.steps).drop("part"))


@query("lifecycle", _WRITE + """
SELECT id, depth, dir, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, dir, depth) AS k FROM (SELECT -1 AS part, id, depth, dir, name FROM vt UNION ALL SELECT part, id, depth, dir, name FROM tr)) WHERE k = 1
""")
def _(spark, d):
    g = shop.graph(spark, d)
    return _longs(trace.lifecycle(g.nodes, g.edges, _write_anchor(g), g.steps).select("id", "depth", "dir", "name"))


#: Table main, the rows of the summary chain.
_CHAIN = """

sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dir, depth ORDER BY id) AS k FROM vt) WHERE k = 1),
ch AS (SELECT dir AS part, 0 AS sub, CASE WHEN dir = 0 THEN -depth ELSE depth END AS place, id, name, kind, access, line, func_id, file_path FROM sp
  UNION ALL SELECT 2, part, depth, id, name, kind, access, line, func_id, file_path FROM tr WHERE (SELECT count(*) FROM sp WHERE dir = 1) <= 1),
nu AS (SELECT *, row_number() OVER (ORDER BY part, sub, place, id) AS n, count(*) OVER () AS last, regexp_extract(coalesce(func_id, ''), '([^:]*)$', 1) AS func FROM ch),
ki AS (SELECT *, CASE WHEN n = 1 THEN 'entry' WHEN name LIKE 'sql.%' OR name LIKE 'metric%' THEN 'write' WHEN kind = 'field_access' AND access = 'write' THEN 'write' WHEN kind = 'field_access' AND access = 'read' THEN 'consume' WHEN n = last THEN 'consume' ELSE 'compute' END AS sk FROM nu),
fi AS (SELECT *, row_number() OVER w AS first, first_value(CASE WHEN sk IN ('write', 'consume') THEN sk END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS better FROM ki WINDOW w AS (PARTITION BY name, file_path, line, func ORDER BY n)),
main AS (SELECT n AS step, CASE WHEN sk = 'compute' THEN coalesce(better, sk) ELSE sk END AS step_kind, name, file_path, line, func FROM fi WHERE first = 1)
"""


@query("summary_chain", _WRITE.rstrip() + "," + _CHAIN + """
SELECT * FROM main
""")
def _(spark, d):
    g = shop.graph(spark, d)
    return _longs(trace.summary_chain(g.nodes, g.edges, _write_anchor(g), g.steps))


@query("dispatch_marks", """
WITH t AS (SELECT target_id, arg_max(origin, (confidence, source_id)) AS origin, max(confidence) AS c FROM g_edges WHERE kind = 'dispatch_to' GROUP BY 1)
SELECT n.id, t.target_id IS NOT NULL AS dispatch_candidate, t.origin AS dispatch_origin, t.c AS dispatch_conf FROM g_nodes n LEFT JOIN t ON t.target_id = n.func_id WHERE n.kind = 'parameter'
""")
def _(spark, d):
    g = shop.graph(spark, d)
    return trace.marked(g.nodes.where("kind = 'parameter'").select("id", "func_id"), g.edges).select("id", "dispatch_candidate", "dispatch_origin", "dispatch_conf")


@query("path_conditions", """
WITH c AS (SELECT 'user/u' || (s_suppkey % 10) || '.go' AS file_path, s_suppkey * 7 % 900 AS a, s_suppkey * 7 % 900 + s_suppkey % 60 + 1 AS b, 'x > ' || s_suppkey AS condition FROM supplier),
m AS (SELECT n.id, c.condition, row_number() OVER (PARTITION BY n.id ORDER BY b - a, condition) AS k FROM g_nodes n JOIN c ON c.file_path = n.file_path AND n.line_start BETWEEN a AND b WHERE n.kind = 'ssa_value')
SELECT n.id, coalesce(m.condition, '') AS condition FROM g_nodes n LEFT JOIN m ON m.id = n.id AND k = 1 WHERE n.kind = 'ssa_value'
""")
def _(spark, d):
    g = shop.graph(spark, d)
    s = F.col("s_suppkey")
    ranges = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("user/u"), s % 10, F.lit(".go")).alias("file_path"), (s * 7 % 900).alias("from_line"), (s * 7 % 900 + s % 60 + 1).alias("to_line"), F.concat(F.lit("x > "), s).alias("condition"))
    return trace.path_conditions(g.nodes.where("kind = 'ssa_value'").select("id", "file_path", F.col("line_start").alias("line")), ranges).select("id", "condition")


# --- dead code -----------------------------------------------------------------------------------------------------


@query("uncalled_functions", """
WITH c AS (SELECT DISTINCT target_id FROM g_edges WHERE kind IN ('calls', 'passes_result')),
r AS (SELECT target_id AS id FROM g_edges WHERE kind IN ('passes_to', 'dispatch_to', 'initializes') UNION SELECT n.func_id FROM g_edges e JOIN g_nodes n ON n.id = e.source_id WHERE e.kind = 'data_flows_to' AND e.target_id LIKE 'symbol:go:%:var.%' AND n.func_id IS NOT NULL)
SELECT id, id IN (SELECT id FROM r) AS referenced, regexp_matches(name, '^[A-Z]') AS exported FROM g_nodes WHERE kind IN ('function', 'method') AND name NOT IN ('main', 'init') AND file_path NOT LIKE '%\\_test.go' ESCAPE '\\' AND id NOT IN (SELECT target_id FROM c)
""")
def _(spark, d):
    g = shop.graph(spark, d)
    return deadcode.uncalled(g.nodes, g.edges).select("id", "referenced", "exported")


#: Table chains, by closure: a function is in the chain of the only head among all that lead to it, if none of these is on a cycle;
#: a ring is a cycle whose members have no caller but each other.
_CHAINS = """
fn AS (SELECT id, name FROM g_nodes WHERE kind IN ('function', 'method') AND file_path NOT LIKE '%\\_test.go' ESCAPE '\\'),
na AS (SELECT id FROM fn WHERE name NOT IN ('main', 'init')),
rf AS (SELECT target_id AS id FROM g_edges WHERE kind IN ('passes_to', 'dispatch_to', 'initializes') UNION SELECT n.func_id FROM g_edges e JOIN g_nodes n ON n.id = e.source_id WHERE e.kind = 'data_flows_to' AND e.target_id LIKE 'symbol:go:%:var.%' AND n.func_id IS NOT NULL),
ca AS (SELECT DISTINCT source_id AS a, target_id AS x FROM g_edges WHERE kind = 'calls' AND target_id IN (SELECT id FROM fn)),
an(x, a) AS (SELECT x, a FROM ca UNION SELECT an.x, ca.a FROM an JOIN ca ON ca.x = an.a),
up AS (SELECT x, a FROM an UNION SELECT id, id FROM na),
cy AS (SELECT x FROM an WHERE x = a),
hd AS (SELECT id FROM na WHERE id NOT IN (SELECT x FROM ca) AND id NOT IN (SELECT id FROM rf)),
st AS (SELECT x, min(a) AS head FROM up WHERE x IN (SELECT id FROM na) GROUP BY x
  HAVING count(*) FILTER (a NOT IN (SELECT x FROM ca)) = 1 AND count(*) FILTER (a IN (SELECT x FROM cy) OR a NOT IN (SELECT id FROM na)) = 0),
so AS (SELECT st.x, up.a AS head FROM st JOIN up ON up.x = st.x WHERE up.a NOT IN (SELECT x FROM ca)),
ri AS (SELECT an.x, min(an.a) AS head, max(CASE WHEN an.a IN (SELECT id FROM na) AND an.a NOT IN (SELECT id FROM rf) THEN 1 ELSE 0 END) AS fits FROM an JOIN cy ON cy.x = an.x LEFT JOIN an back ON back.x = an.a AND back.a = an.x GROUP BY an.x HAVING count(*) > 1 AND count(*) = count(back.x)),
chains AS (SELECT head, x AS id, false AS is_cycle FROM so WHERE head IN (SELECT id FROM hd) UNION ALL SELECT head, x, true FROM ri WHERE fits = 1)
"""


@query("isolated_chains", "WITH " + _CHAINS.strip() + "\nSELECT * FROM chains")
def _(spark, d):
    g = shop.graph(spark, d)
    return deadcode.isolated_chains(g.nodes, g.edges)


def _change_set(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    new = spark.createDataFrame([("cust/m3.go",)], "file_path string")
    return new, s.select(F.concat(F.lit("cust/m"), F.col("s_suppkey") % 25, F.lit(".go")).alias("file_path"), (F.col("s_suppkey") * 37 % 4000).alias("line"))


@query("mark_since", """
WITH a AS (SELECT 'cust/m' || (s_suppkey % 25) || '.go' AS file_path, s_suppkey * 37 % 4000 AS line FROM supplier)
SELECT n.id, CASE WHEN n.file_path = 'cust/m3.go' OR EXISTS (SELECT 1 FROM a WHERE a.file_path = n.file_path AND a.line = n.line_start) THEN 'new'
  WHEN EXISTS (SELECT 1 FROM a WHERE a.file_path = n.file_path AND a.line BETWEEN n.line_start AND n.line_end) THEN 'mod' ELSE '' END AS since FROM g_nodes n WHERE n.kind = 'function'
""")
def _(spark, d):
    g = shop.graph(spark, d)
    return deadcode.mark_since(g.nodes.where("kind = 'function'").select("id", "file_path", "line_start", "line_end"), *_change_set(spark, d)).select("id", "since")


@query("unused_since", "WITH " + _CHAINS.strip() + """,
ad AS (SELECT 'cust/m' || (s_suppkey % 25) || '.go' AS file_path, s_suppkey * 37 % 4000 AS line FROM supplier),
ma AS (SELECT n.id FROM g_nodes n WHERE n.id IN (SELECT id FROM fn) AND (n.file_path = 'cust/m3.go' OR EXISTS (SELECT 1 FROM ad WHERE ad.file_path = n.file_path AND ad.line BETWEEN n.line_start AND n.line_end)))
SELECT 'unused' AS part, id FROM ma WHERE id IN (SELECT id FROM na) AND id NOT IN (SELECT target_id FROM g_edges WHERE kind IN ('calls', 'passes_result'))
UNION ALL SELECT 'chain', id FROM chains WHERE head IN (SELECT head FROM chains WHERE id IN (SELECT id FROM ma))
""")
def _(spark, d):
    g = shop.graph(spark, d)
    dead, chains = deadcode.unused_report(g.nodes, g.edges, *_change_set(spark, d))
    return dead.select(F.lit("unused").alias("part"), "id").unionByName(chains.select(F.lit("chain").alias("part"), "id"))


# --- tables and their relations ------------------------------------------------------------------------------------


@query("er_columns", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM g_nodes WHERE kind = 'field_access' AND is_external = 'true' AND type_string IN ('sql', 'gorm', 'xorm') AND regexp_full_match(name, '[^.]+\\.[^.]+'))
SELECT split_part(name, '.', 1) AS table_name, split_part(name, '.', 2) AS column_name, access_kind AS access, line_start::BIGINT AS line FROM c WHERE k = 1
""")
def _(spark, d):
    return _longs(relations.all_columns(shop.graph(spark, d).nodes))


@query("er_tables", """
SELECT split_part(name, '.', 1) AS table_name, string_agg(DISTINCT split_part(name, '.', 2), ',' ORDER BY split_part(name, '.', 2)) AS columns FROM g_nodes WHERE kind = 'field_access' AND is_external = 'true' AND type_string IN ('sql', 'gorm', 'xorm') AND regexp_full_match(name, '[^.]+\\.[^.]+') GROUP BY 1
""")
def _(spark, d):
    return relations.er_tables(shop.graph(spark, d).nodes).select("table_name", F.array_join("columns", ",").alias("columns"))


@query("table_columns", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM g_nodes WHERE kind = 'field_access' AND is_external = 'true' AND contains(name, '.')),
w AS (SELECT DISTINCT c.name, regexp_replace(e.source_id, '#[^#]*$', '') AS f, coalesce(e.line_num, n.line_start) AS l FROM c JOIN g_edges e ON e.target_id = c.id AND e.kind = 'summary_io' LEFT JOIN g_nodes n ON n.id = e.source_id),
r AS (SELECT DISTINCT c.name, regexp_replace(e.target_id, '#[^#]*$', '') AS f, coalesce(e.line_num, n.line_start) AS l FROM c JOIN g_edges e ON e.source_id = c.id AND e.kind = 'summary_io' LEFT JOIN g_nodes n ON n.id = e.target_id WHERE c.access_kind = 'read')
SELECT split_part(c.name, '.', 1) AS table_name, split_part(c.name, '.', 2) AS column_name, c.access_kind AS access,
  coalesce((SELECT string_agg(f || ':' || l, ',' ORDER BY f, l) FROM w WHERE w.name = c.name), '') AS writers, coalesce((SELECT string_agg(f || ':' || l, ',' ORDER BY f, l) FROM r WHERE r.name = c.name), '') AS readers FROM c WHERE k = 1
""")
def _(spark, d):
    g = shop.graph(spark, d)
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda p: F.concat_ws(":", p["func_id"], p["line"])), ","), F.lit("")).alias(c)
    return relations.table_columns(g.nodes, g.edges).select("table_name", "column_name", "access", text("writers"), text("readers"))


@query("relations_all")
def _(spark, d):
    g = shop.graph(spark, d)
    return _longs(relations.infer(g.nodes, g.edges))


@query("relations_table")
def _(spark, d):
    g = shop.graph(spark, d)
    one = spark.createDataFrame([("t1",)], "table_name string")
    return _longs(relations.shown(relations.infer(g.nodes, g.edges, one)))


@query("where_direct", """
WITH c AS (SELECT DISTINCT split_part(name, '.', 1) AS t, split_part(name, '.', 2) AS c, access_kind FROM g_nodes WHERE kind = 'field_access' AND is_external = 'true' AND type_string = 'sql'),
f AS (SELECT DISTINCT t, c FROM c WHERE access_kind = 'filter' AND c <> 'id' AND c <> t AND c <> t || '_id'),
b AS (SELECT t, c, CASE WHEN c LIKE '%\\_id' ESCAPE '\\' THEN left(c, length(c) - 3) ELSE c END AS base FROM f),
x AS (SELECT b.t AS from_table, b.c AS from_col, min(o.t) AS to_table, 'id' AS to_col FROM b JOIN c o ON o.c = 'id' AND o.t <> b.t AND o.t LIKE '%' || b.base GROUP BY 1, 2),
y AS (SELECT f.t AS from_table, f.c AS from_col, o.t AS to_table, min(o.c) AS to_col FROM f JOIN c o ON o.t <> f.t AND replace(lower(o.c), '_', '') = replace(lower(f.c), '_', '') WHERE f.c LIKE '%id' GROUP BY 1, 2, 3)
SELECT DISTINCT *, 0::BIGINT AS hops, 'fk' AS type FROM (SELECT * FROM x UNION ALL SELECT * FROM y)
""")
def _(spark, d):
    return _longs(relations.where_direct(shop.graph(spark, d).nodes))


#: Relations made of order and supplier keys, so that filters and merges have something to decide.
_CANDIDATES = """
SELECT 'a' || (o_custkey % 4) AS from_table, CASE o_orderkey % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'b' || (o_orderkey % 5) || '_id' ELSE 'title' END AS from_col, 'a' || (o_orderkey % 5) AS to_table,
  CASE o_orderkey % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'a' || (o_custkey % 4) || '_id' ELSE 'name' END AS to_col, CAST(o_orderkey % 7 AS INT) AS hops, CASE o_custkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'query' ELSE 'fk' END AS type
FROM {orders}
"""


def _candidates(spark, d):
    return spark.sql(_CANDIDATES, orders=spark.read.parquet(f"{d}/orders.parquet"))


_RANK = "CASE type WHEN 'fk' THEN 3 WHEN 'query' THEN 2 WHEN 'write' THEN 1 ELSE 0 END"
_C = f"WITH c AS ({_CANDIDATES.format(orders='orders')}),\n"


@query("relation_merge", _C + f"""m AS (SELECT from_table, from_col, to_table, to_col, min(hops)::BIGINT AS hops, max({_RANK}) AS k FROM c GROUP BY ALL)
SELECT from_table, from_col, to_table, to_col, hops, ['read', 'write', 'query', 'fk'][k + 1] AS type FROM m""", bare=True)
def _(spark, d):
    return _longs(relations.merge(_candidates(spark, d)))


@query("relation_best", _C + f"""m AS (SELECT *, row_number() OVER (PARTITION BY from_table, from_col, to_table, to_col ORDER BY hops, {_RANK} DESC) AS n FROM c)
SELECT from_table, from_col, to_table, to_col, hops::BIGINT AS hops, type FROM m WHERE n = 1""", bare=True)
def _(spark, d):
    return _longs(relations.best_of(_candidates(spark, d)))


@query("relation_key_noise", _C + """o AS (SELECT *, max((from_col <> 'id')::INT) OVER (PARTITION BY from_table, to_table, to_col) = 1 AS other FROM c)
SELECT from_table, from_col, to_table, to_col, hops::BIGINT AS hops, type FROM o WHERE NOT (from_col = 'id' AND (to_col = 'id' OR (other AND type NOT IN ('query', 'fk'))))""", bare=True)
def _(spark, d):
    return _longs(relations.without_key_noise(_candidates(spark, d)))


@query("relation_dedup", _C + """s AS (SELECT *, CASE WHEN type IN ('query', 'fk') OR (type = 'write' AND lower(to_col) LIKE '%id') THEN concat_ws('|', from_table, from_col, to_table, to_col) ELSE concat_ws('|', from_table, from_col, to_table) END AS k FROM c
  WHERE from_table <> to_table AND NOT (type IN ('query', 'read') AND hops > 4)),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY hops, to_col, type) AS n FROM s)
SELECT from_table, from_col, to_table, to_col, hops::BIGINT AS hops, type FROM n WHERE n = 1""", bare=True)
def _(spark, d):
    return _longs(relations.dedup(_candidates(spark, d)))


@query("relation_counts", _C + "x AS (SELECT 1) SELECT type, count(*) AS n FROM c GROUP BY type", bare=True)
def _(spark, d):
    return relations.count_by_type(_candidates(spark, d))


def _rules(spark):
    rows = [(1, "", "title", "t1", "id", 0), (2, "t2", "id", "t3", "title", 0), (3, "t0", "none", "t1", "id", 0), (4, "t4", "title", "t9", "id", 0)]
    return spark.createDataFrame(rows, "id long, from_table string, from_col string, to_table string, to_col string, created_at long")


@query("rule_relations", """
WITH c AS (SELECT DISTINCT split_part(name, '.', 1) AS t, split_part(name, '.', 2) AS c FROM g_nodes WHERE kind = 'field_access' AND is_external = 'true'),
r(ft, fc, tt, tc) AS (VALUES ('', 'title', 't1', 'id'), ('t2', 'id', 't3', 'title'), ('t0', 'none', 't1', 'id'), ('t4', 'title', 't9', 'id'))
SELECT DISTINCT s.t AS from_table, fc AS from_col, tt AS to_table, tc AS to_col, 1::BIGINT AS hops, 'fk' AS type FROM r JOIN c s ON s.c = fc AND (ft = '' OR ft = s.t) JOIN c x ON x.t = tt AND x.c = tc WHERE s.t <> tt
""")
def _(spark, d):
    return _longs(relations.of_rules(shop.graph(spark, d).nodes, _rules(spark)))


_WHERE_DIRECT = """
cw AS (SELECT DISTINCT split_part(name, '.', 1) AS t, split_part(name, '.', 2) AS c, access_kind FROM g_nodes WHERE kind = 'field_access' AND is_external = 'true' AND type_string = 'sql'),
fw AS (SELECT DISTINCT t, c FROM cw WHERE access_kind = 'filter' AND c <> 'id' AND c <> t AND c <> t || '_id'),
bw AS (SELECT t, c, CASE WHEN c LIKE '%\\_id' ESCAPE '\\' THEN left(c, length(c) - 3) ELSE c END AS base FROM fw),
wd AS (SELECT DISTINCT from_table, from_col, to_table, to_col, 0 AS hops, 'fk' AS type FROM (
  SELECT bw.t AS from_table, bw.c AS from_col, min(o.t) AS to_table, 'id' AS to_col FROM bw JOIN cw o ON o.c = 'id' AND o.t <> bw.t AND o.t LIKE '%' || bw.base GROUP BY 1, 2
  UNION ALL SELECT fw.t, fw.c, o.t, min(o.c) FROM fw JOIN cw o ON o.t <> fw.t AND replace(lower(o.c), '_', '') = replace(lower(fw.c), '_', '') WHERE fw.c LIKE '%id' GROUP BY 1, 2, 3))
"""


@query("rule_merge", "WITH " + _WHERE_DIRECT.strip() + """,
cr AS (SELECT DISTINCT split_part(name, '.', 1) AS t, split_part(name, '.', 2) AS c FROM g_nodes WHERE kind = 'field_access' AND is_external = 'true'),
r(ft, fc, tt, tc) AS (VALUES ('', 'title', 't1', 'id'), ('t2', 'id', 't3', 'title'), ('t0', 'none', 't1', 'id'), ('t4', 'title', 't9', 'id')),
al AS (SELECT *, false AS is_rule FROM wd UNION ALL SELECT DISTINCT s.t, fc, tt, tc, 1, 'fk', true FROM r JOIN cr s ON s.c = fc AND (ft = '' OR ft = s.t) JOIN cr x ON x.t = tt AND x.c = tc WHERE s.t <> tt)
SELECT from_table, from_col, to_table, to_col, hops::BIGINT AS hops, type, is_rule FROM (SELECT *, row_number() OVER (PARTITION BY from_table, from_col, to_table, to_col ORDER BY is_rule DESC, hops) AS k FROM al) WHERE k = 1
""")
def _(spark, d):
    g = shop.graph(spark, d)
    return _longs(relations.with_rules(relations.where_direct(g.nodes), relations.of_rules(g.nodes, _rules(spark))))


@query("table_path", _C.replace("WITH", "WITH RECURSIVE", 1) + f"""
bo AS (SELECT from_table AS a, from_col AS ac, to_table AS b, to_col AS bc, type, hops FROM c UNION ALL SELECT to_table, to_col, from_table, from_col, type, hops FROM c),
be AS (SELECT a, ac, b, bc, type FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY {_RANK} DESC, hops, ac, bc) AS k FROM bo) WHERE k = 1 AND a <> b),
pa(spot, visited) AS (SELECT 'a0', ['a0'] UNION ALL SELECT be.b, list_append(visited, be.b) FROM pa JOIN be ON be.a = pa.spot WHERE NOT list_contains(visited, be.b) AND len(visited) < 7),
sh AS (SELECT visited, row_number() OVER (ORDER BY visited) AS path_no FROM (SELECT *, min(len(visited)) OVER () AS m FROM pa WHERE spot = 'a4') WHERE len(visited) = m),
st AS (SELECT path_no, visited, unnest(range(1, len(visited))) AS i FROM sh)
SELECT path_no, (i - 1)::BIGINT AS step, be.a AS from_table, be.ac AS from_col, be.b AS to_table, be.bc AS to_col, be.type FROM st JOIN be ON be.a = visited[i] AND be.b = visited[i + 1]
""", bare=True)
def _(spark, d):
    return _longs(relations.table_path(_candidates(spark, d), "a0", "a4"))


# --- modules, routes, facts ----------------------------------------------------------------------------------------


def _modules(spark):
    return spark.createDataFrame([("shop", "all"), ("shop/cust", "customers"), ("shop/supp", "suppliers")], "prefix string, name string")


_MODULE_SQL = """
WITH im AS (SELECT source_id, min(target_id) AS impl FROM g_edges WHERE kind = 'grpc_impl' GROUP BY 1),
nm AS (SELECT n.name, min(i.target_id) AS impl FROM g_edges i JOIN g_nodes n ON n.id = i.source_id WHERE i.kind = 'grpc_impl' GROUP BY 1),
cl AS (SELECT e.source_id, e.target_id, e.kind, e.method, e.path, CASE WHEN e.kind = 'grpc_call' THEN coalesce(im.impl, nm.impl) ELSE CASE WHEN h.kind = 'http_route' THEN h.handler_id END END AS implementer
  FROM g_edges e LEFT JOIN im ON im.source_id = e.target_id LEFT JOIN g_nodes h ON h.id = e.target_id LEFT JOIN nm ON nm.name = h.name WHERE e.kind IN ('grpc_call', 'http_call')),
mo(prefix, name) AS (VALUES ('shop', 'all'), ('shop/cust', 'customers'), ('shop/supp', 'suppliers')),
pk AS (SELECT p, coalesce((SELECT name FROM mo WHERE p = prefix OR starts_with(p, prefix || '/') ORDER BY length(prefix) DESC LIMIT 1), '') AS module FROM (SELECT DISTINCT regexp_extract(x, '^symbol:go:(.*):[^:]*$', 1) AS p FROM (SELECT source_id AS x FROM cl UNION SELECT implementer FROM cl) WHERE x IS NOT NULL)),
mc AS (SELECT cl.*, a.module AS from_module, coalesce(b.module, '') AS to_module FROM cl JOIN pk a ON a.p = regexp_extract(source_id, '^symbol:go:(.*):[^:]*$', 1) LEFT JOIN pk b ON b.p = regexp_extract(implementer, '^symbol:go:(.*):[^:]*$', 1))
"""


@query("module_calls", _MODULE_SQL + "SELECT * FROM mc")
def _(spark, d):
    g = shop.graph(spark, d)
    return modules.module_calls(g.nodes, g.edges, _modules(spark)).select("source_id", "target_id", "kind", "method", "path", "implementer", "from_module", "to_module")


@query("module_edges", _MODULE_SQL + """
SELECT from_module, to_module, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels FROM (SELECT *, CASE WHEN kind = 'grpc_call' THEN 'grpc ' || coalesce(method, '') ELSE 'http ' || coalesce(path, '') END AS label FROM mc)
WHERE from_module <> '' AND to_module <> '' AND from_module <> to_module GROUP BY 1, 2
""")
def _(spark, d):
    g = shop.graph(spark, d)
    return modules.module_edges(modules.module_calls(g.nodes, g.edges, _modules(spark)))


@query("url_parts", """
SELECT DISTINCT url, regexp_extract(url, '^(?:.*?://)?([^/?]*)', 1) AS host, CASE WHEN regexp_extract(url, '^(?:.*?://)?[^/?]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^(?:.*?://)?[^/?]*([^?#]*)', 1) END AS path FROM pages
""", bare=True)
def _(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("url", naming.url_host(F.col("url")).alias("host"), naming.url_path(F.col("url")).alias("path")).distinct()


@query("route_match", """
WITH u AS (SELECT DISTINCT url, regexp_extract(url, '^(?:.*?://)?([^/?]*)', 1) AS host, CASE WHEN regexp_extract(url, '^(?:.*?://)?[^/?]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^(?:.*?://)?[^/?]*([^?#]*)', 1) END AS path FROM pages),
r(route, pattern) AS (VALUES ('/', '/.*'), ('/p/{id}', '/p/[^/]*'), ('/{a}/{b}', '/[^/]*/[^/]*'), ('/{a}', '/[^/]*'))
SELECT url, host, path, route FROM u JOIN r ON regexp_full_match(path, pattern)
""", bare=True)
def _(spark, d):
    urls = spark.read.parquet(f"{d}/pages.parquet").select("url")
    routes = spark.createDataFrame([("/",), ("/p/{id}",), ("/{a}/{b}",), ("/{a}",)], "route string")
    return modules.match_routes(urls, routes)


def _write_facts(o, c):
    """Direct writes of each customer's function, and a call for each order."""
    k = F.col("o_orderkey")
    functions = max(c.count(), 1)
    calls = o.select(F.concat(F.lit("f"), "o_custkey").alias("caller_id"), F.concat(F.lit("f"), k * 7919 % functions).alias("callee_id"), (k % 9).alias("call_line"), F.array(F.concat(F.lit("T"), k % 3)).alias("arg_paths"), F.array(F.lit("x")).alias("arg_names"))
    direct = c.select(F.concat(F.lit("f"), "c_custkey").alias("function_id"), F.concat(F.lit("T"), F.col("c_custkey") % 3, F.lit(".F")).alias("field_path"))
    return direct, calls


@query("indirect_writes", """
WITH s AS (SELECT DISTINCT 'f' || o_custkey AS caller, 'f' || (o_orderkey * 7919 % (SELECT count(*) FROM customer)) AS callee, o_orderkey % 9 AS line, 'T' || (o_orderkey % 3) AS owner FROM orders),
w AS (SELECT DISTINCT 'f' || c_custkey AS f, 'T' || (c_custkey % 3) || '.F' AS p FROM customer),
r(f, p) AS (SELECT f, p FROM w UNION SELECT s.caller, r.p FROM r JOIN s ON s.callee = r.f AND s.owner || '.F' = r.p)
SELECT DISTINCT s.caller AS function_id, r.p AS field_path, s.line::BIGINT AS call_line, s.callee AS callee_id FROM r JOIN s ON s.callee = r.f AND s.owner || '.F' = r.p
""")
def _(spark, d):
    direct, calls = _write_facts(spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet"))
    return closure.indirect_writes(direct, calls)[1].select("function_id", "field_path", "call_line", "callee_id")


_ARGUMENT_PLACES = "SELECT DISTINCT 'f' || o_custkey AS caller_id, 'f' || (o_orderkey * 7919 % greatest((SELECT count(*) FROM {customer}), 1)) AS callee_id, 'A' || (o_orderkey % 5) AS allocation FROM {orders}"
_WRITER_PLACES = "SELECT 'f' || c_custkey AS callee_id, 'T' || (c_custkey % 3) || '.F' AS field_path, 'A' || (c_custkey % 7) AS allocation FROM {customer}"


@query("indirect_writes_disjoint", f"""
WITH a AS ({_ARGUMENT_PLACES.format(customer="customer", orders="orders")}), p AS ({_WRITER_PLACES.format(customer="customer")}),
x AS (SELECT DISTINCT a.caller_id, p.callee_id, p.field_path FROM a JOIN p USING (callee_id) EXCEPT SELECT a.caller_id, a.callee_id, p.field_path FROM a JOIN p USING (callee_id, allocation)),
s AS (SELECT DISTINCT 'f' || o_custkey AS caller, 'f' || (o_orderkey * 7919 % (SELECT count(*) FROM customer)) AS callee, o_orderkey % 9 AS line, 'T' || (o_orderkey % 3) AS owner FROM orders),
w AS (SELECT DISTINCT 'f' || c_custkey AS f, 'T' || (c_custkey % 3) || '.F' AS p FROM customer),
r(f, p) AS (SELECT f, p FROM w UNION SELECT s.caller, r.p FROM r JOIN s ON s.callee = r.f AND s.owner || '.F' = r.p WHERE (s.caller, s.callee, r.p) NOT IN (SELECT (caller_id, callee_id, field_path) FROM x))
SELECT DISTINCT s.caller AS function_id, r.p AS field_path, s.line::BIGINT AS call_line, s.callee AS callee_id FROM r JOIN s ON s.callee = r.f AND s.owner || '.F' = r.p WHERE (s.caller, s.callee, r.p) NOT IN (SELECT (caller_id, callee_id, field_path) FROM x)
""")
def _(spark, d):
    o, c = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    direct, calls = _write_facts(o, c)
    excluded = closure.disjoint_writes(spark.sql(_ARGUMENT_PLACES, customer=c, orders=o), spark.sql(_WRITER_PLACES, customer=c))
    return closure.indirect_writes(direct, calls, excluded)[1].select("function_id", "field_path", "call_line", "callee_id")


_CALLS = "SELECT o_orderkey AS call_id, o_custkey % 50 AS callee, 'g' || (o_custkey % 50) AS callee_id, CASE WHEN o_orderkey % 6 <> 0 THEN 'r' || o_orderkey END AS result, CASE WHEN o_orderkey % 4 = 0 THEN 'I' || (o_custkey % 3) END AS interface, CASE WHEN o_orderkey % 4 = 0 THEN 'enum' END AS candidate_origin, CASE WHEN o_orderkey % 4 = 0 THEN CAST(0.7 AS DOUBLE) END AS confidence FROM {orders}"
_ARGUMENTS = "SELECT l_orderkey AS call_id, l_linenumber - 1 AS position, 'v' || (l_partkey % 997) AS value, l_linestatus = 'F' AS is_const FROM {lineitem}"
_EXTRACTS = "SELECT l_orderkey AS call_id, l_linenumber - 1 AS position, 'x' || l_orderkey || '.' || l_linenumber AS value FROM {lineitem} WHERE l_orderkey % 5 <> 0 AND l_linenumber <= 3"
_PARAMETERS = "SELECT DISTINCT 'g' || (c_custkey % 50) AS func_id, n_nationkey AS position, 'p' || (c_custkey % 50) || '.' || n_nationkey AS value FROM {customer}, {nation} WHERE n_nationkey < 1 + c_custkey % 50 % 5"
_RETURNS = "SELECT DISTINCT 'g' || (c_custkey % 50) AS func_id, r_regionkey AS statement, n_nationkey AS position, 'o' || (c_custkey % 50) || '.' || r_regionkey || '.' || n_nationkey AS value FROM {customer}, {nation}, {region} WHERE r_regionkey < 1 + c_custkey % 50 % 2 AND n_nationkey < 1 + c_custkey % 50 % 3"
_SOURCES = dict(orders="orders", lineitem="lineitem", customer="customer", nation="nation", region="region")


@query("value_flow", f"""
WITH c AS ({_CALLS.format(**_SOURCES)}), a AS ({_ARGUMENTS.format(**_SOURCES)}), x AS ({_EXTRACTS.format(**_SOURCES)}), p AS ({_PARAMETERS.format(**_SOURCES)}), r AS ({_RETURNS.format(**_SOURCES)}),
k AS (SELECT c.*, (SELECT max(r.position) FROM r WHERE r.func_id = c.callee_id) AS last, call_id IN (SELECT call_id FROM x) AS split FROM c WHERE result IS NOT NULL)
SELECT a.value AS source_id, p.value AS target_id, 'argument' AS kind, interface, confidence FROM c JOIN a USING (call_id) JOIN p ON p.func_id = c.callee_id AND p.position = a.position + CASE WHEN interface IS NULL THEN 0 ELSE 1 END WHERE NOT is_const
UNION SELECT r.value, result, 'returns', interface, confidence FROM k JOIN r ON r.func_id = callee_id WHERE last = 0 OR split
UNION SELECT result, x.value, 'data_flows_to', interface, confidence FROM k JOIN x USING (call_id) WHERE interface IS NULL
UNION SELECT r.value, x.value, 'returns', interface, confidence FROM k JOIN x USING (call_id) JOIN r ON r.func_id = callee_id AND r.statement = 0 AND r.position = x.position WHERE interface IS NOT NULL AND last > 0
""", bare=True)
def _(spark, d):
    tables = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in _SOURCES}
    facts = (spark.sql(q, **{t: v for t, v in tables.items() if f"{{{t}}}" in q}) for q in (_CALLS, _ARGUMENTS, _PARAMETERS, _RETURNS, _EXTRACTS))
    return callfacts.value_flow(*facts).select("source_id", "target_id", "kind", "interface", "confidence")


_LIBRARY_CALLS = "SELECT o_orderkey AS call_id, 'f' || o_custkey AS func_id, o_orderkey % 90 AS line, k AS key, 'ext:' || k AS callee_id FROM (SELECT *, CASE o_orderkey % 7 WHEN 0 THEN 'encoding/json.Unmarshal' WHEN 1 THEN 'fmt.Printf' WHEN 2 THEN 'net/http.(Request).FormValue' WHEN 3 THEN 'shop/audit.Mark' WHEN 4 THEN 'database/sql.(DB).Exec' WHEN 5 THEN 'shop/audit.None' ELSE 'net/http.(Request).ParseForm' END AS k FROM {orders}) o"
_LIBRARY_ARGUMENTS = "SELECT l_orderkey AS call_id, l_linenumber - 1 AS position, CASE WHEN l_linestatus = 'O' THEN 'v' || l_partkey END AS value, CASE WHEN l_partkey % 3 > 0 THEN 'shop/a.T' || (l_partkey % 3) END AS type, 'i' || l_linenumber AS instance FROM {lineitem}"
_LIBRARY_SPECS = "summaries:\n  - func: shop/audit.Mark\n    param_index: 2\n    reads: [Seen, By]\n    writes: [Seen]\n  - func: fmt.Printf\n    param_index: 3\n    reads: [Text]\n"


@query("library_effects", f"""
WITH c AS ({_LIBRARY_CALLS.format(orders="orders")}), a AS ({_LIBRARY_ARGUMENTS.format(lineitem="lineitem")}),
s(key, first, field, access) AS (VALUES ('encoding/json.Unmarshal', 1, NULL, 'write'), ('fmt.Printf', 3, 'Text', 'read'), ('net/http.(Request).FormValue', 0, 'Form', 'read'), ('net/http.(Request).ParseForm', 0, 'Form', 'write'), ('shop/audit.Mark', 2, 'Seen', 'write'), ('shop/audit.Mark', 2, 'By', 'read')),
o(owner, field) AS (VALUES ('shop/a.T1', 'Id'), ('shop/a.T1', 'Inner'), ('shop/a.T1', 'Inner.Size'), ('shop/a.T2', 'Size')),
u AS (SELECT c.*, a.value, a.type, coalesce(s.field, o.field) AS field, s.access FROM c JOIN s USING (key) JOIN a ON a.call_id = c.call_id AND a.position >= s.first LEFT JOIN o ON s.field IS NULL AND o.owner = a.type WHERE coalesce(s.field, o.field) IS NOT NULL),
n AS (SELECT *, func_id || '#ext.' || CASE WHEN type IS NULL THEN field ELSE type || '.' || regexp_extract(field, '([^.]*)$', 1) END || '.' || access || '@' || line AS id FROM u)
SELECT callee_id AS source_id, id AS target_id, 'summary_io' AS kind FROM n UNION SELECT func_id, id, 'indirect_write' FROM n WHERE access = 'write'
UNION SELECT value, id, 'data_flows_to' FROM n WHERE access = 'write' AND value IS NOT NULL UNION SELECT id, value, 'data_flows_to' FROM n WHERE access = 'read' AND value IS NOT NULL
""", bare=True)
def _(spark, d):
    specs = callfacts.with_user_specs(callfacts.library(spark), readers.field_summaries(spark, _LIBRARY_SPECS))
    calls = spark.sql(_LIBRARY_CALLS, orders=spark.read.parquet(f"{d}/orders.parquet"))
    own = spark.createDataFrame([("shop/a.T1", "Id", "int"), ("shop/a.T1", "Inner", "shop/a.T2"), ("shop/a.T2", "Size", "int")], "owner string, name string, type string")
    arguments = spark.sql(_LIBRARY_ARGUMENTS, lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))
    return callfacts.argument_effects(callfacts.known_calls(calls, specs), arguments, closure.owned_fields(own))[1].select("source_id", "target_id", "kind")


@query("may_alias", """
WITH e AS (SELECT source_id AS a, target_id AS b FROM g_edges WHERE kind IN ('data_flows_to', 'argument', 'returns')),
r(value, allocation, d) AS (SELECT id, id, 0 FROM g_nodes WHERE kind = 'ssa_value' UNION SELECT e.b, r.allocation, d + 1 FROM r JOIN e ON e.a = r.value WHERE d < 20)
SELECT DISTINCT value, allocation FROM r
""")
def _(spark, d):
    g = shop.graph(spark, d)
    start = g.nodes.where("kind = 'ssa_value'").select(F.col("id").alias("value"), F.col("id").alias("allocation"))
    return closure.may_alias(start, g.edges.where(F.col("kind").isin("data_flows_to", "argument", "returns")).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")))


# --- scalar functions ----------------------------------------------------------------------------------------------


@query("id_functions", """
SELECT id, regexp_extract(id, '([^:]*)$', 1) AS short_name, regexp_replace(regexp_replace(id, '^symbol:go:', ''), ':[^:]*$', '') AS package,
  CASE WHEN regexp_matches(id, ':\\([^()]+\\)\\.[^:]*$') THEN regexp_replace(id, ':\\(([^()]+)\\)\\.[^:]*$', ':\\1') END AS struct_id, regexp_replace(id, '#[^#]*$', '') AS func_part,
  regexp_matches(name, '^t[0-9]+$') AS ssa_name, regexp_matches(name, '^[A-Z]') AS exported,
  CASE WHEN type_string IS NOT NULL AND trim(regexp_extract(type_string, '([^.]*)$', 1), '[]*') NOT IN ('', 'any', 'string', 'int', 'int64', 'bool', 'error', 'byte') THEN trim(regexp_extract(type_string, '([^.]*)$', 1), '[]*') END AS type_name
FROM g_nodes
""")
def _(spark, d):
    i, name = F.col("id"), F.col("name")
    return shop.graph(spark, d).nodes.select("id", ids.short_name(i).alias("short_name"), ids.package_of(i).alias("package"), ids.struct_of_method(i).alias("struct_id"), ids.function_of(i).alias("func_part"), ids.is_ssa_name(name).alias("ssa_name"), ids.is_exported(name).alias("exported"), ids.type_name(F.col("type_string")).alias("type_name"))


#: Columns of the graph, each beside tables of several spellings.
_PAIRS = "SELECT DISTINCT split_part(name, '.', 2) AS col, CASE line_start % 4 WHEN 0 THEN 't' || (line_start % 7) WHEN 1 THEN 'tb_t' || (line_start % 7) || 's' WHEN 2 THEN 'T_title' ELSE 'x_t' || (line_start % 5) END AS tbl FROM {nodes} WHERE is_external = 'true'"


@query("column_affinity", "WITH p AS (" + _PAIRS.format(nodes="g_nodes") + """),
b AS (SELECT *, lower(col) AS l, lower(tbl) AS t, CASE WHEN lower(col) LIKE '%\\_id' ESCAPE '\\' AND length(col) > 3 THEN left(lower(col), length(col) - 3) WHEN lower(col) LIKE '%id' AND length(col) > 2 THEN left(lower(col), length(col) - 2) ELSE lower(col) END AS base,
  regexp_replace(regexp_replace(regexp_replace(lower(tbl), '^t_', ''), '^tb_', ''), 's$', '') AS one FROM p)
SELECT col, tbl, base <> '' AND ends_with(t, base) AS fk, replace(l, '_', '') LIKE '%id' AS is_key, l = 'id' OR l = one OR l = one || '_id' AS pk FROM b
""")
def _(spark, d):
    p, c, t = spark.sql(_PAIRS, nodes=shop.graph(spark, d).nodes), F.col("col"), F.col("tbl")
    return p.select("col", "tbl", A.foreign_key_of(c, t).alias("fk"), A.is_key(c).alias("is_key"), A.primary_key_of(c, t).alias("pk"))


#: Names put together from words, and what they have to become.
_NAMES = """
SELECT DISTINCT upper(left(a, 1)) || substring(a, 2) || upper(left(b, 1)) || substring(b, 2) || CASE p_partkey % 5 WHEN 1 THEN 'ID' WHEN 2 THEN 'SourceURL' WHEN 3 THEN 'HTTPServer' WHEN 4 THEN 'V2' ELSE '' END AS name,
  a || '_' || b || CASE p_partkey % 5 WHEN 1 THEN '_id' WHEN 2 THEN '_source_url' WHEN 3 THEN '_http_server' WHEN 4 THEN '_v2' ELSE '' END AS snake
FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM {part}) w
"""


@query("snake_case", _NAMES.format(part="part"), bare=True)
def _(spark, d):
    return spark.sql(_NAMES, part=spark.read.parquet(f"{d}/part.parquet")).select("name", naming.snake_case(F.col("name")).alias("snake"))


#: Statements with their table, columns and filter columns.
_STATEMENTS = """
SELECT no, CASE no % 5 WHEN 0 THEN 'INSERT INTO `' || t || '` (' || c || ', kind) VALUES (?, now())' WHEN 1 THEN 'update ' || t || ' set ' || c || ' = ?, seen = 1 where ' || k || ' = ?' WHEN 2 THEN 'SELECT x.' || c || ', max(seen) FROM ' || t || ' x WHERE x.' || k || ' = $1 AND size > 3 GROUP BY 1'
    WHEN 3 THEN 'DELETE FROM ' || t || ' WHERE ' || k || ' = ? AND ' || c || ' = ? LIMIT 1' ELSE 'VACUUM ' || t END AS sql,
  CASE WHEN no % 5 < 4 THEN t ELSE '' END AS tbl, CASE no % 5 WHEN 0 THEN c || ',kind' WHEN 1 THEN c || ',seen' WHEN 2 THEN c ELSE '' END AS cols, CASE no % 5 WHEN 1 THEN k WHEN 2 THEN k WHEN 3 THEN k || ',' || c ELSE '' END AS where_cols
FROM (SELECT p_partkey AS no, 'tab_' || (p_partkey % 40) AS t, 'c' || (p_size % 20) AS c, 'k' || (p_partkey % 7) || '_id' AS k FROM {part}) p
"""


@query("sql_statements", f"SELECT sql, tbl, cols, where_cols FROM ({_STATEMENTS.format(part='part')})", bare=True)
def _(spark, d):
    s = spark.sql(_STATEMENTS, part=spark.read.parquet(f"{d}/part.parquet")).select("sql").withColumn("p", parse_sql("sql"))
    return s.select("sql", F.col("p.tbl").alias("tbl"), F.array_join("p.cols", ",").alias("cols"), F.array_join("p.where_cols", ",").alias("where_cols"))


_CONDITIONS = """
SELECT CASE no % 4 WHEN 0 THEN a || ' = ? AND ' || b || ' LIKE ?' WHEN 1 THEN 'm.' || a || ' IN (?) or ' || b || '>=$2 ORDER BY z ' WHEN 2 THEN b ELSE a || ' IS NULL' END AS condition, CASE no % 4 WHEN 0 THEN a || ',' || b WHEN 1 THEN 'm.' || a || ',' || b WHEN 2 THEN b ELSE a END AS cols
FROM (SELECT p_partkey AS no, 'c' || (p_size % 20) AS a, 'k' || (p_partkey % 7) || '_id' AS b FROM {part}) p
"""


@query("condition_columns", _CONDITIONS.format(part="part"), bare=True)
def _(spark, d):
    c = spark.sql(_CONDITIONS, part=spark.read.parquet(f"{d}/part.parquet"))
    return c.select("condition", F.array_join(condition_columns_udf("condition"), ",").alias("cols"))


@query("sql_columns", f"""
WITH s AS (SELECT * FROM ({_STATEMENTS.format(part='part')}) WHERE tbl <> ''),
w AS (SELECT no, tbl, no % 5 < 2 AS writes, unnest(string_split(cols, ',')) AS col, unnest(range(1, len(string_split(cols, ',')) + 1)) AS i FROM s WHERE cols <> ''),
x AS (SELECT no, tbl, col, CASE WHEN writes THEN 'write' ELSE 'read' END AS access, CASE WHEN writes THEN i END AS arg FROM w
  UNION ALL SELECT no, tbl, col, 'filter', i + CASE WHEN no % 5 = 1 THEN 2 ELSE 0 END FROM (SELECT no, tbl, unnest(string_split(where_cols, ',')) AS col, unnest(range(1, len(string_split(where_cols, ',')) + 1)) AS i FROM s WHERE where_cols <> '')),
y AS (SELECT 'f' || no || '#ext.sql.' || tbl || '.' || col || '.' || access || '@' || no AS id, access, 'f' || no || '#a' || arg AS source, 'f' || no || '#r' AS result FROM x)
SELECT id, '' AS target_id FROM y UNION ALL SELECT source, id FROM y WHERE access <> 'read' UNION ALL SELECT id, result FROM y WHERE access = 'read'
""", bare=True)
def _(spark, d):
    func = F.concat(F.lit("f"), "no")
    args = F.array(*(F.concat(func, F.lit(f"#a{i}")) for i in (1, 2, 3)))
    facts = spark.sql(_STATEMENTS, part=spark.read.parquet(f"{d}/part.parquet")).select(func.alias("func_id"), F.col("no").cast("int").alias("line"), "sql", args.alias("args"), F.concat(func, F.lit("#r")).alias("result"))
    nodes, edges = virtual_columns.from_sql(facts)
    return nodes.select("id", F.lit("").alias("target_id")).unionByName(edges.select(F.col("source_id").alias("id"), "target_id"))


def _as_lines(df: DataFrame, key: str, source: str, *lines: str) -> DataFrame:
    """A text in git's form: some lines a row, in the order of the key, in files by `source`."""
    made = df.select(F.expr(source).alias("source"), F.col(key).alias("_key"), F.posexplode(F.filter(F.array(*map(F.expr, lines)), lambda x: x.isNotNull())).alias("_at", "line"))
    return made.select("source", (F.col("_key") * 100 + F.col("_at")).alias("no"), "line")


def _diff(spark, d):
    """Every supplier is a changed file; some are new, some deleted."""
    s = spark.read.parquet(f"{d}/supplier.parquet").withColumn("f", F.concat(F.lit("m/s"), "s_suppkey", F.lit(".go"))).withColumn("n", F.col("s_suppkey") % 90 + 2)
    return _as_lines(s, "s_suppkey", "concat('diff', s_suppkey % 3)", "concat('diff --git a/', f, ' b/', f)", "if(s_suppkey % 5 = 0, 'deleted file mode 100644', if(s_suppkey % 5 = 1, 'new file mode 100644', null))", "if(s_suppkey % 5 = 1, '--- /dev/null', concat('--- a/', f))",
        "if(s_suppkey % 5 = 0, '+++ /dev/null', concat('+++ b/', f))", "concat('@@ -', n, ',3 +', n, ',3 @@ func g() {')", "' same'", "'-gone'", "'+one'", "'+two'", "concat('@@ -900 +', n + 500, ' @@')", "'+more'")


@query("git_diff", """
WITH f AS (SELECT 'm/s' || s_suppkey || '.go' AS file_path, s_suppkey % 90 + 2 AS n FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT file_path, unnest([n + 1, n + 2, n + 500])::BIGINT AS line FROM f
""", bare=True)
def _(spark, d):
    return _longs(gittext.parse_diff(_diff(spark, d))[1])


@query("git_new_files", "SELECT 'm/s' || s_suppkey || '.go' AS file_path FROM supplier WHERE s_suppkey % 5 = 1", bare=True)
def _(spark, d):
    return gittext.parse_diff(_diff(spark, d))[0]


def _log(spark, d):
    """Every supplier is a commit of two files, one of them renamed."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return gittext.parse_log(_as_lines(s, "s_suppkey", "concat('log', s_suppkey % 3)", "concat(md5(concat('c', s_suppkey)), '\t2024-01-02\t', s_name)", "''", "concat('m/a', s_suppkey % 7, '.go')", "concat('m/{x', s_suppkey, ' => y', s_suppkey % 11, '}/b.go')"))


_LOG = """
WITH c AS (SELECT md5('c' || s_suppkey) AS sha, s_name AS subject, s_suppkey AS k FROM supplier),
l AS (SELECT sha, subject, 'm/a' || (k % 7) || '.go' AS file_path FROM c UNION ALL SELECT sha, subject, 'm/y' || (k % 11) || '/b.go' FROM c)
"""


@query("git_log", _LOG + "SELECT sha, subject, file_path FROM l", bare=True)
def _(spark, d):
    return _log(spark, d).select("sha", "subject", "file_path")


@query("git_graph", _LOG + "SELECT 'commit:' || sha AS id, '' AS target_id FROM c UNION ALL SELECT DISTINCT 'file:' || file_path, 'commit:' || sha FROM l", bare=True)
def _(spark, d):
    nodes, edges = gittext.log_graph(_log(spark, d))
    return nodes.select("id", F.lit("").alias("target_id")).unionByName(edges.select(F.col("source_id").alias("id"), "target_id"))


@query("changed_files", "SELECT DISTINCT file_path AS path FROM g_nodes WHERE file_path LIKE '%.go'")
def _(spark, d):
    nodes = shop.graph(spark, d).nodes
    tracked = nodes.where("kind <> 'method'").select(F.col("file_path").alias("path"))
    untracked = nodes.where("kind = 'method'").select(F.col("file_path").alias("path")).unionByName(nodes.select(F.concat("id", F.lit(".md")).alias("path")))
    return gittext.changed_go_files(tracked, untracked)


# --- bundles and further facts -------------------------------------------------------------------------------------


def _bundle_sql(anchor: str) -> str:
    """Parts and ids of the context bundle of a function."""
    first = f"WITH o AS (SELECT * FROM g_nodes WHERE id = coalesce((SELECT min(id) FROM g_nodes WHERE func_id = '{anchor}' AND kind IN ('parameter', 'receiver', 'result', 'field_access')), '{anchor}')),"
    traced = _TRAMPOLINE.strip() + "," + _ANCHORS.format(pick="id = (SELECT id FROM o)").removeprefix("WITH") + _VT.format(conf=0.0, cont="").rstrip() + "," + _CHAIN
    return first + traced + f"""
SELECT 'symbol' AS part, id FROM g_nodes WHERE id = '{anchor}' UNION ALL SELECT 'callers', source_id FROM g_edges WHERE kind = 'calls' AND confidence >= 0.8 AND target_id = '{anchor}'
UNION ALL SELECT 'callees', target_id FROM g_edges WHERE kind = 'calls' AND confidence >= 0.8 AND source_id = '{anchor}' UNION ALL SELECT 'fields', field_path FROM g_summary WHERE function_id = '{anchor}'
UNION ALL (SELECT 'dispatch', target_id FROM g_edges WHERE kind = 'dispatch_to' AND target_id = '{anchor}' LIMIT 1) UNION ALL SELECT 'chain', name FROM main UNION ALL SELECT 'trace', id FROM vt WHERE depth <= 4
"""


def _bundle(spark, d, anchor):
    g = shop.graph(spark, d)
    parts = bundle.context(g.nodes, g.edges, g.summary, g.origins, anchor, steps=g.steps)
    key = {"callers": "source_id", "callees": "target_id", "fields": "field_path", "dispatch": "target_id", "chain": "name"}
    out = [df.select(F.lit(name).alias("part"), F.col(key.get(name, "id")).alias("id")) for name, df in parts.items()]
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return out[0]


@query("context_bundle", _bundle_sql(CUSTOMER))
def _(spark, d):
    return _bundle(spark, d, CUSTOMER)


@query("context_bundle_values", _bundle_sql(USER))
def _(spark, d):
    return _bundle(spark, d, USER)


@query("er_bundle", "WITH " + _WHERE_DIRECT.strip() + """,
co AS (SELECT split_part(name, '.', 1) AS t, split_part(name, '.', 2) AS c, access_kind AS access, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM g_nodes WHERE kind = 'field_access' AND is_external = 'true')
SELECT 'table' AS part, t AS name, string_agg(DISTINCT c, ',' ORDER BY c) AS value FROM co GROUP BY t UNION ALL SELECT 'column', t || '.' || c, access FROM co WHERE k = 1
UNION ALL SELECT 'relation', from_table || '.' || from_col || '>' || to_table || '.' || to_col, type FROM wd WHERE from_table <> to_table
""")
def _(spark, d):
    g = shop.graph(spark, d)
    parts = bundle.er(g.nodes, g.edges, relations.where_direct(g.nodes))
    end = lambda s: F.concat_ws(".", f"{s}_table", f"{s}_col")
    tables = parts["tables"].select(F.lit("table").alias("part"), F.col("table_name").alias("name"), F.array_join("columns", ",").alias("value"))
    columns = parts["columns"].select(F.lit("column").alias("part"), F.concat_ws(".", "table_name", "column_name").alias("name"), F.col("access").alias("value"))
    return tables.unionByName(columns).unionByName(parts["relations"].select(F.lit("relation").alias("part"), F.concat_ws(">", end("from"), end("to")).alias("name"), F.col("type").alias("value")))


@query("stale_build", "SELECT build_id, status, build_id <> 'b2' AS stale FROM g_builds ORDER BY timestamp DESC, build_id DESC LIMIT 1")
def _(spark, d):
    return bundle.stale(shop.graph(spark, d).builds.withColumn("commit_sha", F.col("build_id")), "b2").select("build_id", "status", "stale")


#: Fields of entities with their tags, and their tables and columns.
_ORM = """
SELECT DISTINCT upper(left(a, 1)) || substring(a, 2) || 'Book' AS entity, CASE k WHEN 0 THEN 'BuyerID' WHEN 1 THEN 'Fee' ELSE 'SourceURL' END || CAST(p_size % 9 AS {text}) AS field, CASE k WHEN 0 THEN 'gorm:"column:buyer' || CAST(p_size % 9 AS {text}) || '"' WHEN 1 THEN '' ELSE 'gorm:"primaryKey"' END AS tag,
  a || '_books' AS tbl, CASE k WHEN 0 THEN 'buyer' WHEN 1 THEN 'fee' ELSE 'source_url' END || CAST(p_size % 9 AS {text}) AS col
FROM (SELECT split_part(p_name, ' ', 1) AS a, p_partkey % 3 AS k, p_size FROM {part}) p
"""


@query("orm_columns", f"SELECT entity, field, tbl, col FROM ({_ORM.format(part='part', text='VARCHAR')})", bare=True)
def _(spark, d):
    fields = spark.sql(_ORM.replace("{text}", "STRING"), part=spark.read.parquet(f"{d}/part.parquet")).select("entity", "field", "tag")
    return virtual_columns.orm_mapping(fields, spark.createDataFrame([], "entity string, tbl string"))


@query("dotted_paths", r"""
WITH p AS (SELECT full_path AS path FROM g_nodes UNION SELECT instance_path FROM g_nodes UNION SELECT name FROM g_nodes)
SELECT path, regexp_extract(path, '([^.]*)$', 1) AS last, CASE WHEN length(path) - length(replace(path, '.', '')) < 2 THEN path ELSE regexp_replace(path, '\.[^.]*\.[^.]*$', '') END AS package FROM p WHERE path IS NOT NULL
""")
def _(spark, d):
    n = shop.graph(spark, d).nodes
    p = n.select(F.explode(F.array("full_path", "instance_path", "name")).alias("path")).where("path is not null").distinct()
    return p.select("path", ids.last_segment(F.col("path")).alias("last"), ids.dotted_package(F.col("path")).alias("package"))


_GRPC = """
SELECT DISTINCT CASE k WHEN 0 THEN 'New' || a || 'Client' WHEN 1 THEN 'Register' || a || 'Server' WHEN 2 THEN 'New' || lower(a) ELSE a || 'Client' END AS name, CASE k WHEN 0 THEN a ELSE '' END AS client, CASE k WHEN 1 THEN a ELSE '' END AS server, CASE k WHEN 0 THEN 'New' || a WHEN 3 THEN a ELSE '' END AS typed
FROM (SELECT upper(left(p_name, 1)) || substring(split_part(p_name, ' ', 1), 2) AS a, p_partkey % 4 AS k FROM {part}) p
"""


@query("grpc_names", _GRPC.format(part="part"), bare=True)
def _(spark, d):
    n = F.col("name")
    return spark.sql(_GRPC, part=spark.read.parquet(f"{d}/part.parquet")).select("name", naming.grpc_client_service(n).alias("client"), naming.grpc_register_service(n).alias("server"), naming.grpc_client_type_service(n).alias("typed"))


_PATHS = """
SELECT CASE k % 4 WHEN 0 THEN 'a/{{b' || k || ' => c' || k || '}}/d.go' WHEN 1 THEN 'a/{{x => }}/y' || k || '.go' WHEN 2 THEN 'old.go => new' || k || '.go' ELSE '"q' || k || '.go"' END AS path,
  CASE k % 4 WHEN 0 THEN 'a/c' || k || '/d.go' WHEN 1 THEN 'a/y' || k || '.go' WHEN 2 THEN 'new' || k || '.go' ELSE 'q' || k || '.go' END AS now
FROM (SELECT s_suppkey AS k FROM {supplier}) s
"""


@query("git_paths", _PATHS.format(supplier="supplier"), bare=True)
def _(spark, d):
    return spark.sql(_PATHS, supplier=spark.read.parquet(f"{d}/supplier.parquet")).select("path", naming.git_path(F.col("path")).alias("now"))


@query("rule_upkeep", "SELECT n AS id, CASE WHEN n % 2 = 0 THEN 'x' ELSE '' END AS from_table, lower(r_name) || '_id' AS from_col, 'u' AS to_table, 'id' AS to_col FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS n FROM region) WHERE n <> 2", bare=True)
def _(spark, d):
    rules = _rules(spark).limit(0)
    for i, (name,) in enumerate(spark.read.parquet(f"{d}/region.parquet").orderBy("r_regionkey").select("r_name").collect(), 1):  # five regions
        rules = ingest.add_rule(rules, f"{name.lower()}_id", "u", from_table="" if i % 2 else "x")
    return ingest.remove_rule(rules, 2).select("id", "from_table", "from_col", "to_table", "to_col")
