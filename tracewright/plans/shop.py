"""A code graph derived from the star-schema tables, by one SQL text that Spark and DuckDB both run.

Customers are functions that call each other along orders, nations are structs with suppliers as methods, events are values that
flow along their users and now and then to another one, and every tenth event is a database column. Integer arithmetic only, so all engines agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trace
from ..storage import keep, plan_by_memory

TABLES = ("region", "nation", "customer", "supplier", "orders", "events")

EVENTS = """
SELECT event_id, user_id, event_type, 'symbol:go:shop/user:u' || user_id AS func_id,
  CASE WHEN event_id % 10 = 0 THEN 't' || (user_id % 6) || '.' || CASE event_id % 40 WHEN 0 THEN 'id' WHEN 10 THEN 't' || (event_id % 7) || '_id' WHEN 20 THEN 'title' ELSE 't' || (user_id % 5) || '_id' END
       WHEN event_type IN ('purchase', 'signup') THEN 'T' || (event_id % 3) || '.F' || (event_id % 2) ELSE 't' || event_id END AS name,
  CASE WHEN event_id % 10 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'filter' END
       WHEN event_type = 'signup' OR (event_type = 'purchase' AND event_id % 2 = 0) THEN 'read' WHEN event_type = 'purchase' THEN 'write' END AS access_kind,
  CASE WHEN event_id % 10 = 0 OR event_type IN ('purchase', 'signup') THEN 'field_access' WHEN event_type = 'error' THEN 'parameter' ELSE 'ssa_value' END AS kind,
  'symbol:go:shop/user:u' || user_id || CASE WHEN event_id % 10 = 0 THEN '#ext.sql.' ELSE '#v' END || event_id AS id,
  lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id, lead(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later_id
FROM {events}
"""

NODES = """
SELECT 'symbol:go:shop/cust:f' || c_custkey AS id, 'function' AS kind,
  CASE WHEN c_custkey % 97 = 0 THEN 'main' WHEN c_custkey % 89 = 1 THEN 'init' WHEN c_custkey % 5 = 0 THEN 'F' || c_custkey ELSE 'f' || c_custkey END AS name,
  'cust/m' || c_nationkey || CASE WHEN c_custkey % 11 = 0 THEN '_test.go' ELSE '.go' END AS file_path,
  CAST(c_custkey % 400 * 10 + 1 AS INT) AS line_start, CAST(c_custkey % 400 * 10 + 9 AS INT) AS line_end,
  CAST(NULL AS {text}) AS full_path, CAST(NULL AS {text}) AS instance_path, CAST(NULL AS {text}) AS access_kind, CAST(NULL AS {text}) AS type_string,
  CAST(NULL AS {text}) AS func_id, CAST(NULL AS {text}) AS origin_kind, CAST(NULL AS {text}) AS is_external,
  CASE WHEN c_custkey % 101 = 0 THEN 'true' END AS serves_http, CAST(NULL AS {text}) AS handler_id
FROM {customer}
UNION ALL
SELECT 'symbol:go:shop/supp:S' || n_nationkey, 'struct', 'S' || n_nationkey, 'supp/s' || n_nationkey || '.go', CAST(n_nationkey AS INT), CAST(n_nationkey + 5 AS INT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {nation}
UNION ALL
SELECT 'symbol:go:shop/supp:(S' || s_nationkey || ').m' || s_suppkey, 'method', '(S' || s_nationkey || ').m' || s_suppkey, 'supp/s' || s_nationkey || '.go', CAST(s_suppkey AS INT), CAST(s_suppkey + 3 AS INT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {supplier}
UNION ALL
SELECT DISTINCT func_id, 'function', 'u' || user_id, 'user/u' || (user_id % 10) || '.go', CAST(user_id AS INT), CAST(user_id + 9 AS INT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ({user_events}) u
UNION ALL
SELECT id, kind, name, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'user/u' || (user_id % 10) || '.go' END, CAST(event_id % 1000 AS INT), CAST(event_id % 1000 AS INT),
  CASE WHEN event_id % 10 = 0 THEN name WHEN kind = 'field_access' THEN 'shop/user.' || name END, CASE WHEN kind = 'field_access' AND event_id % 4 = 1 THEN 'shop/user.' || name || '.x' END, access_kind,
  CASE WHEN event_id % 10 = 0 THEN 'sql' WHEN event_id % 7 = 3 THEN 'error' WHEN event_id % 4 = 0 THEN '*shop/user.T0' WHEN event_id % 4 = 1 THEN 'int' ELSE 'shop/user.T1' END,
  func_id, CASE WHEN event_id % 11 = 0 THEN 'global' WHEN event_id % 11 = 1 THEN 'parameter' ELSE 'local' END, CASE WHEN event_id % 10 = 0 THEN 'true' ELSE 'false' END, NULL, NULL
FROM ({user_events}) v
UNION ALL
SELECT 'symbol:go:shop/gen:svc.R' || r_regionkey, 'grpc_service', r_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {region}
UNION ALL
SELECT 'symbol:http:shop:route./r/' || r_regionkey, 'http_route', '/r/' || r_regionkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN r_regionkey % 2 = 0 THEN 'symbol:go:shop/cust:f' || r_regionkey END FROM {region}
"""

EDGES = """
SELECT 'symbol:go:shop/cust:f' || o_custkey AS source_id, 'symbol:go:shop/cust:f' || (o_orderkey * 7919 % n.c) AS target_id, CASE o_orderstatus WHEN 'P' THEN 'calls' WHEN 'F' THEN 'references' ELSE 'depends_on' END AS kind, max(0.5e0 + (o_orderkey % 6) / 10e0) AS confidence, CAST(min(o_orderkey % 300) AS INT) AS line_num,
  CAST(NULL AS {text}) AS method, CAST(NULL AS {text}) AS path, CAST(NULL AS {text}) AS interface, CAST(NULL AS {text}) AS candidate_origin, CAST(NULL AS DOUBLE) AS cand_confidence, CAST(NULL AS {text}) AS origin
FROM {orders}, (SELECT count(*) AS c FROM {customer}) n GROUP BY 1, 2, 3
UNION ALL
SELECT 'symbol:go:shop/supp:(S' || s_nationkey || ').m' || s_suppkey, 'symbol:go:shop/cust:f' || (s_suppkey * 13 % n.c), 'calls', 0.8e0, CAST(1 AS INT), NULL, NULL, NULL, NULL, NULL, NULL FROM {supplier}, (SELECT count(*) AS c FROM {customer}) n
UNION ALL
SELECT 'symbol:go:shop/cust:f' || c_custkey, 'symbol:go:shop/supp:(S' || s_nationkey || ').m' || s_suppkey, 'calls', 1e0, CAST(2 AS INT), NULL, NULL, NULL, NULL, NULL, NULL FROM {customer} JOIN {supplier} ON c_custkey = s_suppkey * 7 + 3 AND s_nationkey % 4 <> 0
UNION ALL
SELECT 'symbol:go:shop/supp:S' || s_nationkey, 'symbol:go:shop/supp:(S' || s_nationkey || ').m' || s_suppkey, 'has_method', 1e0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {supplier}
UNION ALL
SELECT 'symbol:go:shop/cust:f' || c_custkey, 'symbol:go:shop/cust:f' || (c_custkey + 1), 'passes_to', 0.8e0, CAST(3 AS INT), NULL, NULL, NULL, NULL, NULL, NULL FROM {customer} WHERE c_custkey % 13 = 0
UNION ALL
SELECT 'symbol:go:shop/supp:(S' || s_nationkey || ').m' || s_suppkey, 'symbol:go:shop/user:u' || (s_suppkey % 40), 'dispatch_to', CASE WHEN s_suppkey % 2 = 0 THEN 0.9e0 ELSE 0.7e0 END, NULL, NULL, NULL, 'I' || s_nationkey, NULL, NULL, CASE WHEN s_suppkey % 2 = 0 THEN 'register' ELSE 'enum' END FROM {supplier}
UNION ALL
SELECT 'symbol:go:shop/cust:f' || c_custkey, 'symbol:go:shop/supp:S' || (c_custkey % 25), 'initializes', 0.8e0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {customer} WHERE c_custkey % 17 = 0
UNION ALL
SELECT e.id, x.id, CASE e.event_id % 6 WHEN 0 THEN 'argument' WHEN 1 THEN 'returns' WHEN 2 THEN 'phi_operand' WHEN 3 THEN 'summary_io' ELSE 'data_flows_to' END, 1e0, CAST(e.event_id % 500 AS INT), NULL, NULL,
  CASE WHEN e.event_id % 9 = 4 THEN 'I' || (e.event_id % 3) END, CASE WHEN e.event_id % 9 = 4 THEN 'register' END, CASE WHEN e.event_id % 9 = 4 THEN 0.5e0 + (e.event_id % 5) / 10e0 END, NULL
FROM ({user_events}) e JOIN ({user_events}) x ON x.event_id = e.next_id
UNION ALL
SELECT e.id, x.id, 'data_flows_to', 1e0, CAST(e.event_id % 700 AS INT), NULL, NULL, NULL, NULL, NULL, NULL FROM ({user_events}) e JOIN ({user_events}) x ON x.event_id = e.later_id WHERE e.event_id % 4 = 1
UNION ALL
SELECT e.id, x.id, 'data_flows_to', 1e0, CAST(e.event_id % 700 AS INT), NULL, NULL, NULL, NULL, NULL, NULL FROM ({user_events}) e JOIN ({user_events}) x ON x.event_id = e.event_id * 3 + 1 WHERE e.event_id % 400 = 2
UNION ALL
SELECT id, 'symbol:go:shop/user:var.g' || (event_id % 9), 'data_flows_to', 1e0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ({user_events}) g WHERE event_id % 50 = 7
UNION ALL
SELECT 'symbol:go:shop/cust:f' || c_custkey, 'symbol:go:shop/gen:svc.R' || (c_custkey % 5), 'grpc_call', 1e0, CAST(c_custkey % 90 AS INT), 'M' || (c_custkey % 4), NULL, NULL, NULL, NULL, NULL FROM {customer} WHERE c_custkey % 23 = 0
UNION ALL
SELECT 'symbol:go:shop/gen:svc.R' || (s_suppkey % 4), 'symbol:go:shop/supp:(S' || s_nationkey || ').m' || s_suppkey, 'grpc_impl', 1e0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {supplier} WHERE s_suppkey % 20 < 4
UNION ALL
SELECT 'symbol:go:shop/cust:f' || c_custkey, 'symbol:http:shop:route./r/' || (c_custkey % 5), 'http_call', 1e0, CAST(c_custkey % 80 AS INT), NULL, '/r/' || (c_custkey % 5), NULL, NULL, NULL, NULL FROM {customer} WHERE c_custkey % 29 = 0
"""

SUMMARY = """
SELECT 'symbol:go:shop/cust:f' || o_custkey AS function_id, CASE o_orderkey % 3 WHEN 0 THEN 'direct_read' WHEN 1 THEN 'direct_write' ELSE 'indirect_write' END AS access_kind,
  'shop/cust.T' || (o_orderkey % 20) || '.F' || (o_orderkey % 3) AS field_path, CAST(max(o_orderkey % 100) AS INT) AS line_start
FROM {orders} GROUP BY 1, 2, 3
"""

ORIGINS = """
SELECT DISTINCT 'symbol:go:shop/cust:f' || o_custkey AS function_id, 'indirect_write' AS access_kind, 'shop/cust.T' || (o_orderkey % 20) || '.F' || (o_orderkey % 3) AS field_path,
  CAST(o_orderkey % 50 AS INT) AS call_line, 'symbol:go:shop/cust:f' || (o_orderkey * 31 % n.c) AS callee_id
FROM {orders}, (SELECT count(*) AS c FROM {customer}) n WHERE o_orderkey % 3 = 2
"""

BUILDS = """
SELECT 'b' || r_regionkey AS build_id, CASE WHEN r_regionkey % 2 = 0 THEN 'success' ELSE 'degraded' END AS status, CAST(r_regionkey / 2 AS BIGINT) * 0 + CAST(r_regionkey % 3 AS BIGINT) AS timestamp FROM {region}
"""

PARTS = {"nodes": NODES, "edges": EDGES, "summary": SUMMARY, "origins": ORIGINS, "builds": BUILDS}


def duckdb_ctes() -> str:
    """The derived tables as common table expressions g_nodes, g_edges, ... for DuckDB."""
    names = {t: t for t in TABLES}
    events = EVENTS.format(**names)
    return ",\n".join(f"g_{k} AS MATERIALIZED ({text.format(text='VARCHAR', user_events=events, **names)})" for k, text in PARTS.items())


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    summary: DataFrame
    origins: DataFrame
    builds: DataFrame
    steps: DataFrame


class Derived(Graph):
    """The graph of a folder's tables. Each table is made when it is first asked for, and kept: a question about calls waits for no trace
    steps."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._made = spark, {}
        self._tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}

    def _part(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name == "steps":
            return trace.prepare(self.nodes, self.edges)
        plan_by_memory(self._spark)
        if name == "user_events":
            return keep(self._spark.sql(EVENTS, events=self._tables["events"]), "shop-events")
        text = PARTS[name].replace("{text}", "STRING").replace("({user_events})", "{user_events}")
        used = {t: df for t, df in self._tables.items() if "{" + t + "}" in text} | ({"user_events": self._part("user_events")} if "{user_events}" in text else {})
        made = keep(self._spark.sql(text, **used), f"shop-{name}")
        if name == "nodes":
            made = made.withColumn("properties", F.map_filter(F.create_map(F.lit("serves_http"), F.col("serves_http"), F.lit("handler_id"), F.col("handler_id")), lambda _, v: v.isNotNull()))
        return made

    nodes, edges, summary, origins, builds, steps = (property(lambda self, name=name: self._part(name)) for name in ("nodes", "edges", "summary", "origins", "builds", "steps"))

    def make(self) -> None:
        """Make all tables now."""
        for name in (*PARTS, "steps"):
            self._part(name)


_made: dict[tuple[str, str], Derived] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The derived graph, kept once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        _made[key] = Derived(spark, sf_dir)
    return _made[key]
