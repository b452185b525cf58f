"""Modules of a workspace and the calls between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, naming


def module_of(packages: DataFrame, modules: DataFrame) -> DataFrame:
    """packages (package) with `module`: of the longest prefix that is the package or a folder above it, '' without one. Each package's own
    prefixes are the join keys, so this is an equi-join."""
    distinct = packages.select("package").distinct()
    parts = F.split("package", "/")
    prefixes = distinct.select("package", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("prefix"))
    best = prefixes.join(modules.select("prefix", F.col("name").alias("module")), "prefix").groupBy("package").agg(F.max_by("module", F.struct(F.length("prefix"), "module")).alias("module"))
    return packages.join(best, "package", "left").withColumn("module", F.coalesce("module", F.lit("")))


def service_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source_id, target_id, kind, method, path, implementer, line: grpc_call and http_call edges. A service is implemented by the target of
    its own grpc_impl edge, or else of the least one of a service of the same name."""
    calls = edges.where(F.col("kind").isin("grpc_call", "http_call"))
    impl = edges.where(F.col("kind") == "grpc_impl").select(F.col("source_id").alias("service_id"), F.col("target_id").alias("impl"))
    by_id = impl.groupBy("service_id").agg(F.min("impl").alias("by_id")).withColumnRenamed("service_id", "target_id")
    name = nodes.select(F.col("id").alias("service_id"), F.col("name").alias("service_name"))
    by_name = impl.join(name, "service_id").groupBy("service_name").agg(F.min("impl").alias("by_name"))
    handler = nodes.where(F.col("kind") == "http_route").select(F.col("id").alias("target_id"), F.col("properties")["handler_id"].alias("handler_id"))
    named = calls.join(name.withColumnRenamed("service_id", "target_id"), "target_id", "left").join(by_id, "target_id", "left").join(by_name, "service_name", "left").join(handler, "target_id", "left")
    who = F.when(F.col("kind") == "grpc_call", F.coalesce("by_id", "by_name")).otherwise(F.col("handler_id"))
    return named.select("source_id", "target_id", "kind", "method", "path", who.alias("implementer"), F.col("line_num").alias("line"))


def _module(rows: DataFrame, id_: str, out: str, modules: DataFrame) -> DataFrame:
    keyed = rows.withColumn("package", ids.package_of(F.coalesce(id_, F.lit(""))))
    return module_of(keyed, modules).drop("package").withColumnRenamed("module", out)


def module_calls(nodes: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """service_calls with from_module and to_module ('' where no implementer is known)."""
    return _module(_module(service_calls(nodes, edges), "source_id", "from_module", modules), "implementer", "to_module", modules)


def module_edges(calls: DataFrame) -> DataFrame:
    """from_module, to_module and the distinct labels of the calls between them, in order."""
    label = F.when(F.col("kind") == "grpc_call", F.concat(F.lit("grpc "), F.coalesce("method", F.lit("")))).otherwise(F.concat(F.lit("http "), F.coalesce("path", F.lit(""))))
    return calls.where((F.col("from_module") != "") & (F.col("to_module") != "") & (F.col("from_module") != F.col("to_module"))).groupBy("from_module", "to_module").agg(F.array_join(F.array_sort(F.collect_set(label)), ", ").alias("labels"))


def match_routes(urls: DataFrame, routes: DataFrame) -> DataFrame:
    """urls (url) with the routes (route) that their paths match. Routes of segments join on the segment count and the first fixed segment
    or wildcard; routes ending in '/' join on each folder above the path."""
    asked = urls.select("url", naming.url_host(F.col("url")).alias("host"), naming.url_path(F.col("url")).alias("path")).distinct()
    parts = F.split("path", "/")
    folders = asked.select("url", "host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))).alias("route"))
    under = folders.where(F.col("path").startswith(F.col("route"))).join(routes.where(F.col("route").endswith("/")).select("route").distinct(), "route").select("url", "host", "path", "route")
    shaped = routes.where(~F.col("route").endswith("/")).select("route", naming.route_shape(F.col("route")).alias("shape")).distinct()
    same = asked.withColumn("shape", naming.route_shape(F.col("path"))).join(shaped, "shape").where(naming.route_matches(F.col("path"), F.col("route"))).select("url", "host", "path", "route")
    return under.unionByName(same).distinct()


