"""Merging extracted items into the graph's tables. Rows carry `seq`, the order in which they arrived: numbers, or sources.readers' places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def split_items(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Items (schema.ITEM and seq) as nodes, edges, summaries and origins with seq."""
    part = lambda c: items.where(F.col(c).isNotNull()).select(f"{c}.*", "seq")
    return part("node"), part("fact"), part("summary"), items.where("origins is not null").select("seq", F.inline("origins"))


def _merged_properties(nodes: DataFrame) -> DataFrame:
    """id, properties: later values win; a null value deletes its key. Keys are merged one by one, so a node that arrives very often
    is combined before it is shuffled."""
    last = nodes.select("id", "seq", F.explode("properties")).groupBy("id", "key").agg(F.max_by("value", F.struct("seq", "value")).alias("value"))
    return last.where("value is not null").groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties"))


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id: kind, name, file and lines of the first; properties merged in order of arrival. seq: anything that has an order."""
    one = F.struct("kind", "name", "file_path", "line_start", "line_end")
    first = nodes.groupBy("id").agg(F.min_by(one, F.struct("seq", one)).alias("first"))
    none = F.expr("cast(map() as map<string, string>)")
    return first.join(_merged_properties(nodes), "id", "left").select("id", "first.*", F.coalesce("properties", none).alias("properties"))


def upsert_edges(edges: DataFrame) -> DataFrame:
    """One row for each (source_id, target_id, kind): the highest confidence (0.5 if not given), of equal ones the first."""
    value = F.struct(*(c for c in edges.columns if c not in ("source_id", "target_id", "kind", "seq", "confidence")), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
    best = F.min_by(value, F.struct(-F.coalesce("confidence", F.lit(0.5)), "seq")).alias("best")
    return edges.groupBy("source_id", "target_id", "kind").agg(best).select("source_id", "target_id", "kind", "best.*")


def upsert_summaries(summaries: DataFrame) -> DataFrame:
    """One row for each (function_id, access_kind, field_path): the last."""
    last = F.max_by(F.struct(*(c for c in summaries.columns if c not in ("function_id", "access_kind", "field_path", "seq"))), "seq").alias("last")
    return summaries.groupBy("function_id", "access_kind", "field_path").agg(last).select("function_id", "access_kind", "field_path", "last.*")


def upsert_origins(origins: DataFrame) -> DataFrame:
    """Distinct rows without blank keys."""
    filled = F.lit(True)
    for c in ("function_id", "access_kind", "field_path"):
        filled = filled & F.col(c).isNotNull() & (F.col(c) != "")
    return origins.where(filled).select("function_id", "access_kind", "field_path", "call_line", "callee_id").distinct()


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist. Nodes may arrive after their edges, so nothing has to be tried again."""
    ids = nodes.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return out.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(edges.columns)


def skipped_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many edges lack an end."""
    ids = nodes.select("id").distinct()
    source = edges.join(ids.select(F.col("id").alias("source_id"), F.lit(True).alias("has_source")), "source_id", "left")
    both = source.join(ids.select(F.col("id").alias("target_id"), F.lit(True).alias("has_target")), "target_id", "left")
    return both.agg(F.count(F.when(F.col("has_source").isNull() | F.col("has_target").isNull(), 1)).alias("skipped"))


def delete_files(nodes: DataFrame, edges: DataFrame, summary: DataFrame, origins: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tables without the nodes of the files (column file_path) and what hangs on them."""
    left = nodes.join(files.select("file_path").distinct(), "file_path", "left_anti").select(nodes.columns)
    ids = left.select(F.col("id").alias("function_id"))
    own = lambda t: t.join(ids, "function_id", "left_semi").select(t.columns)
    return left, with_endpoints(edges, left), own(summary), own(origins)


def of_changed_files(nodes: DataFrame, edges: DataFrame, summary: DataFrame, origins: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of freshly extracted tables, what an incremental build takes over: nodes of changed files; edges with an end in one, or an
    end that no fresh node has; summaries and origins of functions in one."""
    changed = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select(nodes.columns)
    state = nodes.select("id", F.lit(True).alias("known")).join(changed.select("id", F.lit(True).alias("changed")), "id", "left")
    ends = edges
    for end in ("source", "target"):
        ends = ends.join(state.select(F.col("id").alias(f"{end}_id"), F.col("known").alias(f"{end}_known"), F.col("changed").alias(f"{end}_changed")), f"{end}_id", "left")
    touched = ends.where(F.coalesce("source_changed", F.lit(False)) | F.coalesce("target_changed", F.lit(False)) | F.col("source_known").isNull() | F.col("target_known").isNull()).select(edges.columns)
    ids = changed.select(F.col("id").alias("function_id"))
    own = lambda t: t.join(ids, "function_id", "left_semi").select(t.columns)
    return changed, touched, own(summary), own(origins)


def incremental(old: tuple[DataFrame, ...], fresh: tuple[DataFrame, ...], files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The old tables without the changed files, merged with what the fresh ones say about them. Tables in the order nodes, edges,
    summary, origins; the old rows arrive first."""
    kept, added = delete_files(*old, files), of_changed_files(*fresh, files)
    both = [k.withColumn("seq", F.lit(0)).unionByName(a.withColumn("seq", F.lit(1)), allowMissingColumns=True) for k, a in zip(kept, added, strict=True)]
    nodes = upsert_nodes(both[0])
    edges = with_endpoints(upsert_edges(both[1]), nodes)
    return nodes, edges, upsert_summaries(both[2]), upsert_origins(both[3])


def build_status(errors: dict[str, str | None]) -> str:
    """failed if the index of symbols failed, degraded if any other extractor did."""
    if errors.get("scip"):
        return "failed"
    return "degraded" if any(errors.values()) else "success"


def needs_full_build(stored_analyzer: str | None, analyzer: str) -> bool:
    """An incremental build mixes facts of one analyzer version only."""
    return stored_analyzer != analyzer


def unchanged_packages(packages: DataFrame, cache: DataFrame, analyzer: str) -> DataFrame:
    """Packages (package, hash) whose cached facts still hold: equal content hash, equal hash of each dependency, same analyzer. cache:
    package, hash, analyzer."""
    return packages.join(cache.where(F.col("analyzer") == analyzer).select("package", "hash").distinct(), ["package", "hash"], "left_semi")


def add_rule(rules: DataFrame, from_col: str, to_table: str, from_table: str = "", to_col: str = "id", created_at: int = 0) -> DataFrame:
    """rules with one more row, under the next id. An empty from_table is a pattern over all tables that have the column."""
    if not from_col or not to_table:
        raise ValueError("a rule needs from_col and to_table")
    top = rules.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    row = top.select((F.col("top") + 1).cast("long").alias("id"), *(F.lit(v).alias(k) for k, v in (("from_table", from_table), ("from_col", from_col), ("to_table", to_table), ("to_col", to_col or "id"))), F.lit(created_at).cast("long").alias("created_at"))
    return rules.unionByName(row)


def remove_rule(rules: DataFrame, id_: int) -> DataFrame:
    return rules.where(F.col("id") != id_)


def upsert_repos(repos: DataFrame, new: DataFrame) -> DataFrame:
    """Repositories by path: the new row replaces the old one's values."""
    rows = repos.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy("path").orderBy(F.col("_new").desc())
    return rows.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_new", "_rank")


def remove_repo(repos: DataFrame, path: str) -> DataFrame:
    """Without the repository and its work trees (main_path)."""
    return repos.where((F.col("path") != path) & (F.coalesce("main_path", F.lit("")) != path))
