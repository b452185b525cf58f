"""Builds: extracted items to stored graph tables, with a row of metadata and the analyzer's marker; and the registry of repositories.

A build is written to a folder of its own and named by its id; what readers take is the latest one whose metadata row says it was not
failed. Nulls: items without any part are ignored; an empty input makes empty tables and a row with counts of 0.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..sources import sinks
from . import ingest, scan

TABLES = ("nodes", "edges", "summary", "origins")


@dataclass
class Run:
    """Who makes a build, from what, and how long the extractors took."""

    build_id: str
    commit_sha: str
    analyzer: str
    timestamp: int
    tool_name: str = "all"
    duration_ms: int = 0
    errors: dict[str, str | None] | None = None


def _path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _finish(spark: SparkSession, folder: str, run: Run, tables: dict[str, DataFrame]) -> DataFrame:
    """Write the tables, then the metadata row, then the marker: a build that breaks off before its row does not count."""
    base = f"{folder}/build={run.build_id}"
    sinks.write_graph(base, **tables)
    counts = scan.counts(*(spark.read.parquet(f"{base}/{t}") for t in ("nodes", "edges")))
    errors = {k: v for k, v in (run.errors or {}).items() if v}
    given = {"build_id": run.build_id, "commit_sha": run.commit_sha, "tool_name": run.tool_name, "status": ingest.build_status(errors), "duration_ms": run.duration_ms, "error_message": "; ".join(f"{k}: {v}" for k, v in sorted(errors.items())), "timestamp": run.timestamp}
    value = lambda f: F.col({"nodes_count": "nodes", "edges_count": "edges"}[f.name]).cast("int") if f.name in ("nodes_count", "edges_count") else F.lit(given[f.name]).cast(f.dataType)
    row = counts.select(*(value(f).alias(f.name) for f in S.BUILD))
    row.write.mode("append").parquet(f"{folder}/builds")
    path, fs = _path(spark, f"{folder}/analyzer.json")
    out = fs.create(path, True)
    out.write(bytearray(json.dumps({"analyzer": run.analyzer}).encode()))
    out.close()
    return spark.read.schema(S.BUILD).parquet(f"{folder}/builds").where(F.col("build_id") == run.build_id)


def stored_analyzer(spark: SparkSession, folder: str) -> str | None:
    path, fs = _path(spark, f"{folder}/analyzer.json")
    return spark.read.json(path.toString()).first()["analyzer"] if fs.exists(path) else None


def builds(spark: SparkSession, folder: str) -> DataFrame:
    """All builds of a folder; none before the first."""
    path, fs = _path(spark, f"{folder}/builds")
    return spark.read.schema(S.BUILD).parquet(path.toString()) if fs.exists(path) else spark.createDataFrame([], S.BUILD)


def full(items: DataFrame, folder: str, run: Run) -> DataFrame:
    """Merge items (schema.ITEM and seq) into fresh tables under folder/build=<id>; returns the build's metadata row."""
    spark = items.sparkSession
    parts = dict(zip(TABLES, ingest.split_items(items), strict=True))
    nodes = ingest.upsert_nodes(parts["nodes"])
    tables = {"nodes": nodes, "edges": ingest.with_endpoints(ingest.upsert_edges(parts["edges"]), nodes), "summary": ingest.upsert_summaries(parts["summary"]), "origins": ingest.upsert_origins(parts["origins"])}
    return _finish(spark, folder, run, tables)


def update(items: DataFrame, changed: DataFrame, folder: str, run: Run) -> DataFrame:
    """An incremental build of the changed files (file_path) on the latest one; a full build where there is none, or where another
    analyzer made it. items: of a whole extraction."""
    spark = items.sparkSession
    before = scan.latest_build(builds(spark, folder).where("status <> 'failed'")).select("build_id").first()
    if before is None or ingest.needs_full_build(stored_analyzer(spark, folder), run.analyzer):
        return full(items, folder, run)
    old = tuple(spark.read.parquet(f"{folder}/build={before[0]}/{t}") for t in TABLES)
    parts = ingest.split_items(items)
    nodes = ingest.upsert_nodes(parts[0])
    fresh = (nodes, ingest.upsert_edges(parts[1]), ingest.upsert_summaries(parts[2]), ingest.upsert_origins(parts[3]))
    return _finish(spark, folder, run, dict(zip(TABLES, ingest.incremental(old, fresh, changed), strict=True)))


# --- registry of repositories: path, module, head_commit, build_id, last_built_at, main_path (of a work tree), workspace, registered_at


def register(repos: DataFrame, new: DataFrame) -> DataFrame:
    """Repositories and work trees by path: a new row replaces the old one's values, but the time of the first registration stays."""
    first = repos.select("path", F.col("registered_at").alias("_first"))
    kept = new.join(first, "path", "left").withColumn("registered_at", F.coalesce("_first", "registered_at")).drop("_first")
    return repos.join(new.select("path"), "path", "left_anti").unionByName(kept.select(repos.columns))


def refresh(repos: DataFrame, path: str, head_commit: str, build_id: str, at: str) -> DataFrame:
    """The repository's state after a build."""
    own = F.col("path") == path
    put = lambda c, v: F.when(own, F.lit(v)).otherwise(F.col(c)).alias(c)
    values = {"head_commit": head_commit, "build_id": build_id, "last_built_at": at}
    return repos.select(*(put(c, values[c]) if c in values else F.col(c) for c in repos.columns))


def referred(repos: DataFrame, text: Column | str) -> DataFrame:
    """path: the registered repositories that a reference means: its absolute path's ending (of a text with a leading '/'), its
    folder's name, or its module. Several, or none, are for the caller to refuse."""
    text = F.lit(text) if isinstance(text, str) else text
    ending = text.startswith("/") & F.col("path").endswith(text)
    return repos.where((text != "") & (ending | (F.substring_index("path", "/", -1) == text) | (F.coalesce("module", F.lit("")) == text))).select("path").distinct().orderBy("path")
