"""Items as a stream: each micro-batch is merged into the graph's tables, under a version of its own.

The merge is by key, so a batch that is replayed after a failure gives the same tables; the version is the batch's number, and
``latest`` reads the last complete one. No state store and no watermark are needed: items have no event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import ingest
from ..sources.readers import placed, with_place

TABLES = {"nodes": S.NODE, "edges": S.EDGE, "summary": S.SUMMARY, "origins": S.ORIGIN}


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions, in order."""
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    done = [s.getPath() for s in fs.listStatus(base) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().split("=")[1]) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "origins/_SUCCESS")))


def read(spark: SparkSession, folder: str, version: int | None) -> dict[str, DataFrame]:
    if version is None:
        return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    return {name: spark.read.schema(schema).parquet(f"{folder}/version={version}/{name}") for name, schema in TABLES.items()}


def latest(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    found = versions(spark, folder)
    return read(spark, folder, found[-1] if found else None)


def merge_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Merge a batch of items (with seq, or with the columns of sources.readers.with_place) into the version before it. Origins are written
    last, which completes the version; versions older than the one before it are deleted then."""
    spark = batch.sparkSession
    before = [v for v in versions(spark, folder) if v < batch_id]
    old = read(spark, folder, before[-1] if before else None)
    new = dict(zip(TABLES, ingest.split_items(batch if "seq" in batch.columns else placed(batch)), strict=True))
    before_all = F.struct(F.lit("").alias("file"), F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("place"))
    both = {name: old[name].withColumn("seq", before_all).unionByName(new[name], allowMissingColumns=True) for name in TABLES}
    merged = {"nodes": ingest.upsert_nodes(both["nodes"]), "edges": ingest.upsert_edges(both["edges"]), "summary": ingest.upsert_summaries(both["summary"]), "origins": ingest.upsert_origins(both["origins"])}
    for name, schema in TABLES.items():  # edges wait in the table for their ends; readers take those that have both
        merged[name].select(*schema.fieldNames()).write.mode("overwrite").parquet(f"{folder}/version={batch_id}/{name}")
    for old_version in before[:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={old_version}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ingest_stream(spark: SparkSession, source: str, folder: str, checkpoint: str, once: bool = True):
    """Start merging JSONL items that appear under `source`. once: take what is there and stop."""
    stream = with_place(spark.readStream.schema(S.ITEM).json(source))
    writer = stream.writeStream.foreachBatch(lambda batch, n: merge_batch(batch, n, folder)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
