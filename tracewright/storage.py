"""Tables in the folder that driver and executors share. They cut the lineage of iterative operators and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir. Where that is unset, a temporary folder serves a local session, as in tests;
    a cluster has to name one."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = context._jsc.sc().getCheckpointDir()
        if made.isEmpty():
            if context.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tracewright-"))
            made = context._jsc.sc().getCheckpointDir()
        base = made.get()
    return f"{base.rstrip('/')}/tracewright-{context.applicationId}"


#: How many times their files' size tables of ids are taken for, when a join is planned. Compressed ids are small: a column of files that
#: are estimated at 10 MB, the most that Spark broadcasts, was 1,225 MB as a hash table on the driver.
IN_MEMORY = 32.0


def plan_by_memory(spark: SparkSession) -> None:
    """Let the session's joins go by what tables take in memory instead of in files, unless it was told a factor."""
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) == 1.0:
        spark.conf.set(name, str(IN_MEMORY))


def keep(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Write the rows to the shared folder, in a folder for each value of `by`, and return them read again."""
    plan_by_memory(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[str], name: str, label: str, keep: Callable[[DataFrame, str], DataFrame] = keep) -> DataFrame:
    """The rows, kept, with a long column `name`: their place from 0 in the order of `keys`.

    The rows are range partitioned and sorted within partitions; the driver only sees a row count for each partition.
    """
    spark = df.sparkSession
    kept = keep(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", 33)
    base, rows = 0, []
    for p, n in kept.groupBy(part.alias("p")).count().orderBy("p").collect():
        rows.append((p, base))
        base += n
    starts = F.broadcast(spark.createDataFrame(rows, "_part long, _base long"))  # a row for each partition
    placed = kept.withColumn("_part", part).join(starts, "_part")
    return placed.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_base", "_at")
