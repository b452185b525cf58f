"""Tables in the folder that all executors share: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .. import storage
from ..storage import shared_folder as root

_scope: list[str] = []


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables kept inside go to a folder of this name, for `clear`."""
    _scope.append(name)
    try:
        yield
    finally:
        _scope.pop()


def folder(spark: SparkSession, label: str) -> str:
    return "/".join([root(spark), *_scope, f"{label}-{uuid.uuid4().hex[:12]}"])


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and return them read again."""
    path = folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, name: str) -> None:
    """Delete a scope's tables, or one folder. Call it only when what was made from them has been written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name if name.startswith(root(spark)) else f"{root(spark)}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, keys: list[str], name: str, label: str) -> DataFrame:
    """The rows, kept, with a long column `name`: their place from 0 in the order of `keys`."""
    return storage.numbered(df, keys, name, label, keep)
