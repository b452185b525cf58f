"""What the engine writes: graph tables, and JSON in the contract's form (snake case, empty values left out)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import scan


def write_graph(folder: str, **tables: DataFrame) -> None:
    """Overwrite graph tables. Edges are laid out by kind, because every traversal reads some kinds only."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy("kind") if name == "edges" else writer).parquet(f"{folder}/{name}")


def without_empty(df: DataFrame) -> DataFrame:
    """Empty strings and arrays as nulls, which JSON leaves out."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c != "", c)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.when(F.size(c) > 0, c)
        out.append(c.alias(f.name))
    return df.select(*out)


def as_json(df: DataFrame) -> DataFrame:
    """One column json: a row's object."""
    bare = without_empty(df)
    return bare.select(F.to_json(F.struct(*bare.columns)).alias("json"))


def export_index(summary: DataFrame, path: str) -> None:
    """The field index: producers and consumers of each field."""
    without_empty(scan.field_index(summary)).write.mode("overwrite").json(path)


def export_relations(relations: DataFrame, path: str) -> None:
    without_empty(relations).write.mode("overwrite").json(path)
