"""What the engine reads: graph tables, item streams, configuration files and git texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.naming import python_rule


def graph_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """nodes, edges, summary, origins, builds or rules, as Parquet under the folder."""
    return spark.read.parquet(f"{folder}/{name}")


def placed(rows: DataFrame) -> DataFrame:
    """Rows of a file source with the hidden columns file and block: where they stand. seq orders them by file name, then by their
    place in the file, however the files were packed into tasks: the rows of one block of one file follow each other in one task.
    Rows without those columns keep the order they come in."""
    rows = rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("block", "long")) if c not in rows.columns))
    seq = F.struct(F.coalesce("file", F.lit("")).alias("file"), F.coalesce("block", F.lit(0).cast("long")).alias("block"), F.monotonically_increasing_id().alias("place"))
    return rows.withColumn("seq", seq).drop("file", "block")


def with_place(rows: DataFrame) -> DataFrame:
    """Rows read from files, or a stream of them, with the columns that `placed` needs."""
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").cast("long").alias("block"))


def items(spark: SparkSession, path: str) -> DataFrame:
    """Extracted items, a JSON object a line, with seq: their order within the files in name order."""
    return placed(with_place(spark.read.schema(S.ITEM).json(path)))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """source (file name), no, line of text files; a file is one value, split on the executors."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    return whole.select("source", F.posexplode(F.split("value", "\n")).alias("no", "line"))


_SPEC = T.StructType([T.StructField(n, t) for n, t in (("func", T.StringType()), ("iface", T.StringType()), ("method", T.StringType()), ("kind", T.StringType()), ("where_arg", T.IntegerType()), ("obj_arg", T.IntegerType()), ("id_arg", T.IntegerType()), ("sql_write", T.BooleanType()), ("type", T.StringType()), ("chain_table", T.BooleanType()), ("reads", T.ArrayType(T.StringType())), ("writes", T.ArrayType(T.StringType())), ("param_index", T.IntegerType()), ("orm_write", T.BooleanType()), ("orm_read", T.BooleanType()))])


def _entries(text: str, key: str) -> list[dict]:
    """The list under a top-level key of a YAML text, by PyYAML where there is one, else for flat entries."""
    try:
        import yaml
    except ImportError:
        return _flat_entries(text, key)
    return (yaml.safe_load(text) or {}).get(key) or []


def _scalar(text: str):
    text = text.split(" #")[0].strip()
    if text.startswith("["):
        return [_scalar(t) for t in text.strip("[]").split(",") if t.strip()]
    if text[:1] in "\"'" and text:
        return text.strip("\"'")
    return {"true": True, "false": False, "null": None, "": None}.get(text, int(text) if text.lstrip("-").isdigit() else text)


def _flat_entries(text: str, key: str) -> list[dict]:
    out, inside = [], False
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if not line[0].isspace() and not bare.startswith("-"):
            inside = bare.rstrip(":") == key
        elif inside:
            if bare.startswith("-"):
                out.append({})
                bare = bare[1:].strip()
            if ":" in bare and out:
                name, _, value = bare.partition(":")
                out[-1][name.strip()] = _scalar(value)
    return out


def field_summaries(spark: SparkSession, text: str) -> DataFrame:
    """Specifications of functions and interface methods (key summaries) as a small table; what is not set is null, so argument 0 counts."""
    rows = [{f.name: e.get(f.name) for f in _SPEC} for e in _entries(text, "summaries")]
    return spark.createDataFrame(rows, _SPEC)


def modules(spark: SparkSession, text: str) -> DataFrame:
    """prefix, name (key modules)."""
    return spark.createDataFrame([(e.get("prefix"), e.get("name")) for e in _entries(text, "modules")], "prefix string, name string")


def routes(spark: SparkSession, text: str) -> DataFrame:
    """route, handler, method (key routes)."""
    return spark.createDataFrame([(e.get("path"), e.get("handler"), e.get("method")) for e in _entries(text, "routes")], "route string, handler string, method string")


def rules(spark: SparkSession, expressions: list[str]) -> DataFrame:
    """Relation rules from expressions such as `orders.user_id -> users.id`; ids from 1."""
    rows = []
    for i, e in enumerate(expressions, 1):
        if (parts := python_rule(e)) is None:
            raise ValueError(f"no rule: {e}")
        rows.append((i, *parts, 0))
    return spark.createDataFrame(rows, S.RULE)
