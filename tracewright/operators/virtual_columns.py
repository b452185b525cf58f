"""From SQL strings and ORM calls, as extracted facts, to nodes of database columns and the edges that tie them in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.sqltext import condition_columns_udf, parse_sql


def _node_id(func: Column, orm: Column, table: Column, column: Column, access: Column, line: Column) -> Column:
    return F.concat(func, F.lit("#ext."), orm, F.lit("."), table, F.lit("."), column, F.lit("."), access, F.lit("@"), line.cast("string"))


def _as_nodes(rows: DataFrame) -> DataFrame:
    """rows: func_id, orm, tbl, col, access, line."""
    name = F.concat_ws(".", "tbl", "col")
    id_ = _node_id(F.col("func_id"), F.col("orm"), F.col("tbl"), F.col("col"), F.col("access"), F.col("line"))
    return rows.select(id_.alias("id"), F.lit("field_access").alias("kind"), name.alias("name"), name.alias("full_path"), F.col("line").alias("line_start"), F.col("access").alias("access_kind"), F.col("orm").alias("type_string"), "func_id", F.lit("true").alias("is_external")).distinct()


def from_sql(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of SQL strings. facts: func_id, line, sql, args (ids of the values bound to placeholders, in order), result (the
    id of the value that takes the rows, or null). Written columns get the arguments in order, filters those behind; read columns flow
    into the result; the two sides of a join condition are filters that flow into each other."""
    parsed = facts.withColumn("p", parse_sql("sql")).where("p.tbl <> ''").withColumn("upper", F.upper(F.trim("sql")))
    writes = F.col("upper").startswith("INSERT") | F.col("upper").startswith("UPDATE")
    base = parsed.select("func_id", "line", "args", "result", F.lit("sql").alias("orm"), F.col("p.tbl").alias("tbl"), "p.cols", "p.where_cols", "p.joins", writes.alias("writes"))
    cols = base.select("func_id", "line", "args", "result", "orm", "tbl", "writes", F.posexplode("cols").alias("n", "col")).withColumn("access", F.when(F.col("writes"), "write").otherwise("read"))
    offset = F.when(F.col("writes"), F.size("cols")).otherwise(0)
    filters = base.select("func_id", "line", "args", "result", "orm", "tbl", F.lit(True).alias("writes"), offset.alias("offset"), F.posexplode("where_cols").alias("k", "col")).withColumn("n", F.col("k") + F.col("offset")).withColumn("access", F.lit("filter"))
    shape = ["func_id", "line", "args", "result", "orm", "tbl", "writes", "n", "col", "access"]
    used = cols.select(shape).unionByName(filters.select(shape))
    id_ = _node_id(F.col("func_id"), F.col("orm"), F.col("tbl"), F.col("col"), F.col("access"), F.col("line"))
    bound = used.where("writes").select(F.get("args", F.col("n")).alias("source_id"), id_.alias("target_id"), F.col("line").alias("line_num")).where("source_id is not null")
    taken = used.where("access = 'read' and result is not null").select(id_.alias("source_id"), F.col("result").alias("target_id"), F.col("line").alias("line_num"))
    pairs = base.select("func_id", "line", "orm", F.inline("joins"))
    side = lambda s: _node_id(F.col("func_id"), F.col("orm"), F.col(f"{s}_table"), F.col(f"{s}_col"), F.lit("filter"), F.col("line"))
    ends = pairs.select("func_id", "orm", F.col("left_table").alias("tbl"), F.col("left_col").alias("col"), F.lit("filter").alias("access"), "line").unionByName(pairs.select("func_id", "orm", F.col("right_table").alias("tbl"), F.col("right_col").alias("col"), F.lit("filter").alias("access"), "line"))
    nodes = _as_nodes(used.select("func_id", "orm", "tbl", "col", "access", "line").unionByName(ends))
    edges = bound.unionByName(taken).withColumn("kind", F.lit("summary_io")).unionByName(pairs.select(side("left").alias("source_id"), side("right").alias("target_id"), F.col("line").alias("line_num"), F.lit("data_flows_to").alias("kind")))
    return nodes, edges.select("source_id", "target_id", "kind", F.lit("ssa").alias("tool_source"), F.lit(1.0).alias("confidence"), "line_num").distinct()


def orm_mapping(fields: DataFrame, tables: DataFrame) -> DataFrame:
    """entity, field, tbl, col: an ORM's columns. fields: entity, field, tag. tables: entity, tbl (what TableName() returns); without one, the
    entity in snake case with an s."""
    named = fields.join(tables, "entity", "left")
    table = F.coalesce("tbl", F.concat(naming.snake_case(F.col("entity")), F.lit("s")))
    return named.where(~F.coalesce(F.col("tag"), F.lit("")).rlike(r"(gorm|xorm):\"-\"")).select("entity", "field", table.alias("tbl"), naming.orm_column(F.coalesce("tag", F.lit("")), F.col("field")).alias("col"))


def from_orm(facts: DataFrame, mapping: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ORM calls. facts: func_id, line, method, orm, entity, object (id of the entity's value), condition (string or null),
    args. specs: method, orm, action (read, write). A call touches all columns of its entity, between them and the object; its
    condition's columns are filters fed by the arguments in order."""
    calls = facts.join(specs, ["method", "orm"])
    touched = calls.join(mapping, "entity").select("func_id", "line", "orm", "tbl", "col", F.col("action").alias("access"), "object")
    tables = mapping.select("entity", "tbl").distinct()
    conditions = calls.where("condition is not null").join(tables, "entity").withColumn("cols", condition_columns_udf("condition")).select("func_id", "line", "orm", "tbl", "args", F.posexplode("cols").alias("n", "named")).withColumn("col", F.substring_index("named", ".", -1)).withColumn("access", F.lit("filter"))
    id_ = _node_id(F.col("func_id"), F.col("orm"), F.col("tbl"), F.col("col"), F.col("access"), F.col("line"))
    shape = ["func_id", "orm", "tbl", "col", "access", "line"]
    nodes = _as_nodes(touched.select(shape).unionByName(conditions.select(shape)))
    into = touched.where("access = 'write' and object is not null").select(F.col("object").alias("source_id"), id_.alias("target_id"), F.col("line").alias("line_num"))
    out = touched.where("access = 'read' and object is not null").select(id_.alias("source_id"), F.col("object").alias("target_id"), F.col("line").alias("line_num"))
    bound = conditions.select(F.get("args", F.col("n")).alias("source_id"), id_.alias("target_id"), F.col("line").alias("line_num")).where("source_id is not null")
    edges = into.unionByName(out).unionByName(bound)
    return nodes, edges.select("source_id", "target_id", F.lit("summary_io").alias("kind"), F.lit("ssa").alias("tool_source"), F.lit(1.0).alias("confidence"), "line_num").distinct()
