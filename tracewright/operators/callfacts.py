"""From the facts of call sites to edges: values that enter and leave functions, and what library functions do to their arguments.

All are equi-joins on the call, the callee or the key of a specification; a function with many call sites is a skewed key that AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SQL, _BEGIN, _COMMIT, _ROLLBACK = ({"effect": "sql"}, *({"effect": "tx", "boundary": b} for b in ("begin", "commit", "rollback")))
_SQL_WRITE, _ORM_WRITE, _ORM_READ = {**_SQL, "sql_write": True}, {"effect": "orm_write", "param_index": 1}, {"effect": "orm_read", "param_index": 1}
_READ_ALL, _WRITE_ALL = {"effect": "arguments", "all": "read"}, {"effect": "arguments", "all": "write"}

#: Library functions by prefix and names, and what a call of one does.
LIBRARY: tuple[tuple[str, str, dict], ...] = (
    ("encoding/json.", "Unmarshal", {**_WRITE_ALL, "param_index": 1}),
    ("fmt.", "Printf", {**_READ_ALL, "param_index": 1}),
    ("database/sql.(Rows).", "Scan", {**_WRITE_ALL, "param_index": 1, "scan_out": True}),
    ("database/sql.(Row).", "Scan", {**_WRITE_ALL, "param_index": 1, "scan_out": True}),
    ("net/http.(Request).", "ParseForm", {"effect": "arguments", "param_index": 0, "writes": ["Form"]}),
    ("net/http.(Request).", "FormValue", {"effect": "arguments", "param_index": 0, "reads": ["Form"]}),
    ("database/sql.(DB).", "Exec", {**_SQL_WRITE, "param_index": 1}),
    ("database/sql.(DB).", "Query QueryRow Prepare", {**_SQL, "param_index": 1}),
    ("database/sql.(DB).", "Begin", _BEGIN),
    ("database/sql.(Tx).", "Exec", {**_SQL_WRITE, "param_index": 1}),
    ("database/sql.(Tx).", "Query QueryRow Prepare", {**_SQL, "param_index": 1}),
    ("database/sql.(Tx).", "Commit", _COMMIT),
    ("database/sql.(Tx).", "Rollback", _ROLLBACK),
    ("github.com/prometheus/client_golang/prometheus.(Counter).", "Inc Add", {**_READ_ALL, "param_index": 0}),
    ("github.com/prometheus/client_golang/prometheus.(CounterVec).", "WithLabelValues", {**_READ_ALL, "param_index": 0}),
    ("github.com/prometheus/client_golang/prometheus.(Histogram).", "Observe", {**_READ_ALL, "param_index": 0}),
    ("github.com/prometheus/client_golang/prometheus.(Gauge).", "Set Inc Dec", {**_READ_ALL, "param_index": 0}),
    ("github.com/prometheus/client_golang/prometheus.(Summary).", "Observe", {**_READ_ALL, "param_index": 0}),
    ("gorm.io/gorm.(DB).", "Create Save Updates Delete Update Where Not Or", _ORM_WRITE),
    ("gorm.io/gorm.(DB).", "Find First Take Last Scan", _ORM_READ),
    ("gorm.io/gorm.(DB).", "Exec", {**_SQL_WRITE, "param_index": 1}),
    ("gorm.io/gorm.(DB).", "Raw", {**_SQL, "param_index": 1}),
    ("gorm.io/gorm.(DB).", "Begin", _BEGIN),
    ("gorm.io/gorm.(Tx).", "Commit", _COMMIT),
    ("gorm.io/gorm.(Tx).", "Rollback", _ROLLBACK),
    ("xorm.io/xorm.(Engine).", "Table", {"effect": "table", "orm": "xorm"}),
    ("xorm.io/xorm.(Engine).", "Exec", {**_SQL_WRITE, "where_arg": 1, "orm": "xorm"}),
    ("xorm.io/xorm.(Session).", "Table", {"effect": "table", "orm": "xorm"}),
    ("xorm.io/xorm.(Session).", "Where And Or In NotIn", {"effect": "filter", "where_arg": 1, "chain_table": True, "orm": "xorm"}),
    ("xorm.io/xorm.(Session).", "Find Get Iterate", {"effect": "read", "obj_arg": 1, "chain_table": True, "orm": "xorm"}),
    ("xorm.io/xorm.(Session).", "Update Insert Delete", {"effect": "write", "obj_arg": 1, "chain_table": True, "orm": "xorm"}),
    ("xorm.io/xorm.(Session).", "Exec", {**_SQL_WRITE, "where_arg": 1, "orm": "xorm"}),
)

SPEC = T.StructType([T.StructField(n, t) for n, t in (("key", T.StringType()), ("effect", T.StringType()), ("param_index", T.IntegerType()), ("all", T.StringType()), ("reads", T.ArrayType(T.StringType())), ("writes", T.ArrayType(T.StringType())), ("scan_out", T.BooleanType()), ("sql_write", T.BooleanType()), ("boundary", T.StringType()), ("where_arg", T.IntegerType()), ("obj_arg", T.IntegerType()), ("id_arg", T.IntegerType()), ("orm", T.StringType()), ("chain_table", T.BooleanType()))])

#: What a specification without the value stands for.
_UNSET = {"param_index": 0, "scan_out": False, "sql_write": False, "chain_table": False, "orm": "gorm"}


def library(spark: SparkSession) -> DataFrame:
    """The specifications of library functions, by key: package.Function, package.(Type).Method or iface:package.Interface.Method."""
    rows = []
    for prefix, names, facts in LIBRARY:
        for name in names.split():
            rows.append({**_UNSET, **facts, "key": prefix + name})
            if prefix.startswith("xorm") and (prefix.endswith("(Session).") or name in ("Table", "Exec")):
                shifted = {k: facts[k] - 1 for k in ("where_arg", "obj_arg") if k in facts}  # an interface call has no receiver among its arguments
                rows.append({**rows[-1], **shifted, "key": f"iface:{prefix}{name}", **({"id_arg": 1} if name == "Get" else {})})
    return spark.createDataFrame([{f.name: r.get(f.name) for f in SPEC} for r in rows], SPEC)


def with_user_specs(library: DataFrame, user: DataFrame) -> DataFrame:
    """The specifications in force: user entries, as `readers.field_summaries` gives them, replace those of the library with the same
    key. Of entries with one key the first counts; entries without a function or interface, or with an interface but no method, do not."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = F.when(text("iface") != "", F.when(text("method") != "", F.concat(F.lit("iface:"), "iface", F.lit("."), "method"))).when(text("func") != "", F.col("func"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    effect = F.when(flag("orm_write"), "orm_write").when(flag("orm_read"), "orm_read").when(text("kind") != "", F.col("kind")).otherwise("arguments")
    given = {"key": key, "effect": effect, "param_index": F.coalesce("param_index", F.lit(0)), "reads": F.col("reads"), "writes": F.col("writes"), "sql_write": flag("sql_write"), "where_arg": F.col("where_arg"), "obj_arg": F.col("obj_arg"), "id_arg": F.col("id_arg"), "orm": F.coalesce("type", F.lit("gorm")), "chain_table": flag("chain_table"), "scan_out": F.lit(False)}
    shaped = user.withColumn("place", F.monotonically_increasing_id()).select("place", *(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SPEC)).where("key is not null")
    first = shaped.groupBy("key").agg(F.min_by(F.struct(*(f.name for f in SPEC if f.name != "key")), "place").alias("s")).select("key", "s.*")
    return library.join(first, "key", "left_anti").select(*SPEC.names).unionByName(first.select(*SPEC.names))


def known_calls(calls: DataFrame, specs: DataFrame) -> DataFrame:
    """calls (call_id, func_id, callee_id, line, key and more) whose callee has a specification, with it. `value_flow` leaves them out."""
    return calls.join(specs, "key")


def argument_effects(known: DataFrame, arguments: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of library calls that read or write fields of what they are given. known: of `known_calls`. arguments: call_id,
    position, value (node id or null), type (the struct's path, or null), instance. fields: owner, path (`closure.owned_fields`).

    An argument from param_index on has the specification's reads and writes (a field of both is written), or with `all` every field of
    its type. Nodes: field_access at the call's line. Edges: summary_io from the callee; a write is an indirect_write of the function
    and flows from the argument; a read flows into it. Without a value no flow; without a type a named field is its own path."""
    used = known.where("effect = 'arguments'").join(arguments, "call_id").where("position >= param_index")
    none = F.array().cast("array<string>")
    wrote, read = F.coalesce("writes", none), F.coalesce("reads", none)
    base = ["func_id", "callee_id", "line", "value", "type", "instance"]
    named = used.where("`all` is null").select(*base, F.explode(F.array_union(read, wrote)).alias("field"), wrote.alias("w")).withColumn("access", F.when(F.array_contains("w", F.col("field")), "write").otherwise("read")).drop("w")
    whole = used.where("`all` is not null").join(fields.select(F.col("owner").alias("type"), F.col("path").alias("field")), "type").select(*base, "field", F.col("all").alias("access"))
    segment = F.substring_index("field", ".", -1)
    path = F.when(~F.col("field").contains("/") & F.col("type").isNotNull(), F.concat("type", F.lit("."), segment)).otherwise(F.col("field"))
    rows = named.unionByName(whole).withColumn("full_path", path).withColumn("instance_path", F.concat(F.coalesce("instance", F.lit("")), F.lit("."), segment))
    rows = rows.withColumn("id", F.concat("func_id", F.lit("#ext."), "full_path", F.lit("."), "access", F.lit("@"), F.col("line").cast("string")))
    nodes = rows.groupBy("id", "func_id", "full_path", F.col("access").alias("access_kind"), F.col("line").alias("line_start")).agg(F.min("instance_path").alias("instance_path"), F.min("type").alias("type_string"))
    nodes = nodes.select("id", F.lit("field_access").alias("kind"), F.col("instance_path").alias("name"), "full_path", "instance_path", "access_kind", "type_string", "func_id", F.lit("true").alias("is_external"), "line_start")
    writes = F.col("access") == "write"
    ends = F.array(
        F.struct(F.col("callee_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("summary_io").alias("kind")),
        F.when(writes, F.struct(F.col("func_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("indirect_write").alias("kind"))),
        F.when(F.col("value").isNotNull(), F.struct(F.when(writes, F.col("value")).otherwise(F.col("id")).alias("source_id"), F.when(writes, F.col("id")).otherwise(F.col("value")).alias("target_id"), F.lit("data_flows_to").alias("kind"))),
    )
    edges = rows.select(F.explode(ends).alias("e"), F.col("line").alias("line_num")).where("e is not null").select("e.*", "line_num")
    return nodes, edges.distinct()


def value_flow(calls: DataFrame, arguments: DataFrame, parameters: DataFrame, returns: DataFrame, extracts: DataFrame) -> DataFrame:
    """Edges source_id, target_id, kind, interface, candidate_origin, confidence of values that cross calls, distinct.

    calls: call_id, callee_id (of a module of the build), result (node id, or null where it is not used), interface, candidate_origin,
    confidence (null but for a candidate of an interface call). arguments: call_id, position, value, is_const. parameters: func_id, position, value.
    returns: func_id, statement, position, value. extracts: call_id, position, value (a member taken out of several results).

    An argument that is no constant flows into the parameter of its place; the parameters of a candidate begin with the receiver, which is not
    among the arguments. A single returned value flows into the result. Of several, where members are taken out, all returned values
    flow into the result, and members get theirs from the result, or for a candidate from the first return statement."""
    marks = ["interface", "candidate_origin", "confidence"]
    candidate = F.col("interface").isNotNull()
    into = calls.join(arguments.where("not is_const and value is not null").select("call_id", "position", F.col("value").alias("source_id")), "call_id")
    into = into.withColumn("position", F.col("position") + F.when(candidate, 1).otherwise(0)).withColumnRenamed("callee_id", "func_id")
    entered = into.join(parameters.select("func_id", "position", F.col("value").alias("target_id")), ["func_id", "position"]).select("source_id", "target_id", F.lit("argument").alias("kind"), *marks)

    several = returns.groupBy("func_id").agg((F.max("position") > 0).alias("several"), F.min("statement").alias("first"))
    left = calls.where("result is not null").withColumnRenamed("callee_id", "func_id")
    split = extracts.select("call_id", F.lit(True).alias("split")).distinct()
    known = left.join(several, "func_id").join(split, "call_id", "left").where("not several or split")
    out = known.join(returns.where("value is not null").select("func_id", F.col("value").alias("source_id")), "func_id").select("source_id", F.col("result").alias("target_id"), F.lit("returns").alias("kind"), *marks)
    plain = left.where(~candidate).join(extracts.select("call_id", F.col("value").alias("target_id")), "call_id").select(F.col("result").alias("source_id"), "target_id", F.lit("data_flows_to").alias("kind"), *marks)
    heads = returns.where("value is not null").select("func_id", F.col("statement").alias("first"), "position", F.col("value").alias("source_id"))
    taken = known.where(candidate & F.col("several")).join(extracts.select("call_id", "position", F.col("value").alias("target_id")), "call_id").join(heads, ["func_id", "first", "position"]).select("source_id", "target_id", F.lit("returns").alias("kind"), *marks)
    return entered.unionByName(out).unionByName(plain).unionByName(taken).distinct()
