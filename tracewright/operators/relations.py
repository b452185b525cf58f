"""Which columns of database tables refer to each other, inferred from data flow; and what is made of that.

``infer`` runs one search from every column node of every table at once. State is a row for each (start, node): depth, whether the way
crossed a function boundary, whether the value still carries the start column's name (the taint), and the place in the
start's queue. The first way to reach a node wins: least place of the node it came from, then ordinary edges before bridges, then
adjacency order (source_id, target_id, kind; for bridges the node id). So each level is one join, one bridge join and one
aggregate, for all starts together, and results do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import affinity as A
from ..functions import ids
from ..storage import keep, numbered
from .callgraph import first_by
from .scan import is_column_node

MAX_DEPTH = 12
#: Most hops of a relation by type that is shown; None: any.
HOP_CAPS = {"fk": None, "query": 4, "write": None, "read": 4}
KEY = ["from_table", "from_col", "to_table", "to_col"]


def _bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src to dst: a node of a named type, to the reads in its function of a field of that type whose value ends in a filter two
    steps on."""
    out = edges.select("source_id", "target_id").distinct()
    filters = nodes.where((F.col("kind") == "field_access") & (F.col("access_kind") == "filter") & (F.col("is_external") == "true")).select(F.col("id").alias("target_id"))
    one = out.join(filters, "target_id", "left_semi").select(F.col("source_id").alias("target_id")).distinct()
    two = out.join(one, "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
    reads = nodes.where((F.col("kind") == "field_access") & (F.col("access_kind") == "read")).join(two, "id", "left_semi").select(F.col("id").alias("dst"), "func_id", "full_path")
    typed = nodes.where(F.col("func_id").isNotNull() & (F.col("func_id") != "")).select(F.col("id").alias("src"), "func_id", ids.type_name(F.col("type_string")).alias("type_name")).where("type_name is not null")
    return typed.join(reads, "func_id").where(F.col("full_path").contains(F.col("type_name")) & (F.col("src") != F.col("dst"))).select("src", "dst")


def _places(nodes: DataFrame) -> DataFrame:
    """id, n: numbers in the order of the ids. The search runs on numbers; edges without both ends have none and are left out."""
    return numbered(nodes.select("id").where("id is not null").distinct(), ["id"], "n", "rel-places")


def _steps(nodes: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """src, dst in both directions; a, b, c: the first edge between the two in adjacency order; crossing: whether any of them crosses
    functions; and what the step does to a taint: reads, the column that a read forward asks for (null: nothing); writes, the field
    that a struct's write must name (null: no such write, '': no name). Steps onto errors are left out."""
    at = lambda end, name: places.select(F.col("id").alias(end), F.col("n").alias(name))
    code = F.array_position(F.array(*(F.lit(k) for k in sorted(S.RELATIONS))), F.col("kind"))
    joined = edges.select("source_id", "target_id", F.when(F.col("kind").isin(*S.RELATIONS), code).alias("c"), F.col("kind").isin(*S.CROSSING).alias("crossing")).join(at("source_id", "s"), "source_id").join(at("target_id", "t"), "target_id")
    way = lambda x, y, ahead: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), F.lit(ahead).alias("ahead"))
    both = joined.select(F.explode(F.array(way("s", "t", True), way("t", "s", False))).alias("w"), F.when(F.col("c").isNotNull(), F.struct("s", "t", "c")).alias("place"), "crossing")
    least = both.groupBy("w.src", "w.dst").agg(F.min("place").alias("p"), F.max(F.col("crossing") & F.col("place").isNotNull()).alias("crossing"), F.max("w.ahead").alias("ahead")).where("p is not null")
    no = F.lit(False)
    kind, access, type_ = F.col("kind"), F.col("access_kind"), F.col("type_string")
    leaves = nodes.select(F.col("id"), F.when((kind == "field_access") & (access == "read") & (A.column_of(F.col("name")) != ""), A.column_of(F.col("name"))).alias("asked"), F.coalesce((kind == "ssa_value") & (type_.startswith("*") | type_.contains("struct")), no).alias("holder"))
    enters = nodes.select(F.col("id"), F.coalesce(type_ == "error", no).alias("error"), F.when((kind == "field_access") & (access == "write") & ~F.coalesce(F.col("is_external") == "true", no), A.column_of(F.col("name"))).alias("written"))
    near, far = (x.join(places, "id").drop("id").withColumnRenamed("n", end) for x, end in ((leaves, "src"), (enters, "dst")))
    known = least.join(near, "src", "left").join(far, "dst", "left").where(~F.coalesce("error", no))
    return known.select("src", "dst", "p.*", "crossing", F.when(F.col("ahead"), F.col("asked")).alias("reads"), F.when(F.coalesce("holder", no), F.col("written")).alias("writes"))


def search(nodes: DataFrame, edges: DataFrame, tables: DataFrame | None = None, depth: int = MAX_DEPTH) -> DataFrame:
    """start, start_name, node, depth, crossed, taint (empty for a node reached by a bridge), from all external column nodes (of the
    tables, column table_name). A taint is the start's column or nothing, so a row holds numbers, flags and that column. A start's
    level is put in order in one task; rows grow with the nodes within `depth` of each start."""
    places = keep(_places(nodes), "rel-places")
    steps = keep(_steps(nodes, edges, places), "rel-steps")
    number = lambda df, end: df.join(places.select(F.col("id").alias(end), F.col("n").alias(f"{end}_n")), end).drop(end).withColumnRenamed(f"{end}_n", end)
    bridges = keep(number(number(_bridges(nodes, edges), "src"), "dst"), "rel-bridges")
    starts = nodes.where((F.col("kind") == "field_access") & (F.col("is_external") == "true"))
    if tables is not None:
        starts = starts.join(tables.select(F.col("table_name")), A.table_of(F.col("name")) == F.col("table_name"), "left_semi")
    names = keep(number(starts.select(F.col("id").alias("start"), F.col("name").alias("start_name"), A.column_after_table(F.col("name")).alias("column")), "start"), "rel-starts")
    yes = F.lit(True)
    level = keep(names.select("start", "column", F.col("start").alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("crossed"), yes.alias("taint"), yes.alias("carried"), F.lit(1).alias("place")), "rel-level")
    seen = level
    same = lambda a, b: F.lower(a) == F.lower(b)
    kept = F.col("taint") & (F.col("reads").isNull() | same(F.col("column"), F.col("reads")))
    named = F.col("taint") & (F.col("writes") != "") & A.same_column(F.col("column"), F.col("writes"))
    taint = F.when(F.col("writes").isNotNull(), named).otherwise(kept)
    zero = F.lit(0).cast("long")
    for d in range(1, depth + 1):
        at = level.select("start", "column", F.col("node").alias("src"), F.col("crossed").alias("was"), F.col("carried").alias("taint"), F.col("place").alias("from"))
        one = at.join(steps, "src").select("start", "column", F.col("dst").alias("node"), F.struct("from", F.lit(0).alias("bridge"), F.col("s").alias("a"), F.col("t").alias("b"), F.col("c").cast("long").alias("c")).alias("order"), (F.col("was") | F.col("crossing")).alias("crossed"), taint.alias("taint"), taint.alias("carried"))
        two = at.join(bridges, "src").select("start", "column", F.col("dst").alias("node"), F.struct("from", F.lit(1).alias("bridge"), F.col("dst").alias("a"), zero.alias("b"), zero.alias("c")).alias("order"), F.col("was").alias("crossed"), F.lit(False).alias("taint"), F.col("taint").alias("carried"))
        best = one.unionByName(two).groupBy("start", "node").agg(F.min(F.struct("order", "column", "crossed", "taint", "carried")).alias("w"))
        fresh = best.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        placed = fresh.withColumn("place", F.row_number().over(Window.partitionBy("start").orderBy("w.order")))
        level = keep(placed.select("start", "w.column", "node", F.lit(d).alias("depth"), "w.crossed", "w.taint", "w.carried", "place"), "rel-level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    found = seen.join(names.drop("column"), "start").withColumn("taint", F.filter(F.array("column"), lambda _: F.col("taint")))
    as_id = lambda df, end: df.join(places.select(F.col("n").alias(end), F.col("id").alias(f"{end}_id")), end).drop(end).withColumnRenamed(f"{end}_id", end)
    return as_id(as_id(found, "start"), "node").select("start", "start_name", "node", "depth", "crossed", "taint")


def classify(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Relations of the terminals of a search: the highest type and the least hops of each (start's column, table, column)."""
    ends = nodes.where((F.col("kind") == "field_access") & F.col("type_string").isin(*S.SQL_TYPES) & F.col("name").contains("."))
    terminals = found.where("depth > 0").join(ends.select(F.col("id").alias("node"), "name", F.col("access_kind").alias("access")), "node")
    rows = terminals.select(A.table_of(F.col("start_name")).alias("from_table"), A.column_after_table(F.col("start_name")).alias("from_col"), A.table_of(F.col("name")).alias("to_table"), A.column_after_table(F.col("name")).alias("to_col"), F.col("depth").alias("hops"), "crossed", "taint", "access")
    rows = rows.where(F.col("from_table") != F.col("to_table"))
    used = nodes.where((F.col("kind") == "field_access") & (F.col("access_kind") == "filter") & (F.col("is_external") == "true")).select(F.col("name").alias("filter_name"), F.lit(True).alias("filtered")).distinct()
    rows = rows.join(used, F.concat_ws(".", "to_table", "to_col") == F.col("filter_name"), "left").withColumn("filtered", F.coalesce("filtered", F.lit(False)))
    col, start, table, taint = F.col("to_col"), F.col("from_col"), F.col("from_table"), F.col("taint")
    calls = A.foreign_key_of(col, table)
    carried = (calls & A.primary_key_of(start, table)) | A.taint_matches(taint, col)
    sure = calls | A.taint_equals(taint, col)
    rows = rows.where(~((F.coalesce(F.col("access"), F.lit("")) == "write") & F.col("crossed")) | (carried & sure))
    suffix = F.lower(col).endswith(F.lower(start)) | F.lower(start).endswith(F.lower(col))
    first = F.when((F.col("access") == "filter") & suffix, "query").when(F.col("access") == "write", "write").otherwise("read")
    rows = rows.withColumn("type", first)
    rows = rows.withColumn("type", F.when((F.col("type") == "query") & A.taint_matches(taint, col), "fk").otherwise(F.col("type")))
    keyed = F.col("type").isin("query", "write") & F.col("filtered") & A.is_key(col) & (A.same_column(col, start) | calls | A.taint_matches(taint, col))
    rows = rows.withColumn("type", F.when(keyed, "fk").otherwise(F.col("type")))
    return rows.groupBy(*KEY).agg(F.min("hops").cast("int").alias("hops"), A.rank_type(F.max(A.relation_rank(F.col("type")))).alias("type"))


def where_direct(nodes: DataFrame) -> DataFrame:
    """Relations read from filter columns alone: to the `id` of a table that the column's name calls to, and to a key column of the same name
    in every other table. Of several tables the least. The tables' columns join on the endings of the key's base, so
    this is an equi-join although names match by suffix."""
    columns = keep(nodes.where(is_column_node() & F.col("name").contains(".")).select(A.table_of(F.col("name")).alias("t"), A.column_after_table(F.col("name")).alias("c"), F.col("access_kind").alias("access")).distinct(), "rel-columns")
    filters = columns.where("access = 'filter'").select(F.col("t").alias("from_table"), F.col("c").alias("from_col")).distinct().where(~A.primary_key_of(F.col("from_col"), F.col("from_table")))
    with_id = columns.where("c = 'id'").select("t").distinct()
    endings = with_id.select("t", F.explode(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.lower(F.substring(F.col("t"), i, F.length("t"))))).alias("ending"))
    by_name = filters.withColumn("ending", A.key_base(F.col("from_col"))).join(endings, "ending").where(F.col("t") != F.col("from_table")).groupBy("from_table", "from_col").agg(F.min("t").alias("to_table")).withColumn("to_col", F.lit("id"))
    keys = columns.select("t", "c", A.normalised(F.col("c")).alias("n")).distinct()
    same = filters.where(A.is_key(F.col("from_col"))).withColumn("n", A.normalised(F.col("from_col"))).join(keys, "n").where(F.col("t") != F.col("from_table")).groupBy("from_table", "from_col", F.col("t").alias("to_table")).agg(F.min("c").alias("to_col"))
    return by_name.select(*KEY).unionByName(same.select(*KEY)).distinct().select(*KEY, F.lit(0).alias("hops"), F.lit("fk").alias("type"))


def merge(*relations: DataFrame) -> DataFrame:
    """One row a key: the highest type and the least hops, each on its own."""
    both = relations[0]
    for r in relations[1:]:
        both = both.unionByName(r)
    return both.groupBy(*KEY).agg(F.min("hops").cast("int").alias("hops"), A.rank_type(F.max(A.relation_rank(F.col("type")))).alias("type"))


def without_key_noise(relations: DataFrame) -> DataFrame:
    """Without id to id; and where a target column has a start of another name, without read and write relations from `id`."""
    other = F.max(F.col("from_col") != "id").over(Window.partitionBy("from_table", "to_table", "to_col"))
    weak = (F.col("from_col") == "id") & ((F.col("to_col") == "id") | (F.col("_other") & ~F.col("type").isin("query", "fk")))
    return relations.withColumn("_other", other).where(~weak).drop("_other")


def infer(nodes: DataFrame, edges: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """schema.RELATION rows of all tables, or of some (column table_name)."""
    direct = where_direct(nodes)
    if tables is not None:
        direct = direct.join(tables.select(F.col("table_name").alias("from_table")), "from_table", "left_semi").select(direct.columns)
    return without_key_noise(merge(classify(nodes, search(nodes, edges, tables)), direct))


def best_of(relations: DataFrame) -> DataFrame:
    """One row a key: of the least hops, then of the highest type."""
    best = F.min(F.struct(F.col("hops"), (-A.relation_rank(F.col("type"))).alias("rank"))).alias("b")
    return relations.groupBy(*KEY).agg(best).select(*KEY, F.col("b.hops").alias("hops"), A.rank_type(-F.col("b.rank")).alias("type"))


def dedup(relations: DataFrame, caps: dict[str, int | None] = HOP_CAPS) -> DataFrame:
    """For reading: without self relations and those of too many hops; query and fk by column, write by column if the target ends in id, others
    by start column and table; of each the least hops."""
    far = F.lit(False)
    for kind, cap in caps.items():
        if cap:
            far = far | ((F.col("type") == kind) & (F.col("hops") > cap))
    shown = relations.where((F.col("from_table") != F.col("to_table")) & ~far)
    by_column = F.col("type").isin("query", "fk") | ((F.col("type") == "write") & F.lower("to_col").endswith("id"))
    keyed = shown.withColumn("_key", F.when(by_column, F.concat_ws("|", "from_table", "from_col", "to_table", "to_col")).otherwise(F.concat_ws("|", "from_table", "from_col", "to_table")))
    return first_by(keyed, ["_key"], ["hops", "to_col", F.col("type")]).drop("_key")


def of_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Relations that rules state, where both columns exist. A rule without from_table holds for each table with the column."""
    columns = keep(nodes.where(is_column_node() & F.col("name").contains(".")).select(A.table_of(F.col("name")).alias("t"), A.column_after_table(F.col("name")).alias("c")).distinct(), "rel-columns")
    target = rules.join(columns.select(F.col("t").alias("to_table"), F.col("c").alias("to_col")), ["to_table", "to_col"], "left_semi")
    source = target.join(columns.withColumnRenamed("c", "from_col"), "from_col").where((F.col("from_table") == "") | (F.col("from_table") == F.col("t")))
    rows = source.select(F.col("t").alias("from_table"), "from_col", "to_table", "to_col").where(F.col("from_table") != F.col("to_table")).distinct()
    return rows.select(*KEY, F.lit(1).alias("hops"), F.lit("fk").alias("type"))


def with_rules(relations: DataFrame, stated: DataFrame) -> DataFrame:
    """A stated relation takes the place of an inferred one of its key unless that one's type is higher; with is_rule."""
    both = relations.withColumn("is_rule", F.lit(False)).unionByName(stated.withColumn("is_rule", F.lit(True)))
    return first_by(both, KEY, [A.relation_rank(F.col("type")).desc(), F.col("is_rule").desc(), "hops"])


def shown(relations: DataFrame, types: tuple[str, ...] = ("fk", "query", "write"), max_hops: int = 0, limit: int = 0) -> DataFrame:
    """The relations of these types, in order; 0: no bound."""
    out = relations.where(F.col("type").isin(*types))
    if max_hops:
        out = out.where(F.col("hops") <= max_hops)
    out = out.orderBy("from_table", "from_col", "hops", "to_table", "to_col")
    return out.limit(limit) if limit else out


def count_by_type(relations: DataFrame) -> DataFrame:
    return relations.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def table_path(relations: DataFrame, start: str, end: str, max_hops: int = 6) -> DataFrame:
    """path_no, step, from_table, from_col, to_table, to_col, type: all shortest ways between two tables, over relations either way, each step
    by its best relation. A path is an array in the frontier's row; tables do not repeat in it."""
    spark = relations.sparkSession
    cols = ["from_table", "from_col", "to_table", "to_col", "type", "hops"]
    back = relations.select(F.col("to_table").alias("from_table"), F.col("to_col").alias("from_col"), F.col("from_table").alias("to_table"), F.col("from_col").alias("to_col"), "type", "hops")
    best = keep(first_by(relations.select(cols).unionByName(back), ["from_table", "to_table"], [A.relation_rank(F.col("type")).desc(), "hops", "from_col", "to_col"]).drop("hops"), "table-path")
    step = F.struct("from_table", "from_col", "to_table", "to_col", "type")
    level = spark.createDataFrame([(start,)], "at string").select("at", F.array("at").alias("visited"), F.expr("cast(array() as array<struct<from_table: string, from_col: string, to_table: string, to_col: string, type: string>>)").alias("steps"))
    reached = {start}
    for _ in range(max_hops if start != end else 0):
        met = level.join(best, level["at"] == best["from_table"]).where(~F.array_contains("visited", F.col("to_table")))
        level = keep(met.where(~F.col("to_table").isin(*reached)).select(F.col("to_table").alias("at"), F.concat("visited", F.array("to_table")).alias("visited"), F.concat("steps", F.array(step)).alias("steps")), "table-path")
        tables = {r[0] for r in level.select("at").distinct().collect()}  # names of tables, each at most once in the search
        if end in tables or not tables:
            break
        reached |= tables
    hits = level.where((F.col("at") == end) & (F.size("steps") > 0))
    numbered = hits.withColumn("path_no", F.row_number().over(Window.orderBy("visited")))  # the few shortest paths
    return numbered.select("path_no", F.posexplode("steps").alias("step", "s")).select("path_no", "step", "s.*")


def table_columns(nodes: DataFrame, edges: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """table_name, column_name, access, line (of its first node by id), writers and readers as (function, line)."""
    columns = nodes.where((F.col("kind") == "field_access") & (F.col("is_external") == "true") & F.col("name").contains(".")).withColumn("table_name", A.table_of(F.col("name")))
    if tables is not None:
        columns = columns.join(tables.select("table_name"), "table_name", "left_semi")
    columns = columns.select("id", "name", "table_name", F.col("access_kind").alias("access"), F.col("line_start").alias("line"))
    io = edges.where(F.col("kind") == "summary_io")
    lines = nodes.select(F.col("id").alias("other"), F.col("line_start").alias("other_line"))
    at = F.coalesce("line_num", "other_line").cast("int")
    into = columns.join(io, columns["id"] == io["target_id"]).select("name", F.col("source_id").alias("other"), "line_num", F.lit("w").alias("side"))
    out = columns.where("access = 'read'").join(io, columns["id"] == io["source_id"]).select("name", F.col("target_id").alias("other"), "line_num", F.lit("r").alias("side"))
    places = into.unionByName(out).join(lines, "other", "left").select("name", "side", F.struct(ids.function_of(F.col("other")).alias("func_id"), at.alias("line")).alias("p"))
    side = lambda s: F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("p"))))
    used = places.groupBy("name").agg(side("w").alias("writers"), side("r").alias("readers"))
    first = first_by(columns, ["name"], ["id"])
    return first.join(used, "name", "left").select("table_name", A.column_after_table(F.col("name")).alias("column_name"), "access", "line", "writers", "readers")


def all_columns(nodes: DataFrame) -> DataFrame:
    """table_name, column_name, access, line of every column of one dot, the first node by id of each."""
    columns = nodes.where(is_column_node() & F.col("name").rlike(r"^[^.]+\.[^.]+$"))
    return first_by(columns, ["name"], ["id"]).select(A.table_of(F.col("name")).alias("table_name"), A.column_after_table(F.col("name")).alias("column_name"), F.col("access_kind").alias("access"), F.col("line_start").alias("line"))


def er_tables(nodes: DataFrame) -> DataFrame:
    """table_name with its columns, in order."""
    return all_columns(nodes).groupBy("table_name").agg(F.array_sort(F.collect_list("column_name")).alias("columns"))


def cached(relations: DataFrame, path: str, build_id: str, version: str = "1") -> DataFrame:
    """The relations of a build, computed once for each version of the inference: the folder's name says which it is."""
    spark = relations.sparkSession
    folder = f"{path}/build_id={build_id}/version={version}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        relations.write.mode("overwrite").parquet(folder)
    return spark.read.schema(relations.schema).parquet(folder)
