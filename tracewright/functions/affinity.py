"""How column, field and table names call to each other; all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(name: Column) -> Column:
    """Lower case without '_'."""
    return F.lower(F.translate(name, "_", ""))


def same_column(a: Column, b: Column) -> Column:
    return normalised(a) == normalised(b)


def column_of(name: Column) -> Column:
    """The text after the last '.', '' without one."""
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def table_of(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def column_after_table(name: Column) -> Column:
    """The text after the first '.', or the whole name."""
    return F.regexp_replace(name, r"^[^.]*\.", "")


def key_base(column: Column) -> Column:
    """The column in lower case without its `_id` or `id` ending, where anything is left before it."""
    low = F.lower(column)
    return F.when(low.endswith("_id") & (F.length(low) > 3), F.regexp_replace(low, "_id$", "")).when(low.endswith("id") & (F.length(low) > 2), F.regexp_replace(low, "id$", "")).otherwise(low)


def foreign_key_of(column: Column, table: Column) -> Column:
    """The column's base names the table, or ends its name."""
    base = key_base(column)
    return (base != "") & F.lower(table).endswith(base)


def is_key(column: Column) -> Column:
    return normalised(column).endswith("id")


def primary_key_of(column: Column, table: Column) -> Column:
    """`id`, or the table's singular (without t_, then tb_ before and s behind), with or without _id."""
    low = F.lower(column)
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(table), "^t_", ""), "^tb_", ""), "s$", "")
    return (low == "id") | (low == base) | (low == F.concat(base, F.lit("_id")))


def taint_meets(taint: Column, name: Column) -> Column:
    """The elements of taint that equal the name but for case, in taint's spelling."""
    return F.filter(taint, lambda x: F.lower(x) == F.lower(name))


def taint_matches(taint: Column, column: Column) -> Column:
    """Any element ends the column's name, or the other way round, but for case."""
    low = F.lower(column)
    return F.coalesce(F.exists(taint, lambda x: low.endswith(F.lower(x)) | F.lower(x).endswith(low)), F.lit(False))


def taint_equals(taint: Column, column: Column) -> Column:
    return F.coalesce(F.exists(taint, lambda x: F.lower(x) == F.lower(column)), F.lit(False))


def relation_rank(kind: Column) -> Column:
    return F.when(kind == "fk", 3).when(kind == "query", 2).when(kind == "write", 1).otherwise(0)


def rank_type(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("read"), F.lit("write"), F.lit("query"), F.lit("fk")), rank + 1)
