"""How a value trace is shown around its anchor's source line, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ids

#: Fixed value: what stands for a function that is not known.
UNKNOWN = "（未知函数）"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def short_anchor(func_id: Column, name: Column) -> Column:
    """Function#name, by the function's short name."""
    func = ids.short_name(F.coalesce(func_id, F.lit("")))
    return F.concat(F.when(func == "", F.lit(UNKNOWN)).otherwise(func), F.lit("#"), name)


def assigned_to(line: Column) -> Column:
    """What the line assigns to, without its last field: u of `u.Brands = brands`; '' where it assigns nothing."""
    before = lambda sign: _trim(F.regexp_extract(line, f"(?s)^(.*?){sign}", 1))
    left = F.when(F.instr(line, ":=") > 0, before(":=")).otherwise(before("="))
    return F.when(F.instr(line, "=") > 0, _trim(F.regexp_replace(left, r"(?s)^(.*)\.[^.]*$", "$1"))).otherwise(F.lit(""))


def assigned_value(line: Column) -> Column:
    """The first name of the value that the line assigns (from the second character behind the sign's first one on); of a literal's
    `Key: value,` the whole value, without a comment."""
    right = F.when(F.instr(line, ":=") > 0, F.regexp_extract(line, r"(?s)^.*?:=(.*)$", 1)).otherwise(F.regexp_extract(line, r"(?s)^.*?=.(.*)$", 1))
    pair = _trim(F.regexp_replace(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1), r"(?s)//.*$", ""))
    return F.when(F.instr(line, "=") > 0, F.regexp_extract(_trim(right), r"^[^.( ]*", 0)).otherwise(F.regexp_replace(pair, ",$", ""))


def source_side(depth: Column, name: Column, line: Column) -> Column:
    """Of a row on the source side: value (what the anchor's line writes), object (what it writes to), or source (all others)."""
    near = depth == 1
    value, target = assigned_value(line), assigned_to(line)
    return F.when(near & (value != "") & (name == value), "value").when(near & (target != "") & (name == target), "object").otherwise("source")
