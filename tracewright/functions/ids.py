"""Identifiers: building and taking apart, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_name(id_: Column) -> Column:
    """The text after the last ':'."""
    return F.substring_index(id_, ":", -1)


def package_of(id_: Column) -> Column:
    """The import path of symbol:go:<path>:<name>; without that form, all before the last ':'."""
    bare = F.regexp_replace(id_, "^symbol:go:", "")
    return F.when(F.instr(bare, ":") > 0, F.regexp_extract(bare, "(?s)^(.*):[^:]*$", 1)).otherwise(bare)


def struct_of_method(id_: Column) -> Column:
    """symbol:go:P:(T).m to symbol:go:P:T; null where the name is no method."""
    return F.when(id_.rlike(r"^.*:\(\*?[^()]+\)\.[^:]*$"), F.regexp_replace(id_, r"^(.*:)\(\*?([^()]+)\)\.[^:]*$", "$1$2"))


def method_name(receiver: Column, method: Column) -> Column:
    return F.concat(F.lit("("), F.regexp_replace(receiver, r"^\*", ""), F.lit(")."), method)


def symbol_id(import_path: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lit("symbol:go"), import_path, name)


def function_of(node_id: Column) -> Column:
    """The function part of a node inside a function: all before the last '#'."""
    return F.when(F.instr(node_id, "#") > 0, F.regexp_extract(node_id, "(?s)^(.*)#[^#]*$", 1)).otherwise(node_id)


def short_id(id_: Column) -> Column:
    """For display: the last path element of the package, then the name."""
    return F.concat_ws(".", F.substring_index(package_of(id_), "/", -1), short_name(id_))


def last_segment(path: Column) -> Column:
    """The text after the last '.'."""
    return F.substring_index(path, ".", -1)


def dotted_package(path: Column) -> Column:
    """All but the last two parts of a dotted path; one of two parts or fewer stays."""
    parts = F.split(path, r"\.")
    return F.when(F.size(parts) <= 2, path).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1))), "."))


def last_edge_kind(kinds: Column) -> Column:
    return F.substring_index(kinds, ",", -1)


def sorted_edge_kinds(kinds: Column) -> Column:
    return F.array_join(F.array_sort(F.split(kinds, ",")), ",")


def type_name(type_string: Column) -> Column:
    """The bare type name; null for basic types, which never connect anything."""
    bare = F.regexp_replace(last_segment(type_string), r"^[\[\]*]+|[\[\]*]+$", "")
    return F.when(~bare.isin("", "any", "string", "int", "int64", "bool", "error", "byte"), bare)


def struct_path(path: Column) -> Column:
    """All before the last '.'; '' without one."""
    return F.when(F.instr(path, ".") > 0, F.regexp_extract(path, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(F.lit(""))


def is_ssa_name(name: Column) -> Column:
    return name.rlike("^t[0-9]+$")


def short_alloc_type(type_string: Column) -> Column:
    """Leading '*' and '[]' stay, the path up to the last '/' goes."""
    return F.regexp_replace(type_string, r"^([*\[\]]*).*/", "$1")


def element_mark(index: Column, kind: Column) -> Column:
    """["a"] for a constant string, [0] for a constant number, [key] for a named one, [*] otherwise."""
    return F.when(kind == "string", F.concat(F.lit('["'), index, F.lit('"]'))).when(kind.isin("int", "name"), F.concat(F.lit("["), index, F.lit("]"))).otherwise("[*]")


def short_sha(sha: Column, n: int = 12) -> Column:
    return F.substring(sha, 1, n)


def is_exported(name: Column) -> Column:
    """First character A-Z; a method's name starts with '(', so it never is."""
    return name.rlike("^[A-Z]")


def in_modules(path: Column, modules: list[str]) -> Column:
    """Equal to a module, or inside one."""
    hit = F.lit(False)
    for m in modules:
        hit = hit | (path == m) | path.startswith(m + "/")
    return hit
