"""Names of tables and columns from type and field names, URLs and routes; as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The initialisms of the ORM naming convention, in its order.
INITIALISMS = (
    "API", "ASCII", "CPU", "CSS", "DNS", "EOF", "GUID", "HTML", "HTTP", "HTTPS", "ID", "IP", "JSON", "LHS", "QPS", "RAM", "RHS", "RPC", "SLA",
    "SMTP", "SSH", "TLS", "TTL", "UID", "UI", "UUID", "URI", "URL", "UTF8", "VM", "XML", "XSRF", "XSS",
)


def snake_case(name: Column) -> Column:
    """UserProfile to user_profile. Initialisms count as words, other runs of capitals stay together up to the last one
    that a small letter follows."""
    for word in INITIALISMS:
        name = F.replace(name, F.lit(word), F.lit(word.capitalize()))
    after_small = "(?<=[^_A-Z])[A-Z](?!_)"
    before_small = "(?<=[A-Z])[A-Z](?=[^A-Z0-9_])"
    last = "(?<=_)[A-Z]$"
    return F.lower(F.regexp_replace(name, f"({after_small}|{before_small}|{last})", "_$1"))


def orm_column(tag: Column, field: Column) -> Column:
    """The name in the tag's `column:x`, else the field's in snake case."""
    named = F.regexp_extract(tag, r"column:([^;\"'\s]+)", 1)
    return F.when(named != "", named).otherwise(snake_case(field))


def url_host(url: Column) -> Column:
    """The host of a URL with or without a scheme; '' for a path."""
    return F.regexp_extract(url, r"^(?:.*?://)?([^/?]*)", 1)


def url_path(url: Column) -> Column:
    """The path without query and fragment; '/' where there is none."""
    path = F.regexp_extract(url, r"^(?:.*?://)?[^/?]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def route_matches(path: Column, route: Column) -> Column:
    """Equal; or the route ends in '/' and begins the path; or both have equal segments but for the route's {x} segments."""
    return (path == route) | F.when(route.endswith("/"), path.startswith(route)).otherwise(
        (F.size(F.split(path, "/")) == F.size(F.split(route, "/")))
        & F.forall(F.zip_with(F.split(path, "/"), F.split(route, "/"), lambda a, b: F.coalesce((a == b) | (b.startswith("{") & b.endswith("}")), F.lit(False))), lambda same: same)
    )


def route_shape(path: Column) -> Column:
    """The number of segments: routes and paths that match segment by segment have equal shapes, which makes an equi-join key."""
    return F.size(F.split(path, "/"))


def is_grpc_method_path(path: Column) -> Column:
    return path.rlike("^/[^/]+/[^/]+$")


def grpc_client_service(function: Column) -> Column:
    """X of NewXClient, '' else."""
    return F.regexp_extract(function, "^New(.+)Client$", 1)


def grpc_client_type_service(type_name: Column) -> Column:
    """X of XClient, '' else."""
    return F.regexp_extract(type_name, "^(.+)Client$", 1)


def grpc_register_service(function: Column) -> Column:
    """X of RegisterXServer, '' else."""
    return F.regexp_extract(function, "^Register(.+)Server$", 1)


def git_path(path: Column) -> Column:
    """The new path of a rename in git's short form, without quotes: a/{b => c}/d to a/c/d."""
    bare = F.regexp_replace(path, '^"|"$', "")
    braced = F.regexp_replace(bare, r"\{[^{}]* => ([^{}]*)\}", "$1")
    whole = F.regexp_replace(braced, r"^.* => ", "")
    return F.regexp_replace(whole, "//+", "/")


def python_rule(text: str) -> tuple[str, str, str, str] | None:
    """`a.x to b.y`, `a.x -> b.y` or `a.x → b.y` as (from_table, from_col, to_table, to_col); the table of the first may be
    missing (a pattern over all tables), to_col defaults to id. None for anything else."""
    if not (m := re.fullmatch(r"\s*(?:([\w]+)\.)?([\w]+)\s*(?:\bto\b|->|→)\s*([\w]+)(?:\.([\w]+))?\s*", text)):
        return None
    return m[1] or "", m[2], m[3], m[4] or "id"
