"""Text forms of bounded results, made on the driver from collected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _quoted(text: object) -> str:
    return '"' + str(text).replace("\\", "\\\\").replace('"', '\\"') + '"'


def _pairs(df: DataFrame, most: int) -> list:
    return df.limit(most).collect()


def dot(edges: DataFrame, most: int = 2000) -> str:
    """source_id, target_id and kind as a Graphviz digraph; at most `most` edges are drawn."""
    rows = _pairs(edges.select("source_id", "target_id", "kind").distinct().orderBy("source_id", "target_id", "kind"), most)
    return "\n".join(["digraph g {", *(f"  {_quoted(a)} -> {_quoted(b)} [label={_quoted(k)}];" for a, b, k in rows), "}"])


def mermaid(edges: DataFrame, most: int = 2000) -> str:
    """The same as a Mermaid flow chart."""
    rows = _pairs(edges.select("source_id", "target_id", "kind").distinct().orderBy("source_id", "target_id", "kind"), most)
    number = {name: f"n{i}" for i, name in enumerate(sorted({x for r in rows for x in r[:2]}))}
    clean = lambda s: str(s).replace('"', "'")
    return "\n".join(["flowchart LR", *(f'  {n}["{clean(name)}"]' for name, n in number.items()), *(f"  {number[a]} -->|{clean(k)}| {number[b]}" for a, b, k in rows)])


def modules_mermaid(calls: DataFrame, most: int = 500) -> str:
    """from_module, to_module, labels as a Mermaid flow chart."""
    rows = _pairs(calls.select("from_module", "to_module", "labels").orderBy("from_module", "to_module"), most)
    return "\n".join(["flowchart LR", *(f'  {a} -->|"{label}"| {b}' for a, b, label in rows)])


def trace_text(rows: DataFrame, most: int = 2000) -> str:
    """Trace rows (dir, depth, name, line, edge_kinds), producers before uses, indented by depth."""
    out = []
    for r in _pairs(rows.select("dir", "depth", "name", "line", "edge_kinds", "id").orderBy("dir", "depth", "id"), most):
        out.append(f"{'  ' * r['depth']}{'<-' if r['dir'] == 0 else '->'} {r['name']}:{r['line'] or '?'} [{r['edge_kinds']}]")
    return "\n".join(out)


def trace_tree(rows: DataFrame, most: int = 2000) -> str:
    """Value trace rows as a tree along their parents."""
    found = _pairs(rows.select("dir", "depth", "id", "parent", "name", "line").orderBy("dir", "depth", "id"), most)
    under: dict[tuple, list] = {}
    for r in found:
        under.setdefault((r["dir"], r["parent"]), []).append(r)
    out: list[str] = []

    def show(row, level: int) -> None:
        out.append(f"{'  ' * level}{row['name']}:{row['line'] or '?'}")
        for child in under.get((row["dir"], row["id"]), []):
            if child["depth"] == row["depth"] + 1:
                show(child, level + 1)

    for root in (r for r in found if r["depth"] == 0):
        for d, title in ((0, "from"), (1, "to")):
            out.append(f"{title}:")
            show({"name": root["name"], "line": root["line"], "dir": d, "id": root["id"], "depth": 0}, 1)
    return "\n".join(out)
