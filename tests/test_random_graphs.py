"""Order-sensitive operators on random graphs, against queue-by-queue versions."""

import random
from collections import deque

import pytest
from test_graph_fixtures import edges_of, nodes_of, related

from tracewright import schema as S
from tracewright.operators import deadcode, relations

COLS = ["id", "t1_id", "t2_id", "title", "biz_id"]
KINDS = ["data_flows_to", "data_flows_to", "argument", "returns", "summary_io", "alias", "phi_operand", "calls"]


def random_graph(seed):
    rng = random.Random(seed)
    nodes = []
    for i in range(34):
        func = f"f{rng.randrange(3)}"
        if i < 12:
            name = f"t{rng.randrange(3)}.{rng.choice(COLS)}"
            nodes.append((f"n{i:02}", "field_access", name, "a.go", i, {"full_path": name, "access_kind": rng.choice(["read", "write", "filter"]), "func_id": func, "type_string": rng.choice(["sql", "gorm", "sql", "other"]), "is_external": rng.choice(["true", "true", "false"])}))
        elif i < 20:
            name = f"{rng.choice('TU')}.{rng.choice(['Id', 'BizID', 'T1Id', 'Title'])}"
            nodes.append((f"n{i:02}", "field_access", name, "a.go", i, {"full_path": "m." + name, "access_kind": rng.choice(["read", "write"]), "func_id": func, "type_string": rng.choice(["int", "error", "m.T"]), "is_external": "false"}))
        else:
            nodes.append((f"n{i:02}", "ssa_value", f"t{i}", "a.go", i, {"func_id": func, "type_string": rng.choice(["*m.T", "int", "error", "struct{}", "m.U"])}))
    edges = {}
    for _ in range(60):
        a, b = rng.sample(range(34), 2)
        edges[(f"n{a:02}", f"n{b:02}", rng.choice(KINDS))] = 1
    return nodes, sorted(edges)


def low(x):
    return x.replace("_", "").lower()


def calls_to(col, table):
    c = col.lower()
    base = c[:-3] if c.endswith("_id") and len(c) > 3 else c[:-2] if c.endswith("id") and len(c) > 2 else c
    return table.lower().endswith(base)


def primary(col, table):
    base = table.lower().removeprefix("t_").removeprefix("tb_").removesuffix("s")
    return col.lower() in ("id", base, base + "_id")


def tainted(taint, col):
    c = col.lower()
    return any(c.endswith(t.lower()) or t.lower().endswith(c) for t in taint)


def by_queue(nodes, edges):
    info = {i: {"kind": k, "name": n, **p} for i, k, n, _, _, p in nodes}
    near, crossing, out = {}, set(), {}
    for a, b, kind in edges:
        out.setdefault(a, set()).add(b)
        if kind in S.RELATIONS:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, []).append(((a, b, kind), y))
                if kind in S.CROSSING:
                    crossing.add((x, y))
    is_filter = lambda x: x in info and info[x].get("access_kind") == "filter" and info[x].get("is_external") == "true"
    filtered = {info[i]["name"] for i in info if is_filter(i)}

    def bare_type(i):
        t = info[i].get("type_string", "").rsplit(".", 1)[-1].strip("[]*")
        return None if t in ("", "any", "string", "int", "int64", "bool", "error", "byte") else t

    found = {}
    for s in sorted(info):
        if info[s]["kind"] != "field_access" or info[s].get("is_external") != "true":
            continue
        table, start = info[s]["name"].split(".", 1)
        seen = {s: (0, False, (start,))}
        queue = deque([(s, (start,))])
        while queue:
            cur, carried = queue.popleft()
            depth, crossed, _ = seen[cur]
            if depth >= 12:
                continue
            me = info[cur]
            for _, y in sorted(near.get(cur, [])):
                if y in seen or info[y].get("type_string") == "error":
                    continue
                taint, you = carried, info[y]
                if me["kind"] == "field_access" and me["access_kind"] == "read" and y in out.get(cur, ()):
                    taint = tuple(t for t in carried if t.lower() == me["name"].rsplit(".", 1)[-1].lower())
                if me["kind"] == "ssa_value" and (me["type_string"].startswith("*") or "struct" in me["type_string"]) and you["kind"] == "field_access" and you["access_kind"] == "write" and you["is_external"] != "true":
                    taint = tuple(t for t in carried if low(t) == low(you["name"].rsplit(".", 1)[-1]))[:1]
                seen[y] = (depth + 1, crossed or (cur, y) in crossing, taint)
                queue.append((y, taint))
            if me.get("func_id") and (name := bare_type(cur)):
                for y in sorted(info):
                    you = info[y]
                    if you["kind"] == "field_access" and you["access_kind"] == "read" and you["func_id"] == me["func_id"] and name in you["full_path"] and y not in seen and any(is_filter(w) for z in out.get(y, ()) for w in out.get(z, ())):
                        seen[y] = (depth + 1, crossed, ())
                        queue.append((y, carried))
        for y, (depth, crossed, taint) in seen.items():
            you = info[y]
            if not depth or you["kind"] != "field_access" or you["type_string"] not in S.SQL_TYPES:
                continue
            other, col = you["name"].split(".", 1)
            if other == table:
                continue
            kind = {"filter": "query", "write": "write"}.get(you["access_kind"], "read")
            if kind == "write" and crossed:
                if not ((calls_to(col, table) and primary(start, table)) or tainted(taint, col)) or not (calls_to(col, table) or col.lower() in [t.lower() for t in taint]):
                    continue
            if kind == "query" and not (col.lower().endswith(start.lower()) or start.lower().endswith(col.lower())):
                kind = "read"
            if kind == "query" and tainted(taint, col):
                kind = "fk"
            if kind in ("query", "write") and f"{other}.{col}" in filtered and low(col).endswith("id") and (low(col) == low(start) or calls_to(col, table) or tainted(taint, col)):
                kind = "fk"
            key = (table, start, other, col)
            old = found.get(key, (99, "read"))
            found[key] = (min(depth, old[0]), max(kind, old[1], key=S.RELATION_RANK.get))
    return found


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_relations(spark, seed):
    nodes, edges = random_graph(seed)
    frames = nodes_of(spark, nodes), edges_of(spark, [(*e, 1) for e in edges])
    assert related(relations.classify(frames[0], relations.search(*frames))) == by_queue(nodes, edges)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_isolated_chains(spark, seed):
    rng = random.Random(seed)
    names = [f"f{i:02}" for i in range(40)]
    calls = {(a, b) for a, b in (rng.sample(names[:30], 2) for _ in range(26))} | {("f30", "f31"), ("f31", "f32"), ("f32", "f30"), ("f31", "f30"), ("f33", "f34"), ("f34", "f33"), ("f00", "f34"), ("f35", "f35")}
    passed = {("f00", "f05"), ("f01", "f36")}
    into = {x: {a for a, b in calls if b == x} for x in names}
    heads = [x for x in names if not into[x] and x not in {b for _, b in passed}]
    want = set()
    for h in heads:
        chain = {h}
        while more := {b for a, b in calls if a in chain and b not in chain and into[b] <= chain}:
            chain |= more
        want |= {(h, x, False) for x in chain}
    want |= {("f30", x, True) for x in ("f30", "f31", "f32")}
    rings = {x for _, x, cycle in want if cycle}
    nodes = nodes_of(spark, [(x, "function", x, "a.go", 1, {}) for x in names])
    edges = edges_of(spark, [(a, b, "calls", 1) for a, b in sorted(calls)] + [(a, b, "passes_to", 1) for a, b in sorted(passed)])
    found = {(r.head, r.id, r.is_cycle) for r in deadcode.isolated_chains(nodes, edges).collect()}
    assert {x for x in found if not x[2]} == {x for x in want if not x[2]}
    assert rings <= {x for _, x, cycle in found if cycle} and all(x in rings or x < "f30" for _, x, cycle in found if cycle)
