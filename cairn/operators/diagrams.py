"""Mermaid diagrams of modules and call flows; a diagram has at most a few dozen nodes, so its text is assembled here."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairn.functions import text as T
from cairn.operators import graph

MODULE_NODES, FLOW_NODES = 40, 30


def modules(edges: DataFrame, scope: str = "", limit: int = MODULE_NODES) -> tuple[str, DataFrame]:
    """(text, edges drawn) of file edges (src, dst, weight): the finest level with at most ``limit`` nodes, else the
    nodes of most weight."""
    limit, scope = max(5, min(100, limit)), scope.strip().strip("/")
    drawn, truncated = None, False
    for depth in (None, 3, 2, 1):
        drawn = graph.collapse(edges, scope, depth, scope.count("/") + 1)
        if graph.degrees(drawn).count() <= limit:
            break
    else:
        keep = graph.top_degree(drawn, limit).select("node")
        drawn, truncated = graph.induced_edges(drawn, keep), True
    looped = {r.node for r in graph.strongly_connected(drawn.select("src", "dst")).limit(limit).collect()}
    rows = drawn.orderBy("src", "dst").limit(limit * limit).select("src", "dst", "weight", T.mermaid_label(F.col("src")).alias("ls"), T.mermaid_label(F.col("dst")).alias("ld")).collect()
    names: dict[str, str] = {}
    labels: dict[str, str] = {}
    for r in rows:
        for n, text in ((r.src, r.ls), (r.dst, r.ld)):
            names.setdefault(n, f"n{len(names)}")
            labels[n] = text
    lines = ["flowchart LR", *(f'  {k}["{labels[n]}"]' for n, k in names.items())]
    lines += [f"  {names[r.src]} -->{f'|{r.weight}|' if r.weight > 1 else ''} {names[r.dst]}" for r in rows]
    if inside := [names[n] for n in names if n in looped]:
        lines += ["  classDef cycle stroke:#dc2626,stroke-width:2px", f"  class {','.join(inside)} cycle"]
    if truncated:
        lines.append(f"  %% only the {limit} nodes of most weight")
    return "\n".join(lines) + "\n", drawn


def _flow_parts(symbols: DataFrame, edges: DataFrame, symbol_id: int, depth: int, limit: int):
    limit = max(5, min(60, limit))
    t = graph.traverse(edges, [symbol_id], depth, limit - 1, callers=False)
    nodes = [symbol_id, *(r.node for r in t.hits.orderBy("pos").collect())]
    n = symbols.sparkSession.createDataFrame([(x,) for x in nodes], "node bigint")
    names = {r.id: r for r in symbols.join(F.broadcast(n), F.col("id") == F.col("node")).select("id", "name", "qualified_name", "kind", "file_path").collect()}  # at most `limit` nodes
    e = graph.induced_edges(edges, n).orderBy("file_path", "line", "seq").limit(limit * limit).collect()
    return nodes, names, e, t.truncated


def flow(symbols: DataFrame, edges: DataFrame, symbol_id: int, depth: int = 3, limit: int = FLOW_NODES) -> str:
    """Flow chart of what a symbol calls; low-confidence links are dashed, shapes go by kind."""
    nodes, names, e, truncated = _flow_parts(symbols, edges, symbol_id, depth, limit)
    ids = {n: f"n{i}" for i, n in enumerate(nodes)}
    shape = {"class": ("[[", "]]"), "method": ("([", "])")}
    lines = ["flowchart TD"]
    for n in nodes:
        if n in names:
            a, b = shape.get(names[n].kind, ("[", "]"))
            lines.append(f'  {ids[n]}{a}"{names[n].qualified_name}"{b}')
    seen = set()
    for r in e:
        if (r.src, r.dst) not in seen:
            seen.add((r.src, r.dst))
            lines.append(f"  {ids[r.src]} {'-.->' if r.confidence == 'low' else '-->'} {ids[r.dst]}")
    if truncated:
        lines.append("  %% more calls than shown")
    return "\n".join(lines) + "\n"


def sequence(symbols: DataFrame, edges: DataFrame, symbol_id: int, depth: int = 3, limit: int = FLOW_NODES, messages: int = 60) -> str:
    """Sequence of calls in source order, depth first: no node twice on a path, every edge once."""
    nodes, names, e, _ = _flow_parts(symbols, edges, symbol_id, depth, limit)
    out: dict[int, list] = {}
    for r in e:
        out.setdefault(r.src, []).append(r)
    actors: dict[str, str] = {}

    def actor(n: int) -> str:
        f = names[n].file_path
        return actors.setdefault(f, f"p{len(actors)}")

    body: list[str] = []
    used: set[tuple[int, int]] = set()
    stack = [(symbol_id, (symbol_id,), 0)]
    while stack and len(body) < messages:
        n, path, k = stack.pop()
        calls = out.get(n, [])
        if k >= len(calls) or len(path) > depth:
            continue
        stack.append((n, path, k + 1))
        r = calls[k]
        if r.dst in path or (r.src, r.dst) in used or r.dst not in names:
            continue
        used.add((r.src, r.dst))
        body.append(f"  {actor(n)}->>{actor(r.dst)}: {names[r.dst].name}()")
        stack.append((r.dst, (*path, r.dst), 0))
    return "\n".join(["sequenceDiagram", *(f"  participant {k} as {f}" for f, k in actors.items()), *body]) + "\n"
