"""Graphs of calls and imports: bounded traversal, impact, module graphs, cycles.

Traversals stop at ``max_nodes`` (a feature of the report), so what the driver holds between levels is bounded by it; the
edges stay distributed, and each level reduces its candidates to one row per node before any of them is fetched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from cairn.functions import constants as K, text as T
from cairn.session import cut

EDGE = "src bigint, dst bigint, kind string, file_path string, line int, seq bigint, confidence string"
HIT = "node bigint, depth int, pos int, via bigint, confidence string"


@dataclass
class Traversal:
    hits: DataFrame
    truncated: bool


def traverse(edges: DataFrame, roots: list[int], depth: int = 3, max_nodes: int = K.MAX_BFS_NODES, callers: bool = True) -> Traversal:
    """Breadth first from ``roots`` against (callers) or along the edges; each node by the edge that finds it first.

    Order of discovery: position of the node it is found from, then file, line and number of the edge. The confidence of
    a hit is the weakest of its path. ``truncated`` tells that another node was met when the cap was reached."""
    depth = max(1, min(5, depth))
    spark = edges.sparkSession
    a, b = ("dst", "src") if callers else ("src", "dst")
    e = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col(a).alias("at"), F.col(b).alias("to"), "file_path", "line", "seq", "confidence")
    visited, frontier, rows, truncated = set(roots), [(r, i, "high") for i, r in enumerate(roots)], [], False
    rank = {c: i for i, c in enumerate(K.CONFIDENCES)}
    for level in range(1, depth + 1):
        if not frontier:
            break
        room = max_nodes - len(rows)
        f = spark.createDataFrame(frontier, "at bigint, fpos int, fconf string")
        c = e.join(F.broadcast(f), "at").filter(~F.col("to").isin(list(visited)))  # frontier and visited: at most max_nodes
        key = F.struct("fpos", "file_path", "line", "seq")
        c = c.groupBy("to").agg(F.min_by(F.struct("at", "confidence", "fconf"), key).alias("v"), F.min(key).alias("k"))
        found = c.orderBy("k").limit(max(room, 0) + 1).collect()
        if len(found) > room:
            truncated, found = True, found[: max(room, 0)]
        frontier = []
        for r in found:
            conf = min((r.v.confidence or "low", r.v.fconf), key=lambda x: rank.get(x, 0))
            rows.append((r.to, level, len(rows), r.v["at"], conf))
            visited.add(r.to)
            frontier.append((r.to, len(frontier), conf))
    return Traversal(spark.createDataFrame(rows, HIT), truncated)


def blast_radius(hits: DataFrame) -> DataFrame:
    """(score, level) of hits (depth, confidence, is_test): weights by depth and confidence, tests do not count."""
    w = F.element_at(F.array(*map(F.lit, K.DEPTH_WEIGHTS)), F.col("depth")) * F.element_at(F.create_map(*(F.lit(x) for kv in K.CONFIDENCE_WEIGHTS.items() for x in kv)), F.col("confidence"))
    s = hits.agg(F.coalesce(F.sum(F.when(~F.col("is_test"), w)), F.lit(0.0)).alias("raw"))
    return s.select(F.round("raw", 2).alias("score"), F.when(F.col("raw") >= 10, "High").when(F.col("raw") >= 3, "Medium").otherwise("Low").alias("level"))


def roots_of(symbols: DataFrame, symbol_id: int) -> list[int]:
    """The symbol, and the members of a class."""
    s = symbols.filter(F.col("id") == symbol_id).select("id", "kind", "qualified_name", "file_path").first()
    if s is None:
        return []
    if s.kind != "class":
        return [s.id]
    members = symbols.filter((F.col("owner") == s.qualified_name) & (F.col("file_path") == s.file_path)).select("id").orderBy("start_line", "id").limit(K.MAX_BFS_NODES).collect()
    return [s.id, *(r.id for r in members)]


def impact(symbols: DataFrame, references: DataFrame, symbol_id: int, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Hits with their symbols, ordered by depth, file and line, and a one-row summary."""
    roots = roots_of(symbols, symbol_id)
    refs = references.filter(F.col("kind").isin("call", "inherit")).select(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst"), "kind", "file_path", "line", "seq", "confidence")
    t = traverse(refs, roots, depth)
    hits = t.hits.join(symbols.withColumnRenamed("id", "node"), "node").select("node", "depth", "confidence", "qualified_name", "kind", "file_path", "start_line", "is_test")
    score = blast_radius(hits)
    summary = hits.agg(
        F.count("*").alias("total"), F.count_if(F.col("depth") == 1).alias("direct"), F.countDistinct("file_path").alias("files"),
        F.countDistinct(F.when(~F.col("is_test"), F.col("file_path"))).alias("production_files"), F.count_if(F.col("confidence") == "low").alias("low_confidence"), F.count_if("is_test").alias("tests"),
    )
    name = symbols.filter(F.col("id") == symbol_id).select("name").first()
    unresolved = references.filter(F.col("to_symbol_id").isNull() & (F.col("to_name") == F.lit(name[0] if name else None))).count()
    points, level = score.first()
    summary = summary.select("*", F.lit(points).alias("score"), F.lit(level).alias("level"), F.lit(unresolved).alias("unresolved_same_name"), F.lit(t.truncated).alias("truncated"))
    return hits.orderBy("depth", "file_path", "start_line"), summary


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both in ``nodes`` (node), without loops."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").filter("src <> dst")


def module_graph(imports: DataFrame, level: str = "file") -> DataFrame:
    """(src, dst, weight) of resolved imports (file_path, resolved_file_path) by file or folder, without loops."""
    key = (lambda c: F.col(c)) if level == "file" else (lambda c: T.dir_of(F.col(c)))
    d = imports.filter(F.col("resolved_file_path").isNotNull()).select(key("file_path").alias("src"), key("resolved_file_path").alias("dst"))
    return d.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def collapse(edges: DataFrame, scope: str = "", depth: int | None = None, external_depth: int = 1) -> DataFrame:
    """(src, dst, weight) of file edges cut to ``depth`` folders inside the scope and ``external_depth`` outside; edges that
    begin outside the scope are left out."""

    def key(c: str):
        inside = F.col(c) if depth is None else T.key_at(F.col(c), depth)
        return F.when(T.in_scope(F.col(c), scope), inside).otherwise(T.key_at(F.col(c), external_depth)) if scope else inside

    d = edges.filter(T.in_scope(F.col("src"), scope)) if scope else edges
    return d.select(key("src").alias("src"), key("dst").alias("dst"), "weight").filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): weights in and out."""
    return edges.select(F.col("src").alias("node"), "weight").unionByName(edges.select(F.col("dst").alias("node"), "weight")).groupBy("node").agg(F.sum("weight").alias("degree"))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component) of components of more than one node, by trimming and forward-backward colouring.

    Every round spreads the least name along the edges until it rests, then walks back from the nodes that kept their own
    name inside its colour: what is reached both ways is a component. Rounds remove whole components; only links and
    names are shuffled, and each step is written to the checkpoint folder."""
    left = cut(edges.select("src", "dst").filter("src is not null and dst is not null and src <> dst").distinct())
    done = left.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    while True:
        while True:  # nodes without a way in or out are in no cycle
            n = left.count()
            left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            now = left.count()
            if now == n:
                break
        if not now:
            return done
        colour = cut(left.select(F.col("src").alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            heard = left.join(colour, left["src"] == colour["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("h"))
            new = cut(colour.join(heard, "node", "left").select("node", F.least("c", F.coalesce("h", "c")).alias("c"), (F.coalesce("h", "c") < F.col("c")).alias("moved")))
            moved = new.filter("moved").count()
            colour = new.select("node", "c")
            if not moved:
                break
        own = colour.withColumnRenamed("node", "src").withColumnRenamed("c", "cs")
        inside = cut(left.join(own, "src").join(colour.withColumnRenamed("node", "dst").withColumnRenamed("c", "cd"), "dst").filter("cs = cd").select("src", "dst"))
        reach = cut(colour.filter("node = c").select("node", "c"))
        size = reach.count()
        while True:
            back = inside.join(reach, inside["dst"] == reach["node"]).select(F.col("src").alias("node"), "c")
            reach = cut(reach.unionByName(back).distinct())
            n = reach.count()
            if n == size:
                break
            size = n
        sizes = reach.groupBy("c").count().filter("count > 1").select("c")
        done = cut(done.unionByName(reach.join(sizes, "c", "left_semi").select("node", F.col("c").alias("component"))))
        gone = reach.select("node")
        left = cut(left.join(gone, left["src"] == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti"))


def cycles(edges: DataFrame) -> DataFrame:
    """One sorted list of members per cycle group, in order of the lists."""
    return strongly_connected(edges).groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members")).select("members")


def top_degree(edges: DataFrame, limit: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(limit)


def top_callers(symbols: DataFrame, references: DataFrame, n: int = 3) -> DataFrame:
    """(id, callers): for every symbol the names of up to ``n`` of its direct callers, tests last, then by file and line."""
    by = symbols.select(F.col("id").alias("from_symbol_id"), "qualified_name", "is_test", F.col("file_path").alias("_f"), "start_line")
    d = references.filter(F.col("kind").isin("call", "inherit") & F.col("to_symbol_id").isNotNull()).select(F.col("to_symbol_id").alias("id"), "from_symbol_id").distinct().join(by, "from_symbol_id")
    d = d.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("is_test", "_f", "start_line", "from_symbol_id"))).filter(F.col("k") <= n)
    return d.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "qualified_name"))).alias("c")).select("id", F.transform("c", lambda x: x["qualified_name"]).alias("callers"))
