"""Parent-child rows to full hierarchies by pointer doubling.

``resolve_hierarchy`` takes one row per node (``id``, ``parent``, ``segments``) and returns the node's root, depth,
path segments and ancestors. Each round joins every unresolved pointer with the pointer of the node it stands on, so
the distance doubles; nodes on a cycle, or below one, never reach a root and come out with root and depth -1.

Two passes keep the work bounded: the first moves only (pointer, distance), so that cyclic nodes never gather paths;
the second concatenates segments of the acyclic nodes alone. A pass ends early when a round resolves nothing: a chain
longer than the distance covered would have had a shorter part resolved in that round.

Defined cases: an empty input gives an empty result; a null ``parent`` or one that names no node makes a root of depth
0; null segments count as none; repeated rows of one id are one node (the first by parent); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.session import cut

CYCLE = -1


def _rounds(df: DataFrame, step) -> DataFrame:
    """Apply ``step`` to the unresolved rows until a round resolves none. ``df`` has (id, ptr, ...); ptr null = resolved."""
    df = cut(df)
    left = df.filter("ptr is not null").count()
    while left:
        df = cut(step(df))
        now = df.filter("ptr is not null").count()
        if now == left:
            break
        left = now
    return df


def resolve_hierarchy(nodes: DataFrame) -> DataFrame:
    """(id, parent, segments array<string>) -> (id, root_id, depth, segments, ancestors), root first in both arrays."""
    nodes = nodes.groupBy("id").agg(F.min_by("parent", F.coalesce(F.col("parent"), F.lit(-(2**63)))).alias("parent"), F.min_by("segments", F.coalesce(F.col("parent"), F.lit(-(2**63)))).alias("segments"))
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    nodes = cut(nodes.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"), F.coalesce("segments", F.array().cast("array<string>")).alias("segments")))

    def jump(df: DataFrame) -> DataFrame:
        # a resolved row keeps its root; an unresolved one stands `dist` above itself on `ptr`
        on = df.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("root").alias("root2"))
        moved = df.filter("ptr is not null").join(on, "ptr").select("id", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("root2").alias("root"))
        return df.filter("ptr is null").unionByName(moved)

    start = nodes.select("id", F.col("parent").alias("ptr"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("dist"), F.when(F.col("parent").isNull(), F.col("id")).alias("root"))
    found = _rounds(start, jump)
    cyclic = found.filter("ptr is not null").select("id")

    def concat(df: DataFrame) -> DataFrame:
        on = df.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("segments").alias("s2"), F.col("ancestors").alias("a2"))
        moved = df.filter("ptr is not null").join(on, "ptr").select("id", F.col("ptr2").alias("ptr"), F.concat("s2", "segments").alias("segments"), F.concat("a2", "ancestors").alias("ancestors"))
        return df.filter("ptr is null").unionByName(moved)

    acyclic = nodes.join(cyclic, "id", "left_anti")
    paths = _rounds(acyclic.select("id", F.col("parent").alias("ptr"), "segments", F.when(F.col("parent").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("parent")).alias("ancestors")), concat)
    good = paths.select("id", F.coalesce(F.element_at(F.when(F.size("ancestors") > 0, F.col("ancestors")), 1), F.col("id")).alias("root_id"), F.size("ancestors").alias("depth"), "segments", "ancestors")
    bad = cyclic.select("id", F.lit(CYCLE).cast("bigint").alias("root_id"), F.lit(CYCLE).alias("depth"), F.array().cast("array<string>").alias("segments"), F.array().cast("array<bigint>").alias("ancestors"))
    return good.unionByName(bad)


def descendants(resolved: DataFrame) -> DataFrame:
    """Every (ancestor_id, descendant_id, distance) of a resolved hierarchy; cyclic nodes have none."""
    r = resolved.select(F.col("id").alias("descendant_id"), "depth", F.posexplode("ancestors").alias("pos", "ancestor_id"))
    return r.select("ancestor_id", "descendant_id", (F.col("depth") - F.col("pos")).alias("distance"))


# --- routers and includes as such a hierarchy -------------------------------------------------------------------


def _trim(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "^/+|/+$", "")


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def _normal_path(parts: Column) -> Column:
    """Resolve '.' and '..' in an array of path parts; null when '..' climbs over the repository root."""
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        return (
            F.when((x == ".") | (x == ""), acc)
            .when((x == "..") & (F.size(acc["p"]) == 0), F.struct(acc["p"].alias("p"), F.lit(False).alias("ok")))
            .when(x == "..", F.struct(F.slice(acc["p"], 1, F.greatest(F.size(acc["p"]) - 1, F.lit(0))).alias("p"), acc["ok"].alias("ok")))
            .otherwise(F.struct(F.concat(acc["p"], F.array(x)).alias("p"), acc["ok"].alias("ok")))
        )

    return F.aggregate(parts, start, step, lambda a: F.when(a["ok"], F.array_join(a["p"], "/")))


def router_nodes(routers: DataFrame, includes: DataFrame) -> DataFrame:
    """Routers and includes -> (id, parent, segments) by the parent rules: same-file variable first, else first include.

    Rows with a null id, repo, file or variable name no router and are left out; exact duplicates are one router."""
    r = routers.select("id", "repo_id", "file_path", "var", "prefix", "parent_var").dropna(subset=["id", "repo_id", "file_path", "var"])
    r = r.groupBy("repo_id", "file_path", "var").agg(F.min("id").alias("id"), F.min_by("prefix", "id").alias("prefix"), F.min_by("parent_var", "id").alias("parent_var"))
    key = r.select("repo_id", "file_path", "var", F.col("id").alias("key_id"))
    own = key.select("repo_id", "file_path", F.col("var").alias("parent_var"), F.col("key_id").alias("own_parent"))

    i = includes.select("id", "repo_id", "file_path", "parent_var", "target", "prefix", "line").dropna(subset=["repo_id", "file_path", "parent_var", "target"]).distinct()
    i = i.join(own.withColumnRenamed("own_parent", "inc_parent"), ["repo_id", "file_path", "parent_var"])
    i = i.select("repo_id", "file_path", "line", F.col("id").alias("inc_id"), "inc_parent", F.col("prefix").alias("inc_prefix"), "target")

    # three kinds of target, each an equi-join on a generated key
    local = i.join(key.withColumnRenamed("var", "target"), ["repo_id", "file_path", "target"])
    dotted = key.select("repo_id", F.concat_ws(".", F.regexp_replace(_stem(F.col("file_path")), "/", "."), "var").alias("target"), "key_id")
    by_dots = i.filter(F.col("target").contains(".") & ~F.col("target").startswith("require:")).join(dotted, ["repo_id", "target"])
    alone = key.groupBy("repo_id", "file_path").agg(F.count("*").alias("n"), F.min("key_id").alias("key_id")).filter("n = 1").select("repo_id", _stem(F.col("file_path")).alias("stem"), "key_id")
    folder = F.split(F.regexp_replace("file_path", r"/?[^/]*$", ""), "/")
    required = i.filter(F.col("target").startswith("require:")).withColumn("stem", _normal_path(F.concat(folder, F.split(F.expr("substring(target, 9)"), "/"))))
    by_file = required.join(alone, ["repo_id", "stem"])

    cols = ["key_id", "file_path", "line", "inc_id", "inc_parent", "inc_prefix"]
    mounts = local.select(cols).unionByName(by_dots.select(cols)).unionByName(by_file.select(cols))
    first = mounts.groupBy("key_id").agg(F.min_by(F.struct("inc_parent", "inc_prefix"), F.struct("file_path", "line", "inc_id")).alias("m"))

    r = r.join(own, ["repo_id", "file_path", "parent_var"], "left").join(first, r["id"] == first["key_id"], "left")
    by_include = F.col("own_parent").isNull() & F.col("m").isNotNull()
    parts = F.array(F.when(by_include, _trim(F.col("m.inc_prefix"))).otherwise(F.lit("")), _trim(F.col("prefix")))
    return r.select("id", F.coalesce("own_parent", F.col("m.inc_parent")).alias("parent"), F.filter(parts, lambda x: x != "").alias("segments"))


def router_paths(routers: DataFrame, includes: DataFrame) -> DataFrame:
    """(id, root_id, depth, full_path) of every router; -1, -1 and an empty path on or below a cycle."""
    r = resolve_hierarchy(router_nodes(routers, includes))
    full = F.when(F.col("depth") == CYCLE, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join("segments", "/")))
    return r.select("id", "root_id", F.col("depth").cast("int").alias("depth"), full.alias("full_path"))
