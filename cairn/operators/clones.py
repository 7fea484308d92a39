"""Clones and clusters: exact groups, similar pairs, complete linkage, topic clustering.

``similar_pairs`` compares blocks of rows with each other, so every task gets a bounded number of rows. Linkage works component by component; a complete-linkage
group never leaves its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cairn.functions import constants as K, text as T
from cairn.operators import pair_blocks
from cairn.session import cut


def eligible(symbols: DataFrame, min_lines: int = K.MIN_LINES, include_tests: bool = False) -> DataFrame:
    """Functions of enough lines, no tests unless asked for, never vendored."""
    long = F.col("end_line") - F.col("start_line") + 1 >= min_lines
    tests = F.lit(True) if include_tests else ~(F.coalesce("is_test", F.lit(False)) | T.is_test_path(F.col("file_path")))
    return symbols.filter(long & tests & ~T.is_vendored_path(F.col("file_path")))


def group_metrics(groups: DataFrame) -> DataFrame:
    """(key, members array<struct(id, file_path, start_line, end_line)>) -> size, duplicated lines and value."""
    lines = F.transform("members", lambda m: m["end_line"] - m["start_line"] + 1)
    dup = F.aggregate(lines, F.lit(0), lambda a, x: a + x) - F.array_max(lines)
    g = groups.withColumn("size", F.size("members")).withColumn("duplicated_lines", dup)
    return g.withColumn("value", F.round((F.col("size") * F.col("duplicated_lines")).cast("double"), 1))


def exact_groups(symbols: DataFrame, max_size: int = K.MAX_GROUP) -> DataFrame:
    """Functions (id, file_path, start_line, end_line, norm_hash) of equal fingerprints, 2 to ``max_size`` of them.

    A member that overlaps another of its group in the same file is taken out; larger classes are no group. The count comes
    first, so that a class of any size costs its counter only."""
    sizes = symbols.groupBy("norm_hash").agg(F.countDistinct("id").alias("n")).filter((F.col("n") >= 2) & (F.col("n") <= 4 * max_size))
    s = symbols.join(sizes.select("norm_hash"), "norm_hash", "left_semi").dropDuplicates(["id"])
    g = s.groupBy("norm_hash").agg(F.array_sort(F.collect_list(F.struct("file_path", "start_line", "end_line", "id"))).alias("all"))

    def alone(m):
        return ~F.exists("all", lambda o: (o["id"] != m["id"]) & (o["file_path"] == m["file_path"]) & (o["start_line"] <= m["end_line"]) & (m["start_line"] <= o["end_line"]))

    g = g.select("norm_hash", F.filter("all", alone).alias("members")).filter((F.size("members") >= 2) & (F.size("members") <= max_size))
    return group_metrics(g)


def similar_pairs(vectors: DataFrame, floor: float = K.PAIR_FLOOR, block: int = 32_768) -> DataFrame:
    """(a, b, sim) with a < b of (id, vector, file_path, start_line, end_line, span): cosines of ``floor`` or more, rounded.

    Pairs overlapping in one file do not count. Every block of at most about ``block`` rows meets every other: blocks are
    packed and written once, and read, not copied, for each pair of them, so disk grows with the rows only."""
    starts, ends = F.coalesce("start_line", F.lit(-(1 << 31))).cast("int"), F.coalesce("end_line", F.lit((1 << 31) - 1)).cast("int")
    v = vectors.filter(F.col("vector").isNotNull() & F.col("id").isNotNull()).select("id", "vector", F.xxhash64("file_path").alias("files"), starts.alias("starts"), ends.alias("ends"))
    kind = vectors.schema["vector"].dataType.simpleString()
    v = cut(v.mapInArrow(pair_blocks.cells, f"id bigint, vector {kind}, files bigint, starts int, ends int, cell int"))
    blocks, own, room = [], -1, 0
    for r in v.groupBy("cell").count().orderBy("cell").collect():  # 4,096 cells at most
        parts = -(-r["count"] // block)
        if parts > 1 or r["count"] > room:
            own, room = own + 1, max(block - r["count"], 0)
            blocks.append((r.cell, own, parts))
            own += parts - 1
        else:
            room -= r["count"]
            blocks.append((r.cell, own, 1))
    at = F.broadcast(v.sparkSession.createDataFrame(blocks, "cell int, first int, parts int"))
    met = v.join(at, "cell").select(F.col("id").alias("ids"), "vector", "files", "starts", "ends", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("own"))
    spread_over = min(own + 1, max(24, own // 4)) or 1
    packed = cut(met.repartition(spread_over, "own").groupBy("own").applyInArrow(pair_blocks.pack, pair_blocks.PACKED))
    other = packed.toDF(*(f"_{c}" for c in packed.columns)).hint("shuffle_replicate_nl")
    return packed.join(other, F.col("own") <= F.col("_own")).mapInArrow(lambda batches: pair_blocks.similar(batches, floor), "a bigint, b bigint, sim double")


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): least id of everything linked, by spreading the least name with pointer jumps.

    Each task first drops the links that its others make needless, so that rounds shuffle about a link a node."""
    tree = pairs.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).mapInArrow(pair_blocks.forest, "u bigint, v bigint")
    links = cut(tree.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("l")).select("l.u", "l.v").distinct())
    label = cut(links.select(F.col("u").alias("node")).distinct().withColumn("c", F.col("node")))
    while True:
        near = links.join(label, links["v"] == label["node"]).groupBy(F.col("u").alias("node")).agg(F.min("c").alias("m"))
        step = label.join(near, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("n"), "c")
        jump = step.select(F.col("node").alias("n"), F.col("n").alias("n2"))
        new = cut(step.join(jump, "n", "left").select("node", F.least("n", F.coalesce("n2", "n")).alias("c"), (F.least("n", F.coalesce("n2", "n")) < F.col("c")).alias("moved")))
        moved = new.filter("moved").count()
        label = new.select("node", "c")
        if not moved:
            return label.withColumnRenamed("c", "component")


def link_completely(pairs: list[tuple[int, int, float]], threshold: float, max_size: int = K.MAX_GROUP) -> list[list[int]]:
    """Greedy by similarity: two groups merge when every cross pair is known, up to ``max_size``."""
    known = {(min(a, b), max(a, b)) for a, b, s in pairs if s >= threshold}
    group: dict[int, list[int]] = {}
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if s < threshold:
            continue
        ga, gb = group.setdefault(a, [a]), group.setdefault(b, [b])
        if ga is gb or len(ga) + len(gb) > max_size:
            continue
        if all((min(x, y), max(x, y)) in known for x in ga for y in gb):
            ga += gb
            for y in gb:
                group[y] = ga
    out = {id(g): sorted(g) for g in group.values() if len(g) >= 2}
    return sorted(out.values())


def linkage_groups(pairs: DataFrame, threshold: float = K.DEFAULT_SIMILARITY, max_size: int = K.MAX_GROUP) -> DataFrame:
    """(members array<bigint>, avg_similarity) of complete-linkage groups of pairs that are capped beforehand."""
    p = cut(pairs.filter(F.col("sim") >= threshold))
    c = components(p)
    d = p.join(c.withColumnRenamed("node", "a"), "a")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[["a", "b", "sim"]].itertuples(index=False, name=None))
        sims = {(a, b): s for a, b, s in rows}
        groups = link_completely(rows, threshold, max_size)
        avg = [round(float(np.mean([sims[x, y] for i, x in enumerate(g) for y in g[i + 1 :] if (x, y) in sims])), 3) for g in groups]
        return pd.DataFrame({"members": groups, "avg_similarity": avg})

    return d.groupBy("component").applyInPandas(one, "members array<bigint>, avg_similarity double")


def not_in_exact(similar: DataFrame, exact: DataFrame) -> DataFrame:
    """Similar groups (members ids) that are not wholly inside one exact group."""
    s = similar.withColumn("gid", F.xxhash64("members"))
    e = exact.select(F.col("norm_hash"), F.explode("members.id").alias("m"))
    inside = s.select("gid", F.size("members").alias("n"), F.explode("members").alias("m")).join(e, "m").groupBy("gid", "n", "norm_hash").count().filter("count = n")
    return s.join(inside.select("gid").distinct(), "gid", "left_anti").drop("gid")


def function_vectors(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Functions and methods with the vector of the chunk on exactly their lines: what ``similar_pairs`` reads."""
    c = chunks.filter(F.col("embedding").isNotNull()).select("repo_id", "file_path", "start_line", "end_line", F.col("embedding").alias("vector")).dropDuplicates(["repo_id", "file_path", "start_line", "end_line"])
    s = symbols.filter(F.col("kind").isin("function", "method")).select("id", "repo_id", "file_path", "start_line", "end_line")
    return s.join(c, ["repo_id", "file_path", "start_line", "end_line"]).select("id", "vector", F.concat_ws("/", "repo_id", "file_path").alias("file_path"), "start_line", "end_line", (F.col("end_line") - F.col("start_line")).alias("span"))


def duplicate_groups(symbols: DataFrame, pairs: DataFrame, threshold: float = K.DEFAULT_SIMILARITY, kind: str = "all") -> DataFrame:
    """(type, members, size, duplicated_lines, avg_similarity, value): exact groups, and similar ones not wholly inside one of
    them, the most valuable first, then the most similar, then by the first member's file."""
    if kind not in ("all", "exact", "similar"):
        raise ValueError(f"unknown kind {kind}")
    s = eligible(symbols)
    exact = exact_groups(s.filter("norm_hash is not null"))
    near = not_in_exact(linkage_groups(pairs.join(s.select(F.col("id").alias("a")), "a", "left_semi").join(s.select(F.col("id").alias("b")), "b", "left_semi"), threshold), exact)
    m = near.withColumn("gid", F.xxhash64("members")).select("gid", "avg_similarity", F.explode("members").alias("id")).join(s.select("id", "file_path", "start_line", "end_line").dropDuplicates(["id"]), "id")
    near = group_metrics(m.groupBy("gid", "avg_similarity").agg(F.array_sort(F.collect_list(F.struct("file_path", "start_line", "end_line", "id"))).alias("members")))
    cols = ["type", "members", "size", "duplicated_lines", "avg_similarity", "value"]
    parts = {"exact": exact.withColumn("avg_similarity", F.lit(1.0)).withColumn("type", F.lit("exact")).select(cols), "similar": near.withColumn("type", F.lit("similar")).select(cols)}
    d = parts[kind] if kind != "all" else parts["exact"].unionByName(parts["similar"])
    return d.orderBy(F.desc("value"), F.desc("avg_similarity"), F.col("members")[0]["file_path"])


# --- topics -------------------------------------------------------------------------------------------------------------


def average_linkage(x: np.ndarray, threshold: float) -> list[int]:
    """Labels by repeatedly merging the most similar pair of clusters (size-weighted means of similarities)."""
    n = len(x)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    size, members = np.ones(n), [[i] for i in range(n)]
    while n > 1:
        i, j = np.unravel_index(np.argmax(s), s.shape)
        if s[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        row = (size[i] * s[i] + size[j] * s[j]) / (size[i] + size[j])
        s[i], s[:, i] = row, row
        s[i, i] = -np.inf
        s[j], s[:, j] = -np.inf, -np.inf
        size[i] += size[j]
        members[i] += members[j]
        members[j] = []
    labels = [0] * len(x)
    for k, g in enumerate(sorted((g for g in members if g), key=min)):
        for i in g:
            labels[i] = k
    return labels


class Greedy:
    """Clusters of vectors as they come: the nearest running mean of at least ``threshold``, else a new one. Only the sums
    of the clusters are kept."""

    def __init__(self, threshold: float):
        self.threshold, self.n = threshold, 0
        self.sums = self.means = np.zeros((0, 0))

    def add(self, v: np.ndarray) -> int:
        if self.n:
            c = self.means[: self.n] @ v
            k = int(np.argmax(c))
            if c[k] >= self.threshold:
                self.sums[k] += v
                self.means[k] = self.sums[k] / max(np.linalg.norm(self.sums[k]), 1e-12)
                return k
        if self.n == len(self.sums):
            grown = np.zeros((max(16, 2 * self.n), len(v)))
            grown[: self.n] = self.sums[: self.n] if self.n else 0
            means = grown.copy()
            means[: self.n] = self.means[: self.n] if self.n else 0
            self.sums, self.means = grown, means
        self.sums[self.n], self.means[self.n] = v, v / max(np.linalg.norm(v), 1e-12)
        self.n += 1
        return self.n - 1


def greedy_centroids(x: np.ndarray, threshold: float) -> list[int]:
    g = Greedy(threshold)
    return [g.add(v) for v in x]


def cluster_boards(vectors: DataFrame, threshold: float = 0.6, exact_limit: int = 600) -> DataFrame:
    """(board, id, cluster) of (board, id, vector): average linkage for boards of up to ``exact_limit`` items, greedy in order
    of id for larger ones, which are read as a stream, so that a task holds the sums of their clusters only."""
    v = vectors.filter(F.col("vector").isNotNull()).select("board", "id", T.l2_normalise(F.col("vector")).alias("vector"))
    board = vectors.schema["board"].dataType.simpleString()
    v = v.join(v.groupBy("board").agg(F.count("*").alias("_n")), "board")
    schema = f"board {board}, id bigint, cluster int"

    def exact(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        return pa.table({"board": t.column("board"), "id": t.column("id"), "cluster": pa.array(average_linkage(np.stack(t.column("vector").to_numpy()), threshold), pa.int32())})

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, g = None, None
        for b in batches:
            out = []
            for name, x in zip(b.column(0).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)):
                if g is None or name != now:
                    now, g = name, Greedy(threshold)
                out.append(g.add(x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], ["board", "id", "cluster"])

    small = v.filter(F.col("_n") <= exact_limit).select("board", "id", "vector").groupBy("board").applyInArrow(exact, schema)
    large = v.filter(F.col("_n") > exact_limit).select("board", "id", "vector").repartition("board").sortWithinPartitions("board", "id").mapInArrow(stream, schema)
    return small.unionByName(large)


def cluster_vectors(vectors: DataFrame, threshold: float = 0.6, exact_limit: int = 600) -> DataFrame:
    """(id, cluster) of (id, vector): one board."""
    return cluster_boards(vectors.withColumn("board", F.lit(0)), threshold, exact_limit).drop("board")


def keyword_labels(items: DataFrame, words: int = 3) -> DataFrame:
    """(cluster, label) of (cluster, text): the words of most texts, ties by the word; 'Miscellaneous' where none."""
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z0-9_]{2,}"), F.lit(0)))
    d = items.select("cluster", F.explode(w).alias("word")).filter(~F.col("word").isin(K.LABEL_STOPWORDS)).groupBy("cluster", "word").count()
    best = d.withColumn("k", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("count"), "word"))).filter(F.col("k") <= words)
    top = best.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("top"))
    label = F.array_join(F.transform("top", lambda x: x["word"]), " ")
    label = F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 1000))
    return items.select("cluster").distinct().join(top.select("cluster", label.alias("label")), "cluster", "left").select("cluster", F.coalesce("label", F.lit("Miscellaneous")).alias("label"))
