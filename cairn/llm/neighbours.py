"""The k most similar vectors of every vector: a block matrix join with int8 product tiles.

1. Usable vectors (of ``dim`` finite numbers, not all zeros) are folded to distinct ones; each keeps its k+1 smallest
   ids. The fold ranks before it shuffles, so a vector that a third of all rows repeat leaves a few rows per task.
2. Cells: centroids come from a bounded sample (``sample_per_cell`` vectors for each of at most ``max_cells`` cells,
   about one cell for ``cell_rows`` vectors, refined by spherical k-means). Every vector goes to its nearest
   cells as a query (two, and up to ``probes`` whose centroid is within ``margin`` of the best by cosine) and to the nearest ``stored`` as data. A cell of more than
   ``block`` rows, or asked by more than ``asking``, is cut into blocks on both sides; every pair of blocks is a group of its
   own, so it stays exact and no group grows with the data. One of more than ``hot_cells`` times the usual size gets centroids of its own, and its rows ask
   four times as many cells.
3. A tile is the product of two blocks of int8 vectors (held as float32, where these integer products are exact), with a
   bound on the quantisation error of every entry. Pairs that can still be among a row's k best are recomputed in double
   precision; the lists of all tiles of a row are merged by heaps.

Every vector is indexed and asked; the result misses a neighbour only where none of the probed cells holds it (recall is
measured against brute force in the tests). Similarities are rounded to ``DIGITS`` places before they are compared;
equal ones go by smaller id.

Defined cases: null vectors, other lengths, null or non-finite numbers and all zeros take no part; repeated rows of an id
count once; an empty table gives no pairs; with fewer than k others all of them are given.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cairn.llm.common import spread
from cairn.session import cut

DIGITS = 9


def usable(df: DataFrame, vector: str = "embedding", dim: int = 64) -> DataFrame:
    v = F.col(vector)
    fine = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.filter(F.col("id").isNotNull() & v.isNotNull()).filter(fine).select("id", v.cast("array<float>").alias("v"))


def distinct_vectors(df: DataFrame, keep: int) -> DataFrame:
    """(v, ids): distinct vectors with their ``keep`` smallest distinct ids, ascending."""
    w = W.partitionBy("v").orderBy("id")
    d = df.withColumn("r", F.dense_rank().over(w)).filter(F.col("r") <= keep)
    return d.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dim)


def _kmeans(x: np.ndarray, k: int, rounds: int = 3, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = _unit(x.astype(np.float64)).astype(np.float32)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        n = np.linalg.norm(s, axis=1)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1e-9)[:, None], c).astype(np.float32)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, m: int, margin: float = 9.0, least: int = 1) -> list[np.ndarray]:
    """Up to m nearest centroids of each row, nearest first; beyond the first ``least`` only within ``margin`` of the best."""
    m = min(m, len(c))
    out: list[np.ndarray] = []
    step = max(1, (32 << 20) // (4 * len(c)))
    for i in range(0, len(x), step):
        s = x[i : i + step] @ c.T
        top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(c) else np.tile(np.arange(len(c)), (len(s), 1))
        score = np.take_along_axis(s, top, 1)
        order = np.argsort(-score, axis=1)
        top, score = np.take_along_axis(top, order, 1).astype(np.int32), np.take_along_axis(score, order, 1)
        n = np.maximum((score >= score[:, :1] - margin).sum(axis=1), min(least, m))
        out += [t[:k] for t, k in zip(top, n.tolist())]
    return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> (int8 values held as float32, step of each row, norm of each row's rounding error)."""
    step = np.maximum(np.abs(x).max(axis=1), 1e-12) / 127
    q = np.rint(x / step[:, None])
    return q.astype(np.float32), step.astype(np.float64), np.linalg.norm(x - q * step[:, None], axis=1)


def tile_candidates(x: np.ndarray, y: np.ndarray, same: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each unit row of ``x`` the rows of ``y`` that may be among its k most similar, with exact similarities.

    ``same[i]`` is the row of ``y`` that is x[i] itself, or -1. |x.y - x'.y'| <= |ex| |y| + |x'| |ey| bounds the error."""
    qx, sx, ex = quantise(x)
    qy, sy, ey = quantise(y)
    est = (qx @ qy.T).astype(np.float64) * sx[:, None] * sy[None, :]
    err = ex[:, None] + (1 + ex)[:, None] * ey[None, :] + 1e-9
    rows = np.flatnonzero(same >= 0)
    est[rows, same[rows]] = -9
    if y.shape[0] > k:
        floor = -np.partition(-(est - err), k - 1, axis=1)[:, k - 1]
        r, c = np.nonzero(est + err >= floor[:, None])
    else:
        r, c = np.nonzero(est > -8)
    keep = est[r, c] > -8
    r, c = r[keep], c[keep]
    sim = np.round(np.einsum("ij,ij->i", x[r], y[c]), DIGITS)
    cuts = np.searchsorted(r, np.arange(len(x) + 1))
    return [(c[a:b], sim[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def _best(lists, k: int) -> list[tuple[float, int]]:
    """The k best (-similarity, id) of sorted lists, each id once."""
    out: list[tuple[float, int]] = []
    for p in heapq.merge(*lists):
        if not out or p[1] not in (q[1] for q in out):
            out.append(p)
            if len(out) == k:
                break
    return out


def nearest(df: DataFrame, k: int = 5, dim: int = 64, cell_rows: int = 1000, probes: int = 6, margin: float = 0.06, stored: int = 1, sample_per_cell: int = 24, max_cells: int = 16384, block: int = 16384, tile: int = 4096, hot_cells: int = 64, asking: int = 65536) -> DataFrame:
    """(id, neighbour_id, similarity, rank) of every usable vector of ``df`` (id, embedding)."""
    spark = df.sparkSession
    rows = usable(df, dim=dim)
    reps = cut(distinct_vectors(rows, k + 1))
    n = reps.count()
    schema = "id bigint, neighbour_id bigint, similarity double, rank int"
    if n == 0:
        return spark.createDataFrame([], schema)

    def sample(d: DataFrame, total: int, want: int) -> np.ndarray:
        share = min(1.0, 1.3 * want / max(total, 1))
        got = (d if share >= 1 else d.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("v").toArrow()
        return _vectors(got.column(0), dim)

    cells = max(1, min(max_cells, n // cell_rows))
    first = sample(reps, n, cells * sample_per_cell) if cells > 1 else None
    if first is None or len(first) == 0:
        first = sample(reps, n, 64)
    centroids = _kmeans(first, cells)

    def assigned(c, m: int, margin: float = 9.0):
        shared = spark.sparkContext.broadcast(c)

        def run(batches):
            for b in batches:
                x = _unit(_vectors(b.column(0), dim).astype(np.float64)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_nearest(x, shared.value, m, margin, 2), pa.list_(pa.int32()))], ["v", "ids", "cells"])

        return spread(reps).mapInArrow(run, "v array<float>, ids array<bigint>, cells array<int>")

    refined: list[int] = []

    def asked(c) -> DataFrame:
        """Rows with the cells they ask, nearest first; in a refined place, where cells lie close together, more of them."""
        a = assigned(c, max(probes * (4 if refined else 1), stored), 9.0 if refined else margin)
        asks = F.when(F.col("cells")[0].isin(refined), 4 * probes).otherwise(probes) if refined else F.lit(probes)
        return a.select("v", "ids", F.posexplode("cells").alias("pos", "cell"), asks.alias("asks")).filter((F.col("pos") < F.col("asks")) | (F.col("pos") < stored))

    def large(c) -> dict[int, tuple[int, int]]:
        """Rows stored and rows asking of the cells that need cutting: at most one row a cell."""
        a = asked(c).groupBy("cell").agg(F.count_if(F.col("pos") < stored).alias("d"), F.count_if(F.col("pos") < F.col("asks")).alias("q"))
        return {r.cell: (r.d, r.q) for r in a.filter((F.col("d") > block) | (F.col("q") > asking)).collect()}

    for _ in range(3):
        sizes = large(centroids)
        hot = {c: d for c, (d, _) in sizes.items() if d > hot_cells * cell_rows}
        room = max_cells - len(centroids)
        if not hot or room < 2:
            break
        share = min(1.0, room / max(1, sum(8 * s // (hot_cells * cell_rows) for s in hot.values())))
        more = []
        for c, s in hot.items():
            want = max(2, int(share * 8 * s / (hot_cells * cell_rows)))
            x = sample(assigned(centroids, 1).filter(F.col("cells")[0] == c), s, want * sample_per_cell)
            if len(x):
                more.append(_kmeans(x, want))
        if not more:
            break
        refined += [*hot, *range(len(centroids), len(centroids) + sum(map(len, more)))]
        centroids = np.concatenate([centroids, *more])
    else:
        sizes = large(centroids)

    def cuts(n: int, size: int):
        """Number of blocks of a row's cell."""
        many = {c: -(-s[n] // size) for c, s in sizes.items() if s[n] > size}
        return F.coalesce(F.create_map(*(F.lit(int(x)) for c in many.items() for x in c))[F.col("cell")], F.lit(1)) if many else F.lit(1)

    a = asked(centroids).withColumn("nd", cuts(0, block)).withColumn("nq", cuts(1, asking))
    h = F.xxhash64(F.col("ids")[0])
    a = a.withColumn("d", F.pmod(h, F.col("nd")).cast("int")).withColumn("q", F.pmod(F.shiftrightunsigned(h, 17), F.col("nq")).cast("int"))
    stored_here, asking_here = F.col("pos") < stored, F.col("pos") < F.col("asks")
    # a stored row meets every block of those asking, an asking row every block of those stored
    none = F.array().cast("array<int>")
    as_data = F.when(stored_here, F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: F.col("d") * F.col("nq") + q)).otherwise(none)
    as_query = F.when(asking_here, F.transform(F.sequence(F.lit(0), F.col("nd") - 1), lambda d: d * F.col("nq") + F.col("q"))).otherwise(none)
    a = a.withColumn("part", F.explode(F.array_union(as_data, as_query)))
    a = a.select("cell", "part", "v", "ids", (stored_here & (F.floor(F.col("part") / F.col("nq")) == F.col("d"))).alias("is_data"), (asking_here & (F.col("part") % F.col("nq") == F.col("q"))).alias("is_query"))

    def tiles(t: pa.Table) -> pa.Table:
        x = _unit(_vectors(t.column("v"), dim).astype(np.float64))
        ids = t.column("ids").to_pylist()
        data = np.flatnonzero(np.asarray(t.column("is_data")))
        query = np.flatnonzero(np.asarray(t.column("is_query")))
        out_id, out_n, out_s = [], [], []
        at = np.full(len(x), -1)
        at[data] = np.arange(len(data))
        for i in range(0, len(query), 1024):
            q = query[i : i + 1024]
            lists: list[list] = [[] for _ in q]
            for j in range(0, len(data), tile):
                d = data[j : j + tile]
                same = np.where((at[q] >= j) & (at[q] < j + len(d)), at[q] - j, -1)
                for z, (c, s) in enumerate(tile_candidates(x[q], x[d], same, k)):
                    lists[z].append(sorted((-sv, other) for cv, sv in zip(c.tolist(), s.tolist()) for other in ids[d[cv]]))
            for z, ls in zip(q.tolist(), lists):
                best = _best(ls, k)
                if best:
                    out_id.append(ids[z][0])
                    out_n.append([b[1] for b in best])
                    out_s.append([-b[0] for b in best])
        return pa.table([pa.array(out_id, pa.int64()), pa.array(out_n, pa.list_(pa.int64())), pa.array(out_s, pa.list_(pa.float64()))], names=["rep", "n", "s"])

    found = a.groupBy("cell", "part").applyInArrow(tiles, "rep bigint, n array<bigint>, s array<double>")
    lists = found.groupBy("rep").agg(F.collect_list(F.struct("n", "s")).alias("lists"))
    ids = reps.select(F.col("ids")[0].alias("rep"), "ids")
    together = ids.join(lists, "rep", "left").select("ids", "lists")

    def merged(batches):
        for b in batches:
            i, o, s, r = [], [], [], []
            for own_ids, ls in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                best = _best([[(-sv, nv) for nv, sv in zip(x["n"], x["s"])] for x in ls or ()], k)
                for me in own_ids:
                    mine = _best([sorted((-1.0, x) for x in own_ids if x != me), best], k)
                    for rank, (sv, nv) in enumerate(mine, 1):
                        i.append(me), o.append(nv), s.append(-sv), r.append(rank)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(o, pa.int64()), pa.array(s, pa.float64()), pa.array(r, pa.int32())], ["id", "neighbour_id", "similarity", "rank"])

    near = together.mapInArrow(merged, schema)
    # ids beyond the k+1 smallest of a repeated vector: their neighbours are the k smallest
    # (joined by two hashes of the vector: only ids and keys are shuffled, and AQE splits a key that many rows share)
    keys = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")]
    full = reps.filter(F.size("ids") > k).select(*keys, "ids")
    rest = rows.select("id", *keys).join(full, ["k1", "k2"]).filter(~F.array_contains("ids", F.col("id"))).select("id", F.slice("ids", 1, k).alias("ids")).distinct()
    rest = rest.select("id", F.posexplode("ids").alias("rank", "neighbour_id")).select("id", "neighbour_id", F.lit(1.0).alias("similarity"), (F.col("rank") + 1).alias("rank"))
    return near.unionByName(rest)


def neighbour_pairs(df: DataFrame, k: int = 5, **options) -> DataFrame:
    """Distinct pairs (id_a < id_b) one of which is among the k nearest of the other."""
    n = nearest(df, k, **options)
    return n.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).distinct()
