"""Rows of packed blocks and their similar pairs: what ``clones.similar_pairs`` runs in Arrow batches.

Rows of a block stand in groups around leaders, each with the widest angle of its group. Two rows are no further apart
than their leaders less both widths, so groups whose leaders are too far apart hold no pair and are passed over; all
others are compared row by row. How well rows are grouped decides the time, never the pairs: a row far from all others
leads itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LEADS = 0.95
MEMBERS = ("ids", "files", "starts", "ends")
PACKED = "own int, ids binary, files binary, starts binary, ends binary, vectors binary, wide boolean, sizes binary, widths binary"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, numbers as they are stored."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(n) > 1:
        raise ValueError(f"vectors of different lengths: {n[:5].tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A last column cell: the nearest of 64 fixed directions, and of 64 others. Rows alike mostly share it."""
    rng, d = np.random.default_rng(1), None
    for b in batches:
        x = matrix(b.column("vector")).astype(np.float32)
        if len(x):
            d = rng.normal(size=(2, x.shape[1], 64)).astype(np.float32) if d is None else d
            cell = 64 * (x @ d[0]).argmax(1) + (x @ d[1]).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], [*b.schema.names, "cell"])


def leaders(x: np.ndarray) -> np.ndarray:
    """The leader of each row: itself or a row of a cosine of LEADS or more."""
    head, left = np.full(len(x), -1), np.arange(len(x))
    while len(left):
        first = left[:256]
        s = x[first] @ x[left].T
        chosen, free = [], np.ones(len(first), bool)
        for k in range(len(first)):
            if free[k]:
                chosen.append(k)
                free &= ~(s[k, : len(first)] >= LEADS)
        s = s[chosen]
        best = s.argmax(0)
        near = s[best, np.arange(len(left))] >= LEADS
        lead = first[chosen]
        head[left[near]] = lead[best[near]]
        head[lead] = lead
        left = left[head[left] < 0]
    return head


def pack(t: pa.Table) -> pa.Table:
    """One PACKED row of the rows of a block, group by group, narrow groups first."""
    raw = matrix(t.column("vector"))
    x = unit(raw)
    head = leaders(x.astype(np.float32))
    cosine = np.clip(np.einsum("ij,ij->i", x, x[head]), -1, 1)
    angle = np.where(head == np.arange(len(x)), 0.0, np.arccos(cosine) + 1e-6)
    width = np.zeros(len(x))
    np.maximum.at(width, head, angle)
    order = np.lexsort((head != np.arange(len(x)), head, width[head]))  # a leader stands first in its group
    lead, at, sizes = np.unique(head[order], return_index=True, return_counts=True)
    by = np.argsort(at)
    columns = {c: t.column(c).to_numpy()[order] for c in MEMBERS} | {"vectors": raw[order], "sizes": sizes[by], "widths": width[lead[by]]}
    kinds = {"ids": np.int64, "files": np.int64, "starts": np.int32, "ends": np.int32, "sizes": np.int32, "widths": np.float64, "vectors": np.float64 if raw.dtype == np.float64 else np.float32}
    packed = {c: pa.array([np.ascontiguousarray(v, kinds[c]).tobytes()], pa.binary()) for c, v in columns.items()}
    packed |= {"own": pa.array([t.column("own")[0].as_py()], pa.int32()), "wide": pa.array([raw.dtype == np.float64])}
    return pa.table({c.split()[0]: packed[c.split()[0]] for c in PACKED.split(", ")})


class Block:
    def __init__(self, own: int, row: dict):
        self.own = own
        self.ids, self.files = (np.frombuffer(row[c], np.int64) for c in ("ids", "files"))
        self.starts, self.ends, self.sizes = (np.frombuffer(row[c], np.int32) for c in ("starts", "ends", "sizes"))
        self.widths = np.frombuffer(row["widths"], np.float64)
        self.x = unit(np.frombuffer(row["vectors"], np.float64 if row["wide"] else np.float32).reshape(len(self.ids), -1))
        self.sizes = self.sizes.astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.lead = self.x[self.first].astype(np.float32)


def near_groups(p: Block, q: Block, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups that may hold pairs of cosine ``floor``; those of one block once."""
    far = np.arccos(np.clip(floor, -1, 1))
    for i in range(0, len(p.lead), 512):
        for j in range(i if p is q else 0, len(q.lead), 2048):
            s = p.lead[i : i + 512] @ q.lead[j : j + 2048].T
            width = p.widths[i : i + 512] + q.widths[j : j + 2048].max()
            least = (np.cos(np.minimum(far + width, np.pi)) - 1e-5).astype(np.float32)
            r, c = np.divmod(np.flatnonzero(s >= least[:, None]), s.shape[1])
            good = s[r, c] >= np.cos(np.minimum(far + p.widths[r + i] + q.widths[c + j], np.pi)) - 1e-5
            r, c = r[good] + i, c[good] + j
            if p is q:
                good = r <= c
                r, c = r[good], c[good]
            if len(r):
                yield r, c


def row_pairs(p: Block, q: Block, r: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, cosine) of all rows of groups r and c, some 65,536 at a time."""
    n = p.sizes[r] * q.sizes[c]
    large = n > 1024
    for g, h in zip(r[large], c[large]):
        b = np.arange(q.first[h], q.first[h] + q.sizes[h])
        for at in range(p.first[g], p.first[g] + p.sizes[g], max(1, 1_000_000 // len(b))):
            a = np.arange(at, min(at + max(1, 1_000_000 // len(b)), p.first[g] + p.sizes[g]))
            yield np.repeat(a, len(b)), np.tile(b, len(a)), (p.x[a] @ q.x[b].T).ravel()
    r, c, n = r[~large], c[~large], n[~large]
    total = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 65_536, "right")))
        g, h, k = r[lo:hi], c[lo:hi], n[lo:hi]
        within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        up, over = np.divmod(within, np.repeat(q.sizes[h], k))
        a, b = np.repeat(p.first[g], k) + up, np.repeat(q.first[h], k) + over
        yield a, b, np.einsum("ij,ij->i", p.x[a], q.x[b])
        lo = hi


def similar(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """(a, b, sim) of pairs of packed blocks, columns of the second one with an underscore before their names."""
    kept: dict[str, Block] = {}

    def block(b: pa.RecordBatch, k: int, mark: str) -> Block:
        own = b.column(mark + "own")[k].as_py()
        if mark not in kept or kept[mark].own != own:
            kept[mark] = Block(own, {n: b.column(mark + n)[k].as_py() for n in (c.split()[0] for c in PACKED.split(", ")[1:])})
        return kept[mark]

    out, waiting = [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], ["a", "b", "sim"])

    for batch in batches:
        for k in range(batch.num_rows):
            p = block(batch, k, "")
            q = p if batch.column("_own")[k].as_py() == p.own else block(batch, k, "_")
            for r, c in near_groups(p, q, floor - 6e-5):  # rounding raises a cosine by 5e-5 at most
                for i, j, s in row_pairs(p, q, r, c):
                    s = np.round(s, 4)
                    good = np.flatnonzero(s >= floor)
                    i, j, s = i[good], j[good], s[good]
                    good = ~((p.files[i] == q.files[j]) & (p.starts[i] <= q.ends[j]) & (q.starts[j] <= p.ends[i]))
                    if p is q:  # within a group every pair comes twice
                        good &= i < j
                    i, j, s = p.ids[i[good]], q.ids[j[good]], s[good]
                    out.append((np.minimum(i, j), np.maximum(i, j), s))
                    waiting += len(s)
                    if waiting > 200_000 or len(out) > 2000:
                        yield flush()
                        out, waiting = [], 0
    if out:
        yield flush()


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): links that hold together what the links (a, b) of a task do, one less than it has nodes at most.

    Beyond two million nodes it begins anew, with some links more than needed."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for b in batches:
        if len(up) > 2_000_000:
            up.clear()
        links = []
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                links.append((min(x, y), max(x, y)))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in links], pa.int64()), pa.array([k[1] for k in links], pa.int64())], ["u", "v"])
