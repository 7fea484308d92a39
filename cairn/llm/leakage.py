"""Evaluation texts leaking into training text: pigeonhole edit matching on words.

Words are maximal runs of letters and digits in lower case. Every window of ``window`` consecutive words of a test item
is looked for in the documents with at most ``max_edits`` words inserted, deleted or replaced. A window is split into
max_edits + 1 pieces: with that many edits one piece is untouched, so an exact hit of a piece comes first, found for a
whole batch of documents at once on numbered words. Around each hit Myers' bit-parallel recurrence gives the smallest
distance of the window to a stretch of the document; a distance of 0 is a run of ``window`` words as it stands.

Items are taken in blocks of at most ``block_words`` words, each broadcast (its size is bounded by that number); every
block scans all documents, so any number of items works. The test set does not grow with the corpus.

Defined cases: null, empty and blank texts match nothing; items of fewer words than ``window`` match nothing; repeated
items and repeated rows give one row per (document, item); texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm.common import spread

WORDS = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return [w.lower() for w in WORDS.findall(text)] if text else []


def myers(pattern: list[int], text: list[int], limit: int) -> int:
    """Smallest word distance of ``pattern`` to any stretch of ``text``; more than ``limit`` comes back as limit + 1."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a stretch may begin anywhere: no cost for words before it
        pv = (mh << 1 & full) | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best = score
    return best if best <= limit else limit + 1


class PieceIndex:
    """Pieces of all windows of a block of items, as sorted numbers of ``size`` words each."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int, max_edits: int):
        self.window, self.edits = window, max_edits
        self.size = window // (max_edits + 1)
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        at: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for item, ws in items:
            if len(ws) < window:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]
            for p in range(len(ids) - self.size + 1):
                at[tuple(ids[p : p + self.size])].append((len(self.items), p))
            self.items.append((item, ids))
        self.at = dict(at)
        self.keys = np.unique(self._numbers(np.array(sorted(at), dtype=np.uint64))) if at else np.zeros(0, np.uint64)

    @staticmethod
    def _numbers(grams: np.ndarray) -> np.ndarray:
        """A number for each row of words; equal rows have equal numbers, a collision only costs a look at ``at``."""
        h = np.zeros(len(grams), np.uint64)
        for k in range(grams.shape[1]):
            h = (h ^ grams[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def search(self, docs: list[list[str]]) -> list[tuple[int, int, int]]:
        """(index of the document, item, smallest distance) of every document that holds a window."""
        get = self.vocabulary.get
        lengths = [len(d) for d in docs]
        ids = np.fromiter((get(w, 0) for d in docs for w in d), np.uint64, sum(lengths))
        n, out = len(ids) - self.size + 1, []
        if n <= 0 or not len(self.keys):
            return out
        known = ids[:n] > 0
        for k in range(1, self.size):
            known &= ids[k : n + k] > 0
        starts = np.flatnonzero(known)
        grams = np.stack([ids[starts + k] for k in range(self.size)], axis=1) if len(starts) else np.zeros((0, self.size), np.uint64)
        h = self._numbers(grams)
        pos = np.searchsorted(self.keys, h)
        pos[pos == len(self.keys)] = 0
        hit = self.keys[pos] == h
        bounds = np.cumsum([0, *lengths])
        found: dict[tuple[int, int], int] = {}
        tried: set[tuple[int, int, int, int]] = set()
        for j, gram in zip(starts[hit].tolist(), grams[hit].tolist()):
            d = int(np.searchsorted(bounds, j, side="right")) - 1
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            if j + self.size > hi:
                continue
            for k, p in self.at.get(tuple(gram), ()):
                if found.get((d, k), 1) == 0:
                    continue
                item = self.items[k][1]
                for piece in range(self.edits + 1):
                    w = p - piece * self.size
                    if w < 0 or w + self.window > len(item):
                        continue
                    begin = j - piece * self.size
                    if (d, k, w, begin) in tried:
                        continue
                    tried.add((d, k, w, begin))
                    a, b = max(lo, begin - self.edits), min(hi, begin + self.window + self.edits)
                    dist = myers(item[w : w + self.window], ids[a:b].tolist(), self.edits)
                    if dist <= self.edits and dist < found.get((d, k), self.edits + 1):
                        found[d, k] = dist
                    if dist == 0:
                        break
        best: dict[tuple[int, int], int] = {}
        for (d, k), e in found.items():
            key = (d, self.items[k][0])
            best[key] = min(e, best.get(key, e))
        return [(d, i, e) for (d, i), e in best.items()]


def _blocks(items: DataFrame, block_words: int) -> list[list[tuple[int, list[str]]]]:
    """Items in blocks of at most ``block_words`` words (one item more when it is longer than that itself)."""
    blocks, block, size = [], [], 0
    for r in items.select("item_id", "text").dropna().distinct().toLocalIterator():
        ws = words(r[1])
        if block and size + len(ws) > block_words:
            blocks.append(block)
            block, size = [], 0
        block.append((r[0], ws))
        size += len(ws)
    return [*blocks, block] if block else blocks


def find_leaks(documents: DataFrame, items: DataFrame, window: int = 12, max_edits: int = 2, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, edits): documents with a window of the item within ``max_edits`` word edits, smallest first."""
    if not 0 <= max_edits < window:
        raise ValueError("max_edits must lie in 0..window-1")
    spark, docs, schema = documents.sparkSession, spread(documents.select("doc_id", "text")), "doc_id bigint, item_id bigint, edits int"
    out = spark.createDataFrame([], schema)
    for block in _blocks(items, block_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = PieceIndex(shared.value, window, max_edits)
            for b in batches:
                ids = b.column(0).to_pylist()
                hits = index.search([words(t) for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _, _ in hits], pa.int64()), pa.array([i for _, i, _ in hits], pa.int64()), pa.array([e for _, _, e in hits], pa.int32())], ["doc_id", "item_id", "edits"])

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
