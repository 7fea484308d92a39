"""Many questions against all documents at once: what ``search.bm25_questions`` runs in Arrow batches.

The terms of a block of questions form a trie of words. One pass over the documents packs, for some 32,768 of them at a
time, which holds which term how often; a second one scores the packed rows. Neither the words nor the scores of all
pairs of question and document are ever rows: a task keeps the best rows of each question and passes over documents
whose terms cannot reach them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cairn.functions import constants as K

PACKED = "docs bigint, length bigint, ids binary, lengths binary, terms binary, counts binary, holders binary, tfs binary"
BLOCK, NEAR = 32_768, 1e-8


class Questions:
    """The questions of a block with their terms; terms of the same words share one number."""

    def __init__(self, asked: list[tuple[str, list[str]]]):
        self.texts = [q for q, _ in asked]
        self.words: dict[str, int] = {}
        nodes: dict[tuple[int, int], int] = {}
        ends, self.bounds = [], [0]
        for _, terms in asked:
            for t in terms:
                at = -1
                for w in filter(None, t.split("_")):
                    at = nodes.setdefault((at, self.words.setdefault(w, len(self.words))), len(nodes))
                ends.append(at)
            self.bounds.append(len(ends))
        self.ends = np.array(ends, np.int64)
        self.size = len(nodes)
        keys = np.array([(a + 1) * len(self.words) + w for a, w in nodes], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.is_end = np.zeros(self.size, bool)
        self.is_end[self.ends] = True

    def step(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The node below each node by a word, -1 where there is none."""
        key = (node + 1) * len(self.words) + word
        at = np.minimum(np.searchsorted(self.keys, key), self.size - 1)
        return np.where((word >= 0) & (self.keys[at] == key), self.order[at], -1)

    def matches(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term, document) of every place where a term begins; words: -1 for those of no term."""
        found = []
        at = np.flatnonzero(words >= 0)
        node = self.step(np.full(len(at), -1), words[at])
        while len(at):
            at, node = at[node >= 0], node[node >= 0]
            whole = self.is_end[node]
            found.append((node[whole], doc[at[whole]]))
            inside = at + 1 < len(words)
            at, node = at[inside], node[inside]
            inside = doc[at] == doc[at + 1]
            at, node = at[inside] + 1, node[inside]
            node = self.step(node, words[at])
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))

    def pack(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """PACKED rows of (chunk_id, tokens)."""
        ids, lengths, found, docs = [], [], [], 0

        def row() -> pa.RecordBatch:
            key, tf = np.unique(np.concatenate(found), return_counts=True)
            term, counts = np.unique(key >> 16, return_counts=True)
            dl = np.concatenate(lengths)
            parts = [np.concatenate(ids), dl, term.astype(np.int32), counts.astype(np.int32), (key & 0xFFFF).astype(np.uint16), tf.astype(np.int32)]
            names = [c.split()[0] for c in PACKED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([int(dl.sum())], pa.int64()), *(pa.array([zlib.compress(p.tobytes(), 1)], pa.binary()) for p in parts)], names)

        for whole in batches:
            for lo in range(0, whole.num_rows, 8192):
                b = whole.slice(lo, 8192)
                tokens = b.column(1)
                coded = tokens.flatten().dictionary_encode()
                number = np.array([self.words.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
                words = number[coded.indices.to_numpy(zero_copy_only=False)] if len(number) else np.zeros(0, np.int64)
                dl = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
                term, doc = self.matches(words, np.repeat(np.arange(docs, docs + len(dl)), dl))
                ids.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                lengths.append(dl)
                found.append(term << 16 | doc)
                docs += len(dl)
                if docs >= BLOCK:  # never over 65,535, so that 16 bits number them
                    yield row()
                    ids, lengths, found, docs = [], [], [], 0
        if docs:
            yield row()

    def best(self, batches: Iterator[pa.RecordBatch], df: np.ndarray, n_docs: int, avgdl: float, n: int) -> Iterator[pa.RecordBatch]:
        """(question, chunk_id, score): the n best of the packed rows for each question, smaller id first among equals."""
        log = np.log((n_docs - df + 0.5) / (df + 0.5))
        idf = np.where(log <= 0, 1e-6, log)
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for k in range(b.num_rows):
                self._one(b.slice(k, 1), idf, avgdl, n, top)
        for lo in range(0, len(qs := sorted(top)), 4096):
            part = qs[lo : lo + 4096]
            sizes = [len(top[q][0]) for q in part]
            text = pa.array([self.texts[q] for q in part], pa.string()).take(pa.array(np.repeat(np.arange(len(part)), sizes)))
            yield pa.RecordBatch.from_arrays([text, pa.array(np.concatenate([top[q][0] for q in part])), pa.array(np.concatenate([top[q][1] for q in part]))], ["question", "chunk_id", "score"])

    def _one(self, row: pa.RecordBatch, idf: np.ndarray, avgdl: float, n: int, top: dict) -> None:
        ids, dl, term, counts, holders, tf = (np.frombuffer(zlib.decompress(row.column(c)[0].as_py()), t) for c, t in (("ids", np.int64), ("lengths", np.int32), ("terms", np.int32), ("counts", np.int32), ("holders", np.uint16), ("tfs", np.int32)))
        if not len(term):
            return
        part = np.repeat(idf[term], counts) * (tf * (K.BM25_K1 + 1)) / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * dl[holders] / avgdl))
        starts = np.concatenate(([0], np.cumsum(counts)))
        most = np.maximum.reduceat(part, starts[:-1])
        # n documents reach what the n-th best holder of a single term does
        sure = [float(np.partition(part[starts[k] : starts[k + 1]], -n)[-n]) if counts[k] >= n else 0.0 for k in range(len(term))]
        place = np.full(self.size, -1)
        place[term] = np.arange(len(term))
        where, most, starts, holders = place[self.ends], most.tolist(), starts.tolist(), holders.astype(np.int64)
        acc = np.zeros(len(ids))
        for q in range(len(self.texts)):
            ts = [t for t in where[self.bounds[q] : self.bounds[q + 1]].tolist() if t >= 0]
            if not ts:
                continue
            had = top.get(q)
            least = max([sure[t] for t in ts] + ([float(had[1][-1])] if had and len(had[1]) == n else [])) - NEAR
            ts.sort(key=most.__getitem__)
            # the least terms that cannot reach it together: no document of these alone counts
            rest, skip = 0.0, 0
            while skip < len(ts) and rest + most[ts[skip]] < least:
                rest += most[ts[skip]]
                skip += 1
            if skip == len(ts):
                continue
            for t in ts[skip:]:
                acc[holders[starts[t] : starts[t + 1]]] += part[starts[t] : starts[t + 1]]
            if skip == len(ts) - 1:
                c = holders[starts[ts[-1]] : starts[ts[-1] + 1]]
                c = c[acc[c] >= least - rest]
            else:
                c = np.flatnonzero(acc >= max(least - rest, 1e-300))
            s = acc[c]
            acc[:] = 0
            for t in ts[:skip]:
                own = holders[starts[t] : starts[t + 1]]
                at = np.minimum(np.searchsorted(own, c), len(own) - 1)
                s = s + np.where(own[at] == c, part[starts[t] + at], 0.0)
            if len(c) > n:
                good = s >= np.partition(s, -n)[-n] - NEAR
                c, s = c[good], s[good]
            i, s = ids[c], np.round(s, 9)
            if had:
                i, s = np.concatenate((had[0], i)), np.concatenate((had[1], s))
            if len(i):
                keep = np.lexsort((i, -s))[:n]
                top[q] = i[keep], s[keep]


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of packed rows, to be summed up."""
    for b in batches:
        for k in range(b.num_rows):
            t, c = (np.frombuffer(zlib.decompress(b.column(x)[k].as_py()), np.int32) for x in ("terms", "counts"))
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(c)], ["term", "df"])
