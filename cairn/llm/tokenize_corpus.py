"""Encoding of whole texts with a public byte-level BPE vocabulary, and decoding.

Texts are cut into pre-tokens by the vocabulary's pattern. Within one, the symbols form a doubly linked list over its
bytes; a priority queue holds the merge rank of every adjacent pair, lowest rank and leftmost first. A popped entry whose
symbols have changed since is stale and skipped. Equal pre-tokens are encoded once per worker; the memo is emptied when
it holds ``memo`` entries, so its memory is bounded while the result is the same.

The vocabulary (fixed size, some 50,000 entries) is read from ``vocabulary`` on the driver and broadcast.

Defined cases: a null and an empty text both have the empty list of ids; strings that look like special tokens are plain
text; a text of any length is encoded whole, in n log n for its longest pre-token.
"""

from __future__ import annotations

import base64
import heapq
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import spread

#: Fixed value: the pattern that cuts text into pre-tokens for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = os.environ.get("CAIRN_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
MEMO = 1 << 18


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    sym: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = right[i]
        if sym[i] is None or j < 0 or len(sym[i]) + len(sym[j]) != size:
            continue  # stale: one of the two has merged with something else
        sym[i] += sym[j]
        sym[j] = None
        k = right[i] = right[j]
        if k >= 0:
            left[k] = i
            if (r := ranks.get(sym[i] + sym[k])) is not None:
                heapq.heappush(heap, (r, i, len(sym[i]) + len(sym[k])))
        h = left[i]
        if h >= 0 and (r := ranks.get(sym[h] + sym[i])) is not None:
            heapq.heappush(heap, (r, h, len(sym[h]) + len(sym[i])))
    return [ranks[s] for s in sym if s is not None]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, memo: int = MEMO):
        self.ranks, self.find, self.limit = ranks, regex.compile(pattern).findall, memo
        self.memo: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for piece in self.find(text):
            ids = memo.get(piece)
            if ids is None:
                if len(memo) >= self.limit:
                    memo.clear()
                ids = merge(piece.encode("utf-8"), self.ranks)
                if len(piece) <= 64:
                    memo[piece] = ids
            out += ids
        return out


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.strings = {i: b for b, i in ranks.items()}

    def decode(self, ids: list[int] | None) -> str:
        """The text whose encoding ``ids`` is; bytes that are no UTF-8 become replacement characters."""
        return b"".join(self.strings[i] for i in ids or ()).decode("utf-8", "replace")


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids array<int>), one row per input row."""
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(load_ranks(vocabulary))
    d = spread(df.select(id_column, text))
    kind = pa.from_numpy_dtype("int64")

    def run(batches):
        enc = Encoder(shared.value)
        for b in batches:
            lists = [enc.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(kind), pa.array(lists, pa.list_(pa.int32()))], [id_column, "ids"])

    return d.mapInArrow(run, f"{id_column} bigint, ids array<int>")


def decode_corpus(df: DataFrame, id_column: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text) of encoded rows; null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches):
        dec = Decoder(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([dec.decode(x) for x in b.column(1).to_pylist()], pa.string())], [id_column, "text"])

    return df.select(id_column, ids).mapInArrow(run, f"{id_column} bigint, text string")
