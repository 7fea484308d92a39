"""Helpers of the text operators: Arrow stages and working partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.session import spread  # noqa: F401


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """``mapInArrow`` with one function per batch; tables are split into their batches, None gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = work(b)
            if out is None:
                continue
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            else:
                yield out

    return df.mapInArrow(run, schema)


def thinned(df: DataFrame, key: str, rows: int, factor: int = 8) -> DataFrame:
    """A share of the rows by hash of the key, some ``factor * rows`` of them: what a bounded sample is then drawn from.

    The share comes from a count of keys, so sorting the sample never sees more than that many rows at any size."""
    n = df.select(key).count()
    share = min(1.0, factor * rows / max(n, 1))
    return df if share >= 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
