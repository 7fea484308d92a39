"""Streaming front-end of the index: micro-batches of file states merged into a snapshot.

``run_available`` takes up what has arrived since the last run and ends. Every micro-batch writes the newest state of each
of its files to a folder of its own number and only then commits, by a version file that is created once: a batch that is
repeated after a failure writes the same rows to the same folder, and no moment leaves the index without a snapshot.
Batches are folded into one table every ``FOLD`` of them; reading takes the newest state over that table and the batches since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.operators.incremental import Versions

FOLD = 16


def latest(files: DataFrame) -> DataFrame:
    """One row per file: the largest indexed_at, ties by the larger hash."""
    key = F.struct(F.coalesce("indexed_at", F.lit(float("-inf"))).alias("t"), F.coalesce("hash", F.lit("")).alias("h"))
    cols = [c for c in files.columns if c not in ("repo_id", "path")]
    return files.groupBy("repo_id", "path").agg(F.max_by(F.struct(*cols), key).alias("s")).select("repo_id", "path", "s.*")


def merge_batch(root: str):
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        versions = Versions(spark, f"{root}/versions")
        before = versions.latest() or {"batch": -1, "parts": []}
        if before["batch"] >= number:
            return  # committed already
        at = f"{root}/batches/{number:012d}"
        latest(batch).write.mode("overwrite").parquet(at)
        parts = [*before["parts"], at]
        if len(parts) > FOLD:
            at = f"{root}/folded/{number:012d}"
            latest(spark.read.parquet(*parts)).write.mode("overwrite").parquet(at)
            parts = [at]
        versions.create(max([number, *(n + 1 for n in versions.numbers()[-1:])]), {"batch": number, "parts": parts})

    return run


def snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    now = Versions(spark, f"{root}/versions").latest()
    return latest(spark.read.schema(schema).parquet(*now["parts"]) if now else spark.createDataFrame([], schema))


def run_available(spark: SparkSession, source: str, schema: str, root: str, files_per_batch: int = 1000) -> DataFrame:
    """Reads the parquet files in ``source`` that are new, merges them, and returns the snapshot."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    q = stream.writeStream.foreachBatch(merge_batch(root)).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return snapshot(spark, root, schema)
