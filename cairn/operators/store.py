"""The store: a registry of repositories and one folder per table, partitioned by repository.

A repository's rows are replaced with dynamic partition overwrite, so indexing one never touches another; dropping one
removes its partitions. ``Embedder`` is what a vector back-end offers; the hashing one needs no model.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn.functions import text as T

REPOS = "id string, name string, root string, created_at double, files bigint, chunks bigint, embedder string"


class Embedder(Protocol):
    name: str

    def embed(self, text: Column) -> Column: ...


class HashingEmbedder:
    """Token counts in 256 buckets, of unit length; a pure expression."""

    name = "hashing-256"

    def embed(self, text: Column) -> Column:
        return T.hash_embedding(text)


_EMBEDDERS: dict[str, type] = {"hashing-256": HashingEmbedder, "auto": HashingEmbedder}


def register_embedder(name: str, make: type) -> None:
    _EMBEDDERS[name] = make


def embedder(name: str = "auto") -> Embedder:
    if name not in _EMBEDDERS:
        raise ValueError(f"unknown embedder {name}")
    return _EMBEDDERS[name]()


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def write(self, table: str, rows: DataFrame) -> None:
        """Replaces the rows of the repositories that occur in ``rows``."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(f"{self.root}/{table}")

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        at = f"{self.root}/{table}"
        if not self._exists(at):
            return self.spark.createDataFrame([], schema or "repo_id string")
        return self.spark.read.parquet(at).withColumn("repo_id", F.col("repo_id").cast("string"))

    def drop(self, repo_id: str, tables: list[str]) -> None:
        """Removes one repository's partition from each table."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{t}/repo_id={repo_id}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def register(repos: DataFrame, name: str, root: str, now: float, embedder_name: str = "hashing-256") -> DataFrame:
    """The registry with one repository more; its id is a hash of name, root and time."""
    row = repos.sparkSession.createDataFrame([(name, root, float(now), 0, 0, embedder_name)], "name string, root string, created_at double, files bigint, chunks bigint, embedder string")
    i = F.substring(F.sha2(F.concat_ws("|", "name", "root", F.col("created_at").cast("string")), 256), 1, 12)
    return repos.unionByName(row.withColumn("id", i))


def update_stats(repos: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts of files and chunks of every repository."""
    f = files.select("repo_id", "path").distinct().groupBy(F.col("repo_id").alias("id")).agg(F.count("*").alias("_f"))
    c = chunks.groupBy(F.col("repo_id").alias("id")).agg(F.countDistinct("id").alias("_c")) if "id" in chunks.columns else chunks.groupBy(F.col("repo_id").alias("id")).agg(F.count("*").alias("_c"))
    d = repos.join(f, "id", "left").join(c, "id", "left")
    return d.select(*(F.coalesce("_f", F.lit(0)).alias("files") if x == "files" else F.coalesce("_c", F.lit(0)).alias("chunks") if x == "chunks" else F.col(x) for x in repos.columns))


def listing(repos: DataFrame) -> DataFrame:
    return repos.orderBy(F.desc("created_at"), "id")
