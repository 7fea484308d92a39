"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "cairn", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; extra settings by keyword (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only where a single machine runs without that setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="cairn-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder once and drop the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before an expensive stage, where the scan has fewer splits than the cluster has cores."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * n) if df.rdd.getNumPartitions() < n else df
