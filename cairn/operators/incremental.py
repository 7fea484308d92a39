"""Processing only new or changed records: interval sets of processed sequence numbers.

A log is split into ``streams``; within a stream every record has a sequence number. The ledger keeps what was processed
as disjoint closed intervals per stream, never as single numbers. A run subtracts them from the ranges that are
available, takes up exactly the gaps that remain (late records lie in gaps below the highest number and are found the
same way), and commits the merged intervals together with the output: one small manifest file, which can only be created
once, makes both visible, so a run that dies before it leaves nothing behind and the next run takes the same gaps again.

``FileIndex`` keeps the files of an indexer that way. A file's state gets its number once, when it is first seen to be the
newest one, and the number is stored; source files that were read before are not read again. No clock takes part: a state
that arrives late, or a run that failed or was never noted down, changes nothing but the gaps.

Defined cases: an empty ledger leaves everything to do, an empty input leaves nothing; rows with a null stream, bound or
an inverted range count as no range; overlapping, touching and repeated ranges merge; extra columns are ignored.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cairn.session import ensure_checkpoint_dir

RANGE = "stream string, lo bigint, hi bigint"


def _valid(df: DataFrame) -> DataFrame:
    return df.select(F.col("stream").cast("string"), F.col("lo").cast("bigint"), F.col("hi").cast("bigint")).filter("stream is not null and lo <= hi")


def merge_intervals(df: DataFrame) -> DataFrame:
    """Disjoint, maximal intervals covering the same numbers (touching ones are joined)."""
    w = W.partitionBy("stream").orderBy("lo", "hi")
    seen = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    d = _valid(df).withColumn("new", F.when(seen.isNull() | (F.col("lo") > seen + 1), 1).otherwise(0))
    d = d.withColumn("grp", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy("stream", "grp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("stream", "lo", "hi")


def to_intervals(df: DataFrame, stream: str, seq: str) -> DataFrame:
    """Single sequence numbers -> disjoint intervals (islands: the number minus its rank is constant within one)."""
    d = df.select(F.col(stream).cast("string").alias("stream"), F.col(seq).cast("bigint").alias("seq")).dropna().distinct()
    d = d.withColumn("isle", F.col("seq") - F.row_number().over(W.partitionBy("stream").orderBy("seq")))
    return d.groupBy("stream", "isle").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).select("stream", "lo", "hi")


def subtract_intervals(available: DataFrame, processed: DataFrame) -> DataFrame:
    """Numbers of ``available`` that no interval of ``processed`` covers, as disjoint intervals.

    A sweep over the ends of both (merged) sides: +1/-1 for either, the gaps are where only ``available`` is open."""
    a, p = merge_intervals(available), merge_intervals(processed)

    def ends(d: DataFrame, side: str) -> DataFrame:
        one, none = F.lit(1), F.lit(0)
        da, dp = (one, none) if side == "a" else (none, one)
        return d.select("stream", F.col("lo").alias("at"), da.alias("da"), dp.alias("dp")).unionByName(d.select("stream", (F.col("hi") + 1).alias("at"), (-da).alias("da"), (-dp).alias("dp")))

    e = ends(a, "a").unionByName(ends(p, "p")).groupBy("stream", "at").agg(F.sum("da").alias("da"), F.sum("dp").alias("dp"))
    w = W.partitionBy("stream").orderBy("at")
    e = e.select("stream", "at", F.sum("da").over(w).alias("a"), F.sum("dp").over(w).alias("p"), F.lead("at").over(w).alias("next"))
    return merge_intervals(e.filter("a > 0 and p = 0 and next is not null").select("stream", F.col("at").alias("lo"), (F.col("next") - 1).alias("hi")))


def expand(gaps: DataFrame, records: DataFrame, stream: str, seq: str, width: int = 4096) -> DataFrame:
    """The records whose number lies in a gap: gaps are cut at multiples of ``width``, so the join has an equality key."""
    g = gaps.select("stream", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("cell"))
    g = g.select(F.col("stream").alias("g_stream"), F.col("cell").alias("g_cell"), F.greatest("lo", F.col("cell") * width).alias("g_lo"), F.least("hi", (F.col("cell") + 1) * width - 1).alias("g_hi"))
    cell = F.floor(records[seq] / width)
    on = (records[stream].cast("string") == g["g_stream"]) & (cell == g["g_cell"]) & (records[seq] >= g["g_lo"]) & (records[seq] <= g["g_hi"])
    return records.join(g, on, "left_semi")


def number_records(df: DataFrame, key: list[str], buckets: int = 256) -> DataFrame:
    """Give every record a stream (a hash bucket of its key, so no stream is hot) and a dense number within it."""
    d = df.withColumn("stream", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("string"))
    return d.withColumn("seq", F.row_number().over(W.partitionBy("stream").orderBy(*key)).cast("bigint"))


class Versions:
    """Numbered JSON files in a folder, each created once and never changed.

    Creating fails where the file exists (atomically on HDFS); what was written is read back, so that of two writers on an
    object store only the one whose content stands has committed. A file that is not complete JSON, left by a writer that
    died, holds its number but counts as nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs.mkdirs(self._path(folder))

    def numbers(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict | None:
        src = self._fs.open(self._path(f"{self.folder}/{number:012d}.json"))
        try:
            return json.loads(self._io.toString(src, "UTF-8"))
        except ValueError:
            return None
        finally:
            src.close()

    def latest(self) -> dict | None:
        return next((m for m in map(self.read, reversed(self.numbers())) if m is not None), None)

    def create(self, number: int, value: dict) -> None:
        value = value | {"writer": uuid.uuid4().hex}
        at = self._path(f"{self.folder}/{number:012d}.json")
        try:
            out = self._fs.create(at, False)
            out.write(bytearray(json.dumps(value).encode()))
            out.close()
        except Exception as e:
            if self._fs.exists(at):
                raise RuntimeError(f"version {number} was committed by another run") from e
            raise
        if self.read(number) != value:
            raise RuntimeError(f"version {number} was committed by another run")


class IntervalLedger:
    """Processed intervals and outputs in one folder; a version file commits both.

    ``run`` plans the gaps, hands the records in them to ``work`` and commits. Outputs of runs that did not commit are
    never listed; of two runs at once the second fails to commit. A version names its own output only, so it stays small."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, f"{self.root}/versions")

    def manifest(self) -> dict:
        return self.versions.latest() or {"version": 0, "intervals": None, "output": None}

    def processed(self) -> DataFrame:
        at = self.manifest()["intervals"]
        return self.spark.read.schema(RANGE).parquet(at) if at else self.spark.createDataFrame([], RANGE)

    def output(self, schema: str) -> DataFrame:
        """What committed runs wrote."""
        outs = [m["output"] for m in map(self.versions.read, self.versions.numbers()) if m and m["output"]]
        return self.spark.read.schema(schema).parquet(*outs) if outs else self.spark.createDataFrame([], schema)

    def gaps(self, available: DataFrame) -> DataFrame:
        """Ranges of ``available`` that were not processed, written down first: what is planned is what is processed."""
        at = f"{self.root}/gaps/{uuid.uuid4().hex}"
        subtract_intervals(available, self.processed()).write.parquet(at)
        return self.spark.read.schema(RANGE).parquet(at)

    def run(self, records: DataFrame, stream: str, seq: str, work: Callable[[DataFrame], DataFrame], available: DataFrame | None = None) -> dict:
        """One run over ``records`` (numbers ``available``, by default all of theirs); returns the new manifest. Nothing to do
        commits nothing."""
        before = self.manifest()
        gaps = self.gaps(to_intervals(records, stream, seq) if available is None else available)
        if gaps.isEmpty():
            return before
        out = f"{self.root}/output/{uuid.uuid4().hex}"
        work(expand(gaps, records, stream, seq)).write.parquet(out)
        return self.commit(before, gaps, out)

    def commit(self, before: dict, intervals: DataFrame, output: str | None) -> dict:
        """Adds ``intervals`` to what is processed, together with the output."""
        at = f"{self.root}/intervals/{uuid.uuid4().hex}"
        merge_intervals(self.processed().unionByName(intervals)).write.parquet(at)
        number = max([before["version"], *self.versions.numbers()[-1:]]) + 1
        if (self.versions.latest() or {"version": 0})["version"] != before["version"]:
            raise RuntimeError(f"version {before['version']} was followed by another run")
        m = {"version": number, "intervals": at, "output": output, "at": time.time()}
        self.versions.create(number, m)
        return m


# --- the indexer's backlog ---------------------------------------------------------------------------------------


def current_files(files: DataFrame) -> DataFrame:
    """One row per (repo_id, path): the state of the largest indexed_at (nulls last; ties by the larger hash)."""
    f = files.dropna(subset=["repo_id", "path"]).groupBy("repo_id", "path")
    return f.agg(F.max_by(F.struct("hash", "language", "indexed_at"), F.struct(F.coalesce("indexed_at", F.lit(float("-inf"))).alias("t"), F.coalesce("hash", F.lit("")).alias("h"))).alias("s")).select("repo_id", "path", "s.hash", "s.language", "s.indexed_at")


_NEWER = "struct(coalesce({0}indexed_at, double('-inf')), coalesce({0}hash, ''))"


class FileIndex:
    """Numbered file states and what was done with them, in one folder.

    ``register`` gives numbers to states that are newer than what is known of their file, ``run`` takes up the files whose
    newest state was not processed; states overtaken before they were processed are marked as done without work."""

    STATES = "stream string, seq bigint, repo_id string, path string, hash string, indexed_at double"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.batches = Versions(spark, f"{self.root}/batches")
        self.ledger = IntervalLedger(spark, f"{self.root}/ledger")

    def states(self) -> DataFrame:
        """Every numbered state."""
        m = self.batches.latest()
        return self.spark.read.schema(self.STATES).parquet(*m["parts"]) if m else self.spark.createDataFrame([], self.STATES)

    def newest(self) -> DataFrame:
        """The newest state of every file."""
        s = self.states()
        cols = [c for c in s.columns if c not in ("repo_id", "path")]
        return s.groupBy("repo_id", "path").agg(F.max_by(F.struct(*cols), F.expr(_NEWER.format(""))).alias("s")).select("repo_id", "path", "s.*")

    def register(self, files: DataFrame, sources: list[str] | None = None) -> None:
        """Numbers the states in ``files`` that are newer than those known of their files."""
        before = self.batches.latest()
        new = current_files(files).select("repo_id", "path", "hash", "indexed_at").withColumn("stream", F.pmod(F.xxhash64("repo_id", "path"), F.lit(self.buckets)).cast("string"))
        if before:
            known = self.newest().select("repo_id", "path", F.expr(_NEWER.format("")).alias("known"))
            new = new.join(known, ["repo_id", "path"], "left").filter(F.col("known").isNull() | (F.expr(_NEWER.format("")) > F.col("known"))).drop("known")
            top = self.states().groupBy("stream").agg(F.max("seq").alias("top"))
            new = new.join(F.broadcast(top), "stream", "left")  # one row a bucket
        else:
            new = new.withColumn("top", F.lit(0))
        rank = F.row_number().over(W.partitionBy("stream").orderBy("repo_id", "path"))
        at = f"{self.root}/states/{uuid.uuid4().hex}"
        new.select("stream", (F.coalesce("top", F.lit(0)) + rank).cast("bigint").alias("seq"), "repo_id", "path", "hash", "indexed_at").write.parquet(at)
        number = max(self.batches.numbers()[-1:] or [0]) + 1
        self.batches.create(number, {"parts": [*(before["parts"] if before else []), at], "sources": sorted({*(before["sources"] if before else []), *(sources or [])})})

    def unread(self, folder: str) -> list[str]:
        """Parquet files of a folder that no batch has read."""
        known = set((self.batches.latest() or {"sources": []})["sources"])
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = (str(s.getPath().toString()) for s in fs.listStatus(path))
        return sorted(n for n in names if n.endswith(".parquet") and n not in known)

    def register_folder(self, folder: str) -> int:
        """Registers the states in the folder's new files, and only reads those; gives their number."""
        new = self.unread(folder)
        if new:
            self.register(self.spark.read.parquet(*new), new)
        return len(new)

    def available(self) -> DataFrame:
        return self.states().groupBy("stream").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))

    def recover(self, chunks: DataFrame) -> None:
        """Takes over what an index without a ledger has done: states overtaken, and those of files all of whose chunks, at
        least one, carry their hash (a chunk without hash carries none). Chunks are folded to a row a file before the join."""
        c = chunks.select("repo_id", F.col("file_path").alias("path"), "file_hash").dropna(subset=["repo_id", "path", "file_hash"])
        c = c.groupBy("repo_id", "path").agg(F.min("file_hash").alias("lo_hash"), F.max("file_hash").alias("hi_hash"))
        open_ = self.newest().join(c, ["repo_id", "path"], "left").filter(~F.coalesce((F.col("hash") == F.col("lo_hash")) & (F.col("hash") == F.col("hi_hash")), F.lit(False)))
        self.ledger.commit(self.ledger.manifest(), subtract_intervals(self.available(), to_intervals(open_, "stream", "seq")), None)

    def backlog(self) -> DataFrame:
        """States to take up now: in a gap, and the newest of their file."""
        return expand(self.ledger.gaps(self.available()), self.newest(), "stream", "seq")

    def run(self, work: Callable[[DataFrame], DataFrame]) -> dict:
        """One run: the backlog goes to ``work``; its output and the processed numbers, overtaken ones too, commit as one."""
        return self.ledger.run(self.newest(), "stream", "seq", work, self.available())


def backlog(files: DataFrame, chunks: DataFrame, root: str | None = None) -> DataFrame:
    """Files whose current state is not fully chunked: the ledger's gaps, what is done being recovered from the chunks.

    The ledger stands in ``root``, by default a new folder beside the cluster's checkpoints."""
    spark = files.sparkSession
    index = FileIndex(spark, root or f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}")
    index.register(files)
    index.recover(chunks)
    return index.backlog().select("repo_id", "path")


def backlog_by_repository(files: DataFrame, chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Files, files to take up, the end of the last successful run, and how many of the backlog's states are dated before it
    (late arrivals, or left over by failed runs): what a run that went by the clock would miss. A ``finished_at`` without a
    time zone is UTC, whatever the session's zone."""
    cur = current_files(files)
    todo = backlog(files, chunks).withColumn("open", F.lit(True))
    last = runs.filter("status = 'success'").groupBy("repo_id").agg(F.max("finished_at").alias("last_success"))
    d = cur.join(todo, ["repo_id", "path"], "left").join(last, "repo_id", "left")
    instant = F.col("last_success")
    if dict(runs.dtypes)["finished_at"] == "timestamp_ntz":
        instant = F.concat(instant.cast("string"), F.lit("Z")).cast("timestamp")
    late = F.col("open") & (F.col("indexed_at") < F.unix_micros(instant) / 1e6)
    return d.groupBy("repo_id").agg(F.count("*").alias("n_files"), F.count_if("open").alias("n_backlog"), F.max("last_success").alias("last_success"), F.count_if(late).alias("n_dated_before"))
