"""The index as tables that are re-made in part: diffs, upserts, analyzer state, schema versions, settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from cairn.functions import text as T

SCHEMA_VERSION = 7


class Analyzer(Protocol):
    """What an analyzer offers: facts of files, and tables derived from all facts."""

    name: str
    version: int

    def extract(self, files: DataFrame) -> DataFrame: ...

    def finalize(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]: ...


def diff(known: DataFrame, now: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key..., change): added, changed or deleted files of two snapshots (key..., hash)."""
    key = key or ["repo_id", "path"]
    a = known.select(*key, F.col("hash").alias("_old")).dropDuplicates(key)
    b = now.select(*key, F.col("hash").alias("_new")).dropDuplicates(key)
    d = a.withColumn("_k", F.lit(1)).join(b.withColumn("_n", F.lit(1)), key, "full")
    change = F.when(F.col("_k").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return d.select(*key, change.alias("change")).filter("change is not null")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.dropDuplicates(key))


def delete_files(tables: dict[str, DataFrame], gone: DataFrame, path_column: dict[str, str]) -> dict[str, DataFrame]:
    """Every table without the rows of the files in ``gone`` (repo_id, path)."""
    out = {}
    for name, df in tables.items():
        c = path_column.get(name, "file_path")
        out[name] = df.join(gone.select("repo_id", F.col("path").alias(c)).distinct(), ["repo_id", c], "left_anti")
    return out


def stale(files: DataFrame, state: DataFrame, analyzers: list[tuple[str, int]], force: bool = False) -> DataFrame:
    """(repo_id, path, analyzer, hash, version) of what must be analysed again: no state, another hash or version."""
    each = F.array(*(F.struct(F.lit(a).alias("analyzer"), F.lit(v).cast("bigint").alias("version")) for a, v in analyzers))
    want = files.select("repo_id", "path", "hash").dropDuplicates(["repo_id", "path"]).select("repo_id", "path", "hash", F.inline(each))
    return want if force else want.join(state.select("repo_id", "path", "analyzer", "hash", "version"), ["repo_id", "path", "analyzer", "hash", "version"], "left_anti")


def vanished(files: DataFrame, state: DataFrame) -> DataFrame:
    """State of files that are gone."""
    return state.join(files.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti")


def wipe_for_embedder(tables: dict[str, DataFrame], stored: str, current: str) -> dict[str, DataFrame]:
    """Another embedder empties chunks, postings and files; analysis tables stay."""
    return {n: d.limit(0) if stored != current and n in ("chunks", "postings", "files") else d for n, d in tables.items()}


def migrate(version: int, steps: dict[int, callable], tables: dict[str, DataFrame]) -> tuple[int, dict[str, DataFrame]]:
    """Applies the steps above ``version`` in order; a second run changes nothing."""
    for v in sorted(s for s in steps if s > version):
        tables = steps[v](tables)
        version = v
    return version, tables


@dataclass(frozen=True)
class Settings:
    top_k: int = 6
    relevance: float = 0.35
    hybrid: bool = True
    debt_tags: str = "TODO,FIXME,HACK,XXX,BUG,NOTE"
    topic_threshold: float = 0.6
    min_similarity: float = 0.9
    min_lines: int = 5

    def update(self, changes: dict) -> Settings:
        """A checked copy; unknown names and values out of range are errors."""
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        s = replace(self, **changes)
        if not 1 <= s.top_k <= 20 or not 0 <= s.relevance <= 1 or not 0 <= s.topic_threshold <= 1 or not 0.8 <= s.min_similarity <= 1 or s.min_lines < 1:
            raise ValueError("a setting is out of range")
        return s

    def dump(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def load(cls, text: str | None) -> Settings:
        """Defaults where the text is broken."""
        try:
            return cls().update(json.loads(text or "{}"))
        except (ValueError, TypeError):
            return cls()


def chunk_preview(chunks: DataFrame, sources: DataFrame, context: int = 30) -> DataFrame:
    """(id, first, last, shown, stale) of chunks (id, repo_id, file_path, start_line, end_line, content) whose file is there:
    the lines around each chunk as they are now, and whether its own lines differ from what was stored."""
    c = chunks.select("id", "repo_id", F.col("file_path").alias("path"), "start_line", "end_line", "content").dropna().dropDuplicates(["id"])
    s = sources.filter(F.col("content").isNotNull()).select("repo_id", "path", T.lines_of(F.col("content")).alias("lines"))
    j = c.join(s, ["repo_id", "path"]).withColumn("first", F.greatest(F.col("start_line") - context, F.lit(1))).withColumn("last", F.least(F.col("end_line") + context, F.size("lines")))

    def part(a, b):
        return F.array_join(F.slice("lines", a, F.greatest(b - a + 1, F.lit(0))), "\n")

    stale = part(F.col("start_line"), F.col("end_line")) != F.array_join(T.lines_of(F.col("content")), "\n")
    return j.select("id", "first", "last", part(F.col("first"), F.col("last")).alias("shown"), stale.alias("stale"))
