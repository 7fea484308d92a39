"""Repositories as tables: file scans, ignore rules, dotenv names, git blame text, file slices, evaluation sets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn.functions import constants as K, text as T


def scan(spark: SparkSession, root: str, max_bytes: int = 1_000_000) -> DataFrame:
    """(path, hash, language, content) of the text files below ``root``; size and name filters come before the bytes."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), "^(?:file:)?" + re.escape(base), "")
    d = d.select(F.regexp_replace(rel, "^file:/*(?=" + re.escape(base.lstrip("/")) + ")", "/").alias("path"), "length", "content")
    d = d.withColumn("path", F.regexp_replace("path", "^" + re.escape(base), "")).filter((F.col("length") <= max_bytes) & wanted(F.col("path")))
    d = d.filter(~is_binary(F.col("content")))
    text = F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8")
    return d.select("path", F.sha2("content", 256).alias("hash"), T.language(F.col("path")).alias("language"), text.alias("content"))


def wanted(path: Column) -> Column:
    """No pruned or dot directory, no dot or lock file, no binary or secret suffix, nothing minified."""
    folders = T._folders(path)
    name = T.file_name(path)
    pruned = F.exists(folders, lambda f: f.isin(K.SKIP_DIRS) | f.startswith("."))
    low = F.lower(name)
    suffix = F.regexp_extract(low, r"(\.[^.]*)$", 1).isin(K.BINARY_SUFFIXES)
    return ~pruned & ~name.startswith(".") & ~name.isin(K.LOCKFILES) & ~suffix & ~low.rlike(r"\.(min\.js|min\.css|map)$")


def is_binary(content: Column) -> Column:
    """A zero byte in the first 8 KiB."""
    return F.hex(F.substring(content, 1, 8192)).rlike("^(..)*?00")


def _rule(pattern: str) -> tuple[re.Pattern, bool, bool]:
    """(pattern over a path relative to its folder, negated, directories only)."""
    neg = pattern.startswith("!")
    p = pattern.lstrip("!").rstrip()
    only_dir = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    body = "".join(".*" if t == "**" else re.escape(t).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") for t in re.split(r"(\*\*)", p))
    body = body.replace(".*/", "(?:.*/)?")
    return re.compile(f"(?:{'' if anchored else '(?:.*/)?'}{body})(?:/.*)?"), neg, only_dir


def ignored(path: str, specs: dict[str, list[str]]) -> bool:
    """Whether any ignore file of an ancestor folder (folder -> lines) matches the file or one of its folders."""
    for folder, lines in specs.items():
        if folder and not path.startswith(folder + "/"):
            continue
        rel = path[len(folder) + 1 :] if folder else path
        hit = False
        for line in lines:
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            rx, neg, only_dir = _rule(line.strip())
            parts = rel.split("/")
            names = ["/".join(parts[: k + 1]) for k in range(len(parts))]
            if any(rx.fullmatch(n) for n in (names[:-1] if only_dir else names)):
                hit = not neg
        if hit:
            return True
    return False


def without_ignored(files: DataFrame, specs: dict[str, list[str]]) -> DataFrame:
    """Files no ignore rule matches; the rules of one repository are a few lines of text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[not ignored(p, specs) for p in pdf["path"]]]

    return files.mapInPandas(run, files.schema)


def dotenv_names(lines: DataFrame) -> DataFrame:
    """(name, path) of (path, value): names only, values are never kept."""
    d = lines.filter(T.is_dotenv_path(F.col("path")) & (F.size(F.split("path", "/")) <= 3))
    name = F.regexp_extract("value", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1)
    return d.select(name.alias("name"), "path").filter("name <> ''").distinct()


def parse_blame(output: str) -> dict[int, tuple[str | None, float | None]]:
    """line -> (author, epoch) of a line-porcelain text; lines not committed yet have neither."""
    out: dict[int, tuple[str | None, float | None]] = {}
    line, author, when = 0, None, None
    for x in output.splitlines():
        if m := re.match(r"^[0-9a-f]{40} \d+ (\d+)", x):
            line, author, when = int(m[1]), None, None
        elif x.startswith("author "):
            author = x[7:]
        elif x.startswith("author-time "):
            when = float(x[12:])
        elif x.startswith("\t"):
            out[line] = (None, None) if author == "Not Committed Yet" else (author, when)
    return out


def blame_rows(blames: DataFrame) -> DataFrame:
    """(path, line, author, commit_date) of (path, output)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, n, a, t) for p, o in pdf[["path", "output"]].itertuples(index=False) for n, (a, t) in parse_blame(o or "").items()]
            yield pd.DataFrame(rows, columns=["path", "line", "author", "commit_date"])

    return blames.mapInPandas(run, "path string, line int, author string, commit_date double")


def file_slice(text: Column, start: Column, end: Column, context: int = 30) -> Column:
    """Lines from ``start`` to ``end`` with some around them, clamped to the file."""
    ls = T.lines_of(text)
    a = F.greatest(F.lit(1), F.least(start, F.size(ls)) - context)
    b = F.least(F.size(ls), F.greatest(end, start) + context)
    return F.struct(a.alias("first"), b.alias("last"), F.slice(ls, a, F.greatest(b - a + 1, F.lit(0))).alias("lines"))


def safe_path(path: Column) -> Column:
    """Inside the repository and no secret: relative, without '..', no key or dotenv file."""
    low = F.lower(T.file_name(path))
    secret = F.regexp_extract(low, r"(\.[^.]*)$", 1).isin(".pem", ".key", ".p12", ".pfx", ".jks", ".keystore", ".env") | low.startswith(".env")
    return ~path.startswith("/") & ~F.array_contains(F.split(path, r"[/\\]"), "..") & ~secret & (path != "")


def symbol_source(symbols: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, source): the file's lines while the hash still fits, else the chunk of the same span, else empty."""
    f = files.select("repo_id", F.col("path").alias("file_path"), F.col("hash").alias("file_hash"), F.col("content").alias("_text"))
    c = chunks.select("repo_id", "file_path", "start_line", "end_line", F.col("content").alias("_chunk")).dropDuplicates(["repo_id", "file_path", "start_line", "end_line"])
    d = symbols.join(f, ["repo_id", "file_path", "file_hash"], "left").join(c, ["repo_id", "file_path", "start_line", "end_line"], "left")
    own = F.array_join(F.slice(T.lines_of(F.col("_text")), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    return d.select("id", F.coalesce(own, "_chunk", F.lit("")).alias("source"))


def eval_set(spark: SparkSession, questions: list[tuple[str, list[str]]]) -> DataFrame:
    """(question, path) rows of an evaluation file's questions."""
    rows = [(q, p) for q, paths in questions for p in paths]
    return spark.createDataFrame(rows, "question string, path string")
