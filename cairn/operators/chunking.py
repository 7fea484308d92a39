"""Line-window and structure chunking.

``line_windows`` is all expressions: windows of ``window`` lines, ``overlap`` of them shared, blank windows left out, none
begun once a window reaches the end. ``structure_chunks`` cuts at definitions found by the scanners of ``extract``.

Defined cases: null and empty texts give no windows; line ends are those of ``text.LINE_END``; repeated rows are repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions import text as T
from cairn.operators.extract import facts_of
from cairn.session import spread

WINDOW, OVERLAP = 60, 10
MIN_CHUNK, MAX_CHUNK = 100, 400


def window_starts(n: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """First lines (from 0) of the windows of a text of ``n`` lines."""
    step = window - overlap
    last = F.greatest(F.ceil((n - window) / step).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: k * step)


def line_windows(texts: DataFrame, key: list[str], content: str = "content", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(key..., part, start_line, end_line, content) of every window that is not blank."""
    d = texts.filter(F.length(content) > 0).select(*key, T.lines_of(F.col(content)).alias("_lines"))
    d = d.withColumn("_n", F.size("_lines")).filter("_n > 0")
    d = d.select(*key, "_lines", "_n", F.posexplode(window_starts(F.col("_n"), window, overlap)).alias("part", "_start"))
    body = F.array_join(F.slice("_lines", F.col("_start") + 1, window), "\n")
    d = d.select(*key, "part", (F.col("_start") + 1).alias("start_line"), F.least(F.col("_start") + window, F.col("_n")).alias("end_line"), body.alias("content"))
    return d.filter(F.regexp_replace("content", r"\s+", "") != "")


def _estimate(lines: list[str]) -> int:
    return max(1, len("\n".join(lines)) // 4)


def cut_structure(path: str, language: str, source: str) -> list[tuple]:
    """(symbol_name, symbol_kind, start_line, end_line, content, context) of one file.

    Definitions are kept whole up to ``MAX_CHUNK`` estimated tokens; larger classes become a header and one piece per
    member with the class's signature as context; gaps become module or block pieces; small neighbours of one context
    are merged up to the limit; pieces of more than half as much again are cut into windows."""
    lines = source.splitlines()
    if not source.strip():
        return []
    facts = facts_of(path, language, source)
    tops = sorted((s for s in facts["symbols"] if not s["owner"] and "." not in s["qualified_name"]), key=lambda s: s["start_line"])
    pieces: list[list] = []  # name, kind, first, last, context

    def gap(a: int, b: int, context: str | None) -> None:
        if a <= b and any(x.strip() for x in lines[a - 1 : b]):
            pieces.append([None, "module" if context is None else "block", a, b, context])

    at = 1
    for s in tops:
        if s["start_line"] < at:
            continue
        gap(at, s["start_line"] - 1, None)
        if s["kind"] == "class" and _estimate(lines[s["start_line"] - 1 : s["end_line"]]) > MAX_CHUNK:
            head = f"{lines[s['start_line'] - 1].strip()} ..."
            members = sorted((m for m in facts["symbols"] if m["owner"] == s["qualified_name"] and m["kind"] == "method" and m["start_line"] > s["start_line"]), key=lambda m: m["start_line"])
            inner = s["start_line"]
            for m in members:
                if m["start_line"] < inner:
                    continue
                if m["start_line"] > inner:
                    pieces.append([s["name"] if inner == s["start_line"] else None, "class" if inner == s["start_line"] else "block", inner, m["start_line"] - 1, None if inner == s["start_line"] else head])
                pieces.append([m["qualified_name"], "method", m["start_line"], m["end_line"], head])
                inner = m["end_line"] + 1
            gap(inner, s["end_line"], head)
        else:
            pieces.append([s["name"], s["kind"], s["start_line"], s["end_line"], None])
        at = s["end_line"] + 1
    gap(at, len(lines), None)
    merged: list[list] = []
    for p in pieces:
        q = merged[-1] if merged else None
        if q and q[4] == p[4] and min(_estimate(lines[q[2] - 1 : q[3]]), _estimate(lines[p[2] - 1 : p[3]])) < MIN_CHUNK and _estimate(lines[q[2] - 1 : p[3]]) <= MAX_CHUNK:
            q[0] = ", ".join(x for x in dict.fromkeys([*(q[0] or "").split(", "), p[0]]) if x) or None
            q[1] = q[1] if q[1] == p[1] else "block"
            q[3] = p[3]
        else:
            merged.append(p)
    out = []
    for name, kind, a, b, context in merged:
        part = lines[a - 1 : b]
        if not any(x.strip() for x in part):
            continue
        if _estimate(part) <= MAX_CHUNK * 3 // 2:
            out.append((name, kind, a, b, "\n".join(part), context))
            continue
        for k, start in enumerate(range(0, max(1, len(part)), 40), 1):
            end = min(start + 50, len(part))
            if any(x.strip() for x in part[start:end]):
                out.append((f"{name} (part {k})" if name else None, kind, a + start, a + end - 1, "\n".join(part[start:end]), context))
            if end == len(part):
                break
    return out


_SCHEMA = "repo_id string, file_path string, symbol_name string, symbol_kind string, start_line int, end_line int, content string, context string"


def structure_chunks(files: DataFrame) -> DataFrame:
    """Chunks of (repo_id, path, content); languages without a scanner are cut into line windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from cairn.operators.extract import language_of

        for pdf in batches:
            rows = []
            for repo, path, text in pdf[["repo_id", "path", "content"]].itertuples(index=False):
                lang = language_of(path)
                rows += [(repo, path, *c) for c in cut_structure(path, lang, text)]
            yield pd.DataFrame(rows, columns=["repo_id", "file_path", "symbol_name", "symbol_kind", "start_line", "end_line", "content", "context"])

    known = T.language(F.col("path")).isin("python", "javascript", "typescript", "go", "java", "csharp")
    d = files.filter(F.col("content").isNotNull())
    cut_ = spread(d.filter(known).select("repo_id", "path", "content")).mapInPandas(run, _SCHEMA)
    rest = line_windows(d.filter(~known).select("repo_id", F.col("path").alias("file_path"), "content"), ["repo_id", "file_path"])
    rest = rest.select("repo_id", "file_path", F.lit(None).cast("string").alias("symbol_name"), F.lit("block").alias("symbol_kind"), "start_line", "end_line", "content", F.lit(None).cast("string").alias("context"))
    return cut_.unionByName(rest)
