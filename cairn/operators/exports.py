"""Report files and sentences: endpoint catalogue, duplicate checklist, impact facts, signatures and result caches."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from cairn.functions import constants as K
from cairn.operators.listings import csv_field

EXPORTED = ["method", "path", "handler", "file_path", "line", "framework", "partial"]


def _framework_label() -> Column:
    m = F.create_map(*(F.lit(x) for kv in K.FRAMEWORK_LABELS.items() for x in kv))
    return F.coalesce(m[F.col("framework")], F.col("framework"))


def endpoint_rows(endpoints: DataFrame, fmt: str) -> DataFrame:
    """(position, row) of the catalogue as json (an object a row), csv or markdown; the header row comes first."""
    order = W.orderBy("path", "method", "file_path", "line")  # a catalogue is one ordered report
    if fmt == "json":
        row, head = F.to_json(F.struct(*EXPORTED), {"ignoreNullFields": "false"}), []
    elif fmt == "csv":
        parts = [F.col("method"), F.col("path"), F.col("handler"), F.col("file_path"), F.col("line"), _framework_label(), F.when(F.col("partial"), "yes").otherwise("")]
        row, head = F.concat_ws(",", *map(csv_field, parts)), ["method,path,handler,file,line,framework,partial"]
    elif fmt == "markdown":
        handler = F.when(F.coalesce("handler", F.lit("")) != "", F.concat(F.lit("`"), "handler", F.lit("`"))).otherwise("")
        path = F.concat(F.lit("`"), "path", F.lit("`"), F.when(F.col("partial"), " (partial)").otherwise(""))
        place = F.concat(F.lit("`"), "file_path", F.lit(":"), F.col("line").cast("string"), F.lit("`"))
        row = F.concat(F.lit("| "), F.concat_ws(" | ", "method", path, handler, place, _framework_label()), F.lit(" |"))
        head = ["# API endpoints", "", "| Method | Path | Handler | Location | Framework |", "|---|---|---|---|---|"]
    else:
        raise ValueError(f"unknown format {fmt}")
    body = endpoints.withColumn("position", F.row_number().over(order)).select("position", row.alias("row"))
    top = endpoints.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "position int, row string")
    return top.unionByName(body).orderBy("position")


def duplicate_checklist(groups: DataFrame, similarity: float) -> DataFrame:
    """(position, row) of a markdown checklist of groups (type, size, duplicated_lines, avg_similarity, value, members
    array<struct(qualified_name, file_path, start_line, end_line)>), most valuable first."""
    first = F.col("members")[0]["file_path"]
    g = groups.withColumn("n", F.row_number().over(W.orderBy(F.desc("value"), F.desc("avg_similarity"), first)))
    head = F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(". "), F.initcap("type"), F.lit(" match: "), F.col("size").cast("string"), F.lit(" functions, "), F.col("duplicated_lines").cast("string"), F.lit(" duplicated lines, similarity "), F.format_string("%.2f", F.col("avg_similarity")))
    items = F.transform("members", lambda m: F.concat(F.lit("- [ ] `"), m["qualified_name"], F.lit("` in `"), m["file_path"], F.lit(":"), m["start_line"].cast("string"), F.lit("-"), m["end_line"].cast("string"), F.lit("`")))
    rows = g.select("n", F.array_join(F.concat(F.array(head), items, F.array(F.lit(""))), "\n").alias("row"))
    total = groups.agg(F.count("*").alias("c")).select(F.lit(0).alias("n"), F.concat(F.lit("# Duplicate code\n\n"), F.col("c").cast("string"), F.lit(f" groups (similarity at least {similarity:.2f})\n")).alias("row"))
    return total.unionByName(rows).select(F.col("n").alias("position"), "row").orderBy("position")


def impact_facts(summary: DataFrame, name: str, kind: str, path: str, depth: int) -> DataFrame:
    """(text): the facts of ``graph.impact``'s one-row summary as a list."""
    s = lambda c: F.col(c).cast("string")
    doubt = F.when((F.col("low_confidence") > 0) | (F.col("unresolved_same_name") > 0), F.concat(F.lit("\n- "), s("low_confidence"), F.lit(" links are low confidence and "), s("unresolved_same_name"), F.lit(" calls by the same name could not be resolved."))).otherwise("")
    text = F.concat(
        F.lit(f"- The {kind} `{name}` is in {path}.\n- Blast radius: "), F.col("level"), F.lit(" (score "), s("score"), F.lit(").\n- "), s("direct"), F.lit(" direct callers, "), s("total"),
        F.lit(" affected in total across "), s("files"), F.lit(f" files (looking {depth} levels out).\n- "), s("tests"), F.lit(" affected tests."), doubt,
    )
    return summary.select(text.alias("text"))


def fallback_summary(summary: DataFrame, name: str, depth: int) -> DataFrame:
    """(text): plain sentences where no model's summary is usable."""
    s = lambda c: F.col(c).cast("string")
    none = F.concat(F.lit(f"Nothing calls `{name}` within {depth} levels, so changing it looks low risk (blast radius "), F.col("level"), F.lit(")."))
    some = F.concat(F.lit(f"Changing `{name}` may affect "), s("total"), F.lit(" symbols across "), s("files"), F.lit(" files, "), s("direct"), F.lit(" of them direct callers. The blast radius is "), F.col("level"), F.lit(" (score "), s("score"), F.lit("). "), s("tests"), F.lit(" affected tests would show a break."))
    doubt = F.when((F.col("low_confidence") > 0) | (F.col("unresolved_same_name") > 0), " Some links are low confidence or unresolved, so check the callers by hand.").otherwise("")
    return summary.select(F.concat(F.when(F.col("total") == 0, none).otherwise(some), doubt).alias("text"))


def analyzer_version(tags: list[str]) -> int:
    """Changes with the configured tags, so that every file is analysed again."""
    return 1 + zlib.crc32(",".join(tags).encode())


def parse_tags(raw: str) -> list[str]:
    """A comma-separated list in upper case without repeats; the defaults where it is empty."""
    return list(dict.fromkeys(t.strip().upper() for t in raw.split(",") if t.strip())) or list(K.DEBT_TAGS)


def items_signature(items: DataFrame, embedder: str) -> DataFrame:
    """(signature) of a board's items in order: the key of its cached topics."""
    line = F.concat_ws(":", "file_path", F.col("line").cast("string"), "tag", "text")
    lines = F.array_sort(F.collect_list(F.struct("file_path", "line", line.alias("l"))))
    return items.agg(F.sha2(F.concat(F.lit(embedder + "\n"), F.array_join(F.transform(lines, lambda x: x["l"]), "\n")), 256).alias("signature"))


def cached(result, cache_root: str, key: str, spark) -> DataFrame:
    """The table stored under ``key``, else ``result()`` stored there; an empty result is not kept."""
    at = f"{cache_root.rstrip('/')}/{key}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df = result()
        if df.isEmpty():
            return df
        df.write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows with counters that fill in while they are written: progress without a second pass."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows")), o
