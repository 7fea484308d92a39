"""Boards, listings and exports: debt, environment variables, undocumented symbols, overview counters.

Pure functions of tables; clocks are parameters. Exported texts are assembled per group, with a final ordered list of
group texts, since a report file is one string by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions import constants as K, text as T

BUCKETS = ["Last 30 days", "1 to 6 months", "6 to 12 months", "Over a year", "Unknown age"]


# --- debt -----------------------------------------------------------------------------------------------------------------


def debt_items(items: DataFrame, now: float, tag: str = "", q: str = "", folder: str = "", older_than_days: int = 0) -> DataFrame:
    """Items (tag, text, file_path, line, symbol, assignee, author, commit_date) with age in whole days, filtered."""
    age = T.age_days(F.lit(float(now)), F.col("commit_date"))
    d = items.withColumn("_age", F.when(F.coalesce("commit_date", F.lit(0.0)) != 0, age)).withColumn("age_days", F.bround("_age").cast("int"))
    if tag:
        d = d.filter(F.col("tag") == tag.upper())
    if q:
        d = d.filter(F.lower(F.concat_ws(" ", "text", "file_path", F.coalesce("symbol", F.lit("")))).contains(q.lower()))
    if folder:
        d = d.filter(T.in_scope(F.col("file_path"), folder.rstrip("/")))
    if older_than_days:
        d = d.filter(F.col("_age") > older_than_days)  # the unrounded age; undated rows are out
    return d


def debt_counters(items: DataFrame, tags: list[str] = K.DEBT_TAGS) -> DataFrame:
    """(counter, value): total, each configured tag (zero where none), and whether any item has a date."""
    total = items.agg(F.count("*").alias("value"), F.count_if(F.col("commit_date").isNotNull()).alias("dated"))
    per = items.groupBy("tag").count()
    dim = items.sparkSession.createDataFrame([(t, i) for i, t in enumerate(tags)], "tag string, i int")
    rows = dim.join(per, "tag", "left").select(F.concat(F.lit("tag:"), "tag").alias("counter"), F.coalesce("count", F.lit(0)).cast("bigint").alias("value"))
    return total.select(F.lit("total").alias("counter"), "value").unionByName(rows).unionByName(total.select(F.lit("dated").alias("counter"), F.col("dated").alias("value")))


def oldest_item(items: DataFrame) -> DataFrame:
    return items.filter("commit_date is not null").orderBy("commit_date", "file_path", "line").limit(1)


def debt_groups(items: DataFrame, group_by: str, tags: list[str] = K.DEBT_TAGS) -> DataFrame:
    """(position, key, count): groups by tag (configured order, empty ones kept), folder, age or topic (``cluster``, ``label``)."""
    if group_by == "tag":
        dim = items.sparkSession.createDataFrame([(t, i) for i, t in enumerate(tags)], "key string, position int")
        return dim.join(items.groupBy(F.col("tag").alias("key")).count(), "key", "left").select("position", "key", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    if group_by == "folder":
        g = items.groupBy(T.folder_of(F.col("file_path")).alias("key")).count()
        return g.select(F.lit(0).alias("position"), "key", "count")
    if group_by == "age":
        g = items.groupBy(T.age_bucket(F.col("_age")).alias("key")).count()
        return g.select((F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("key")) - 1).cast("int").alias("position"), "key", "count")
    if group_by == "topic":
        return items.groupBy("cluster", "label").count().select(F.col("cluster").alias("position"), F.col("label").alias("key"), "count")
    raise ValueError(f"unknown grouping {group_by}")


def _listed(d: DataFrame, key: list[Column | str], order: list[str], line: Column, sep: str = "\n") -> DataFrame:
    """One text per group: its lines in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return d.groupBy(*key).agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda x: x["_line"]), sep).alias("body"))


def debt_markdown(items: DataFrame) -> DataFrame:
    """(section, part, row): the lines of the board as markdown, by tag, in order; write ``row`` as text.

    Rows are sorted over the cluster, so a board of any size needs no task that holds it."""
    who = F.when(F.coalesce("author", F.lit("")) != "", F.concat(F.lit(" ("), F.col("author"), F.lit(")"))).otherwise(F.lit(""))
    text = F.when(F.coalesce("text", F.lit("")) == "", F.lit("(no text)")).otherwise(F.col("text"))
    line = F.concat(F.lit("- "), text, F.lit(" `"), F.col("file_path"), F.lit(":"), F.col("line").cast("string"), F.lit("`"), who)
    rows = items.select(F.col("tag").alias("section"), F.lit(2).alias("part"), "file_path", "line", line.alias("row"))
    per = items.groupBy(F.col("tag").alias("section")).agg(F.count("*").alias("n"))
    title = F.concat(F.lit("## "), "section", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    frame = per.select("section", F.inline(F.array(*(F.struct(F.lit(k).alias("part"), x.alias("row")) for k, x in ((0, title), (1, F.lit("")), (3, F.lit("")))))))
    total = F.concat(F.coalesce(F.sum("n"), F.lit(0)).cast("string"), F.lit(" items"))
    head = per.agg(total.alias("t")).select(F.lit("").alias("section"), F.inline(F.array(*(F.struct(F.lit(k).alias("part"), x.alias("row")) for k, x in enumerate((F.lit("# Tech debt"), F.lit(""), F.col("t"), F.lit("")))))))
    none = [F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line")]
    all_ = rows.unionByName(frame.select("section", "part", *none, "row")).unionByName(head.select("section", "part", *none, "row"))
    return all_.orderBy("section", "part", "file_path", "line", "row").select("section", "part", "row")


def csv_field(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_rows(d: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(row) in order: rows of a CSV file; write with ``text`` to keep them as they are."""
    return d.orderBy(*order).select(F.concat_ws(",", *(csv_field(F.col(c)) for c in columns)).alias("row"))


def debt_csv(items: DataFrame) -> DataFrame:
    d = items.withColumn("age_days", F.when(F.col("age_days") != 0, F.col("age_days")))  # age 0 prints as nothing
    d = d.withColumnRenamed("file_path", "file")
    return csv_rows(d, ["tag", "text", "file", "line", "symbol", "author", "assignee", "age_days"], ["file", "line"])


# --- environment variables -----------------------------------------------------------------------------------------------------


def env_variables(env: DataFrame, declared: DataFrame | None = None, q: str = "") -> DataFrame:
    """One row per name: secret, required, default (if exactly one), default_varies, declared files, usages in order."""
    e = env.select("name", "file_path", "line", "default_value", "is_secret", "required").distinct().filter("name is not null")
    ordered = F.array_sort(F.collect_list(F.struct("file_path", "line", "default_value", "required")))
    g = e.groupBy("name").agg(F.bool_or(F.coalesce("is_secret", F.lit(False))).alias("is_secret"), F.bool_or(F.coalesce("required", F.lit(False))).alias("required"), ordered.alias("u"))
    defaults = F.array_distinct(F.filter(F.transform("u", lambda x: x["default_value"]), lambda x: x.isNotNull()))
    g = g.withColumn("_d", defaults)
    one = F.when((F.size("_d") == 1) & ~F.col("is_secret"), F.try_element_at("_d", F.lit(1)))
    g = g.select("name", "is_secret", "required", one.alias("default"), (F.size("_d") > 1).alias("default_varies"), F.transform("u", lambda x: F.struct(x["file_path"].alias("file_path"), x["line"].alias("line"))).alias("usages"))
    if declared is not None:
        g = g.join(declared.groupBy("name").agg(F.sort_array(F.collect_set("path")).alias("declared_in")), "name", "left")
    return g.filter(F.lower("name").contains(q.lower())) if q else g


def env_modules(variables: DataFrame) -> DataFrame:
    """(name, module): the module of most usages, ties by name."""
    u = variables.select("name", F.explode("usages").alias("u")).groupBy("name", T.module_of(F.col("u.file_path")).alias("module")).count()
    return u.groupBy("name").agg(F.min_by("module", F.struct(-F.col("count"), "module")).alias("module"))


def env_example(variables: DataFrame) -> DataFrame:
    """(module, text): sections of an example file, secrets without value; join them in order of module."""
    d = variables.join(env_modules(variables), "name")
    places = F.array_join(F.transform(F.slice("usages", 1, 3), lambda u: F.concat(u["file_path"], F.lit(":"), u["line"].cast("string"))), ", ")
    more = F.when(F.size("usages") > 3, F.concat(F.lit(" (+"), (F.size("usages") - 3).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    head = F.concat(F.lit("# "), F.when(F.col("required"), "required").otherwise("optional"), F.lit(". Used in "), places, more, F.lit("\n"))
    body = F.when(F.col("is_secret"), F.concat(F.lit("# Secret: set a real value; never commit it.\n"), "name", F.lit("="))).otherwise(F.concat("name", F.lit("="), F.coalesce(T.quote_env(F.col("default")), F.lit(""))))
    g = _listed(d, ["module"], ["name"], F.concat(head, body, F.lit("\n")))
    return g.select("module", F.concat(F.lit("# ---- "), "module", F.lit(" ----\n\n"), "body").alias("text"))


# --- undocumented symbols and overview ---------------------------------------------------------------------------------------------

DOC_LANGUAGES = ["python", "javascript", "typescript", "tsx", "go", "java", "csharp"]


def callers(references: DataFrame, kinds: list[str]) -> DataFrame:
    return references.filter(F.col("kind").isin(kinds) & F.col("to_symbol_id").isNotNull()).groupBy(F.col("to_symbol_id").alias("id")).agg(F.count("*").alias("callers"))


def missing_docs(symbols: DataFrame, references: DataFrame, lang: str = "", min_lines: int = 3, q: str = "", include_tests: bool = False, limit: int = 500) -> DataFrame:
    """Undocumented symbols, most called first; q is a LIKE pattern on name or path."""
    d = symbols.filter(~F.col("has_doc") & F.col("kind").isin("function", "method", "class") & F.col("language").isin(DOC_LANGUAGES) & (F.col("end_line") - F.col("start_line") + 1 >= max(min_lines, 1)))
    if lang:
        d = d.filter(F.col("language") == lang)
    if q:
        d = d.filter(F.col("qualified_name").ilike(f"%{q}%") | F.col("file_path").ilike(f"%{q}%"))
    if not include_tests:
        d = d.filter(~F.col("is_test"))
    d = d.join(callers(references, ["call"]), "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return d.orderBy(F.desc("callers"), F.desc(F.col("end_line") - F.col("start_line")), "file_path", "start_line", "id").limit(limit)


def missing_by_language(symbols: DataFrame) -> DataFrame:
    d = symbols.filter(~F.col("has_doc") & F.col("language").isin(DOC_LANGUAGES) & ~F.col("is_test"))
    return d.groupBy("language").agg(F.count("*").alias("count"))


def symbol_search(symbols: DataFrame, references: DataFrame, q: str = "", kind: str = "", limit: int = 30) -> DataFrame:
    limit = max(1, min(100, limit))
    d = symbols.filter(F.col("kind") == kind) if kind else symbols
    d = d.withColumn("score", T.name_score(q, F.col("name"), F.col("qualified_name"))).filter("score is not null")
    d = d.join(callers(references, ["call", "inherit"]), "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return d.orderBy(F.desc("score"), F.desc("callers"), F.length("name"), "file_path", "id").limit(limit)


def nearest_symbol(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Re-binds (item_id, repo_id, file_path, qualified_name, kind, start_line) to the symbol of that name nearest by line."""
    s = symbols.select("repo_id", "file_path", "qualified_name", "kind", F.col("id").alias("symbol_id"), F.col("start_line").alias("now_line"))
    j = items.join(s, ["repo_id", "file_path", "qualified_name", "kind"], "left")
    return j.groupBy("item_id").agg(F.min_by(F.struct("symbol_id", "now_line"), F.struct(F.abs(F.col("now_line") - F.col("start_line")), "now_line", "symbol_id")).alias("b")).select("item_id", "b.symbol_id", "b.now_line")


def latest_status(suggestions: DataFrame) -> DataFrame:
    """(repo_id, file_path, start_line, status): of the newest pending or failed suggestion."""
    d = suggestions.filter(F.col("status").isin("pending", "failed"))
    return d.groupBy("repo_id", "file_path", "start_line").agg(F.max_by("status", "id").alias("status"))


def save_suggestion(suggestions: DataFrame, new: DataFrame) -> DataFrame:
    """New suggestions replace open ones of the same place; accepted and rejected ones stay."""
    open_ = F.col("status").isin("pending", "failed")
    gone = suggestions.filter(open_).join(new.select("repo_id", "file_path", "start_line").distinct(), ["repo_id", "file_path", "start_line"], "left_semi").select("id")
    return suggestions.join(gone, "id", "left_anti").unionByName(new)


def decide(suggestions: DataFrame, ids: list[int], status: str, hashes: DataFrame | None = None) -> DataFrame:
    """Moves pending suggestions to accepted or rejected; others keep their status. With current file hashes, a stale one
    (its file changed since) is not accepted."""
    if status not in ("accepted", "rejected"):
        raise ValueError(f"unknown status {status}")
    d = suggestions
    may = F.col("id").isin(ids) & (F.col("status") == "pending")
    if hashes is not None and status == "accepted":
        d = d.join(hashes.select("repo_id", F.col("path").alias("file_path"), F.col("hash").alias("_now")), ["repo_id", "file_path"], "left")
        may = may & F.col("_now").eqNullSafe(F.col("file_hash_at_suggestion"))
    return d.withColumn("status", F.when(may, F.lit(status)).otherwise(F.col("status"))).select(*suggestions.columns)


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """(counter, value) for whatever tables there are."""
    parts = []

    def add(name: str, df: DataFrame, agg: Column) -> None:
        parts.append(df.agg(agg.cast("bigint").alias("value")).select(F.lit(name).alias("counter"), "value"))

    if "files" in tables:
        add("files", tables["files"], F.countDistinct("repo_id", "path"))
    if "chunks" in tables:
        add("chunks", tables["chunks"], F.countDistinct("id"))
    if "env" in tables:
        add("env_names", tables["env"], F.countDistinct("name"))
        add("env_secrets", tables["env"], F.countDistinct(F.when(F.col("is_secret"), F.col("name"))))
    if "symbols" in tables:
        add("symbols", tables["symbols"], F.count("*"))
        add("undocumented", tables["symbols"], F.count_if(~F.col("has_doc") & ~F.col("is_test") & ~F.col("name").startswith("_")))
    if "routers" in tables:
        add("routers", tables["routers"], F.countDistinct("id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def symbol_rows(symbols: DataFrame, ids: list[int]) -> DataFrame:
    """The undocumented symbols among ``ids``."""
    return symbols.filter(F.col("id").isin(ids) & ~F.col("has_doc"))


def blame_targets(items: DataFrame) -> DataFrame:
    """The places whose last change is asked for: each line of each file once."""
    return items.select("file_path", "line").distinct()


def exact_duplicates(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hash, n): every key whose text occurs under others too, with the class of equal texts and its size."""
    d = texts.filter(F.col(text).isNotNull()).select(key, F.sha2(F.col(text), 256).alias("hash")).distinct()
    n = d.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    return d.join(n, "hash").select(key, "hash", "n")
