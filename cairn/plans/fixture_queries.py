"""Queries over the fixture repository: extraction, resolution, routes and reports, each against
rows recorded from a run and checked by reading the fixture: they hold results fast, they do not compute them anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.operators import chunking, clones, docs, extract, graph, listings, resolve, routes
from cairn.plans import fixtures as X
from cairn.plans.expected import EXPECTED
from cairn.session import cut

Q: dict = {}


def _raw(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("r", p, t) for p, t in X.FILES.items()], "repo_id string, path string, content string")


def _known(spark: SparkSession):
    """(facts, symbols, imports, import targets, calls) of the fixture."""
    f = cut(extract.extract(_raw(spark)))
    i = extract.imports_table(f)
    return f, extract.symbols_table(f), i, resolve.resolve_imports(f, i), extract.calls_table(f)


def query(f):
    Q[f.__name__] = lambda spark, d: f(spark)
    return f


@query
def fixture_symbols(spark):
    return _known(spark)[1].select("file_path", "qualified_name", "kind", "owner", "start_line", "end_line", "is_test", "has_doc")


@query
def fixture_imports(spark):
    return _known(spark)[3].select("file_path", "module", "target", "bind")


@query
def fixture_calls(spark):
    _, s, _, t, c = _known(spark)
    name = s.select(F.col("id").alias("to_symbol_id"), F.concat_ws(":", "file_path", "qualified_name").alias("target"))
    return resolve.resolve_calls(s, c, t).join(name, "to_symbol_id", "left").select("file_path", "from_name", "to_name", "kind", "line", "target", "confidence")


@query
def fixture_env(spark):
    f, s, *_ = _known(spark)
    e = extract.enclosing(extract.env_table(f), s).join(s.select(F.col("id").alias("symbol_id"), F.col("qualified_name").alias("symbol")), "symbol_id", "left")
    return e.select("file_path", "name", "line", "default_value", "required", "is_secret", "symbol")


@query
def fixture_debt(spark):
    f, s, *_ = _known(spark)
    e = extract.enclosing(extract.debt_table(f), s).join(s.select(F.col("id").alias("symbol_id"), F.col("qualified_name").alias("symbol")), "symbol_id", "left")
    return e.select("file_path", "tag", "text", "line", "assignee", "symbol")


@query
def fixture_endpoints(spark):
    _, s, i, t, _ = _known(spark)
    r = cut(routes.detect_files(_raw(spark)))
    e = routes.build_endpoints(*(routes.table_of(r, k) for k in ("routes", "routers", "includes")), routes.bindings(i, t), s)
    return e.select("method", "path", "handler", "framework", "file_path", "partial", F.col("handler_symbol_id").isNotNull().alias("linked"))


@query
def fixture_missing_docs(spark):
    _, s, _, t, c = _known(spark)
    return listings.missing_docs(s, resolve.references(s, c, t)).select("qualified_name", "file_path", "callers")


@query
def fixture_symbol_search(spark):
    _, s, _, t, c = _known(spark)
    return listings.symbol_search(s, resolve.references(s, c, t), "store").select("qualified_name", "score", "callers")


@query
def fixture_clones(spark):
    s = _known(spark)[1].filter("norm_hash is not null")
    members = F.array_join(F.transform("members", lambda m: F.concat(m["file_path"], F.lit(":"), m["start_line"].cast("string"))), ",")
    return clones.exact_groups(clones.eligible(s)).select(members.alias("members"), "size", "duplicated_lines", "value")


def _pairs(spark):
    v = spark.createDataFrame([(i, [a, b], f"f{i}", 1, 9, 8) for i, a, b in X.VECTORS], "id bigint, vector array<double>, file_path string, start_line int, end_line int, span int")
    return clones.similar_pairs(v)


@query
def fixture_linkage(spark):
    g = clones.linkage_groups(_pairs(spark), 0.97)
    return g.select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "avg_similarity")


@query
def fixture_duplicates(spark):
    """The exact groups of the fixture, and one similar pair made of two of its functions."""
    s = _known(spark)[1]
    a, b = (s.filter(F.col("qualified_name") == n).select("id").first().id for n in ("health", "read_item"))
    pairs = spark.createDataFrame([(min(a, b), max(a, b), 0.95)], "a bigint, b bigint, sim double")
    long = s.withColumn("end_line", F.col("end_line") + 4)  # functions of five lines and more take part
    g = clones.duplicate_groups(long, pairs)
    return g.select("type", F.array_join(F.transform("members", lambda m: F.concat(m["file_path"], F.lit(":"), m["start_line"].cast("string"))), ",").alias("members"), "size", "duplicated_lines", "avg_similarity", "value")


@query
def fixture_top_callers(spark):
    _, s, _, t, c = _known(spark)
    d = graph.top_callers(s, resolve.references(s, c, t)).join(s.select("id", "qualified_name", "file_path"), "id")
    return d.select("file_path", "qualified_name", F.array_join("callers", ",").alias("callers"))


def _impact(spark):
    _, s, _, t, c = _known(spark)
    return graph.impact(s, resolve.references(s, c, t), s.filter("qualified_name = 'Store.total'").first().id, 3)


@query
def fixture_impact(spark):
    return _impact(spark)[0].select("depth", "confidence", "qualified_name", "file_path", "is_test")


@query
def fixture_impact_summary(spark):
    return _impact(spark)[1]


@query
def fixture_docs(spark):
    a = spark.createDataFrame(X.ANSWERS, "id bigint, language string, name string, signature string, answer string")
    out = None
    for style in ("google", "numpy", "rest"):
        d = docs.documented(a, style).select("id", F.lit(style).alias("style"), "ok", "error", "comment", F.array_join("params", ",").alias("params"))
        out = d if out is None else out.unionByName(d)
    return out


@query
def fixture_chunks(spark):
    return chunking.structure_chunks(_raw(spark)).select("file_path", "symbol_name", "symbol_kind", "start_line", "end_line")


def _value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in x.split("\n"))


def sql_of(columns: str, rows: list[tuple]) -> str:
    """The expected rows as SQL; ``columns`` are names with their types."""
    cols = [c.split() for c in columns.split(", ")]
    names = ", ".join(c for c, _ in cols)
    return f"SELECT {', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in cols)} FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) v({names})"


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return {name: sql_of(columns, rows) for name, (columns, rows) in EXPECTED.items()}
