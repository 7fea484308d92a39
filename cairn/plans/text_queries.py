"""Scalar functions over whole tables: labels, titles, scores and lines, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import index
from cairn.session import table

Q: dict = {}
S: dict[str, str] = {}
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def query(sql: str):
    def keep(f):
        Q[f.__name__], S[f.__name__] = f, sql
        return f

    return keep


def _texts(spark, d):
    return table(spark, d, "documents").filter("text is not null")


@query("WITH t AS (SELECT doc_id, " + _strip("regexp_replace(text, '(?s)<think>.*?</think>', '', 'g')") + r""" AS t FROM documents WHERE text IS NOT NULL), e AS (SELECT *, regexp_replace(t, '\s+$', '') AS u FROM t)
SELECT doc_id, md5(t) AS digest FROM e WHERE u <> '' AND len(regexp_extract_all(u, '[.!?]\s+')) + 1 BETWEEN 2 AND 8 AND length(t) <= 900 AND NOT contains(t, '```') AND NOT contains(t, '**') AND NOT regexp_matches(t, '(?m)^\s*(\d+[.)]|[-*•])\s')""")
def usable_summaries(spark, d):
    """The texts that could stand as a summary."""
    return _texts(spark, d).select("doc_id", F.md5(T.usable_summary(F.col("text"))).alias("digest")).filter("digest is not null")


def _mermaid(text: str, limit: int) -> str:
    x = _strip(f"regexp_replace({text}, '{_SPACE}+', ' ', 'g')")
    x = f"CASE WHEN length({x}) > {limit} THEN '…' || right({x}, {limit - 1}) ELSE {x} END"
    x = f"replace({x}, '%%', '%')"
    for c, e in (("#", "#35;"), ('"', "#quot;"), ("<", "#lt;"), (">", "#gt;"), ("&", "#amp;"), ("|", "#124;")):
        x = f"replace({x}, '{c}', '{e}')"
    return f"CASE WHEN {x} = '' THEN '?' ELSE {x} END"


@query(f"SELECT doc_id, {_mermaid('text', 44)} AS label, {_mermaid('''replace(text, ';', ',')''', 60)} AS message FROM documents WHERE text IS NOT NULL")
def mermaid_texts(spark, d):
    return _texts(spark, d).select("doc_id", T.mermaid_label(F.col("text")).alias("label"), T.mermaid_message(F.col("text")).alias("message"))


@query(rf"""WITH l AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_split_to_array({_strip('text')}, '{_LINES}')[1], '^["''`*. :-]+|["''`*. :-]+$', '', 'g'), '^Label:', ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN l <> '' AND length(l) <= 40 AND len(regexp_split_to_array(l, '\s+')) <= 5 AND NOT regexp_matches(l, '[{{}}\[\]<>]') THEN upper(l[1:1]) || l[2:] END AS label FROM l""")
def clean_labels(spark, d):
    return _texts(spark, d).select("doc_id", T.clean_label(F.col("text")).alias("label"))


@query("SELECT doc_id, (" + _strip("text") + r""")[1:120] AS renamed, md5(CASE WHEN length(text) > 600 THEN text[1:600] || ' ...' ELSE text END) AS gist, text[1:80] AS title,
  md5(CASE WHEN regexp_matches(text, '[.!?]\n?$') OR text = '' THEN text ELSE text || '.' END) AS sentence FROM documents WHERE text IS NOT NULL""")
def short_texts(spark, d):
    t = F.col("text")
    return _texts(spark, d).select("doc_id", F.md5(T.gist(t)).alias("gist"), T.create_title(t).alias("title"), T.rename_title(t).alias("renamed"), F.md5(T.sentence(t)).alias("sentence"))


@query(rf"""SELECT repo_id, path, CASE WHEN len(regexp_extract_all(content, '\r\n')) * 2 > len(regexp_extract_all(content, '\n')) THEN 'crlf' ELSE 'lf' END AS line_end,
  CASE WHEN content = '' THEN 0 ELSE len(regexp_split_to_array(content, '{_LINES}')) - CASE WHEN regexp_split_to_array(content, '{_LINES}')[-1] = '' THEN 1 ELSE 0 END END::INT AS lines FROM raw_files WHERE content IS NOT NULL""")
def source_lines(spark, d):
    c = F.col("content")
    return table(spark, d, "raw_files").filter("content is not null").select("repo_id", "path", F.when(T.line_ending(c) == "\r\n", "crlf").otherwise("lf").alias("line_end"), F.size(T.lines_of(c)).alias("lines"))


@query(r"""WITH s AS (SELECT DISTINCT symbol_name AS name, repo_id || '.' || symbol_name AS q FROM chunks WHERE symbol_name IS NOT NULL AND repo_id IS NOT NULL), l AS (SELECT name, q, lower(name) AS a, lower(q) AS b FROM s),
c AS (SELECT name, q, CASE WHEN a = 'load' OR b = 'load' THEN 100 WHEN starts_with(a, 'load') THEN 80 WHEN starts_with(b, 'load') THEN 70 WHEN contains(a, 'load') THEN 60 WHEN contains(b, 'load') THEN 50 WHEN regexp_matches(b, '(?s)l.*o.*a.*d') THEN 30 END AS score FROM l)
SELECT name, q AS qualified, score FROM c WHERE score IS NOT NULL""")
def name_scores(spark, d):
    s = table(spark, d, "chunks").filter("symbol_name is not null and repo_id is not null").select(F.col("symbol_name").alias("name"), F.concat_ws(".", "repo_id", "symbol_name").alias("qualified")).distinct()
    return s.withColumn("score", T.name_score("Load", F.col("name"), F.col("qualified"))).filter("score is not null")


@query("SELECT DISTINCT id, repo_id || '-' || id AS public_id, repo_id AS repo, id::VARCHAR AS chunk FROM chunks WHERE repo_id IS NOT NULL")
def public_ids(spark, d):
    c = table(spark, d, "chunks").filter("repo_id is not null").select("id", T.public_id(F.col("repo_id"), F.col("id")).alias("public_id")).distinct()
    p = T.parse_public_id(F.col("public_id"))
    return c.select("id", "public_id", p["repo_id"].alias("repo"), p["chunk_id"].alias("chunk"))


@query("SELECT DISTINCT target, list_last(regexp_split_to_array(target, '[.:]+')) AS last FROM endpoint_includes WHERE target IS NOT NULL")
def last_segments(spark, d):
    return table(spark, d, "endpoint_includes").filter("target is not null").select("target", T.last_segment(F.col("target")).alias("last")).distinct()


@query("SELECT DISTINCT default_value, CASE WHEN regexp_matches(default_value, '[\\s\"''#$\\\\]') THEN '\"' || replace(replace(default_value, '\\', '\\\\'), '\"', '\\\"') || '\"' ELSE default_value END AS quoted FROM env_vars WHERE default_value IS NOT NULL")
def quoted_defaults(spark, d):
    return table(spark, d, "env_vars").filter("default_value is not null").select("default_value", T.quote_env(F.col("default_value")).alias("quoted")).distinct()


@query(rf"""WITH c AS (SELECT DISTINCT ON (id) id, repo_id, file_path, start_line, end_line, content FROM chunks WHERE content IS NOT NULL AND repo_id IS NOT NULL AND file_path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL),
s AS (SELECT repo_id, path, CASE WHEN content = '' THEN [] WHEN regexp_split_to_array(content, '{_LINES}')[-1] = '' THEN regexp_split_to_array(content, '{_LINES}')[:-2] ELSE regexp_split_to_array(content, '{_LINES}') END AS l FROM raw_files WHERE content IS NOT NULL),
k AS (SELECT id, CASE WHEN content = '' THEN [] WHEN regexp_split_to_array(content, '{_LINES}')[-1] = '' THEN regexp_split_to_array(content, '{_LINES}')[:-2] ELSE regexp_split_to_array(content, '{_LINES}') END AS own FROM c)
SELECT c.id, greatest(start_line - 30, 1) AS first, least(end_line + 30, len(l))::INT AS last, md5(array_to_string(l[greatest(start_line - 30, 1):least(end_line + 30, len(l))], chr(10))) AS digest, array_to_string(l[start_line:end_line], chr(10)) <> array_to_string(own, chr(10)) AS stale
FROM c JOIN k USING (id) JOIN s ON s.repo_id = c.repo_id AND s.path = c.file_path""")
def chunk_previews(spark, d):
    return index.chunk_preview(table(spark, d, "chunks"), table(spark, d, "raw_files")).select("id", "first", "last", F.md5("shown").alias("digest"), "stale")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(S)
