"""Queries of the general operators: incremental backlog and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.operators import hierarchy, incremental
from cairn.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.backlog(table(spark, d, "files"), table(spark, d, "chunks"))


def p4_status(spark: SparkSession, d: str) -> DataFrame:
    return incremental.backlog_by_repository(*(table(spark, d, t) for t in ("files", "chunks", "index_runs")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.router_paths(table(spark, d, "endpoint_routers"), table(spark, d, "endpoint_includes"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    nodes = hierarchy.router_nodes(table(spark, d, "endpoint_routers"), table(spark, d, "endpoint_includes"))
    return hierarchy.descendants(hierarchy.resolve_hierarchy(nodes))


def p5_cycles(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).filter("depth = -1").select("id")


P4_SQL = """
WITH cur AS (
  SELECT repo_id, path, arg_max(hash, indexed_at) AS hash FROM files
  WHERE repo_id IS NOT NULL AND path IS NOT NULL GROUP BY repo_id, path)
SELECT f.repo_id, f.path FROM cur f
LEFT JOIN (SELECT repo_id, file_path, min(file_hash) AS lo, max(file_hash) AS hi FROM chunks GROUP BY 1, 2) c
  ON c.repo_id = f.repo_id AND c.file_path = f.path
WHERE NOT coalesce(c.lo = f.hash AND c.hi = f.hash, false)
"""

P4_STATUS_SQL = f"""
WITH cur AS (SELECT repo_id, path, max(indexed_at) AS indexed_at FROM files WHERE repo_id IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2),
open AS ({P4_SQL}),
last AS (SELECT repo_id, max(finished_at) AS last_success FROM index_runs WHERE status = 'success' GROUP BY 1)
SELECT c.repo_id, count(*) AS n_files, count(o.path) AS n_backlog, max(l.last_success) AS last_success,
  count(*) FILTER (WHERE o.path IS NOT NULL AND c.indexed_at < epoch_us(l.last_success) / 1e6) AS n_dated_before
FROM cur c LEFT JOIN open o ON o.repo_id = c.repo_id AND o.path = c.path LEFT JOIN last l ON l.repo_id = c.repo_id GROUP BY 1
"""

P5_NODES = r"""
WITH RECURSIVE r AS (SELECT DISTINCT id, repo_id, file_path, var, prefix, parent_var FROM endpoint_routers),
inc AS (SELECT DISTINCT i.id, i.repo_id, i.file_path, i.line, i.target, i.prefix, p.id AS inc_parent
  FROM endpoint_includes i JOIN r p ON p.repo_id = i.repo_id AND p.file_path = i.file_path AND p.var = i.parent_var),
req AS (SELECT *, string_split(regexp_replace(file_path, '/?[^/]*$', ''), '/') AS dirs,
    len(regexp_extract_all(target, '\.\./')) AS up,
    regexp_replace(replace(substr(target, 9), '../', ''), '^\./', '') AS tail
  FROM inc WHERE starts_with(target, 'require:')),
stems AS (SELECT repo_id, regexp_replace(file_path, '\.[^./]*$', '') AS stem, min(id) AS id, count(*) AS n
  FROM r GROUP BY repo_id, file_path),
mounts AS (
  SELECT k.id AS key_id, i.file_path, i.line, i.id AS inc_id, i.inc_parent, i.prefix FROM inc i JOIN r k
    ON k.repo_id = i.repo_id AND k.file_path = i.file_path AND k.var = i.target
  UNION ALL
  SELECT k.id, i.file_path, i.line, i.id, i.inc_parent, i.prefix FROM inc i JOIN r k
    ON k.repo_id = i.repo_id AND replace(regexp_replace(k.file_path, '\.[^./]*$', ''), '/', '.') || '.' || k.var = i.target
  UNION ALL
  SELECT s.id, i.file_path, i.line, i.id, i.inc_parent, i.prefix FROM req i JOIN stems s
    ON s.repo_id = i.repo_id AND s.n = 1
    AND s.stem = array_to_string(list_concat(i.dirs[1:len(i.dirs) - i.up], string_split(i.tail, '/')), '/')),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY file_path, line, inc_id) AS rn FROM mounts) WHERE rn = 1),
node AS (
  SELECT r.id, coalesce(o.id, f.inc_parent) AS parent,
    list_filter([CASE WHEN o.id IS NULL AND f.key_id IS NOT NULL THEN trim(coalesce(f.prefix, ''), '/') ELSE '' END,
      trim(coalesce(r.prefix, ''), '/')], lambda x: x <> '') AS seg
  FROM r LEFT JOIN r o ON o.repo_id = r.repo_id AND o.file_path = r.file_path AND o.var = r.parent_var
  LEFT JOIN first f ON f.key_id = r.id),
tree AS (
  SELECT id, id AS root_id, 0 AS depth, seg, CAST([] AS BIGINT[]) AS anc FROM node WHERE parent IS NULL
  UNION ALL
  SELECT n.id, t.root_id, t.depth + 1, list_concat(t.seg, n.seg), list_append(t.anc, t.id) FROM node n JOIN tree t ON n.parent = t.id)
"""

P5_SQL = P5_NODES + """
SELECT n.id, coalesce(t.root_id, -1) AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth,
  CASE WHEN t.id IS NULL THEN '' ELSE '/' || array_to_string(t.seg, '/') END AS full_path
FROM node n LEFT JOIN tree t ON t.id = n.id
"""

P5_DESC_SQL = P5_NODES + """
SELECT anc[k] AS ancestor_id, id AS descendant_id, depth - k + 1 AS distance
FROM (SELECT id, depth, anc, unnest(range(1, len(anc) + 1)) AS k FROM tree)
"""

P5_CYCLE_SQL = P5_NODES + "SELECT id FROM node WHERE id NOT IN (SELECT id FROM tree)"

QUERIES = {"p4_found": p4_found, "p4_status": p4_status, "p5_found": p5_found, "p5_descendants": p5_descendants, "p5_cycles": p5_cycles}
SQL = {"p4_found": P4_SQL, "p4_status": P4_STATUS_SQL, "p5_found": P5_SQL, "p5_descendants": P5_DESC_SQL, "p5_cycles": P5_CYCLE_SQL}
