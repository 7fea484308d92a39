"""Queries of the text operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm import credentials, language, leakage, neighbours, provenance, split, syntax, tokenize_corpus
from cairn.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.examined(table(spark, d, "raw_files"), locate=False).filter("not valid").select("repo_id", "path")


def p1_repairs(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "raw_files"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "raw_files"), table(spark, d, "files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(table(spark, d, "files"), table(spark, d, "raw_files"))


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    return provenance.label_files(table(spark, d, "files"), table(spark, d, "raw_files"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per split chunk: its first piece."""
    return p3_pieces(spark, d).filter("piece = 0").select("id")


def p3_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of a chunk without what they repeat, put together again, and whether each keeps to the limit."""
    p = p3_pieces(spark, d).select("id", F.struct("piece", F.expr("substring(content, n_repeated + 1)").alias("text")).alias("p"), (F.expr("length(content) div 4") <= split.LIMIT).alias("fits"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["text"]), "")
    return p.groupBy("id").agg(F.md5(whole).alias("digest"), F.bool_and("fits").alias("fits"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.found(table(spark, d, "chunks"), table(spark, d, "env_vars"))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.scan(table(spark, d, "chunks"), table(spark, d, "env_vars"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, d, "chunks"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize_corpus.encode_corpus(table(spark, d, "documents"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The texts read back from their token ids."""
    return tokenize_corpus.decode_corpus(p8_ids(spark, d)).select("doc_id", F.md5("text").alias("digest"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).filter("edits = 0").select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.label_errors(table(spark, d, "documents"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.language_segments(table(spark, d, "documents")).drop("lang")


P3_SQL = "SELECT DISTINCT id FROM chunks WHERE greatest(1, length(content) // 4) > 600"

P3_ROUND_SQL = "SELECT DISTINCT id, md5(content) AS digest, true AS fits FROM chunks WHERE greatest(1, length(content) // 4) > 600"
P8_ROUND_SQL = "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents"

P9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(ws[k:k + 11], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS k FROM w WHERE len(ws) >= 12)),
iw AS (SELECT item_id, array_to_string(ws[k:k + 11], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS k FROM i WHERE len(ws) >= 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)
"""
# with few vectors every cell is asked, so the operator is exact and SQL can say the same
P7_SQL = """
WITH v AS (SELECT DISTINCT ON (id) id, embedding::DOUBLE[] AS e FROM chunks WHERE embedding IS NOT NULL AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
s AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.id) AS k FROM v a JOIN v b ON a.id <> b.id)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM s WHERE k <= 5
"""

_QUERIES = {"p1_found": p1_found, "p1_repairs": p1_repairs, "p1_rates": p1_rates, "p2_found": p2_found, "p2_labels": p2_labels, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_roundtrip": p3_roundtrip, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_found": p7_found, "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_segments": p10_segments}
_SQL = {"p3_found": P3_SQL, "p3_roundtrip": P3_ROUND_SQL, "p8_roundtrip": P8_ROUND_SQL, "p7_found": P7_SQL, "p9_found": P9_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
