"""Named queries over the test tables and the fixture repository, and their SQL; ``__spark_entry__`` serves them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.plans import core_queries, fixture_queries, reference_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return core_queries.QUERIES | reference_queries.queries() | fixture_queries.queries() | text_queries.queries()


def oracle_sql() -> dict[str, str]:
    return core_queries.SQL | reference_queries.oracle_sql() | fixture_queries.oracle_sql() | text_queries.oracle_sql()
