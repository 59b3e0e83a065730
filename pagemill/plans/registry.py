"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import page_queries, usage_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return page_queries.QUERIES | usage_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return page_queries.SQL | usage_queries.SQL
