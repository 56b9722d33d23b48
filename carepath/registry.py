"""Every query of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carepath.plans import check_queries, record_queries, table_queries, text_queries, value_queries  # noqa: F401  the others add their queries to those of table_queries

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_queries.QUERIES["trailing_run"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(table_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(table_queries.SQL)
