"""Queries over the driver's tables, by subject; each registers itself with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waygrid.sources.fixtures import for_duckdb, run_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query; ``sql`` may name derived tables by ``$`` and driver tables by ``@``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = for_duckdb(sql)
        return f

    return add


def shared(name: str, spark_sql: str, duckdb_sql: str | None = None) -> None:
    """Register a query that both engines read as SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, sf_dir, spark_sql)

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = for_duckdb(duckdb_sql or spark_sql)
