"""Logical tables derived from the driver's tables, as SQL that Spark and DuckDB read alike.

In a query ``$name`` stands for a derived table and ``@name`` for one of the driver's.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "sites": "SELECT s_suppkey AS id, CAST((s_suppkey * 7919) % 10007 AS DOUBLE) AS x, CAST((s_suppkey * 104729) % 10009 AS DOUBLE) AS y, s_name AS name, s_nationkey AS kind FROM @supplier",
    "circles": "SELECT c_custkey AS cid, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y, CAST(35 + c_custkey % 30 AS DOUBLE) AS r, c_nationkey AS side FROM @customer",
    "docks": "SELECT kind AS id, min_by(x, id) AS x, min_by(y, id) AS y FROM $sites GROUP BY kind",
    "people": "SELECT c_custkey AS pid, CAST((c_custkey * 6007) % 10007 AS DOUBLE) AS x, CAST((c_custkey * 15013) % 10009 AS DOUBLE) AS y, c_nationkey AS kind FROM @customer",
    "zones": "SELECT n_nationkey AS map_id, n_name AS name, CAST((n_nationkey % 5) * 2000 - 100 AS DOUBLE) AS minx, CAST((n_nationkey % 5) * 2000 + 2100 + n_nationkey AS DOUBLE) AS maxx, CAST(floor(n_nationkey / 5) * 2000 - 100 AS DOUBLE) AS miny, CAST(floor(n_nationkey / 5) * 2000 + 2100 + n_nationkey AS DOUBLE) AS maxy FROM @nation",
    "cells": "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS r, p_partkey % 50 AS c, CASE WHEN p_size % 5 = 0 THEN 2 WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS v, CAST(p_size AS BIGINT) AS h FROM @part",
    "arcs": "SELECT p_partkey AS a, CAST(floor(p_partkey / 2) AS BIGINT) AS b, CAST(1 + p_partkey % 7 AS DOUBLE) AS w FROM @part WHERE p_partkey > 0 UNION ALL SELECT p_partkey AS a, (p_partkey * 37 + 11) % (SELECT max(p_partkey) + 1 FROM @part) AS b, CAST(3 + p_partkey % 11 AS DOUBLE) AS w FROM @part",
    "edges": "SELECT a, b, w FROM $arcs WHERE a <> b UNION ALL SELECT b AS a, a AS b, w FROM $arcs WHERE a <> b",
    "forest": "SELECT p_partkey AS a, p_partkey - p_partkey % 16 + CAST(floor((p_partkey % 16) / 2) AS BIGINT) AS b FROM @part",
    "trees": "SELECT p_partkey AS a, p_partkey - p_partkey % 16 + CASE WHEN p_partkey % 16 % 3 = 0 THEN CAST(floor(p_partkey % 16 / 3) AS BIGINT) ELSE p_partkey % 16 - 1 END AS b, CAST(1 + (p_partkey * 7) % 50 AS DOUBLE) AS w FROM @part WHERE p_partkey % 16 > 0",
    "tracks": "SELECT user_id, event_id, ts, SUM(CAST((event_id * 37) % 41 - 20 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x, SUM(CAST((event_id * 53) % 43 - 21 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM @events",
    "segments": "SELECT s_suppkey AS id, CAST((s_suppkey * 7919) % 10007 AS DOUBLE) AS x1, CAST((s_suppkey * 104729) % 10009 AS DOUBLE) AS y1, CAST(((s_suppkey + 1) * 7919) % 10007 AS DOUBLE) AS x2, CAST(((s_suppkey + 1) * 104729) % 10009 AS DOUBLE) AS y2 FROM @supplier",
    "walls": "SELECT c_custkey AS wid, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x1, CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y1, CAST((c_custkey * 7919) % 10007 + 150 + c_custkey % 90 AS DOUBLE) AS x2, CAST((c_custkey * 104729) % 10009 + 60 - c_custkey % 130 AS DOUBLE) AS y2 FROM @customer",
    "flights": "SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst, CAST(1000 + (n_nationkey * 131) % 900 AS DOUBLE) AS yards FROM @nation UNION ALL SELECT n_nationkey AS src, (n_nationkey * 3 + 8) % 25 AS dst, CAST(1500 + (n_nationkey * 71) % 800 AS DOUBLE) AS yards FROM @nation",
    "way_lines": "SELECT s_suppkey AS id, concat('/way #', CAST(s_nationkey AS VARCHAR(9)), ' ', CAST((s_suppkey * 37) % 100 AS VARCHAR(9)), '.5 ', CAST((s_suppkey * 53) % 100 AS VARCHAR(9)), '.25 ', s_name) AS line FROM @supplier",
    "hops": "SELECT l_orderkey AS path, CAST(l_linenumber AS BIGINT) AS seq, l_partkey, CAST((l_partkey * 17) % 400 AS DOUBLE) AS x, CAST((l_suppkey * 29) % 300 AS DOUBLE) AS y FROM @lineitem",
    "boxes": "SELECT p_partkey AS box, CAST((p_partkey * 3571) % 10007 AS DOUBLE) AS minx, CAST((p_partkey * 3571) % 10007 + 40 + p_size AS DOUBLE) AS maxx, CAST((p_partkey * 2857) % 10009 AS DOUBLE) AS miny, CAST((p_partkey * 2857) % 10009 + 60 + p_size AS DOUBLE) AS maxy FROM @part",
}


def for_duckdb(sql: str) -> str:
    return re.sub(r"@(\w+)", r"\1", _aliased(sql))


def for_spark(sql: str, sf_dir: str) -> str:
    return re.sub(r"@(\w+)", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", _aliased(sql)).replace("VARCHAR(9)", "STRING")


def _aliased(sql: str) -> str:
    """Put subqueries in place; a table without an alias is called by its own name."""
    keywords = r"(?:WHERE|JOIN|ON|GROUP|ORDER|UNION|LEFT|CROSS|USING|LIMIT|SEMI|ANTI|INNER|ASOF|HAVING|WINDOW|QUALIFY|EXCEPT|INTERSECT)\b"

    def put(found: re.Match) -> str:
        alias = found[2] if found[2] and not re.match(keywords, found[2], re.IGNORECASE) else None
        tail = "" if alias else found[0][len("$" + found[1]) :]
        return f"({TABLES[found[1]]}) AS {alias or found[1]}{tail}"

    while re.search(r"\$[a-z]", sql):
        sql = re.sub(r"\$([a-z]\w*)(?:[ \n]+(?:AS[ \n]+)?([A-Za-z]\w*))?", put, sql)
    return sql


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(for_spark(sql, sf_dir))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, TABLES[name])
