"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waygrid import queries as registry

SUBJECTS = ("geo", "spatial", "aggregates", "ordered", "raster", "graph", "lines", "text", "world", "streams", "places", "network", "moves", "terrain", "trips", "traces", "shapes", "pulling", "journeys", "mesh", "turns", "notes", "enroute")
Query = Callable[[SparkSession, str], DataFrame]


def _loaded():
    for subject in SUBJECTS:
        importlib.import_module(f"waygrid.queries.{subject}")
    return registry


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each site lies, its nearest edge, and how its trip crosses the zones."""
    return _loaded().QUERIES["trip_overview"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_loaded().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_loaded().ORACLE)
