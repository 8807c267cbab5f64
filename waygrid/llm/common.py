"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygrid.plans.scratch import shared_dir, written

__all__ = ["fold", "keep_ids", "shared_dir", "table", "worker_state", "written"]

#: Rows of one or two numbers that may be broadcast: some 30 MB of hash table at most.
BROADCAST_ROWS = 1_000_000

_state: dict[str, Any] = {}


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps from task to task under ``name``.

    Spark hands a worker from one operator's tasks to the next one's, so only one state is kept: an operator's
    memos go when another operator asks for its own, and the memory of a worker is that of one operator.
    """
    if name not in _state:
        _state.clear()
        _state[name] = make()
    return _state[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key, n: int):
    """``crc32(key as text) mod n``: the fixed split of rows into learning and held-out ones."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def keep_ids(docs: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose key is (``left_semi``) or isn't (``left_anti``) in ``ids``, a written table of keys.

    A counted, small enough list of keys goes to the rows, so that texts stay where they are; a longer one meets
    them in a shuffle.
    """
    ids = ids.select(ids[key].alias("_id"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("merge")
    return docs.join(ids, docs[key] == ids["_id"], how)
