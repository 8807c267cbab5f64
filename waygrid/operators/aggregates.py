"""Aggregates, ranked search and first-wins unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_circles(circles: DataFrame, size: float, margin: float) -> DataFrame:
    """One circle for each square cell: mean centre, largest radius plus a margin."""
    return circles.groupBy(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), (F.max("r") + margin).alias("r"), F.count("*").alias("n")
    )


def central_members(members: DataFrame, group: str, member: str, least: int = 2) -> DataFrame:
    """Of each group of ``least`` or more the member nearest to the group's mean place; ties by id.

    The means come back to the members by the group key, so a large group is averaged map-side and split by the
    adaptive join.
    """
    means = members.groupBy(group).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("size")).filter(F.col("size") >= least)
    d = F.sqrt((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")))
    return members.join(means, group).groupBy(group).agg(F.min(F.struct(F.round(d, 6).alias("d"), F.col(member).alias("m"))).alias("best"), F.max("size").alias("size")).select(group, F.col("best.m").alias(member), "size")


def first_wins(sources: list[DataFrame], key: list[Column], columns: list[str]) -> DataFrame:
    """Union in list order; of rows with one key the first source's is kept, then the lowest id."""
    rows = reduce(DataFrame.unionByName, [df.select(*columns).withColumn("source", F.lit(i)) for i, df in enumerate(sources)])
    order = Window.partitionBy(*key).orderBy("source", columns[0])
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _starting(word: str):
    return lambda w: w.startswith(word)


def search(names: DataFrame, asked: str, name: str, ident: str, most: int = 8) -> DataFrame:
    """Ranked search: names that start with the text, then those that contain it or whose words start with its words.

    Each rank is ordered by length, name and id.  Texts of fewer than two characters find nothing.
    """
    low, text = F.lower(F.col(name)), asked.strip().lower()
    words = text.split()
    starts = F.lit(True)
    for word in words:
        starts = starts & F.exists(F.split(low, r"\s+"), _starting(word))
    rank = F.when(low.startswith(text), 0).when(low.contains(text) | starts, 1)
    found = names.withColumn("rank", rank).filter(F.col("rank").isNotNull() & F.lit(len(text) >= 2))
    return found.orderBy("rank", F.length(name), name, ident).limit(most)
