"""Polylines: simplification, smoothing, packing and turn detection, one line at a time in a task.

Lines are arrays of structs ``x, y``; what can be said with array functions is, and only scans that carry state
along a line (Douglas-Peucker) run as Arrow-fed Python over one line.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygrid.plans.scratch import discard, written


def length(points: Column) -> Column:
    """Sum of the segment lengths."""
    nexts = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), nexts, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))
    return F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)


def chaikin(points: Column) -> Column:
    """One round of corner cutting: each segment gives its points at a quarter and three quarters; ends stay."""
    n = F.size(points)
    cut = F.flatten(
        F.zip_with(
            F.slice(points, 1, n - 1),
            F.slice(points, 2, n - 1),
            lambda a, b: F.array(
                F.struct((a["x"] * 0.75 + b["x"] * 0.25).alias("x"), (a["y"] * 0.75 + b["y"] * 0.25).alias("y")),
                F.struct((a["x"] * 0.25 + b["x"] * 0.75).alias("x"), (a["y"] * 0.25 + b["y"] * 0.75).alias("y")),
            ),
        )
    )
    return F.when(n < 3, points).otherwise(F.concat(F.slice(points, 1, 1), F.slice(cut, 2, F.size(cut) - 2), F.slice(points, -1, 1)))


def deltas(points: Column) -> Column:
    """The first point and then the steps, for packing."""
    before = F.concat(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))), F.slice(points, 1, F.size(points) - 1))
    return F.zip_with(points, before, lambda a, b: F.struct((a["x"] - b["x"]).alias("x"), (a["y"] - b["y"]).alias("y")))


def undeltas(steps: Column) -> Column:
    """Running sums: the points that ``deltas`` was made of."""
    start = F.array().cast("array<struct<x:double,y:double>>")
    last = lambda acc, f: F.when(F.size(acc) == 0, 0.0).otherwise(F.element_at(acc, -1)[f])
    return F.aggregate(steps, start, lambda acc, s: F.concat(acc, F.array(F.struct((last(acc, "x") + s["x"]).alias("x"), (last(acc, "y") + s["y"]).alias("y")))))


def _simplified(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Positions kept by Douglas-Peucker, without recursion."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        size = dx * dx + dy * dy
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        t = np.clip((px * dx + py * dy) / size, 0, 1) if size else np.zeros(len(px))
        d = (px - t * dx) ** 2 + (py - t * dy) ** 2
        at = int(d.argmax())
        if d[at] > tolerance * tolerance:
            keep[a + 1 + at] = True
            todo += [(a, a + 1 + at), (a + 1 + at, b)]
    return np.nonzero(keep)[0]


def simplify(lines: DataFrame, tolerance: float, points: str = "points") -> DataFrame:
    """Douglas-Peucker on each line: no dropped point is farther than ``tolerance`` from the new line."""

    def run(column: pd.Series) -> pd.Series:
        out = []
        for line in column:
            if line is None or len(line) < 3:
                out.append(line)
                continue
            kept = _simplified(np.array([p["x"] for p in line], float), np.array([p["y"] for p in line], float), tolerance)
            out.append([line[i] for i in kept])
        return pd.Series(out)

    return lines.withColumn(points, F.pandas_udf(run, lines.schema[points].dataType)(points))


def merged_near(rows: DataFrame, group: list[str], order: str, reach: float, weight: str | None = None) -> DataFrame:
    """First-wins within ``reach``: rows of a group in ``order``, each joining the first kept row near it.

    ``*group, kept, x, y, n``: the kept rows' order value and place, and how many rows each stands for.  A row is kept if
    no earlier kept row is near.  Settled in rounds over cells so small that a cell's rows are all near each other: a row
    that comes before all undecided ones of its own and the 24 cells around is kept, and what is near it goes.  A round
    moves one row a cell and the undecided rows, of which repeated places are one; no group is read by one task.
    A row counts once, or as often as its ``weight`` says.
    """
    size = reach / np.sqrt(2) * (1 - 1e-9)
    cell = [*group, "cx", "cy"]
    every = rows.groupBy(*group, "x", "y").agg(F.min(order).alias("o"), (F.sum(weight) if weight else F.count("*")).alias("n"))
    every = written(every.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)}), "places")
    around = F.explode(F.expr("transform(sequence(0, 24), i -> struct(i div 5 - 2 AS dx, i % 5 - 2 AS dy))"))

    def seen_around(df: DataFrame, what: Column) -> DataFrame:
        """``*cell, it``: what each cell's neighbourhood holds."""
        df = df.select(*cell, what.alias("it"), around.alias("s"))
        return df.select(*group, (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), "it")

    def near(df: DataFrame, kept: DataFrame) -> DataFrame:
        d = (F.col("x") - F.col("it.x")) * (F.col("x") - F.col("it.x")) + (F.col("y") - F.col("it.y")) * (F.col("y") - F.col("it.y"))
        return df.join(seen_around(kept, F.struct("o", "x", "y")), cell).filter(d <= reach * reach)

    left, kept = every, None
    while left.limit(1).count():
        first = written(left.groupBy(*cell).agg(F.min(F.struct("o", "x", "y")).alias("first")), "first")
        rivals = seen_around(first, F.col("first")).groupBy(*cell).agg(F.min("it").alias("rival"))
        won = written(first.join(rivals, cell).filter("first = rival").select(*cell, "first.o", "first.x", "first.y"), "kept")
        gone = near(left, won).select(*cell, "x", "y").distinct()
        rest = written(left.join(gone, [*cell, "x", "y"], "left_anti"), "undecided")
        kept = won if kept is None else kept.unionByName(won)
        if left is not every:
            discard(left)
        discard(first)
        left = rest
    if kept is None:
        return every.select(*group, F.col("o").alias("kept"), "x", "y", "n")
    counted = near(every, kept).filter(F.struct("it.o", "it.x", "it.y") <= F.struct("o", "x", "y"))
    counted = counted.groupBy(*group, "x", "y", "n").agg(F.min("it").alias("it")).groupBy(*group, "it").agg(F.sum("n").alias("n"))
    return counted.select(*group, F.col("it.o").alias("kept"), "it.x", "it.y", "n")
