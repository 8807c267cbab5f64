"""Triangles on a grid: coverage with heights, slices, and areas filled by crossing parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def covered_cells(triangles: DataFrame, triangle: str = "tri") -> DataFrame:
    """``tri, r, c, z``: the cells of which a triangle ``x1, y1, z1 .. z3`` covers the middle, with its height there.

    A middle on an edge belongs to the triangle if the edge is a left or top one, so triangles that share an edge share no
    cell.  A row of the grid is cut by the triangle's sides first, so a thin diagonal triangle costs the cells near it and not
    its box.  Triangles without an area cover nothing.
    """
    x1, y1, x2, y2, x3, y3 = _c("x1", "y1", "x2", "y2", "x3", "y3")
    area = (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)
    rows = triangles.withColumn("area", area).filter("area <> 0")
    # Two corners change places where the triangle runs the other way round.
    turn = F.col("area") < 0
    swapped = {f"{k}{i}": F.when(turn, F.col(f"{k}{5 - i}")).otherwise(F.col(f"{k}{i}")) for k in "xyz" for i in (2, 3)}
    rows = rows.withColumns(swapped).withColumn("area", F.abs("area"))
    first, last = F.ceil(F.least(y1, y2, y3) - 0.5), F.floor(F.greatest(y1, y2, y3) - 0.5)
    rows = rows.filter(first <= last).withColumn("r", F.explode(F.sequence(first, last)))
    y = F.col("r") + 0.5
    cuts = [F.when((y >= F.least(b, d)) & (y <= F.greatest(b, d)) & (b != d), a + (c - a) * ((y - b) / (d - b))) for a, b, c, d in ((x1, y1, x2, y2), (x2, y2, x3, y3), (x3, y3, x1, y1))]
    left, right = F.floor(F.least(*cuts) - 0.5), F.ceil(F.greatest(*cuts) - 0.5)
    rows = rows.filter(left <= right).withColumn("c", F.explode(F.sequence(left, right)))
    x = F.col("c") + 0.5

    def side(a, b, c, d) -> tuple[Column, Column]:
        """Twice the area beside an edge, and whether a middle on the edge counts."""
        return (c - a) * (y - b) - (d - b) * (x - a), ((d - b) < 0) | ((d == b) & (c > a))

    sides = [side(x2, y2, x3, y3), side(x3, y3, x1, y1), side(x1, y1, x2, y2)]
    inside = F.lit(True)
    for e, owns in sides:
        inside = inside & ((e > 0) | ((e == 0) & owns))
    z = (sides[0][0] * F.col("z1") + sides[1][0] * F.col("z2") + sides[2][0] * F.col("z3")) / F.col("area")
    return rows.filter(inside).select(triangle, "r", "c", z.alias("z"))


def slices(triangles: DataFrame, height: Column, triangle: str = "tri", carry: tuple[str, ...] = ()) -> DataFrame:
    """``tri, *carry, x1, y1, x2, y2``: where triangles pass through a height; corners at that height itself count as above it."""
    def crossing(i: int, j: int) -> Column:
        a, b = F.col(f"z{i}") - height, F.col(f"z{j}") - height
        t = a / (a - b)
        point = F.struct((F.col(f"x{i}") + (F.col(f"x{j}") - F.col(f"x{i}")) * t).alias("x"), (F.col(f"y{i}") + (F.col(f"y{j}") - F.col(f"y{i}")) * t).alias("y"))
        return F.when((a < 0) != (b < 0), point)

    found = triangles.withColumn("p", F.filter(F.array(crossing(1, 2), crossing(2, 3), crossing(3, 1)), lambda p: p.isNotNull())).filter("size(p) = 2")
    p, q = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return found.select(triangle, *carry, p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))


def filled(outlines: DataFrame, shape: str) -> DataFrame:
    """``shape, r, first, last``: the runs of cells whose middles lie inside of each shape's outline segments ``x1, y1, x2, y2``.

    Each segment is met by the rows that it passes (its upper end excluded, so a corner counts once); along a row the crossings
    open and shut the area in turn.
    """
    x1, y1, x2, y2 = _c("x1", "y1", "x2", "y2")
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    first, last = F.ceil(low - 0.5), F.ceil(high - 0.5) - 1
    met = outlines.filter(first <= last).withColumn("r", F.explode(F.sequence(first, last)))
    at = met.select(shape, "r", (x1 + (x2 - x1) * ((F.col("r") + 0.5 - y1) / (y2 - y1))).alias("x"))
    w = Window.partitionBy(shape, "r").orderBy("x")
    turns = at.withColumns({"n": F.row_number().over(w), "until": F.lead("x").over(w)}).filter("n % 2 = 1 AND until IS NOT NULL")
    runs = turns.select(shape, "r", F.ceil(F.col("x") - 0.5).alias("first"), (F.ceil(F.col("until") - 0.5) - 1).alias("last"))
    return runs.filter("first <= last")


def shares(runs: DataFrame, size: int) -> DataFrame:
    """``r, c, share``: how much of each block of ``size`` x ``size`` cells any run ``r, first, last`` covers; blocks without any are left out."""
    cells = runs.select("r", F.explode(F.sequence("first", "last")).alias("c")).distinct()
    return cells.groupBy(F.floor(F.col("r") / size).alias("r"), F.floor(F.col("c") / size).alias("c")).agg((F.count("*") / (size * size)).alias("share"))
