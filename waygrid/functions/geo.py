"""Geometry as column expressions; x points north, y west, distances are yards."""

from __future__ import annotations

import math
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Yards of a terrain tile and of a raster cell (fixed values).
TILE = 1600 / 3
CELL = TILE / 64


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def map_to_world(u: Column, v: Column, box: str = "") -> tuple[Column, Column]:
    """World position of a map fraction: u runs east, v south; ``box`` prefixes minx, maxx, miny, maxy."""
    at = lambda name: F.col(f"{box}{name}")
    return at("maxx") - v * (at("maxx") - at("minx")), at("maxy") - u * (at("maxy") - at("miny"))


def world_to_map(x: Column, y: Column, box: str = "") -> tuple[Column, Column]:
    at = lambda name: F.col(f"{box}{name}")
    return (at("maxy") - y) / (at("maxy") - at("miny")), (at("maxx") - x) / (at("maxx") - at("minx"))


def world_to_tile(x: Column, y: Column) -> tuple[Column, Column]:
    return F.floor(F.lit(32.0) - y / TILE), F.floor(F.lit(32.0) - x / TILE)


def rotated(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    a = F.radians(degrees)
    return x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def wrapped(degrees: Column) -> Column:
    """An angle in (-180, 180]."""
    turned = F.pmod(degrees, F.lit(360.0))
    return F.when(turned > 180, turned - 360).otherwise(turned)


def turned(degrees: Column) -> Column:
    """The difference of two headings in (-180, 180]; one that lies there already is kept to the last bit."""
    return F.when(degrees > 180, degrees - 360).when(degrees <= -180, degrees + 360).otherwise(degrees)


def heading(dy: Column, dx: Column) -> Column:
    """The angle of a direction in radians, as the C library gives it.

    Spark's own ``atan2`` differs from it in the last bit for one direction in six, which turns the sign of ways straight back.
    """
    return _heading()(dy.cast("double"), dx.cast("double"))


@cache
def _heading():
    @F.pandas_udf("double")
    def angle(dy: pd.Series, dx: pd.Series) -> pd.Series:
        return pd.Series(map(math.atan2, dy.tolist(), dx.tolist()), dtype=float)

    return angle


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from north of the way from 1 to 2."""
    return F.pmod(F.degrees(F.atan2(y1 - y2, x2 - x1)), F.lit(360.0))


def compass(degrees: Column) -> Column:
    """One of eight wind names."""
    names = F.array(*[F.lit(n) for n in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(names, (F.pmod(F.floor((degrees + 22.5) / 45), F.lit(8)) + 1).cast("int"))


def tenth(value: Column) -> Column:
    """Half-up rounding to a tenth, also below zero."""
    return F.floor(value * 10 + 0.5) / 10


def orient(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of the triangle a, b, c."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segment_distance(px, py, x1, y1, x2, y2) -> tuple[Column, Column]:
    """Distance of a point from a segment, and the share of the segment at its closest point."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length)))
    return distance(px, py, x1 + t * dx, y1 + t * dy), t


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd test of a point in a ring, an array of structs x, y; half-open in y, so shared borders count once."""
    ends = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crossed = F.zip_with(
        ring,
        ends,
        lambda a, b: F.when(((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0),
    )
    return F.aggregate(crossed, F.lit(0), lambda n, c: n + c) % 2 == 1


def box_distance2(x: Column, y: Column) -> Column:
    """Squared distance of a point from the box ``minx, maxx, miny, maxy``; 0 inside."""
    off = lambda v, low, high: F.greatest(F.col(low) - v, F.lit(0.0), v - F.col(high))
    dx, dy = off(x, "minx", "maxx"), off(y, "miny", "maxy")
    return dx * dx + dy * dy


def nearest_height(heights: Column, z: Column) -> Column:
    """The height of a list that is nearest to ``z``, the first of equal ones; null for an empty list."""
    return F.element_at(F.array_sort(F.transform(heights, lambda h, i: F.struct(F.abs(h - z).alias("d"), i.alias("i"), h.alias("h")))), 1)["h"]


def eased(t: Column) -> Column:
    """Slow start and slow end of a movement over 0..1."""
    left = 2 - 2 * t
    return F.when(t < 0.5, 2 * t * t).otherwise(1 - left * left / 2)
