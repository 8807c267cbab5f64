"""Floors over one another: rules that take null for "not known".

``v`` is the overlay cell's value (null where there is none, 3 where floors lie over one another), ``cave`` whether the
overlay is a cave's, ``split`` the height between its floors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cave_down(v: Column, cave: Column, split: Column, z: Column, indoors: Column) -> Column:
    """Whether a place lies on the lower floor: by its height where floors are split, else by being indoors, else down."""
    by_height = F.coalesce(z < split, F.lit(True))
    over = F.when(split.isNotNull(), by_height).otherwise(F.coalesce(indoors, F.lit(True)))
    return F.when(v.isNull() | ~F.coalesce(cave, F.lit(False)), False).when(v == 3, over).otherwise(True)


def cave_floor_ok(v: Column, cave: Column, road_in_cave: Column, picked_down: Column, down: Column) -> Column:
    """Whether a road is on the place's floor; a floor picked by hand decides before what is known of the place."""
    return F.when(F.coalesce((v != 3) | ~cave, F.lit(True)), True).otherwise(F.coalesce(road_in_cave, F.lit(False)) == F.coalesce(picked_down, down))


def same_wall_floor(a_down: Column, b_down: Column, a_z: Column, b_z: Column, most: float) -> Column:
    """Whether two walls are of one floor: by the picked floors, else by heights at most ``most`` apart, else yes."""
    return F.coalesce(a_down == b_down, F.abs(a_z - b_z) <= most, F.lit(True))
