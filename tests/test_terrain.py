"""Ground, searches and rides against plain Python on small grids, and on empty tables."""

import random

from pyspark.sql import functions as F

from waygrid.operators import raster, spatial
from waygrid.streaming import detectors


def grid(seed, rows=7, columns=9):
    drawn = random.Random(seed)
    return {(r, c): drawn.choice([0, 0, 1, 2, 2]) for r in range(rows) for c in range(columns)}


def regions(cells):
    left, found = set(cells), []
    while left:
        todo, region = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            region.add((r, c))
            near = {(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)} & left
            left -= near
            todo += near
        found.append(region)
    return found


def test_despeckled_equals_plain_python(spark):
    v = grid(3)
    want = dict(v)

    def settle(value, least, to):
        for region in regions([p for p in want if value(want[p])]):
            if len(region) < least:
                want.update(dict.fromkeys(region, to))

    settle(lambda x: x == 2, 3, 0)
    cross = lambda r, c: [(r, c), (r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    grown = {p for p in want if any(want.get(q) == 2 for q in cross(*p))}
    want.update({p: 2 for p in grown if all(q in grown for q in cross(*p))})
    settle(lambda x: x != 2, 4, 2)
    settle(lambda x: x == 1, 3, 0)
    cells = spark.createDataFrame([(r, c, x) for (r, c), x in v.items()], "r bigint, c bigint, v int")
    assert {(x.r, x.c): x.v for x in raster.despeckled(cells, 3, 4).collect()} == want


def test_empty_ground(spark):
    none = spark.createDataFrame([], "r bigint, c bigint, v int")
    assert raster.despeckled(none, 3, 4).count() == 0
    assert raster.hysteresis(none, 1, 2).count() == 0


def test_nearest_anywhere_ties_far_places_and_gaps(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 0.0), (3, None, 1.0)], "pid bigint, x double, y double")
    targets = spark.createDataFrame([(7, 3.0, 4.0), (5, -3.0, 4.0), (9, None, None)], "id bigint, tx double, ty double")
    got = {r.pid: (r.id, round(r.d, 3)) for r in spatial.nearest_anywhere(points, targets, 10, "pid", "id").collect()}
    assert got == {1: (5, 5.0), 2: (7, 4997.002)}
    assert spatial.nearest_anywhere(points, targets.filter("id > 9"), 10, "pid", "id").count() == 0


def test_a_line_does_not_cut_a_corner(spark):
    cells = spark.createDataFrame([(r, c, 2 if (r, c) == (0, 1) else 0) for r in range(3) for c in range(3)], "r bigint, c bigint, v int")
    lines = spark.createDataFrame([(1, 0, 0, 1, 1), (2, 1, 0, 2, 1), (3, 2, 2, 2, 2), (4, 2, 0, 4, 0)], "id bigint, r1 bigint, c1 bigint, r2 bigint, c2 bigint")
    assert {r.id: round(r.cost, 3) for r in raster.open_lines(lines, cells, "id", F.col("v") == 2).collect()} == {2: 1.414, 3: 0.0}


def ride(samples):
    step, state, found = detectors.transport(((0.0, 0.0), (500.0, 0.0)), 45, 1.5, 60, 600, 2), detectors.NO_RIDE, []
    for row in samples:
        state, out = step(state, row)
        found += out
    return found


def test_transport_departs_when_carried_twice_and_arrives_when_still_twice():
    way = [(0, 0, 0, 0, False), (1, 10, 5, 0, False), (2, 20, 30, 0, False), (3, 30, 80, 0, False), (4, 40, 500, 0, False), (5, 50, 500, 0, False), (6, 60, 500, 0, False)]
    assert ride(way) == [(3, "departed", 1, 10), (6, "arrived", 2, 60)]


def test_walking_away_from_a_dock_is_no_ride():
    assert ride([(i, i * 10, i * 30, 0, True) for i in range(20)]) == []
