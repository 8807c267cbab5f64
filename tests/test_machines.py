"""Machines over samples: the same in stream and batch, with late, repeated and odd rows; places kept in versions."""

import random

import pytest
from pyspark.sql import functions as F

from waygrid.functions import text
from waygrid.operators import doors
from waygrid.operators.spatial import nearest_segment_anywhere
from waygrid.plans import paths
from waygrid.streaming import detectors, replay, upsert

DOCKS = ((0.0, 0.0), (2000.0, 0.0))
RULE = detectors.transport(DOCKS, reach=45, carry=1.5, away=60, idle=600, checks=2)
COLUMNS = ["id", "time", "x", "y", "walking"]
SCHEMA = "who bigint, id bigint, time double, x double, y double, walking boolean"
OUT = "who bigint, id bigint, what string, side int, at_ double"


def crossing(who, start, dock):
    """A ride of 80 seconds from a dock to the other: waiting, carried off, coming in, docking past the dock, at rest."""
    there = [0, 0, 0, 10, 30, 80, 900, 1600, 1970, 1995, 2010, 2060, 2030, 2020, 2020, 2020, 2020]
    xs = there if dock == 1 else [2000 - x for x in there]
    return [(who, i, start + 10.0 * i, float(x), 0.0, False) for i, x in enumerate(xs)]


def samples():
    rows = crossing(1, 0.0, 2) + [(w, i + 100, t, x, y, k) for w, i, t, x, y, k in crossing(1, 4000.0, 1)] + crossing(2, 0.0, 1)
    rows += [(3, i, 10.0 * i, 500.0 + 300 * i, 0.0, False) for i in range(8)]  # first seen on board, past the far dock
    rows += [(4, i, 10.0 * i, 30.0 * i, 0.0, True) for i in range(20)]  # walks away
    rows += [(5, i, 10.0 * i, [0.0, 0.0, 20.0, 20.0, 20.0, 40.0, 40.0][i], 0.0, False) for i in range(7)]  # carried once
    return rows


def run(spark, rows, tmp_path=None, files=1):
    if tmp_path is None:
        out = detectors.over_table(spark.createDataFrame(rows, SCHEMA), "who", COLUMNS, RULE, detectors.NO_RIDE, OUT, ["time", "id"])
    else:
        folder = f"{tmp_path}/in{files}"
        ordered = sorted(rows, key=lambda r: r[2])
        for n in range(files):
            spark.createDataFrame(ordered[len(ordered) * n // files : len(ordered) * (n + 1) // files], SCHEMA).coalesce(1).write.parquet(f"{folder}/part={n:03d}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        state = "phase int, dock int, boarded double, rests int, x double, y double"
        out = replay.run_to_end(detectors.over_stream(stream, "who", COLUMNS, RULE, detectors.NO_RIDE, state, OUT, ["time", "id"]))
    return sorted((r["who"], r["at_"], r["what"], r["side"]) for r in out.collect())


RIDES = [(1, 30.0, "departed", 2), (1, 150.0, "arrived", 1), (1, 4030.0, "departed", 1), (1, 4150.0, "arrived", 2), (2, 30.0, "departed", 1), (2, 150.0, "arrived", 2)]


def test_a_ride_departs_once_and_arrives_once(spark):
    """Coming in past the far dock is its arrival, never a departure from it."""
    assert run(spark, samples()) == RIDES


def test_rides_in_a_stream_of_several_batches(spark, tmp_path):
    assert run(spark, samples(), tmp_path, files=3) == RIDES


def test_a_player_carried_in_has_to_wait_there_first():
    step, state, found = RULE, detectors.NO_RIDE, []
    for i, x in enumerate([600, 300, 100, 40, 20, 0, -30, -70, -110]):  # carried past the dock without a rest
        state, out = step(state, (i, 10.0 * i, float(x), 0.0, False))
        found += out
    assert found == []


def session(rows):
    step, state, found = detectors.trip_session(10, 5, 20, 0.85, 3, 100), detectors.NO_TRIP, []
    for row in rows:
        state, out = step(state, row)
        found += out
    return found


def trip(n, **changes):
    rows = [[i, float(10 * i), 12.0 * i, 0.0, 0, "a", False, False, 1000.0] for i in range(n)]
    rows[-1][7] = True
    for key, (i, value) in changes.items():
        rows[i][{"away": 6, "target": 5, "level": 4, "time": 1, "estimate": 8}[key]] = value
    return [tuple(r) for r in rows]


@pytest.mark.parametrize(
    "rows, kept",
    [
        (trip(6), [(5, "a", 0.0, 50.0, 6)]),
        (trip(12), [(11, "a", 0.0, 110.0, 6)]),  # no more than five points, and the arrival
        (trip(3), []),  # too few points
        (trip(6, away=(2, True)), []),  # begins anew behind it, too late for three points
        (trip(9, away=(2, True)), [(8, "a", 30.0, 50.0, 6)]),
        (trip(9, level=(2, 1)), [(8, "a", 30.0, 50.0, 6)]),
        (trip(9, target=(2, "b")), [(8, "a", 30.0, 50.0, 6)]),
        (trip(9, target=(2, None)), [(8, "a", 30.0, 50.0, 6)]),
        (trip(6, estimate=(0, 55.0)), []),  # not fast enough
        (trip(6, target=(5, "b")), []),  # arrived somewhere else
        ([r if i < 3 else (r[0], r[1] + 500, *r[2:]) for i, r in enumerate(trip(8))], [(7, "a", 530.0, 40.0, 5)]),  # a pause
    ],
)
def test_trip_sessions(rows, kept):
    assert session(rows) == kept


def test_ways_in_take_the_last_fresh_place_outside():
    step, state, found = detectors.entering(120), detectors.NOT_OUTSIDE, []
    for row in [(1, 0.0, 1.0, 1.0, 7), (2, 10.0, 2.0, 2.0, None), (3, 50.0, 3.0, 3.0, None), (4, 100.0, 0.0, 0.0, 7), (5, 110.0, 0.0, 0.0, 8), (6, 120.0, 5.0, 5.0, None), (7, 300.0, 0.0, 0.0, 7)]:
        state, out = step(state, row)
        found += out
    assert found == [(4, 7, 3.0, 3.0)]


def by_loop(batches, reach):
    places = []
    for number, rows in enumerate(batches):
        for level, name, x, y, time, key in sorted(rows, key=lambda r: (r[4], r[5])):
            for p in places:
                if p[0] == level and p[1] == name and (p[2] - x) ** 2 + (p[3] - y) ** 2 <= reach * reach:
                    p[4] += 1
                    break
            else:
                places.append([level, name, x, y, 1])
    return sorted(map(tuple, places))


def test_places_equal_a_loop_also_when_a_batch_runs_twice(spark, tmp_path):
    r = random.Random(8)
    batches = [[(r.randrange(2), r.choice("pq"), float(r.randrange(60)), float(r.randrange(60)), float(i), i) for i in range(60)] for _ in range(3)]
    table = upsert.PlaceTable(spark, f"file://{tmp_path}/places", 15)
    schema = "level bigint, name string, x double, y double, time double, id bigint"
    read = lambda: sorted((p["level"], p["name"], p["x"], p["y"], p["n"]) for p in table.read().collect())
    for number, rows in enumerate(batches):
        table.merge(spark.createDataFrame(rows, schema), number)
        if number == 1:
            table.merge(spark.createDataFrame(rows, schema), number)  # as after a failure
        assert read() == by_loop(batches[: number + 1], 15)
    assert len(table.versions()) == upsert.PlaceTable.KEEP


def test_places_of_a_stream(spark, tmp_path):
    schema = "level bigint, name string, x double, y double, time double, id bigint"
    for n in range(2):
        spark.createDataFrame([(0, "p", 1.0 + n, 1.0, float(n), n), (0, "q", 1.0, 1.0, float(n), n)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = upsert.learned_places(stream, f"file://{tmp_path}/base", 5).collect()
    assert sorted((r["name"], r["n"], r["o"]["id"]) for r in got) == [("p", 2, 0), ("q", 2, 0)]


@pytest.mark.parametrize(
    "line, want",
    [
        ("/way Old Town 43.2 65.1 Copper Vein", (None, "Old Town", 43.2, 65.1, "Copper Vein")),
        ("/way #1429, 4,5.5", (1429, None, 4.0, 5.5, None)),
        ("Area 52 43.2 65.1", (None, "Area", 52.0, 43.2, "65.1")),
        ("Sector7, 12 13", (None, "Sector7", 12.0, 13.0, None)),
        ("12 13 here", (None, None, 12.0, 13.0, "here")),
        ("/way 12 130", None),
        ("/way nowhere", None),
        ("", None),
    ],
)
def test_typed_lines(spark, line, want):
    got = spark.createDataFrame([(line,)], "line string").select(text.way_line(F.col("line")).alias("w")).first()["w"]
    assert (tuple(got) if got else None) == want


def test_shared_messages_and_door_keys(spark):
    lines = ["1\tab\t1\t2\t0\t-12.5\t7\tname", "2\tab\t1\t2\t0\t1\t1\tx", "1\tab\t3\t2\t0\t1\t1\tx", "1\tab\t1\t9\t0\t1\t1\tx", "1\tab\t1\t1\t0\t30001\t1\tx", "1\tab\t1\t1\t5\t1\t1\tx", "1\tab\t1\t1\t0\t1.2.3\t1\tx", "junk", None]
    got = [r["m"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", text.shared_message(F.col("line")).alias("m")).orderBy("i").collect()]
    assert tuple(got[0]) == ("ab", 1, 2, 0, -12.5, 7.0, "name") and got[1:] == [None] * 8
    names = spark.createDataFrame([("The Deep Mine - Entering",), ("Deep Mine (back) Exit",), (None,)], "name string").select(doors.door_key(F.col("name")).alias("k"))
    assert [r["k"] for r in names.collect()] == ["deep mine", "deep mine", None]


def test_nearest_segments_however_far(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 9000.0, 0.0), (3, None, 1.0)], "pid bigint, x double, y double")
    roads = spark.createDataFrame([(7, -10.0, 5.0, 10.0, 5.0), (5, -10.0, -5.0, 10.0, -5.0)], "wid bigint, x1 double, y1 double, x2 double, y2 double")
    got = {r["pid"]: (r["wid"], round(r["d"], 2), round(r["t"], 2)) for r in nearest_segment_anywhere(points, roads, "pid", "wid", 8).collect()}
    assert got == {1: (5, 5.0, 0.5), 2: (5, 8990.0, 1.0)}


def test_the_leg_from_the_start_is_weighed_one_way(spark):
    n = 9
    legs = [(1, i, j, 1.0 if j == i % n + 1 else 50.0) for i in range(n + 1) for j in range(n + 1) if i != j]
    legs = [(t, i, j, 500.0 if j == 0 else c) for t, i, j, c in legs]  # nothing leads back to the start
    got = paths.best_orders(spark.createDataFrame(legs, "trip bigint, i int, j int, cost double")).first()
    assert got["stops"][0] == 1
