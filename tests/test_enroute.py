"""Hints, homes, first stops, bodies, plans and stubs on hand-made cases."""

from waygrid.operators import enroute, network
from waygrid.streaming import detectors

LEGS = "route bigint, part bigint, leg int, x1 double, y1 double, x2 double, y2 double, ridden boolean"


def test_hints_are_numbered_as_passed(spark):
    legs = [(1, 0, 1, 0.0, 0.0, 100.0, 0.0, False), (1, 0, 2, 100.0, 0.0, 100.0, 100.0, True), (1, 0, 3, 100.0, 100.0, 0.0, 100.0, False), (1, 1, 1, 0.0, 300.0, 50.0, 300.0, False)]
    places = [(1, 40.0, 108.0), (2, 50.0, 50.0), (3, 108.0, 50.0), (4, 10.0, 295.0), (5, 20.0, 5.0), (6, 30.0, 5.0), (7, None, 0.0)]
    legs, places = spark.createDataFrame(legs, LEGS), spark.createDataFrame(places, "pid bigint, x double, y double")
    known, boarded = spark.createDataFrame([(6,)], "pid bigint"), spark.createDataFrame([(2, 5)], "route bigint, pid bigint")
    got = [tuple(r) for r in enroute.hints(legs, places, known, boarded, 50.0).select("pid", "part", "along", "off", "rank").orderBy("rank").collect()]
    # Place 2 is equally near to both long legs; the one before counts.  Place 3 lies beside the ridden leg, but near the ends of walked ones too far off.
    assert got == [(5, 0, 20.0, 5.0, 1), (2, 0, 50.0, 50.0, 2), (1, 0, 260.0, 8.0, 3), (4, 1, 10.0, 5.0, 4)]
    assert enroute.hints(legs.limit(0), places, known, boarded, 50.0).count() == 0


def test_names_lead_to_the_first_kind_that_has_them(spark):
    asked = spark.createDataFrame([(1, "Inn"), (2, "Inn"), (3, "To"), (4, ""), (5, None), (6, "nowhere")], "cid bigint, name string")
    recorded = spark.createDataFrame([(1, "Inn", 9.0, 9.0), (2, "Old inn", 8.0, 8.0)], "cid bigint, name string, x double, y double")
    schema = "name string, id bigint, x double, y double"
    inns = spark.createDataFrame([("Inn", 2, 2.0, 2.0), ("Inn", 1, 1.0, 1.0)], schema)
    points = enroute.prefixes(spark.createDataFrame([("Town", 7, 7.0, 7.0), ("Tower", 6, 6.0, 6.0), ("", 1, 0.0, 0.0), (None, 2, 0.0, 0.0)], schema))
    got = {r["cid"]: (r["level"], r["x"]) for r in enroute.resolved(asked, recorded, [inns, points]).collect()}
    assert got == {1: (0, 9.0), 2: (1, 1.0), 3: (2, 6.0), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_a_stop_where_the_player_is_comes_first(spark):
    players = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 5.0), (3, 50.0, 50.0), (4, None, 5.0)], "pid bigint, x double, y double")
    stops = [(1, 1, 10, 90.0, 90.0), (1, 2, 11, 6.0, 6.0), (1, 3, 12, 7.0, 7.0), (2, 1, 20, 10.0, 10.0), (2, 2, 21, 6.0, 6.0), (3, 1, 30, 1.0, 1.0), (4, 1, 40, 1.0, 1.0)]
    areas = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0), (2, 4.0, 6.0, 4.0, 6.0)], "box bigint, minx double, maxx double, miny double, maxy double")
    got = enroute.first_stops(players, spark.createDataFrame(stops, "pid bigint, seq int, stop int, sx double, sy double"), areas, 20.0)
    assert {r["pid"]: (r["stop"], r["moved"]) for r in got.collect()} == {1: (11, True), 2: (20, False), 3: (30, False), 4: (40, False)}


def test_bodies_come_move_and_go():
    rows = [(1, 0.0, False, 1.0, 1.0), (2, 1.0, True, 5.0, 5.0), (3, 10.0, True, 5.0, 5.0), (4, 20.0, True, 5.5, 5.5), (5, 30.0, True, 9.0, 5.0), (6, 40.0, True, None, None), (7, 50.0, False, None, None)]
    state, told = detectors.NO_BODY, []
    step = detectors.bodies(5.0)
    for row in rows:
        state, out = step(state, row)
        told += out
    assert told == [(3, True, 5.0, 5.0), (5, True, 9.0, 5.0), (6, False, 0.0, 0.0)]


def test_teleports_start_a_plan_only(spark):
    requests = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 0.0), (2, 0.0, 0.0, 1000.0, 0.0)], "id bigint, x1 double, y1 double, x2 double, y2 double")
    teleports = spark.createDataFrame([(1, 90.0, 500.0, 10.0), (9, 1000.0, 0.0, 0.0)], "id bigint, x double, y double, w double")
    docks = spark.createDataFrame([(5, 100.0, 500.0), (6, 950.0, 0.0)], "dock bigint, x double, y double")
    rides = spark.createDataFrame([(5, 6, 30.0)], "a bigint, b bigint, w double")
    got = {r["id"]: (r["seconds"], r["without"]) for r in enroute.plans(requests, teleports, docks, rides, 200.0, 1.0).collect()}
    assert got == {1: (10.0 + 10.0 + 30.0 + 50.0, 1000.0), 2: (1000.0, 1000.0)}
    assert enroute.plans(requests.limit(0), teleports, docks, rides, 200.0, 1.0).count() == 0


def test_only_stubs_of_cuts_go(spark):
    edges = spark.createDataFrame([(1, 2, 50.0), (2, 3, 5.0), (3, 4, 5.0), (2, 5, 5.0), (2, 6, 90.0), (7, 8, 5.0)], "a bigint, b bigint, w double")
    cut = spark.createDataFrame([(3,), (4,), (4,), (6,), (2,), (7,), (None,)], "node bigint")
    left = lambda rounds: sorted((r["a"], r["b"]) for r in network.without_stubs(edges, cut, 30, rounds).collect())
    assert left(1) == [(1, 2), (2, 3), (2, 5), (2, 6)]
    assert left(3) == [(1, 2), (2, 5), (2, 6)]
