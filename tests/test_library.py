"""Edge cases of operators that the driver's tables don't hold."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from waygrid.functions import geo, text
from waygrid.operators import lines, network, spatial
from waygrid.plans import paths
from waygrid.plans.components import connected_components
from waygrid.sources.literals import literal_to_json
from waygrid.streaming import detectors


def test_literals():
    assert literal_to_json('DB = {["neg"] = -1.5e-3, a = {1, 2, {x = true}}, ["no"] = nil, s = "q\\"uo\\\\te"} -- end') == '{"DB": {"neg": -0.0015, "a": [1, 2, {"x": true}], "s": "q\\"uo\\\\te"}}'
    assert literal_to_json("{1, 2") is None and literal_to_json(None) is None and literal_to_json("os.exit()") is None
    assert literal_to_json("{[1] = 'a', [2] = 'b'}") == '["a", "b"]'


@pytest.mark.parametrize(
    "text, want",
    [
        ("{0x1F, -0x10, .5, 1e3}", "[31, -16, 0.5, 1000.0]"),
        ("--[[ long\n]] x = [==[a]]b]==]", '{"x": "a]]b"}'),
        ("{'\\65\\x42\\195\\169\\z   \n c'}", '["ABéc"]'),
        ("{inf, -inf, nan, -nan(ind), 1.#INF}", '["inf", "-inf", "nan", "nan", "inf"]'),
        ("A = 1\nB = {[1414] = {n = {}}}", '{"A": 1, "B": {"1414": {"n": {}}}}'),
        ("{1 2}", None), ("{a=,}", None), ("{1}}", None), ("x = f()", None), ("", None), ("{a = 1,, b = 2}", None),
    ],
)
def test_forms_of_literals(text, want):
    assert literal_to_json(text) == want


def test_first_wins_equals_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), i, float(rng.randrange(60)), float(rng.randrange(60))) for i in range(400)] + [(1, 1000 + i, 5.0, 5.0) for i in range(50)]
    want = {}
    for kind, at, x, y in sorted(rows):
        near = [k for k in want if k[0] == kind and (k[2] - x) ** 2 + (k[3] - y) ** 2 <= 49]
        key = min(near, key=lambda k: k[1]) if near else (kind, at, x, y)
        want[key] = want.get(key, 0) + 1
    df = spark.createDataFrame(rows, "kind int, at long, x double, y double")
    got = {(r["kind"], r["kept"], r["x"], r["y"]): r["n"] for r in lines.merged_near(df, ["kind"], "at", 7.0).collect()}
    assert got == want
    assert lines.merged_near(df.limit(0), ["kind"], "at", 7.0).count() == 0


def test_orders_of_trips_of_any_length(spark):
    rng = random.Random(5)
    legs = []
    for trip, n in ((1, 1), (2, 3), (3, 5), (4, 9)):
        at = [(rng.random(), rng.random()) for _ in range(n + 1)]
        legs += [(trip, i, j, ((at[i][0] - at[j][0]) ** 2 + (at[i][1] - at[j][1]) ** 2) ** 0.5) for i in range(n + 1) for j in range(n + 1) if i != j]
    cost = {leg[:3]: leg[3] for leg in legs}
    got = {r["trip"]: (r["stops"], r["total"]) for r in paths.best_orders(spark.createDataFrame(legs, "trip long, i long, j long, cost double")).collect()}
    for trip, n in ((1, 1), (2, 3), (3, 5)):
        best = min(sum(cost[trip, a, b] for a, b in zip((0, *p), p)) for p in itertools.permutations(range(1, n + 1)))
        assert abs(got[trip][1] - best) < 1e-9 and sorted(got[trip][0]) == list(range(1, n + 1))
    assert sorted(got[4][0]) == list(range(1, 10)) and abs(sum(cost[4, a, b] for a, b in zip((0, *got[4][0]), got[4][0])) - got[4][1]) < 1e-9


def test_wide_circles_are_one_town(spark, tmp_path):
    rows = [(0, 0), (1, 1), (3, 3)]
    spark.createDataFrame([(k, n, "x") for k, n in rows], "c_custkey long, c_nationkey int, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    at = {k: (k * 7919 % 10007, k * 104729 % 10009) for k, _ in rows}
    from waygrid.queries import graph
    from waygrid.sources import fixtures

    wide = fixtures.TABLES["circles"].replace("35 + c_custkey % 30", "5500")
    assert max(abs(at[0][i] - at[1][i]) for i in (0, 1)) > 200
    original, fixtures.TABLES["circles"] = fixtures.TABLES["circles"], wide
    try:
        towns = {r["cid"]: r["town"] for r in graph.hostile_towns(spark, str(tmp_path)).collect()}
    finally:
        fixtures.TABLES["circles"] = original
    assert towns[0] == towns[1] == 0


def test_components_of_a_chain_and_odd_rows(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 3)], "a long, b long").union(spark.createDataFrame([(None, 5)], "a long, b long"))
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100}


def test_shortest_paths_bound_hops(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0)], "a long, b long, w double")
    start = spark.createDataFrame([(1, 1, 0.0)], "source long, node long, cost double")
    full = {r["node"]: r["cost"] for r in paths.shortest_paths(edges, start).collect()}
    one = {r["node"]: r["cost"] for r in paths.shortest_paths(edges, start, rounds=1).collect()}
    assert full == {1: 0.0, 2: 1.0, 3: 2.0} and one == {1: 0.0, 2: 1.0, 3: 5.0}


def test_contracted_path(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 4, 4.0)], "a long, b long, w double")
    got = network.contracted(edges).collect()
    assert sum(r["w"] for r in got) == 7.0 and len(got) == 2


def test_loop_is_no_longer_than_its_start(spark):
    rows = [(1, i, float(i * 37 % 11), float(i * 17 % 7)) for i in range(9)]
    got = paths.loop_orders(spark.createDataFrame(rows, "trip long, stop long, x double, y double")).toPandas().sort_values("seq")
    at = {r[1]: r[2:] for r in rows}
    length = lambda order: sum(((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5 for a, b in zip(order, order[1:] + order[:1]))
    assert sorted(got["stop"]) == list(range(9)) and length(list(got["stop"])) <= length(list(range(9)))


def test_ring_borders_and_wrapping(spark):
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (4, 0), (4, 4), (0, 4))])
    row = spark.range(1).select(geo.in_ring(F.lit(2.0), F.lit(2.0), ring), geo.in_ring(F.lit(5.0), F.lit(2.0), ring), geo.wrapped(F.lit(-190.0)), geo.tenth(F.lit(-0.25))).first()
    assert row[0] and not row[1] and row[2] == 170.0 and row[3] == -0.2


@pytest.mark.parametrize("line, want", [("/way 12 34", (None, None, 12.0, 34.0, None)), ("/way Deep Wood 1.5, 2 home", (None, "Deep Wood", 1.5, 2.0, "home")), ("/say 1 2", None)])
def test_way_lines(spark, line, want):
    got = spark.range(1).select(text.way_line(F.lit(line)).alias("w")).first()["w"]
    assert (tuple(got) if got else None) == want


def test_nearest_within_has_ties_by_id(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "p long, x double, y double")
    targets = spark.createDataFrame([(9, 1.0, 0.0), (4, 0.0, -1.0), (5, 90.0, 0.0)], "t long, tx double, ty double")
    got = spatial.nearest_within(points, targets, 10, "p", "t", k=2).orderBy("rank").collect()
    assert [r["t"] for r in got] == [4, 9]


def test_reassembly():
    step = detectors.reassembly(30)
    state, out = ("", 0, 0.0, ""), []
    for row in [(0.0, "m", 1, 2, "ab"), (1.0, "m", 1, 2, "ab"), (50.0, "m", 2, 2, "cd"), (51.0, "m", 1, 2, "ab"), (52.0, "x", 9, 2, "no")]:
        state, found = step(state, row)
        out += found
    assert out == [("m", "abcd")]


def test_departure_needs_boarding():
    step, state, out = detectors.rides("board", "leave", "arrive", 600), ("", 0.0), []
    for row in [(0.0, "leave"), (5.0, "arrive"), (10.0, "board"), (20.0, "leave"), (80.0, "arrive"), (90.0, "board"), (900.0, "leave")]:
        state, found = step(state, row)
        out += found
    assert out == [(20.0, 80.0, 60.0)]
    assert pd.DataFrame(out).shape == (1, 3)
