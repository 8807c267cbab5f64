"""Chains, outlines, skeletons, pulled and smoothed ways, routes, streets, blocks, solids, drawn roads, turns: small cases and plain Python."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from waygrid.operators import chains, edits, manoeuvres, mesh, network, pulling, raster
from waygrid.plans import blocks, journeys, paths


def cells_of(spark, picture):
    rows = [(r, c) for r, line in enumerate(picture) for c, x in enumerate(line) if x == "#"]
    return spark.createDataFrame(rows, "r bigint, c bigint")


# Chains and outlines ------------------------------------------------------------------------------------------------------


def test_chains_rings_and_lone_nodes_in_order(spark):
    names = list(range(100, 140))
    random.Random(4).shuffle(names)
    chain, ring = names[:25], names[25:]
    links = list(zip(chain, chain[1:])) + list(zip(ring, ring[1:] + ring[:1])) + [(7, 7), (1, 2), (2, 1), (None, 3)]
    got = chains.ordered_chains(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["chain"], r["seq"])):
        by.setdefault(r["chain"], []).append((r["node"], r["closed"]))
    want = chain if chain[0] < chain[-1] else chain[::-1]
    assert by[min(chain)] == [(x, False) for x in want]
    at = ring.index(min(ring))
    turned = ring[at:] + ring[:at]
    turned = turned if turned[1] < turned[-1] else [turned[0], *turned[:0:-1]]
    assert by[min(ring)] == [(x, True) for x in turned]
    assert by[7] == [(7, False)] and by[1] == [(1, False), (2, False)] and set(by) == {7, 1, min(chain), min(ring)}


def test_outlines_are_closed_and_apart_at_corners(spark):
    assert raster.outline_rings(cells_of(spark, ["##.", "##.", "..#"])).select("ring").distinct().count() == 1  # the other corner joins
    got = raster.outline_rings(cells_of(spark, [".##", ".##", "#.."])).collect()
    rings = {}
    for r in sorted(got, key=lambda r: r["seq"]):
        rings.setdefault(r["ring"], []).append((r["r2"], r["c2"]))
    assert sorted(map(len, rings.values())) == [4, 8]
    for ring in rings.values():
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            assert max(abs(a - c), abs(b - d)) <= 2 and (a, b) != (c, d)
    hole = raster.outline_rings(cells_of(spark, ["###", "#.#", "###"])).groupBy("ring").count().collect()
    assert sorted(r["count"] for r in hole) == [4, 12]


def pieces_and_holes(cells, size):
    """Number of eight-connected pieces of cells and of four-connected pieces of what is around them."""

    def count(left, steps):
        n = 0
        while left:
            todo, n = [left.pop()], n + 1
            while todo:
                r, c = todo.pop()
                for a, b in steps:
                    if (r + a, c + b) in left:
                        left.remove((r + a, c + b))
                        todo.append((r + a, c + b))
        return n

    ring = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    around = {(r, c) for r in range(-1, size + 1) for c in range(-1, size + 1)} - cells
    return count(set(cells), ring), count(around, [(0, 1), (1, 0), (0, -1), (-1, 0)])


def thinned(cells):
    """The rule once more, on a set."""
    cells = set(cells)
    while True:
        before = len(cells)
        edge = {(r, c) for r, c in cells if not {(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)} <= cells}
        for dr, dc in ((0, 0), (1, 1), (0, 1), (1, 0)):
            gone = set()
            for r, c in cells:
                if r % 2 == dr and c % 2 == dc and (r, c) in edge:
                    x = [(r + a, c + b) in cells for a, b in raster.TURN]
                    runs = sum(not x[i] and not (not x[i + 1] and not x[(i + 2) % 8]) for i in (0, 2, 4, 6))
                    if sum(x) >= 2 and runs == 1:
                        gone.add((r, c))
            cells -= gone
        if len(cells) == before:
            return cells


@pytest.mark.parametrize("seed", [1, 2])
def test_thinning_keeps_pieces_and_holes(spark, seed):
    r = random.Random(seed)
    shape = {(i, j) for _ in range(5) for y, x in [(r.randrange(4, 20), r.randrange(4, 20))] for i in range(y - 3, y + 4) for j in range(x - 3, x + 4) if r.random() < 0.97}
    got = {(x["r"], x["c"]) for x in raster.thinned(spark.createDataFrame(sorted(shape), "r bigint, c bigint")).collect()}
    assert got == thinned(shape)
    assert pieces_and_holes(got, 26) == pieces_and_holes(shape, 26)


def test_a_thick_line_is_thinned_to_a_line(spark):
    got = {(x["r"], x["c"]) for x in raster.thinned(cells_of(spark, ["." * 30] + ["." + "#" * 28 + "."] * 5 + ["." * 30])).collect()}
    middle = sorted((c, r) for r, c in got if 6 <= c <= 23)
    assert [c for c, _ in middle] == list(range(6, 24)) and {r for _, r in middle} <= {2, 3, 4}
    assert not any({(r, c + 1), (r + 1, c), (r + 1, c + 1)} <= got for r, c in got)


# Ways ---------------------------------------------------------------------------------------------------------------------


def sees(cells, a, b):
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
    at = lambda i: (a[0] + math.floor((b[0] - a[0]) * i / n + 0.5), a[1] + math.floor((b[1] - a[1]) * i / n + 0.5))
    for i in range(1, n + 1):
        (pr, pc), (r, c) = at(i - 1), at(i)
        if {(r, c)} - cells or r != pr and c != pc and {(pr, c), (r, pc)} - cells:
            return False
    return True


def test_long_ways_are_pulled_as_one_by_one(spark):
    r = random.Random(6)
    cells = {(i, j) for i in range(30) for j in range(30) if r.random() < 0.9}
    ways = {}
    for path in range(6):
        at = r.choice(sorted(cells))
        way = [at]
        for _ in range(r.randint(0, 45)):
            steps = [(at[0] + a, at[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (at[0] + a, at[1] + b) in cells]
            at = r.choice(steps or [at])
            way.append(at)
        ways[path] = way
    points = spark.createDataFrame([(p, i, y, x) for p, way in ways.items() for i, (y, x) in enumerate(way)], "path bigint, i bigint, r bigint, c bigint")
    grid = spark.createDataFrame([(y, x, 0) for y, x in sorted(cells)], "r bigint, c bigint, v int")
    got = sorted((x["path"], x["i"]) for x in pulling.pulled(points, grid, F.col("v") == 2).collect())
    want = []
    for path, way in ways.items():
        i, n = 0, len(way) - 1
        want.append((path, 0))
        while i < n:
            j, far, jump = i + 1, None, 1
            while j < n:
                k = min(n, j + jump)
                if sees(cells, way[i], way[k]):
                    j, jump = k, jump * 2
                else:
                    far = k
                    break
            while far and far - j > 1:
                k = (j + far) // 2
                j, far = (k, far) if sees(cells, way[i], way[k]) else (j, k)
            i = j
            want.append((path, i))
    assert got == sorted(want)


def smooth(spark, points, cells=None, guards=()):
    rows = spark.createDataFrame([(1, i, float(x), float(y), kind, bool(j)) for i, (x, y, kind, j) in enumerate(points)], "path bigint, i bigint, x double, y double, kind string, junction boolean")
    grid = spark.createDataFrame([(r, c, *(cells or {}).get((r, c), (0, 0))) for r in range(-5, 20) for c in range(-5, 120)], "r bigint, c bigint, v int, h int")
    circles = spark.createDataFrame(list(guards), "cid bigint, cx double, cy double, r double")
    return sorted(r["i"] for r in pulling.smoothed(rows, grid, circles, F.col("v") == 2, F.col("h") > 5, span=80, ratio=1.2, tolerance=2.5).collect())


JOG = [(0, 0, "off", 0), (20, 0, "off", 0), (25, 9, "off", 0), (30, 0, "off", 0), (60, 0, "off", 0), (100, 0, "off", 0)]


def test_jogs_go_and_climbs_junctions_walls_and_guards_keep_them(spark):
    assert smooth(spark, JOG) == [0, 3, 5] or smooth(spark, JOG) == [0, 4, 5]
    assert 2 in smooth(spark, JOG, {(8, 24): (0, 9), (9, 25): (0, 9), (9, 24): (0, 9)})  # a climb
    assert 2 in smooth(spark, [(x, y, "road", i == 2) for i, (x, y, _, _) in enumerate(JOG)])  # a junction of roads
    assert 2 in smooth(spark, JOG, {(r, c): (2, 0) for r in range(-5, 6) for c in (24, 25, 26)})  # no way straight on
    assert 2 in smooth(spark, JOG, guards=[(1, 25.0, -2.0, 6.0)])  # nearer to guards
    assert smooth(spark, [(x, y, None, 0) for x, y, _, _ in JOG]) == list(range(6))


def test_routes_from_the_middle_of_edges_and_down_drops(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 100.0, 100.0)], "node bigint, x double, y double")
    edges = spark.createDataFrame([(10, 1, 2, 1.0, False), (11, 2, 3, 1.0, True)], "edge bigint, a bigint, b bigint, ratio double, one_way boolean")
    asked = [(1, 20.0, 5.0, 80.0, 5.0), (2, 50.0, 10.0, 105.0, 50.0), (3, 105.0, 60.0, 105.0, 20.0), (4, 105.0, 20.0, 105.0, 60.0), (5, 900.0, 900.0, 910.0, 900.0), (6, 105.0, 80.0, 50.0, 10.0)]
    requests = spark.createDataFrame(asked, "req bigint, sx double, sy double, tx double, ty double")
    walls = spark.createDataFrame([(1, 101.0, 10.0, 120.0, 10.0), (2, 40.0, 30.0, 140.0, 30.0), (3, 40.0, 70.0, 90.0, 70.0)], "wall bigint, wx1 double, wy1 double, wx2 double, wy2 double")
    out = {}
    for r in sorted(journeys.journeys(nodes, edges, requests, walls, reach=60, k=4, off=3.0, penalty=500).collect(), key=lambda r: (r["req"], r["seq"])):
        out.setdefault(r["req"], []).append((round(r["x"], 3), round(r["y"], 3), r["kind"], round(r["cost"], 3)))
    assert [p[:3] for p in out[1]] == [(20, 5, None), (20, 0, "off"), (80, 0, "road"), (80, 5, "off")] and out[1][0][3] == 15 + 60 + 15  # one edge, entered and left in its middle
    assert [p[:3] for p in out[2]] == [(50, 10, None), (50, 0, "off"), (100, 0, "road"), (100, 50, "drop"), (105, 50, "off")]
    assert [p[:3] for p in out[4]] == [(105, 20, None), (100, 20, "off"), (100, 60, "drop"), (105, 60, "off")]  # down the drop
    assert all(p[2] in (None, "off") for p in out[3]) and out[3][0][3] == pytest.approx(40 * 3 + 500)  # never up a drop: straight through the wall
    assert [p[2] for p in out[5]] == [None, "off"]  # no road in reach


def test_no_route_of_a_request_is_dearer_than_straight_on(spark):
    r = random.Random(2)
    nodes = [(i, r.uniform(0, 1000), r.uniform(0, 1000)) for i in range(60)]
    edges = [(i, r.randrange(60), r.randrange(60), 1.0 + r.random(), r.random() < 0.3) for i in range(120)]
    asked = [(i, *(r.uniform(0, 1000) for _ in range(4))) for i in range(25)]
    frames = (
        spark.createDataFrame(nodes, "node bigint, x double, y double"),
        spark.createDataFrame(edges, "edge bigint, a bigint, b bigint, ratio double, one_way boolean"),
        spark.createDataFrame(asked, "req bigint, sx double, sy double, tx double, ty double"),
        spark.createDataFrame([], "wall bigint, wx1 double, wy1 double, wx2 double, wy2 double"),
    )
    got = {x["req"]: x["cost"] for x in journeys.journeys(*frames, reach=150, k=3, off=4.0).collect()}
    place = {n: (x, y) for n, x, y in nodes}
    for req, sx, sy, tx, ty in asked:
        near = {}
        for side, (x, y) in (("s", (sx, sy)), ("t", (tx, ty))):
            found = []
            for e, a, b, ratio, one_way in edges:
                (x1, y1), (x2, y2) = place[a], place[b]
                size = (x2 - x1) ** 2 + (y2 - y1) ** 2
                t = 0 if not size else max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / size))
                d = math.dist((x, y), (x1 + t * (x2 - x1), y1 + t * (y2 - y1)))
                if d <= 150:
                    found.append((d, e, t))
            near[side] = sorted(found)[:3]
        # The network with the edges split at the places where the request joins them.
        graph = {}
        link = lambda u, v, w: graph.setdefault(u, []).append((v, w))
        link("s", "t", math.dist((sx, sy), (tx, ty)) * 4)
        for e, a, b, ratio, one_way in edges:
            on = sorted([(t, side) for side in "st" for _, x, t in near[side] if x == e])
            stops = [(0, a), *((t, (side, e)) for t, side in on), (1, b)]
            for (t1, u), (t2, v) in zip(stops, stops[1:]):
                w = (t2 - t1) * math.dist(place[a], place[b]) * ratio
                link(u, v, w)
                if not one_way:
                    link(v, u, w)
        for side in "st":
            for d, e, _ in near[side]:
                link("s" if side == "s" else ("t", e), ("s", e) if side == "s" else "t", d * 4)
        best, todo = {}, [(0.0, 0, "s")]
        while todo:
            cost, _, u = heapq.heappop(todo)
            if u not in best:
                best[u] = cost
                for v, w in graph.get(u, []):
                    heapq.heappush(todo, (cost + w, len(todo) + random.random(), v))
        assert got[req] == pytest.approx(best["t"])


# Networks -----------------------------------------------------------------------------------------------------------------


def test_a_rising_chain_is_contracted_in_few_rounds(spark, monkeypatch):
    rounds = []
    once = network.contracted
    monkeypatch.setattr(network, "contracted", lambda e, salt: rounds.append(salt) or once(e, salt))
    got = network.contracted_fully(spark.createDataFrame([(i, i + 1, 1.0) for i in range(512)], "a bigint, b bigint, w double")).collect()
    assert [({r["a"], r["b"]}, r["w"]) for r in got] == [({0, 512}, 512.0)] and len(rounds) < 30


def test_pieces_hang_that_are_only_left_by_drops(spark):
    ways = spark.createDataFrame([(1, 2), (3, 4), (5, 6), (7, 8)], "a bigint, b bigint")
    drops = spark.createDataFrame([(2, 3), (4, 5), (8, 3)], "a bigint, b bigint")  # 1 -> 3 -> 5, 7 -> 3
    keep = spark.createDataFrame([(8,)], "node bigint")
    assert [r["piece"] for r in network.hanging(ways, drops, keep).collect()] == [1]


def test_far_groups_are_linked_too(spark):
    points = [(g, g * 10.0**g, float(i)) for g in range(1, 6) for i in range(3)]
    got = network.closest_links(spark.createDataFrame(points, "g bigint, x double, y double"), "g", 5).collect()
    assert sorted((r["u"], r["v"]) for r in got) == [(1, 2), (2, 3), (3, 4), (4, 5)]
    assert network.closest_links(spark.createDataFrame([], "g bigint, x double, y double"), "g", 5).count() == 0


def test_streets_join_terminals_at_twice_the_least_cost(spark):
    r = random.Random(9)
    edges = [(i, r.randrange(i), float(r.randint(1, 20))) for i in range(1, 40)] + [(r.randrange(40), r.randrange(40), float(r.randint(1, 20))) for _ in range(30)]
    ends = [3, 11, 29, 38]
    got = paths.street_network(spark.createDataFrame(edges, "a bigint, b bigint, w double"), spark.createDataFrame([(x,) for x in ends], "node bigint")).collect()
    ways = {}
    for a, b, w in edges:
        if a != b:
            key = (min(a, b), max(a, b))
            ways[key] = min(w, ways.get(key, w))
    assert all(ways[(x["a"], x["b"])] == x["w"] for x in got)
    near = {}
    for x in got:
        near.setdefault(x["a"], set()).add(x["b"])
        near.setdefault(x["b"], set()).add(x["a"])
    seen, todo = {ends[0]}, [ends[0]]
    while todo:
        for y in near[todo.pop()] - seen:
            seen.add(y)
            todo.append(y)
    assert set(ends) <= seen == set(near) and len(got) == len(near) - 1
    assert all(len(v) > 1 or k in ends for k, v in near.items())
    # No tree costs less than half of the way around the terminals in their best order.
    assert sum(x["w"] for x in got) <= 2 * 60


def test_only_touched_blocks_are_built_anew(spark):
    r = random.Random(3)
    before = {(i, j) for i in range(16) for j in range(16) if r.random() < 0.85}
    changed = {(4, 4), (4, 5), (9, 3), (15, 15)}
    after = before ^ changed
    frame = lambda cells: spark.createDataFrame(sorted(cells), "r bigint, c bigint")
    rows = lambda df: sorted(tuple(x) for x in df.select("a", "b", "w", "crosses").collect())
    graph = blocks.block_graph(frame(before), 4)
    assert blocks.touched_blocks(frame(changed), 4).count() == 8
    assert rows(blocks.maintained(graph, frame(after), frame(changed), 4)) == rows(blocks.block_graph(frame(after), 4))


# Solids and drawn roads ---------------------------------------------------------------------------------------------------


def test_triangles_that_share_edges_share_no_cell(spark):
    fan = [(0, 0), (12, 0), (12, 9), (0, 9)]
    corners = [(5.5, 4.5), *fan]
    tris = [(i, *corners[0], 3.0, *fan[i], 0.0, *fan[(i + 1) % 4], 0.0) for i in range(4)]
    rows = spark.createDataFrame([tuple(map(float, t)) for t in tris], "tri double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, x3 double, y3 double, z3 double")
    got = [(r["r"], r["c"]) for r in mesh.covered_cells(rows).collect()]
    assert sorted(got) == [(r, c) for r in range(9) for c in range(12)]
    top = mesh.covered_cells(rows).groupBy().agg(F.max("z")).first()[0]
    assert 2.9 < top <= 3.0


def test_slices_fill_what_they_enclose(spark):
    square = [(0.0, 0.0, 10.0, 0.0), (10.0, 0.0, 10.0, 10.0), (10.0, 10.0, 0.0, 10.0), (0.0, 10.0, 0.0, 0.0)]
    hole = [(3.0, 3.0, 6.0, 3.0), (6.0, 3.0, 6.0, 6.0), (6.0, 6.0, 3.0, 6.0), (3.0, 6.0, 3.0, 3.0)]
    runs = mesh.filled(spark.createDataFrame([(1, *s) for s in square + hole], "shape int, x1 double, y1 double, x2 double, y2 double"), "shape")
    got = {(r["r"], c) for r in runs.collect() for c in range(r["first"], r["last"] + 1)}
    assert got == {(r, c) for r in range(10) for c in range(10)} - {(r, c) for r in range(3, 6) for c in range(3, 6)}


def test_what_is_left_of_drawn_roads(spark):
    drawn = [
        (1, 0, False, 0.0, 0.0, 1000.0, 0.0),
        (2, 0, False, 200.0, 5.0, 400.0, 5.0),  # replaces a stretch of 1
        (3, 0, True, 300.0, 0.0, 300.0, 1.0),  # takes the middle of 2; the stretch of 1 stays gone
        (4, 0, False, 700.0, -50.0, 700.0, 50.0),  # across: takes nothing
        (5, 1, True, 0.0, 0.0, 1000.0, 0.0),  # another level
        (6, 0, False, 50.0, 50.0, 50.0, 50.0),  # no length
    ]
    got = sorted(tuple(r) for r in edits.surviving(spark.createDataFrame(drawn, "id bigint, level bigint, erases boolean, x1 double, y1 double, x2 double, y2 double"), 20, 0.866).collect())
    reach = math.sqrt(20 * 20 - 25) / 1000
    assert [g for g in got if g[0] == 1] == [(1, 0.0, pytest.approx(0.2 - reach, abs=2e-6)), (1, pytest.approx(0.4 + reach, abs=2e-6), 1.0)]
    assert len([g for g in got if g[0] == 2]) == 2 and len([g for g in got if g[0] == 4]) == 1


# Turns --------------------------------------------------------------------------------------------------------------------


def said(spark, points, hills=()):
    rows = spark.createDataFrame([(1, i, float(x), float(y), k, bool(j)) for i, (x, y, k, j) in enumerate(points)], "path bigint, i bigint, x double, y double, kind string, junction boolean")
    got = manoeuvres.manoeuvres(rows, spark.createDataFrame(list(hills), "r bigint, c bigint"), 10).orderBy("n").collect()
    return [(r["kind"], round(r["dist"])) for r in got]


def test_each_kind_of_manoeuvre(spark):
    off = lambda *at: [(x, y, "off", 0) for x, y in at]
    assert said(spark, off((0, 0), (100, 0), (100, 100))) == [("turn", 100), ("arrive", 200)]
    assert said(spark, off((0, 0), (100, 0), (200, 20))) == [("arrive", 202)]  # too little of a bend
    road = [(0, 0, "off", 0), (100, 0, "road", 0), (300, 0, "off", 0), (400, 0, "off", 0)]
    assert said(spark, road) == [("join", 100), ("leave", 300), ("arrive", 400)]
    assert said(spark, [(0, 0, "off", 0), (100, 0, "road", 0), (140, 0, "off", 0), (300, 0, "off", 0)]) == [("arrive", 300)]  # a hop
    assert said(spark, [(0, 0, "off", 0), (100, 0, "road", 0), (100, 200, "road", 0)]) == [("turn", 100), ("arrive", 300)]  # with the road joined
    assert said(spark, [(0, 0, "road", 0), (100, 0, "road", 0), (150, 75, "road", 0)]) == [("arrive", 190)]  # along a road, no junction
    assert said(spark, [(0, 0, "road", 0), (100, 0, "road", 1), (150, 75, "road", 0)]) == [("turn", 100), ("arrive", 190)]
    assert said(spark, [(0, 0, "road", 0), (100, 0, "drop", 0), (110, 0, "road", 0), (200, 0, "up", 0), (201, 0, "road", 0), (300, 0, "road", 0)]) == [("drop", 100), ("lift", 200), ("arrive", 300)]
    jog = off((0, 0), (100, 0), (110, 40), (120, 0), (300, 0))
    assert said(spark, jog) == [("arrive", 362)]
    assert [k for k, _ in said(spark, jog, hills=[(r, c) for r in range(-1, 5) for c in range(30)])] != ["arrive"]  # winding up a slope
    assert said(spark, off((0, 0), (10, 0))) == [("arrive", 10)]
