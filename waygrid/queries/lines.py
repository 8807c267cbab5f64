"""Polylines, grid paths, edits in order, rides against walks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waygrid.functions import geo
from waygrid.operators import lines, ordered, raster
from waygrid.operators.spatial import crossings, in_buckets, nearest_segments, nearest_within, point_buckets
from waygrid.plans import components, paths
from waygrid.queries import query
from waygrid.queries.raster import cell_steps
from waygrid.sources.fixtures import fixture

STEPS = "SELECT *, sqrt((x - lag(x) OVER v) * (x - lag(x) OVER v) + (y - lag(y) OVER v) * (y - lag(y) OVER v)) AS step FROM $hops WINDOW v AS (PARTITION BY path ORDER BY seq, l_partkey, x, y)"


def _lines(spark, sf):
    """Each order's stops as one line; an order has a handful of them."""
    point = F.struct("seq", "l_partkey", "x", "y")
    rows = fixture(spark, sf, "hops").groupBy("path").agg(F.array_sort(F.collect_list(point)).alias("p"))
    return rows.select("path", F.transform("p", lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y"))).alias("points"))


@query(f"SELECT path, round(sum(coalesce(step, 0.0)), 4) AS length, count(*) AS points FROM ({STEPS}) q GROUP BY path")
def line_lengths(spark, sf):
    return _lines(spark, sf).select("path", F.round(lines.length(F.col("points")), 4).alias("length"), F.size("points").cast("bigint").alias("points"))


@query("""WITH o AS (SELECT path, x, y, row_number() OVER w AS k, lead(x) OVER w AS nx, lead(y) OVER w AS ny, count(*) OVER (PARTITION BY path) AS n FROM $hops WINDOW w AS (PARTITION BY path ORDER BY seq, l_partkey, x, y)),
c AS (SELECT path, n, 2 * k AS pos, x * 0.75 + nx * 0.25 AS x, y * 0.75 + ny * 0.25 AS y FROM o WHERE n > 2 AND nx IS NOT NULL AND k > 1 UNION ALL SELECT path, n, 2 * k + 1 AS pos, x * 0.25 + nx * 0.75 AS x, y * 0.25 + ny * 0.75 AS y FROM o WHERE n > 2 AND nx IS NOT NULL AND k < n - 1
UNION ALL SELECT path, n, 2 * k + CASE WHEN k = 1 THEN 0 ELSE 1 END AS pos, x, y FROM o WHERE n < 3 OR k = 1 OR k = n)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY pos) - 1 AS k, round(x, 4) AS x, round(y, 4) AS y FROM c""")
def smoothed_lines(spark, sf):
    smooth = _lines(spark, sf).select("path", F.posexplode(lines.chaikin(F.col("points"))).alias("k", "p"))
    return smooth.select("path", F.col("k").cast("bigint").alias("k"), F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("SELECT path, row_number() OVER (PARTITION BY path ORDER BY seq, l_partkey, x, y) - 1 AS k, x, y FROM $hops")
def packed_lines(spark, sf):
    """Lines packed as steps and unpacked again, point by point."""
    back = _lines(spark, sf).select("path", F.posexplode(lines.undeltas(lines.deltas(F.col("points")))).alias("k", "p"))
    return back.select("path", F.col("k").cast("bigint").alias("k"), "p.x", "p.y")


@query("""WITH RECURSIVE o AS (SELECT path, x, y, row_number() OVER (PARTITION BY path ORDER BY seq, l_partkey, x, y) AS k, count(*) OVER (PARTITION BY path) AS n FROM $hops),
cuts AS (SELECT DISTINCT path, CAST(1 AS BIGINT) AS a, n AS b FROM o UNION ALL SELECT path, unnest([a, m]) AS a, unnest([m, b]) AS b FROM (
 SELECT path, a, b, arg_max(k, (d, -k)) AS m, max(d) AS far FROM (SELECT c.path, c.a, c.b, p.k, (p.x - u.x - t * (v.x - u.x)) * (p.x - u.x - t * (v.x - u.x)) + (p.y - u.y - t * (v.y - u.y)) * (p.y - u.y - t * (v.y - u.y)) AS d
  FROM cuts c JOIN o u ON u.path = c.path AND u.k = c.a JOIN o v ON v.path = c.path AND v.k = c.b JOIN o p ON p.path = c.path AND p.k > c.a AND p.k < c.b,
  LATERAL (SELECT CASE WHEN (v.x - u.x) * (v.x - u.x) + (v.y - u.y) * (v.y - u.y) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((p.x - u.x) * (v.x - u.x) + (p.y - u.y) * (v.y - u.y)) / ((v.x - u.x) * (v.x - u.x) + (v.y - u.y) * (v.y - u.y)))) END AS t) l) q GROUP BY path, a, b) g WHERE far > 3600)
SELECT o.path, o.k - 1 AS k, o.x, o.y FROM o JOIN (SELECT path, a AS k FROM cuts UNION SELECT path, b AS k FROM cuts) c ON c.path = o.path AND c.k = o.k""")
def simplified_lines(spark, sf):
    """The points that stay when none that goes is farther than 60 yards from the line."""
    numbered = _lines(spark, sf).withColumn("points", F.transform("points", lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), i.alias("k"))))
    kept = lines.simplify(numbered, 60.0).select("path", F.explode("points").alias("p"))
    return kept.select("path", F.col("p.k").cast("bigint").alias("k"), "p.x", "p.y")


@query("""WITH RECURSIVE o AS (SELECT kind, pid, x, y, row_number() OVER (PARTITION BY kind ORDER BY pid) AS n FROM $people),
run AS (SELECT kind, CAST(1 AS BIGINT) AS n, [{'pid': pid, 'x': x, 'y': y}] AS kept, pid AS joined FROM o WHERE n = 1 UNION ALL
 SELECT kind, n, CASE WHEN len(near) = 0 THEN list_append(kept, {'pid': pid, 'x': x, 'y': y}) ELSE kept END AS kept, CASE WHEN len(near) = 0 THEN pid ELSE near[1].pid END AS joined FROM (
 SELECT o.kind, o.n, o.pid, o.x, o.y, r.kept, list_filter(r.kept, lambda k: (k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y) <= 160000) AS near FROM run r JOIN o ON o.kind = r.kind AND o.n = r.n + 1) q)
SELECT kind, joined AS kept, count(*) AS n FROM run GROUP BY kind, joined""")
def merged_same_name(spark, sf):
    """Sightings of one kind of thing within 400 yards of an earlier one count with it."""
    return lines.merged_near(fixture(spark, sf, "people").select("kind", "pid", "x", "y"), ["kind"], "pid", 400).select("kind", "kept", "n")


@query("""SELECT id, map_id, bool_or(v = 2) AS blocked FROM (SELECT s.id, s.kind AS map_id, g.v FROM $sites s LEFT JOIN $cells g ON g.r = CAST(floor(s.x / 250) AS BIGINT) AND g.c = CAST(floor(s.y / 250) AS BIGINT)) q GROUP BY id, map_id""")
def open_places(spark, sf):
    """The cell under each place; null outside the grid."""
    at = fixture(spark, sf, "sites").select("id", F.col("kind").alias("map_id"), F.floor(F.col("x") / 250).alias("r"), F.floor(F.col("y") / 250).alias("c"))
    return at.join(fixture(spark, sf, "cells").select("r", "c", "v"), ["r", "c"], "left").select("id", "map_id", (F.col("v") == 2).alias("blocked"))


def _part(node):
    """The square of cells that a cell's number lies in."""
    return raster.square(F.floor(node / 65536), node % 65536)


@query("""WITH RECURSIVE e AS (SELECT a.r * 65536 + a.c AS a, b.r * 65536 + b.c AS b, CASE WHEN a.r <> b.r AND a.c <> b.c THEN round(sqrt(2.0), 6) ELSE 1.0 END * CASE WHEN b.v = 1 THEN 1.5 ELSE 1.0 END AS w
FROM $cells a JOIN $cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) LEFT JOIN $cells s ON s.r = a.r AND s.c = b.c LEFT JOIN $cells t ON t.r = b.r AND t.c = a.c
WHERE a.v < 2 AND b.v < 2 AND (a.r = b.r OR a.c = b.c OR (coalesce(s.v, 2) < 2 AND coalesce(t.v, 2) < 2))), best(node, cost) USING KEY (node) AS (SELECT min(r * 65536 + c) AS node, CAST(0 AS DOUBLE) AS cost FROM $cells WHERE v < 2
UNION SELECT n.node, min(n.cost) AS cost FROM (SELECT e.b AS node, f.cost + e.w AS cost FROM best f JOIN e ON e.a = f.node) n LEFT JOIN recurring.best o ON o.node = n.node WHERE o.cost IS NULL OR n.cost < o.cost - 1e-9 GROUP BY n.node)
SELECT CAST(floor(node / 65536) AS BIGINT) AS r, node % 65536 AS c, round(cost, 4) AS cost FROM best""")
def cell_paths(spark, sf):
    """Least costs from the first open cell over an eight-way grid."""
    key = lambda r, c: F.col(r) * 65536 + F.col(c)
    edges = cell_steps(spark, sf).select(key("r", "c").alias("a"), key("br", "bc").alias("b"), F.col("cost").alias("w"))
    start = fixture(spark, sf, "cells").filter("v < 2").agg(F.min(key("r", "c")).alias("node")).select(F.lit(0).alias("source"), "node", F.lit(0.0).alias("cost"))
    costs = paths.shortest_paths_by_parts(edges, start, _part)
    return costs.select(F.floor(F.col("node") / 65536).alias("r"), (F.col("node") % 65536).alias("c"), F.round("cost", 4).alias("cost"))


@query("""WITH RECURSIVE e AS (SELECT a.r * 65536 + a.c AS a, b.r * 65536 + b.c AS b, CASE WHEN a.r <> b.r AND a.c <> b.c THEN round(sqrt(2.0), 6) ELSE 1.0 END * CASE WHEN b.v = 1 THEN 1.5 ELSE 1.0 END AS w
FROM $cells a JOIN $cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) LEFT JOIN $cells s ON s.r = a.r AND s.c = b.c LEFT JOIN $cells t ON t.r = b.r AND t.c = a.c
WHERE a.v < 2 AND b.v < 2 AND (a.r = b.r OR a.c = b.c OR (coalesce(s.v, 2) < 2 AND coalesce(t.v, 2) < 2))), best(node, cost) USING KEY (node) AS (SELECT min(r * 65536 + c) AS node, CAST(0 AS DOUBLE) AS cost FROM $cells WHERE v < 2
UNION SELECT n.node, min(n.cost) AS cost FROM (SELECT e.b AS node, f.cost + e.w AS cost FROM best f JOIN e ON e.a = f.node) n LEFT JOIN recurring.best o ON o.node = n.node WHERE o.cost IS NULL OR n.cost < o.cost GROUP BY n.node),
prev AS (SELECT t.node, min(f.node) AS prev FROM best f JOIN e ON e.a = f.node JOIN best t ON t.node = e.b AND t.cost = f.cost + e.w GROUP BY t.node),
back AS (SELECT node AS target, node, 0 AS k FROM best WHERE node IN (SELECT max(r * 65536 + c) FROM $cells WHERE v < 2 GROUP BY r) UNION ALL SELECT b.target, p.prev AS node, k + 1 AS k FROM back b JOIN prev p ON p.node = b.node)
SELECT CAST(floor(target / 65536) AS BIGINT) AS row_, row_number() OVER (PARTITION BY target ORDER BY k DESC) AS seq, CAST(floor(node / 65536) AS BIGINT) AS r, node % 65536 AS c FROM back""")
def cell_ways(spark, sf):
    """The cells of a cheapest way from the first open cell to the last one of each row."""
    key = lambda r, c: F.col(r) * 65536 + F.col(c)
    edges = cell_steps(spark, sf).select(key("r", "c").alias("a"), key("br", "bc").alias("b"), F.col("cost").alias("w"))
    open_ = fixture(spark, sf, "cells").filter("v < 2")
    start = open_.agg(F.min(key("r", "c")).alias("node")).select(F.lit(0).alias("source"), "node", F.lit(0.0).alias("cost"))
    costs = paths.shortest_paths_by_parts(edges, start, _part)
    ends = open_.groupBy("r").agg(F.max(key("r", "c")).alias("target")).join(costs, F.col("target") == F.col("node")).select("source", "target")
    way = paths.routes(costs, edges, ends)
    return way.select(F.floor(F.col("target") / 65536).alias("row_"), F.col("seq").cast("bigint").alias("seq"), F.floor(F.col("node") / 65536).alias("r"), (F.col("node") % 65536).alias("c"))


@query("""WITH RECURSIVE e AS (SELECT a.r * 65536 + a.c AS a, b.r * 65536 + b.c AS b FROM $cells a JOIN $cells b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE a.v = 2 AND b.v = 2),
n AS (SELECT r * 65536 + c AS node FROM $cells WHERE v = 2), reach AS (SELECT node, node AS other FROM n UNION SELECT r.node, e.b AS other FROM reach r JOIN e ON r.other = e.a), k AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT component, count(*) AS cells, count(*) < 6 AS speck FROM k GROUP BY component""")
def specks(spark, sf):
    """Blocked regions by size; small ones are specks."""
    cells = fixture(spark, sf, "cells").select("r", "c", "v")
    met = raster.neighbours(cells, raster.CROSS).join(cells, ["r", "c"]).filter("v = 2 AND other = 2")
    links = met.select((F.col("r") * 65536 + F.col("c")).alias("a"), ((F.col("r") + F.col("dr")) * 65536 + F.col("c") + F.col("dc")).alias("b"))
    alone = cells.filter("v = 2").select((F.col("r") * 65536 + F.col("c")).alias("a"), (F.col("r") * 65536 + F.col("c")).alias("b"))
    found = components.connected_components(links.unionByName(alone))
    return found.groupBy("component").agg(F.count("*").alias("cells")).withColumn("speck", F.col("cells") < 6)


@query("""SELECT w.pid AS wall FROM $people w WHERE NOT EXISTS (SELECT 1 FROM $people e WHERE e.pid > w.pid AND e.kind = w.kind AND sqrt((e.x - w.x) * (e.x - w.x) + (e.y - w.y) * (e.y - w.y)) <= 300)""")
def standing_walls(spark, sf):
    """Edits replayed without a fold: a wall stands unless a later eraser of its floor comes near."""
    walls = fixture(spark, sf, "people")
    erasers = walls.select(F.col("pid").alias("later"), "kind", F.col("x").alias("tx"), F.col("y").alias("ty"))
    gone = nearest_within(walls, erasers, 300, "pid", "later", allowed=F.col("later") > F.col("pid"), same=("kind",)).select("pid")
    return walls.join(gone, "pid", "left_anti").select(F.col("pid").alias("wall"))


ENDS = "SELECT wid, 1 AS side, x1 AS x, y1 AS y, x1 - x2 AS dx, y1 - y2 AS dy FROM $walls UNION ALL SELECT wid, 2 AS side, x2 AS x, y2 AS y, x2 - x1 AS dx, y2 - y1 AS dy FROM $walls"


@query(f"""WITH ends AS ({ENDS}) SELECT a.wid AS a, a.side AS sa, b.wid AS b, b.side AS sb FROM ends a JOIN ends b ON a.wid < b.wid AND sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) BETWEEN 1e-9 AND 250
WHERE (b.x - a.x) * a.dx + (b.y - a.y) * a.dy >= 0.8660254 * sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) * sqrt(a.dx * a.dx + a.dy * a.dy)
AND (a.x - b.x) * b.dx + (a.y - b.y) * b.dy >= 0.8660254 * sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) * sqrt(b.dx * b.dx + b.dy * b.dy)""")
def bridge_gaps(spark, sf):
    """Pairs of road ends within reach that both head for each other."""
    w = fixture(spark, sf, "walls")
    end = lambda s, a, b: w.select("wid", F.lit(s).alias("side"), F.col(f"x{a}").alias("x"), F.col(f"y{a}").alias("y"), (F.col(f"x{a}") - F.col(f"x{b}")).alias("dx"), (F.col(f"y{a}") - F.col(f"y{b}")).alias("dy"))
    ends = end(1, 1, 2).unionByName(end(2, 2, 1))
    left = in_buckets(ends, F.col("x") - 250, F.col("x") + 250, F.col("y") - 250, F.col("y") + 250, 250)
    right = point_buckets(ends.select(*[F.col(c).alias(f"o_{c}") for c in ends.columns]), 250, "o_x", "o_y")
    d = geo.distance(F.col("x"), F.col("y"), F.col("o_x"), F.col("o_y"))
    heads = lambda p, sign: sign * ((F.col("o_x") - F.col("x")) * F.col(f"{p}dx") + (F.col("o_y") - F.col("y")) * F.col(f"{p}dy")) >= 0.8660254 * d * F.sqrt(F.col(f"{p}dx") * F.col(f"{p}dx") + F.col(f"{p}dy") * F.col(f"{p}dy"))
    pairs = left.join(right, ["bx", "by"]).filter((F.col("wid") < F.col("o_wid")) & d.between(1e-9, 250)).filter(heads("", 1) & heads("o_", -1))
    return pairs.select(F.col("wid").alias("a"), F.col("side").alias("sa"), F.col("o_wid").alias("b"), F.col("o_side").alias("sb"))


@query("""SELECT s.id, f.dst AS dock, round(walk - ride, 4) AS gain FROM (SELECT s.id, f.dst, sqrt((s.x - d.x) * (s.x - d.x) + (s.y - d.y) * (s.y - d.y)) * 1.35 / 7 AS walk, f.yards / 32 + 15 AS ride,
 row_number() OVER (PARTITION BY s.id ORDER BY sqrt((s.x - d.x) * (s.x - d.x) + (s.y - d.y) * (s.y - d.y)) * 1.35 / 7 - f.yards / 32 - 15 DESC, f.dst) AS n FROM $sites s JOIN $flights f ON f.src = s.kind JOIN $docks d ON d.id = f.dst) s JOIN (SELECT DISTINCT dst FROM $flights) f ON f.dst = s.dst WHERE n = 1 AND walk - ride > 15""")
def rides_instead(spark, sf):
    """The ride from a site's dock that saves most against walking there, if it saves a quarter minute."""
    sites, docks = fixture(spark, sf, "sites"), fixture(spark, sf, "docks").toDF("dock", "dx", "dy")
    both = sites.join(fixture(spark, sf, "flights"), F.col("kind") == F.col("src")).join(docks, F.col("dst") == F.col("dock"))
    gain = geo.distance(F.col("x"), F.col("y"), F.col("dx"), F.col("dy")) * 1.35 / 7 - F.col("yards") / 32 - 15
    best = both.withColumn("gain", gain).groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("g"), "dock")).alias("b"))
    return best.select("id", "b.dock", F.round(-F.col("b.g"), 4).alias("gain")).filter(-F.col("b.g") > 15)


@query("""SELECT teleport, trip, gain FROM (SELECT *, row_number() OVER (PARTITION BY teleport ORDER BY gain DESC, trip) AS n FROM (SELECT o_custkey % 20 AS teleport, o_orderkey AS trip, o_totalprice AS gain FROM @orders WHERE o_totalprice >= 800) q) p WHERE n = 1""")
def assigned_teleports(spark, sf):
    """Each teleport goes to the trip that gains most, if it gains enough."""
    trips = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 20).alias("teleport"), F.col("o_orderkey").alias("trip"), F.col("o_totalprice").alias("gain"))
    best = trips.filter("gain >= 800").groupBy("teleport").agg(F.min(F.struct((-F.col("gain")).alias("g"), "trip")).alias("b"))
    return best.select("teleport", "b.trip", (-F.col("b.g")).alias("gain"))


@query("""SELECT asked, CASE WHEN max(CASE WHEN n_name = asked THEN 1 ELSE 0 END) = 1 THEN max(CASE WHEN n_name = asked THEN n_nationkey END) WHEN count(*) = 1 THEN min(n_nationkey) END AS map_id
FROM (SELECT * FROM (VALUES ('NATION_1'), ('NATION_2'), ('NATION_24'), ('NATION_9'), ('NAT')) AS a(asked)) a JOIN @nation ON starts_with(n_name, asked) GROUP BY asked""")
def find_map(spark, sf):
    """A map by its exact name, else by a prefix that only one has."""
    asked = spark.createDataFrame([(x,) for x in ("NATION_1", "NATION_2", "NATION_24", "NATION_9", "NAT")], "asked string")
    maps = spark.read.parquet(f"{sf}/nation.parquet")
    met = maps.join(F.broadcast(asked), F.startswith("n_name", "asked"))  # a few typed names
    exact = F.max(F.when(F.col("n_name") == F.col("asked"), F.col("n_nationkey")))
    return met.groupBy("asked").agg(F.coalesce(exact, F.when(F.count("*") == 1, F.min("n_nationkey"))).alias("map_id"))


@query("""SELECT id, max(yards) AS longest FROM (SELECT id, g, count(*) * 50 AS yards FROM (SELECT id, k, k - row_number() OVER (PARTITION BY id ORDER BY k) AS g FROM (
 SELECT s.id, s.k FROM (SELECT id, k, n, CAST(floor((x1 + (x2 - x1) * (k / n)) / 250) AS BIGINT) AS r, CAST(floor((y1 + (y2 - y1) * (k / n)) / 250) AS BIGINT) AS c FROM (SELECT *, unnest(generate_series(0, n)) AS k FROM (SELECT *, CAST(greatest(1, ceil(sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) / 50)) AS BIGINT) AS n FROM $segments) p) o) s
 LEFT JOIN $cells g ON g.r = s.r AND g.c = s.c WHERE coalesce(g.v, 2) = 2 AND s.k > 1 AND s.k < s.n - 1) q) p GROUP BY id, g) t GROUP BY id""")
def blocked_run(spark, sf):
    """The longest run of blocked samples of each way, away from its ends."""
    samples = raster.end_samples(fixture(spark, sf, "segments"), 50).filter("k > 1 AND k < n - 1")
    samples = samples.select("id", "k", F.floor(F.col("sx") / 250).alias("r"), F.floor(F.col("sy") / 250).alias("c"))
    blocked = samples.join(fixture(spark, sf, "cells").select("r", "c", "v"), ["r", "c"], "left").filter(F.coalesce("v", F.lit(2)) == 2)
    w = Window.partitionBy("id").orderBy("k")
    stretches = ordered.islands(blocked.select("id", "k"), ["id"], ["k"], F.col("k") - F.lag("k").over(w) > 1)
    return stretches.groupBy("id", "island").agg((F.count("*") * 50).alias("yards")).groupBy("id").agg(F.max("yards").alias("longest"))


@query("""SELECT wid, count(*) AS crossed FROM (SELECT DISTINCT s.id, w.wid FROM $segments s JOIN $walls w ON ((w.x2 - w.x1) * (s.y1 - w.y1) - (w.y2 - w.y1) * (s.x1 - w.x1)) * ((w.x2 - w.x1) * (s.y2 - w.y1) - (w.y2 - w.y1) * (s.x2 - w.x1)) < 0
 AND ((s.x2 - s.x1) * (w.y1 - s.y1) - (s.y2 - s.y1) * (w.x1 - s.x1)) * ((s.x2 - s.x1) * (w.y2 - s.y1) - (s.y2 - s.y1) * (w.x2 - s.x1)) <= 0) q GROUP BY wid HAVING count(*) >= 2""")
def cut_edges(spark, sf):
    """Edges that two or more drawn lines cut."""
    walls = fixture(spark, sf, "walls").withColumnsRenamed({c: f"w{c}" for c in ("x1", "y1", "x2", "y2")})
    hit = crossings(fixture(spark, sf, "segments"), walls, "id", "wid", 400)
    return hit.groupBy("wid").agg(F.count("*").alias("crossed")).filter("crossed >= 2")


@query("""SELECT pid, wid FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, wid) AS n FROM (SELECT pid, wid, kind, wkind, sqrt((x - (x1 + t * (x2 - x1))) * (x - (x1 + t * (x2 - x1))) + (y - (y1 + t * (y2 - y1))) * (y - (y1 + t * (y2 - y1)))) AS d FROM (
 SELECT p.pid, p.kind, w.wid, p.x, p.y, w.x1, w.y1, w.x2, w.y2, w.wid % 25 AS wkind, CASE WHEN l = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((p.x - w.x1) * (w.x2 - w.x1) + (p.y - w.y1) * (w.y2 - w.y1)) / l)) END AS t
 FROM $people p CROSS JOIN (SELECT *, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS l FROM $walls) w) q) p WHERE d <= 450) o WHERE n = 1""")
def learned_on_route(spark, sf):
    """The way that passes each master within 450 yards, the nearest one."""
    found = nearest_segments(fixture(spark, sf, "people"), fixture(spark, sf, "walls"), "pid", "wid", 450, k=1)
    return found.select("pid", "wid")
