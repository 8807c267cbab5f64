"""Networks: degrees, components, shortest paths, flights, itineraries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waygrid.functions import geo
from waygrid.operators import network
from waygrid.operators.spatial import nearest_segments, smallest_box
from waygrid.plans import components, paths
from waygrid.queries import query
from waygrid.queries.raster import zone_yards
from waygrid.sources.fixtures import fixture


@query("SELECT node, count(*) AS degree FROM (SELECT a AS node FROM $arcs UNION ALL SELECT b AS node FROM $arcs) q GROUP BY node")
def node_degrees(spark, sf):
    return network.degrees(fixture(spark, sf, "arcs"))


@query("SELECT node, list_sort(list_distinct(list(other))) AS others FROM (SELECT a AS node, b AS other FROM $arcs UNION ALL SELECT b AS node, a AS other FROM $arcs) q GROUP BY node")
def incident_nodes(spark, sf):
    return network.incident(fixture(spark, sf, "arcs"))


@query("SELECT node, count(*) AS degree FROM (SELECT a AS node FROM $arcs UNION ALL SELECT b AS node FROM $arcs) q GROUP BY node HAVING count(*) >= 3")
def junctions(spark, sf):
    return network.junctions(fixture(spark, sf, "arcs"))


@query("""WITH e AS (SELECT a, b, CAST(1 + (a * 7 + b) % 50 AS DOUBLE) AS w FROM $forest), d AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM e UNION ALL SELECT b AS node FROM e) q GROUP BY node)
SELECT e.a, e.b, e.w FROM e JOIN d x ON x.node = e.a JOIN d y ON y.node = e.b WHERE NOT (least(x.n, y.n) = 1 AND greatest(x.n, y.n) > 1 AND e.w < 25)""")
def prune_spurs(spark, sf):
    edges = fixture(spark, sf, "forest").withColumn("w", (1 + (F.col("a") * 7 + F.col("b")) % 50).cast("double"))
    return network.without_spurs(edges, 25)


@query("""WITH RECURSIVE e AS (SELECT a, b FROM $forest UNION SELECT b AS a, a AS b FROM $forest), reach AS (SELECT DISTINCT a AS node, a AS other FROM e UNION SELECT r.node, e.b AS other FROM reach r JOIN e ON r.other = e.a)
SELECT node, min(other) AS component FROM reach GROUP BY node""")
def connected_components(spark, sf):
    return components.connected_components(fixture(spark, sf, "forest"))


@query("""WITH RECURSIVE e AS (SELECT a, b FROM $forest UNION SELECT b AS a, a AS b FROM $forest), reach AS (SELECT DISTINCT a AS node, a AS other FROM e UNION SELECT r.node, e.b AS other FROM reach r JOIN e ON r.other = e.a),
c AS (SELECT node, min(other) AS component FROM reach GROUP BY node) SELECT component, count(*) AS nodes FROM c GROUP BY component HAVING count(*) >= 4""")
def large_components(spark, sf):
    found = components.connected_components(fixture(spark, sf, "forest"))
    return found.groupBy("component").agg(F.count("*").alias("nodes")).filter("nodes >= 4")


NEAR = "SELECT a.pid AS a, b.pid AS b FROM $people a JOIN $people b ON a.pid <> b.pid AND a.kind = b.kind AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 400"


@query(f"""WITH RECURSIVE e AS ({NEAR}), reach AS (SELECT DISTINCT a AS node, a AS other FROM e UNION SELECT r.node, e.b AS other FROM reach r JOIN e ON r.other = e.a)
SELECT node AS pid, min(other) AS cluster FROM reach GROUP BY node""")
def place_clusters(spark, sf):
    """Single-linkage clusters of places of one kind."""
    people = fixture(spark, sf, "people")
    found = components.linked_places(people.select(F.col("pid").alias("id"), "x", "y", F.lit(0.0).alias("r"), "kind"), 400, "kind")
    return found.toDF("pid", "cluster")


@query("""WITH RECURSIVE e AS (SELECT a.cid AS a, b.cid AS b FROM $circles a JOIN $circles b ON a.cid <> b.cid AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= a.r + b.r + 60),
reach AS (SELECT DISTINCT a AS node, a AS other FROM e UNION SELECT r.node, e.b AS other FROM reach r JOIN e ON r.other = e.a) SELECT node AS cid, min(other) AS town FROM reach GROUP BY node""")
def hostile_towns(spark, sf):
    """Circles that come within 60 yards of each other are one town."""
    circles = fixture(spark, sf, "circles")
    return components.linked_places(circles.select(F.col("cid").alias("id"), "x", "y", "r"), 60).toDF("cid", "town")


@query("""WITH RECURSIVE e AS (SELECT * FROM $edges), best(node, cost) USING KEY (node) AS (SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS cost
UNION SELECT n.node, min(n.cost) AS cost FROM (SELECT e.b AS node, f.cost + e.w AS cost FROM best f JOIN e ON e.a = f.node) n LEFT JOIN recurring.best o ON o.node = n.node WHERE o.cost IS NULL OR n.cost < o.cost GROUP BY n.node)
SELECT node, cost FROM best""")
def shortest_paths(spark, sf):
    source = spark.sql("SELECT 1L AS source, 1L AS node, 0D AS cost")
    return paths.shortest_paths(fixture(spark, sf, "edges"), source).select("node", "cost")


@query("""WITH RECURSIVE e AS (SELECT * FROM $edges), best(src, node, cost) USING KEY (src, node) AS (SELECT CAST(id AS BIGINT) AS src, CAST(id * 3 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS cost FROM $docks
UNION SELECT n.src, n.node, min(n.cost) AS cost FROM (SELECT f.src, e.b AS node, f.cost + e.w AS cost FROM best f JOIN e ON e.a = f.node) n LEFT JOIN recurring.best o ON o.node = n.node AND o.src = n.src WHERE o.cost IS NULL OR n.cost < o.cost GROUP BY n.src, n.node)
SELECT node, source, cost FROM (SELECT node, src AS source, cost, row_number() OVER (PARTITION BY node ORDER BY cost, src) AS n FROM best) q WHERE n = 1""")
def nearest_entrances(spark, sf):
    """Each node goes to the entrance that reaches it soonest."""
    sources = fixture(spark, sf, "docks").select(F.col("id").cast("bigint").alias("source"), (F.col("id") * 3).cast("bigint").alias("node"), F.lit(0.0).alias("cost"))
    return paths.labelled_search(fixture(spark, sf, "edges"), sources)


@query("""WITH RECURSIVE e AS (SELECT a, b, min(w) AS w FROM $edges GROUP BY a, b), term AS (SELECT DISTINCT CAST(id * 3 AS BIGINT) AS node FROM $docks),
best(node, m) USING KEY (node) AS (SELECT node, struct_pack(cost := CAST(0 AS DOUBLE), source := node) AS m FROM term
UNION SELECT n.node, min(n.m) AS m FROM (SELECT e.b AS node, struct_pack(cost := f.m.cost + e.w, source := f.m.source) AS m FROM best f JOIN e ON e.a = f.node) n LEFT JOIN recurring.best o ON o.node = n.node WHERE o.m IS NULL OR n.m < o.m GROUP BY n.node),
x AS (SELECT least(f.m.source, t.m.source) AS u, greatest(f.m.source, t.m.source) AS v, min(struct_pack(over := f.m.cost + e.w + t.m.cost, a := e.a, b := e.b, w := e.w)) AS l FROM e JOIN best f ON f.node = e.a JOIN best t ON t.node = e.b WHERE e.a < e.b AND f.m.source <> t.m.source GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (ORDER BY l.over, u, v) AS n FROM x), ways AS (SELECT u AS a, v AS b, n FROM l UNION ALL SELECT v AS a, u AS b, n FROM l),
reach AS (SELECT n AS link, u AS node FROM l UNION SELECT r.link, b.b AS node FROM reach r JOIN ways b ON b.a = r.node AND b.n < r.link),
taken AS (SELECT l.a AS a, l.b AS b, l.w AS w FROM l WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.link = l.n AND r.node = l.v)),
tree AS (SELECT e.b AS node, min(struct_pack(a := e.a, w := e.w)) AS p FROM e JOIN best f ON f.node = e.a JOIN best t ON t.node = e.b WHERE f.m.source = t.m.source AND f.m.cost + e.w = t.m.cost GROUP BY e.b),
up AS (SELECT a AS node FROM taken UNION SELECT b AS node FROM taken UNION SELECT tree.p.a AS node FROM up JOIN tree ON tree.node = up.node)
SELECT a, b, w FROM taken UNION SELECT least(up.node, tree.p.a) AS a, greatest(up.node, tree.p.a) AS b, tree.p.w AS w FROM up JOIN tree ON tree.node = up.node""")
def street_network(spark, sf):
    """The streets that join all entrances: nearest regions, cheapest ways between them, a spanning forest of these."""
    terminals = fixture(spark, sf, "docks").select((F.col("id") * 3).cast("bigint").alias("node"))
    return paths.street_network(fixture(spark, sf, "edges"), terminals)


FLIGHT = "SELECT src, dst, yards / 32 + 15 AS s FROM $flights WHERE src <> dst"


@query(f"""WITH RECURSIVE f AS ({FLIGHT}), best(src, node, cost) USING KEY (src, node) AS (SELECT DISTINCT src, src AS node, CAST(0 AS DOUBLE) AS cost FROM f
UNION SELECT n.src, n.node, min(n.cost) AS cost FROM (SELECT b.src, f.dst AS node, b.cost + f.s AS cost FROM best b JOIN f ON f.src = b.node) n LEFT JOIN recurring.best o ON o.node = n.node AND o.src = n.src WHERE o.cost IS NULL OR n.cost < o.cost GROUP BY n.src, n.node)
SELECT src, node AS dst, round(cost, 6) AS seconds FROM best""")
def flight_times(spark, sf):
    """All-pairs flight times over the directed network."""
    f = fixture(spark, sf, "flights").filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("yards") / 32 + 15).alias("w"))
    sources = f.select(F.col("a").alias("source"), F.col("a").alias("node"), F.lit(0.0).alias("cost")).distinct()
    return paths.shortest_paths(f, sources).select(F.col("source").alias("src"), F.col("node").alias("dst"), F.round("cost", 6).alias("seconds"))


@query("SELECT a.src, b.dst, min(a.yards + b.yards) AS yards FROM $flights a JOIN $flights b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY a.src, b.dst")
def two_hop_flights(spark, sf):
    f = fixture(spark, sf, "flights")
    g = f.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("yards").alias("more"))
    both = f.join(g, F.col("dst") == F.col("mid")).filter("src <> end")
    return both.groupBy("src", F.col("end").alias("dst")).agg(F.min(F.col("yards") + F.col("more")).alias("yards"))


PLAN = """SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * 1.35 / 7 AS w FROM {s} a JOIN {s} b ON a.id <> b.id
UNION ALL SELECT CAST(src AS BIGINT) AS a, CAST(dst AS BIGINT) AS b, yards / 32 + 15 AS w FROM $flights WHERE src <> dst"""


@query(f"""WITH RECURSIVE s AS (SELECT CAST(id AS BIGINT) AS id, x, y FROM $docks), e AS ({PLAN.format(s="s")}), best(node, cost) USING KEY (node) AS (SELECT min(id) AS node, CAST(0 AS DOUBLE) AS cost FROM s
UNION SELECT n.node, min(n.cost) AS cost FROM (SELECT e.b AS node, f.cost + e.w AS cost FROM best f JOIN e ON e.a = f.node) n LEFT JOIN recurring.best o ON o.node = n.node WHERE o.cost IS NULL OR n.cost < o.cost GROUP BY n.node)
SELECT node, round(cost, 5) AS seconds FROM best""")
def multimodal_plan(spark, sf):
    """Walks at 7 yards a second (35 % longer than the straight line) and flights between docks, from the first one."""
    docks = fixture(spark, sf, "docks").withColumn("id", F.col("id").cast("bigint"))
    other = docks.toDF("b", "bx", "by")
    walks = docks.join(F.broadcast(other), F.col("id") != F.col("b"))  # one dock for each of the 25 nations
    walks = walks.select(F.col("id").alias("a"), "b", (geo.distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")) * 1.35 / 7).alias("w"))
    rides = fixture(spark, sf, "flights").filter("src <> dst").select(F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b"), (F.col("yards") / 32 + 15).alias("w"))
    start = docks.agg(F.min("id").alias("node")).select(F.lit(0).alias("source"), "node", F.lit(0.0).alias("cost"))
    costs = paths.shortest_paths(walks.unionByName(rides), start)
    return costs.select("node", F.round("cost", 5).alias("seconds"))


LEGS = """SELECT CAST(floor(a.id / 5) AS BIGINT) AS trip, a.id % 5 AS i, b.id % 5 AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS cost FROM $sites a JOIN $sites b ON floor(a.id / 5) = floor(b.id / 5) AND a.id <> b.id"""


@query(f"""WITH legs AS ({LEGS}) SELECT trip, total, stops FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY total, stops) AS n FROM (
SELECT a.trip, round(a.cost + b.cost + c.cost + d.cost, 6) AS total, CAST(a.j AS VARCHAR) || CAST(b.j AS VARCHAR) || CAST(c.j AS VARCHAR) || CAST(d.j AS VARCHAR) AS stops FROM legs a JOIN legs b ON b.trip = a.trip AND b.i = a.j JOIN legs c ON c.trip = b.trip AND c.i = b.j JOIN legs d ON d.trip = c.trip AND d.i = c.j
WHERE a.i = 0 AND a.j > 0 AND b.j > 0 AND c.j > 0 AND d.j > 0 AND b.j <> a.j AND c.j <> a.j AND c.j <> b.j AND d.j <> a.j AND d.j <> b.j AND d.j <> c.j) q) p WHERE n = 1""")
def order_stops(spark, sf):
    """The cheapest order of four stops after the first, for every trip of five sites."""
    sites = fixture(spark, sf, "sites").select(F.floor(F.col("id") / 5).alias("trip"), (F.col("id") % 5).alias("i"), "x", "y")
    other = sites.select("trip", F.col("i").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"))
    legs = sites.join(other, "trip").filter("i <> j").select("trip", "i", "j", geo.distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")).alias("cost"))
    best = paths.best_orders(legs)
    return best.select("trip", F.round("total", 6).alias("total"), F.array_join(F.col("stops").cast("array<string>"), "").alias("stops"))


@query()
def loop_orders(spark, sf):
    """Closed tours over trips of ten sites."""
    return paths.loop_orders(fixture(spark, sf, "sites").select(F.floor(F.col("id") / 10).alias("trip"), F.col("id").alias("stop"), "x", "y"))


@query("""SELECT src, dst, yards FROM (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY yards, src, dst) AS n FROM $flights) q WHERE n = 1""")
def ride_pins(spark, sf):
    """One row for each unordered pair of docks."""
    n = F.row_number().over(Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy("yards", "src", "dst"))
    return fixture(spark, sf, "flights").withColumn("n", n).filter("n = 1").drop("n")


@query("""WITH RECURSIVE up AS (SELECT p_partkey AS node, p_partkey AS place, 0 AS depth FROM @part UNION ALL SELECT node, CAST(floor(place / 2) AS BIGINT) AS place, depth + 1 AS depth FROM up WHERE place > 15)
SELECT node, place AS ancestor, depth FROM up WHERE place <= 15""")
def ancestor_walk(spark, sf):
    """The first ancestor that is a top zone, by climbing parents level by level."""
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("node"))
    # Each row climbs alone: floor(place / 2) shifts one bit out, so 64 steps end any walk and no level of all rows is ever held.
    climbed = F.expr("filter(transform(sequence(0, 63), k -> struct(shiftright(node, k) AS place, k AS depth)), s -> s.place <= 15)[0]")
    return parts.withColumn("top", climbed).select("node", F.col("top.place").alias("ancestor"), F.col("top.depth").alias("depth"))


@query("""WITH z AS (SELECT id, map_id FROM (SELECT s.id, z.map_id, row_number() OVER (PARTITION BY s.id ORDER BY (z.maxx - z.minx) * (z.maxy - z.miny), z.map_id) AS n FROM $sites s JOIN $zones z ON s.x >= z.minx AND s.x <= z.maxx AND s.y >= z.miny AND s.y <= z.maxy) q WHERE n = 1),
d AS (SELECT id, wid, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, wid) AS n FROM (SELECT id, wid, sqrt((x - (x1 + t * (x2 - x1))) * (x - (x1 + t * (x2 - x1))) + (y - (y1 + t * (y2 - y1))) * (y - (y1 + t * (y2 - y1)))) AS d FROM (
 SELECT s.id, w.wid, s.x, s.y, w.x1, w.y1, w.x2, w.y2, CASE WHEN l = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((s.x - w.x1) * (w.x2 - w.x1) + (s.y - w.y1) * (w.y2 - w.y1)) / l)) END AS t FROM $sites s CROSS JOIN (SELECT *, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS l FROM $walls) w) r) p WHERE d <= 800) q WHERE n = 1),
y AS (SELECT id, count(*) AS zones, round(sum(yards), 1) AS yards FROM (SELECT s.id, z.map_id, round(sum(s.share), 4) AS yards FROM (SELECT id, d / n AS share, x1 + (x2 - x1) * ((k + 0.5) / n) AS sx, y1 + (y2 - y1) * ((k + 0.5) / n) AS sy FROM (
  SELECT *, unnest(generate_series(0, n - 1)) AS k FROM (SELECT *, CAST(greatest(1, ceil(d / 64)) AS BIGINT) AS n FROM (SELECT *, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS d FROM $segments) q) p) o) s JOIN $zones z ON z.minx <= s.sx AND s.sx <= z.maxx AND z.miny <= s.sy AND s.sy <= z.maxy GROUP BY s.id, z.map_id) q GROUP BY id)
SELECT z.id, z.map_id, d.wid AS edge, round(d.d, 4) AS distance, y.zones, y.yards FROM z LEFT JOIN d ON d.id = z.id LEFT JOIN y ON y.id = z.id""")
def trip_overview(spark, sf):
    """Where each site lies, its nearest edge, and the zones and yards of the trip to the next one."""
    sites = fixture(spark, sf, "sites")
    at = smallest_box(sites, fixture(spark, sf, "zones"), "id", "map_id", 2000)
    near = nearest_segments(sites.select("id", "x", "y"), fixture(spark, sf, "walls"), "id", "wid", 800, k=1).select("id", F.col("wid").alias("edge"), F.round("d", 4).alias("distance"))
    yards = zone_yards(spark, sf).groupBy("id").agg(F.count("*").alias("zones"), F.round(F.sum("yards"), 1).alias("yards"))
    return at.join(near, "id", "left").join(yards, "id", "left")
