"""Networks: routes and their legs, clean-up, bridges, roads drawn, replaced and erased in order."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waygrid.functions import geo
from waygrid.operators import network, ordered
from waygrid.operators.spatial import in_buckets, nearest_segments, point_buckets
from waygrid.plans import components, paths
from waygrid.queries import query
from waygrid.queries.graph import PLAN
from waygrid.sources.fixtures import fixture

BEST = """best(node, cost) USING KEY (node) AS (SELECT {start} AS node, CAST(0 AS DOUBLE) AS cost
UNION SELECT n.node, min(n.cost) AS cost FROM (SELECT e.b AS node, f.cost + e.w AS cost FROM best f JOIN e ON e.a = f.node) n LEFT JOIN recurring.best o ON o.node = n.node WHERE o.cost IS NULL OR n.cost < o.cost GROUP BY n.node),
prev AS (SELECT t.node, min(f.node) AS prev FROM best f JOIN e ON e.a = f.node JOIN best t ON t.node = e.b AND t.cost = f.cost + e.w GROUP BY t.node)"""


@query(f"""WITH RECURSIVE e AS (SELECT * FROM $edges), {BEST.format(start="CAST(1 AS BIGINT)")},
back AS (SELECT node AS target, node, 0 AS k FROM best UNION ALL SELECT b.target, p.prev AS node, k + 1 AS k FROM back b JOIN prev p ON p.node = b.node WHERE b.node <> 1)
SELECT b.target, row_number() OVER (PARTITION BY b.target ORDER BY k DESC) AS seq, b.node, c.cost FROM back b JOIN best c ON c.node = b.node""")
def road_routes(spark, sf):
    """The nodes of a cheapest way from one place to every place that can be reached."""
    edges = fixture(spark, sf, "edges")
    costs = paths.shortest_paths(edges, spark.sql("SELECT 1L AS source, 1L AS node, 0D AS cost"))
    targets = costs.select("source", F.col("node").alias("target"))
    return paths.routes(costs, edges, targets).select("target", F.col("seq").cast("bigint").alias("seq"), "node", "cost")


@query(f"""WITH RECURSIVE s AS (SELECT CAST(id AS BIGINT) AS id, x, y FROM $docks), e AS ({PLAN.format(s="s")}), {BEST.format(start="(SELECT min(id) FROM s)")},
back AS (SELECT node AS target, node, 0 AS k FROM best UNION ALL SELECT b.target, p.prev AS node, k + 1 AS k FROM back b JOIN prev p ON p.node = b.node WHERE b.node <> (SELECT min(id) FROM s)),
steps AS (SELECT b.target, b.k, lag(b.node) OVER w AS src, b.node AS dst, c.cost - lag(c.cost) OVER w AS seconds, lag(c.cost) OVER w AS before, c.cost FROM back b JOIN best c ON c.node = b.node WINDOW w AS (PARTITION BY b.target ORDER BY b.k DESC)),
kinds AS (SELECT t.*, CASE WHEN EXISTS (SELECT 1 FROM $flights f WHERE f.src = t.src AND f.dst = t.dst AND t.before + (f.yards / 32 + 15) = t.cost) THEN 'ride' ELSE 'walk' END AS kind FROM steps t WHERE src IS NOT NULL),
marked AS (SELECT *, CASE WHEN kind = 'walk' AND lag(kind) OVER (PARTITION BY target ORDER BY k DESC) = 'walk' THEN 0 ELSE 1 END AS starts FROM kinds),
legs AS (SELECT *, sum(starts) OVER (PARTITION BY target ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS leg FROM marked)
SELECT target, CAST(leg AS BIGINT) AS leg, kind, arg_min(src, -k) AS src, arg_max(dst, -k) AS dst, round(sum(seconds), 4) AS seconds FROM legs GROUP BY target, leg, kind""")
def plan_legs(spark, sf):
    """The legs of the plans to all docks: rides and walks, walks that follow each other as one."""
    docks = fixture(spark, sf, "docks").withColumn("id", F.col("id").cast("bigint"))
    other = docks.toDF("b", "bx", "by")
    walks = docks.join(F.broadcast(other), F.col("id") != F.col("b"))  # one dock for each of the 25 nations
    walks = walks.select(F.col("id").alias("a"), "b", (geo.distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")) * 1.35 / 7).alias("w"))
    rides = fixture(spark, sf, "flights").filter("src <> dst").select(F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b"), (F.col("yards") / 32 + 15).alias("w"))
    edges = walks.unionByName(rides)
    costs = paths.shortest_paths(edges, docks.agg(F.min("id").alias("node")).select(F.lit(0).alias("source"), "node", F.lit(0.0).alias("cost")))
    way = paths.routes(costs, edges, costs.select("source", F.col("node").alias("target")))
    w = Window.partitionBy("target").orderBy("seq")
    steps = way.select("target", "seq", F.lag("node").over(w).alias("src"), F.col("node").alias("dst"), F.lag("cost").over(w).alias("before"), "cost").filter("src IS NOT NULL")
    ridden = rides.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("ride")).distinct()
    met = steps.join(F.broadcast(ridden), ["src", "dst"], "left")  # flights of the 25 nations
    steps = met.groupBy("target", "seq", "src", "dst", "before", "cost").agg(F.when(F.bool_or(F.col("before") + F.col("ride") == F.col("cost")), "ride").otherwise("walk").alias("kind"))
    goes_on = (F.col("kind") == "walk") & F.lag("kind").over(w).eqNullSafe(F.lit("walk"))
    legs = ordered.islands(steps.withColumn("_new", ~goes_on), ["target"], ["seq"], F.col("_new"), "leg")
    out = legs.groupBy("target", "leg", "kind").agg(F.min_by("src", "seq").alias("src"), F.max_by("dst", "seq").alias("dst"), F.round(F.sum(F.col("cost") - F.col("before")), 4).alias("seconds"))
    return out.withColumn("leg", F.col("leg").cast("bigint"))


CHAINS = """ways AS (SELECT a, b, w FROM $trees UNION ALL SELECT b AS a, a AS b, w FROM $trees), d AS (SELECT a AS node, count(*) AS n FROM ways GROUP BY a),
walk AS (SELECT e.a AS start, e.a AS before, e.b AS here, e.w FROM ways e JOIN d ON d.node = e.a AND d.n <> 2 UNION ALL
 SELECT k.start, k.here AS before, e.b AS here, k.w + e.w AS w FROM walk k JOIN d ON d.node = k.here AND d.n = 2 JOIN ways e ON e.a = k.here AND e.b <> k.before),
chains AS (SELECT start AS a, here AS b, w FROM walk JOIN d ON d.node = here AND d.n <> 2 WHERE start < here)"""


@query(f"WITH RECURSIVE {CHAINS} SELECT a, b, w FROM chains")
def contracted_network(spark, sf):
    """Chains of nodes with two edges as one edge each."""
    found = network.contracted_fully(fixture(spark, sf, "trees"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")


ROUND = """{new} AS (SELECT e.* FROM {old} e JOIN (SELECT node, count(*) AS n FROM (SELECT a AS node FROM {old} UNION ALL SELECT b AS node FROM {old}) q GROUP BY node) x ON x.node = e.a
 JOIN (SELECT node, count(*) AS n FROM (SELECT a AS node FROM {old} UNION ALL SELECT b AS node FROM {old}) q GROUP BY node) y ON y.node = e.b WHERE NOT (least(x.n, y.n) = 1 AND greatest(x.n, y.n) > 1 AND e.w < 40))"""


@query(f"WITH t0 AS (SELECT a, b, w FROM $trees), {ROUND.format(old='t0', new='t1')}, {ROUND.format(old='t1', new='t2')}, {ROUND.format(old='t2', new='t3')} SELECT a, b, w FROM t3")
def pruned_network(spark, sf):
    """Three rounds of cutting short dead ends."""
    return network.without_spurs(fixture(spark, sf, "trees"), 40, rounds=3)


@query("""SELECT a, b, w FROM (SELECT *, sum(w) OVER (PARTITION BY CAST(floor(a / 16) AS BIGINT)) AS total FROM $trees) q WHERE total >= 380""")
def large_networks(spark, sf):
    """Pieces of a network that are long enough in all."""
    return network.without_small(fixture(spark, sf, "trees"), 380)


@query("SELECT a, b, w FROM $arcs WHERE a <> b OR w >= 9")
def without_short_loops(spark, sf):
    return fixture(spark, sf, "arcs").filter("a <> b OR w >= 9")


@query("""WITH RECURSIVE e AS (SELECT a, b FROM $trees WHERE w < 20 UNION SELECT b AS a, a AS b FROM $trees WHERE w < 20), reach AS (SELECT p_partkey AS node, p_partkey AS other FROM @part UNION SELECT r.node, e.b AS other FROM reach r JOIN e ON r.other = e.a),
g AS (SELECT node, min(other) AS g FROM reach GROUP BY node), p AS (SELECT g, avg(CAST((node * 7919) % 10007 AS DOUBLE)) AS x FROM g GROUP BY g)
SELECT least(u.g, v.g) AS a, greatest(u.g, v.g) AS b, min(t.w) AS w, round(min(x.x), 4) AS ax FROM $trees t JOIN g u ON u.node = t.a JOIN g v ON v.node = t.b JOIN p x ON x.g = least(u.g, v.g) WHERE u.g <> v.g GROUP BY least(u.g, v.g), greatest(u.g, v.g)""")
def merged_close_nodes(spark, sf):
    """Nodes that short edges join as one node at their mean, with the edges that are left."""
    nodes = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") * 7919 % 10007).cast("double").alias("x"), F.lit(0.0).alias("y"))
    places, edges = network.merged_close(nodes, fixture(spark, sf, "trees"), 20)
    return edges.join(places.select(F.col("node").alias("a"), F.round("x", 4).alias("ax")), "a")


PAIRS = """SELECT CAST(least(s.kind, t.kind) AS BIGINT) AS u, CAST(greatest(s.kind, t.kind) AS BIGINT) AS v, min(sqrt((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y))) AS w FROM $sites s JOIN $sites t ON s.kind <> t.kind
 GROUP BY 1, 2"""


@query(f"""WITH RECURSIVE p AS ({PAIRS}), l AS (SELECT *, row_number() OVER (ORDER BY w, u, v) AS n FROM p), ways AS (SELECT u AS a, v AS b, n FROM l UNION ALL SELECT v AS a, u AS b, n FROM l),
reach AS (SELECT n AS link, u AS node FROM l UNION SELECT r.link, b.b AS node FROM reach r JOIN ways b ON b.a = r.node AND b.n < r.link)
SELECT u, v, round(w, 6) AS w FROM l WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.link = l.n AND r.node = l.v)""")
def bridges(spark, sf):
    """The fewest and shortest links that join all groups of places, however far apart: closest pairs, looked for in widening reach."""
    sites = fixture(spark, sf, "sites").select(F.col("kind").cast("bigint").alias("kind"), "x", "y")
    return network.closest_links(sites, "kind", 300).select("u", "v", F.round("w", 6).alias("w"))


NEAREST = """SELECT pid, wid, t, d FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, wid) AS n FROM (SELECT pid, wid, t, sqrt((x - (x1 + t * (x2 - x1))) * (x - (x1 + t * (x2 - x1))) + (y - (y1 + t * (y2 - y1))) * (y - (y1 + t * (y2 - y1)))) AS d FROM (
 SELECT p.pid, w.wid, p.x, p.y, w.x1, w.y1, w.x2, w.y2, CASE WHEN l = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((p.x - w.x1) * (w.x2 - w.x1) + (p.y - w.y1) * (w.y2 - w.y1)) / l)) END AS t
 FROM $people p CROSS JOIN (SELECT *, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS l FROM $walls) w) q) p WHERE d <= 60) o WHERE n = 1"""


@query(f"""WITH s AS (SELECT DISTINCT wid, round(t, 6) AS t FROM ({NEAREST}) q WHERE t > 0.02 AND t < 0.98), c AS (SELECT wid, t FROM s UNION ALL SELECT DISTINCT wid, 1.0 AS t FROM s)
SELECT wid, row_number() OVER (PARTITION BY wid ORDER BY t) AS piece, coalesce(lag(t) OVER (PARTITION BY wid ORDER BY t), 0.0) AS t1, t AS t2 FROM c""")
def joined_ends(spark, sf):
    """Ends of drawn lines snapped onto the nearest road, which is split there; a snap close to a road's end splits nothing."""
    found = nearest_segments(fixture(spark, sf, "people"), fixture(spark, sf, "walls"), "pid", "wid", 60, k=1)
    snaps = found.filter("t > 0.02 AND t < 0.98").select("wid", F.round("t", 6).alias("t")).distinct()
    cuts = snaps.unionByName(snaps.select("wid").distinct().withColumn("t", F.lit(1.0)))
    w = Window.partitionBy("wid").orderBy("t")
    return cuts.select("wid", F.row_number().over(w).cast("bigint").alias("piece"), F.coalesce(F.lag("t").over(w), F.lit(0.0)).alias("t1"), F.col("t").alias("t2"))


MIDDLE = "SELECT wid, wid % 3 AS level, wid % 4 = 0 AS erases, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, x2 - x1 AS dx, y2 - y1 AS dy FROM $walls"


@query(f"""WITH m AS ({MIDDLE}) SELECT e.wid FROM m e WHERE NOT e.erases AND NOT EXISTS (SELECT 1 FROM m l WHERE l.wid > e.wid AND l.level = e.level AND (l.x - e.x) * (l.x - e.x) + (l.y - e.y) * (l.y - e.y) <= 90000
 AND (l.erases OR abs(l.dx * e.dx + l.dy * e.dy) >= 0.866 * sqrt(l.dx * l.dx + l.dy * l.dy) * sqrt(e.dx * e.dx + e.dy * e.dy)))""")
def replayed_edits(spark, sf):
    """Roads drawn in order: one stands unless a later eraser, or a later road about parallel, comes near on its level.

    What was replaced doesn't come back, so no fold over the log is needed.
    """
    w = fixture(spark, sf, "walls")
    edits = w.select("wid", (F.col("wid") % 3).alias("level"), (F.col("wid") % 4 == 0).alias("erases"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))
    early = in_buckets(edits.filter("NOT erases"), F.col("x") - 300, F.col("x") + 300, F.col("y") - 300, F.col("y") + 300, 300)
    late = point_buckets(edits.select(*[F.col(c).alias(f"l_{c}") for c in edits.columns]), 300, "l_x", "l_y")
    size = lambda p: F.sqrt(F.col(f"{p}dx") * F.col(f"{p}dx") + F.col(f"{p}dy") * F.col(f"{p}dy"))
    parallel = F.abs(F.col("l_dx") * F.col("dx") + F.col("l_dy") * F.col("dy")) >= 0.866 * size("l_") * size("")
    near = (F.col("l_x") - F.col("x")) * (F.col("l_x") - F.col("x")) + (F.col("l_y") - F.col("y")) * (F.col("l_y") - F.col("y")) <= 90000
    hit = early.join(late, ["bx", "by"]).filter((F.col("l_wid") > F.col("wid")) & (F.col("l_level") == F.col("level")) & near & (F.col("l_erases") | parallel))
    return edits.filter("NOT erases").join(hit.select("wid"), "wid", "left_anti").select("wid")


@query("""WITH RECURSIVE e AS (SELECT a, b FROM $forest UNION SELECT b AS a, a AS b FROM $forest), reach AS (SELECT p_partkey AS node, p_partkey AS other FROM @part UNION SELECT r.node, e.b AS other FROM reach r JOIN e ON r.other = e.a),
c AS (SELECT node, min(other) AS piece FROM reach GROUP BY node), drops AS (SELECT a, b FROM $arcs WHERE w = 13 AND a < b),
x AS (SELECT u.piece AS src, v.piece AS dst FROM drops d JOIN c u ON u.node = d.a JOIN c v ON v.node = d.b WHERE u.piece <> v.piece)
SELECT DISTINCT src AS piece FROM x WHERE src NOT IN (SELECT dst FROM x) AND src NOT IN (SELECT piece FROM c JOIN @supplier ON s_nationkey = node)""")
def hanging_pieces(spark, sf):
    """Pieces of a network that are left only by one-way drops and that none leads into, unless they hold a node to keep."""
    drops = fixture(spark, sf, "arcs").filter("w = 13 AND a < b")
    keep = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("node"))
    return network.hanging(fixture(spark, sf, "forest"), drops, keep)


@query("""WITH RECURSIVE weak AS (SELECT r * 65536 + c AS node, v FROM $cells WHERE v > 0), e AS (SELECT a.r * 65536 + a.c AS a, b.r * 65536 + b.c AS b FROM $cells a JOIN $cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) AND a.v > 0 AND b.v > 0),
reach AS (SELECT node, node AS other FROM weak UNION SELECT r.node, e.b AS other FROM reach r JOIN e ON r.other = e.a), k AS (SELECT node, min(other) AS piece FROM reach GROUP BY node)
SELECT CAST(floor(node / 65536) AS BIGINT) AS r, node % 65536 AS c, piece FROM k WHERE piece IN (SELECT piece FROM k JOIN weak USING (node) WHERE v = 2)""")
def strong_pieces(spark, sf):
    """Cells with some road that hang together with a cell of clear road (two thresholds)."""
    from waygrid.operators import raster

    cells = fixture(spark, sf, "cells").select("r", "c", "v")
    key = lambda r, c: r * 65536 + c
    met = raster.neighbours(cells.filter("v > 0"), raster.RING).filter("other > 0")
    links = met.select(key(F.col("r"), F.col("c")).alias("a"), key(F.col("r") + F.col("dr"), F.col("c") + F.col("dc")).alias("b"))
    weak = cells.filter("v > 0").select(key(F.col("r"), F.col("c")).alias("node"), "v")
    found = components.connected_components(links.unionByName(weak.select(F.col("node").alias("a"), F.col("node").alias("b"))))
    strong = found.join(weak.filter("v = 2"), "node").select("component").distinct()
    kept = found.join(strong, "component", "left_semi")
    return kept.select(F.floor(F.col("node") / 65536).alias("r"), (F.col("node") % 65536).alias("c"), F.col("component").alias("piece"))
