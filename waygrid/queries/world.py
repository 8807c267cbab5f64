"""Compositions: portals, stairs, remaining flights, dimension builds, merges of shared facts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waygrid.functions import geo
from waygrid.operators import aggregates, ordered, raster
from waygrid.operators.spatial import nearest_within
from waygrid.plans.scratch import written
from waygrid.queries import query
from waygrid.sources.fixtures import fixture

W = "(PARTITION BY path ORDER BY seq, l_partkey, x, y)"


@query("""SELECT block, unnest(CASE WHEN last - first + 1 >= 8 THEN [first, last] ELSE [CAST(floor((first + last) / 2) AS BIGINT)] END) AS portal FROM (
 SELECT block, min(c) AS first, max(c) AS last FROM (SELECT block, c, c - row_number() OVER (PARTITION BY block ORDER BY c) AS g FROM (
 SELECT CAST(floor(a.r / 8) AS BIGINT) AS block, a.c FROM $cells a JOIN $cells b ON b.r = a.r + 1 AND b.c = a.c WHERE a.r % 8 = 7 AND a.v < 2 AND b.v < 2) q) p GROUP BY block, g) o""")
def block_portals(spark, sf):
    """Ways between blocks: the middle of each open run of a border, both ends of a long one."""
    cells = fixture(spark, sf, "cells").select("r", "c", "v")
    border = raster.neighbours(cells, [(1, 0)]).join(cells, ["r", "c"]).filter("r % 8 = 7 AND v < 2 AND other < 2")
    rows = border.select(F.floor(F.col("r") / 8).alias("block"), "c")
    w = Window.partitionBy("block").orderBy("c")
    found = ordered.islands(rows, ["block"], ["c"], F.col("c") - F.lag("c").over(w) > 1).groupBy("block", "island").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    spots = F.when(F.col("b") - F.col("a") + 1 >= 8, F.array("a", "b")).otherwise(F.array(F.floor((F.col("a") + F.col("b")) / 2)))
    return found.select("block", F.explode(spots).alias("portal"))


@query("""SELECT r, min(c) AS first, max(c) AS last, sum(rise) AS rise FROM (SELECT r, c, rise, c - row_number() OVER (PARTITION BY r ORDER BY c) AS g FROM (
 SELECT r, c, h - lag(h) OVER (PARTITION BY r ORDER BY c) AS rise FROM $cells) q WHERE rise >= 5) p GROUP BY r, g HAVING sum(rise) >= 20""")
def stairs(spark, sf):
    """Runs of cells that keep rising steeply, with enough rise in all."""
    w = Window.partitionBy("r").orderBy("c")
    steep = fixture(spark, sf, "cells").withColumn("rise", F.col("h") - F.lag("h").over(w)).filter("rise >= 5")
    found = ordered.islands(steep.select("r", "c", "rise"), ["r"], ["c"], F.col("c") - F.lag("c").over(w) > 1)
    return found.groupBy("r", "island").agg(F.min("c").alias("first"), F.max("c").alias("last"), F.sum("rise").alias("rise")).filter("rise >= 20").drop("island")


@query(f"""SELECT path, round(remaining, 4) AS remaining FROM (SELECT path, total - along AS remaining, row_number() OVER (PARTITION BY path ORDER BY d, along) AS n FROM (
 SELECT path, along, max(along) OVER (PARTITION BY path) AS total, sqrt((x - 200) * (x - 200) + (y - 150) * (y - 150)) AS d FROM (SELECT *, sum(coalesce(step, 0.0)) OVER (PARTITION BY path ORDER BY seq, l_partkey, x, y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS along FROM (
 SELECT *, sqrt((x - lag(x) OVER v) * (x - lag(x) OVER v) + (y - lag(y) OVER v) * (y - lag(y) OVER v)) AS step FROM $hops WINDOW v AS {W}) q) p) o) t WHERE n = 1""")
def flight_left(spark, sf):
    """Yards left from the stop of each path that is nearest to a flyer."""
    s = ordered.steps(fixture(spark, sf, "hops"), ["path"], ["seq", "l_partkey", "x", "y"])
    s = s.withColumn("total", F.max("along").over(Window.partitionBy("path"))).withColumn("d", geo.distance(F.col("x"), F.col("y"), F.lit(200), F.lit(150)))
    best = s.groupBy("path").agg(F.min(F.struct("d", "along", "total")).alias("b"))
    return best.select("path", F.round(F.col("b.total") - F.col("b.along"), 4).alias("remaining"))


@query("""SELECT event_id, CASE WHEN prior IS NULL THEN true WHEN value > prior * 1.1 + 30 THEN false WHEN value <= prior THEN true ELSE prior < 20 END AS keep FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM @events) q""")
def keep_old_route(spark, sf):
    """Hysteresis: the old route stays unless the new one is clearly better."""
    prior = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    keep = F.when(F.col("prior").isNull(), True).when(F.col("value") > F.col("prior") * 1.1 + 30, False).when(F.col("value") <= F.col("prior"), True).otherwise(F.col("prior") < 20)
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("prior", prior).select("event_id", keep.alias("keep"))


@query("""SELECT kind, id, name FROM (SELECT 1 AS kind, s_suppkey AS id, s_name AS name FROM @supplier UNION ALL SELECT 2 AS kind, p_partkey AS id, p_name AS name FROM @part UNION ALL SELECT 3 AS kind, CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM @nation) q""")
def all_pois(spark, sf):
    """Flight masters, places and labels as one table with a kind."""
    read = lambda t, kind, i, n: spark.read.parquet(f"{sf}/{t}.parquet").select(F.lit(kind).alias("kind"), F.col(i).cast("bigint").alias("id"), F.col(n).alias("name"))
    return read("supplier", 1, "s_suppkey", "s_name").unionByName(read("part", 2, "p_partkey", "p_name")).unionByName(read("nation", 3, "n_nationkey", "n_name"))


@query("SELECT brand, size, spot FROM (SELECT p_brand AS brand, p_size AS size, p_partkey AS spot, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS n FROM @part) q WHERE n = 1")
def area_spots(spark, sf):
    """Names by a composite key; the first placement wins."""
    return spark.read.parquet(f"{sf}/part.parquet").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).agg(F.min("p_partkey").alias("spot"))


@query("""SELECT t.o_custkey AS level, t.o_orderkey AS time FROM @orders t WHERE NOT EXISTS (SELECT 1 FROM @lineitem l WHERE l.l_orderkey = t.o_orderkey AND l.l_linenumber = 7)""")
def merge_trips(spark, sf):
    """Shared trips that are not known yet, by level and time."""
    known = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_linenumber = 7").select(F.col("l_orderkey").alias("time"))
    trips = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("level"), F.col("o_orderkey").alias("time"))
    return trips.join(known, "time", "left_anti").select("level", "time")


@query("SELECT event_id, item AS key, CAST(json_extract(props, '/' || item) AS BIGINT) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS item FROM @events) q")
def saved_pins(spark, sf):
    """Nested maps laid out as rows."""
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))


@query("""SELECT s.id, CASE WHEN d.depth IS NULL THEN 'unknown' WHEN d.depth < 10 THEN 'underground' ELSE 'surface' END AS level FROM $sites s LEFT JOIN (SELECT id, min(depth) AS depth FROM (
 SELECT s.id, p.pid % 40 AS depth FROM $sites s JOIN $people p ON sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) <= 450) q GROUP BY id) d ON d.id = s.id""")
def underground_levels(spark, sf):
    """A place is underground if anything near it lies deep enough."""
    targets = fixture(spark, sf, "people").select("pid", F.col("x").alias("tx"), F.col("y").alias("ty"))
    sites = fixture(spark, sf, "sites")
    # One place that is deep enough settles it, else one at all, so nobody meets all that are near.
    deep = written(nearest_within(sites, targets.filter("pid % 40 < 10"), 450, "id", "pid").select("id"), "deep")
    rest = written(sites.join(deep.hint("merge"), "id", "left_anti"), "sites")
    near = nearest_within(rest, targets, 450, "id", "pid").select("id", F.lit("surface").alias("level"))
    found = near.unionByName(deep.select("id", F.lit("underground").alias("level")))
    return sites.select("id").join(found.hint("merge"), "id", "left").fillna("unknown", ["level"])


@query("""SELECT id, x, y, round(z, 6) AS z FROM (SELECT s.id, s.x, s.y, (SELECT avg(h) FROM $cells g WHERE abs(g.r - floor(s.x / 250)) <= 1 AND abs(g.c - floor(s.y / 250)) <= 1) AS z FROM $sites s) q WHERE z IS NOT NULL""")
def place_heights(spark, sf):
    """The mean height of the cells around each place."""
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    at = fixture(spark, sf, "sites").select("id", "x", "y", around.alias("o"))
    at = at.withColumns({"r": F.floor(F.col("x") / 250) + F.col("o.dr"), "c": F.floor(F.col("y") / 250) + F.col("o.dc")})
    return at.join(fixture(spark, sf, "cells").select("r", "c", "h"), ["r", "c"]).groupBy("id", "x", "y").agg(F.round(F.avg("h"), 6).alias("z"))


@query("""SELECT kind, pid, size FROM (SELECT p.kind, p.pid, m.size, row_number() OVER (PARTITION BY p.kind ORDER BY round(sqrt((p.x - m.mx) * (p.x - m.mx) + (p.y - m.my) * (p.y - m.my)), 6), p.pid) AS n
 FROM $people p JOIN (SELECT kind, avg(x) AS mx, avg(y) AS my, count(*) AS size FROM $people GROUP BY kind HAVING count(*) >= 10) m ON m.kind = p.kind) q WHERE n = 1""")
def cave_entrances(spark, sf):
    """Of each group of ten or more the member nearest to the group's middle."""
    return aggregates.central_members(fixture(spark, sf, "people"), "kind", "pid", least=10)
