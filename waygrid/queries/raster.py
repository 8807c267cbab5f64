"""Grids: sampling, classification, pooling, borders, outlines."""

from pyspark.sql import functions as F

from waygrid.operators import ordered, raster
from waygrid.operators.spatial import in_buckets, points_in_circles
from waygrid.queries import query
from waygrid.sources.fixtures import fixture

SAMPLES = """SELECT id, d / n AS share, x1 + (x2 - x1) * ((k + 0.5) / n) AS sx, y1 + (y2 - y1) * ((k + 0.5) / n) AS sy FROM (
  SELECT *, unnest(generate_series(0, n - 1)) AS k FROM (SELECT *, CAST(greatest(1, ceil(d / {step})) AS BIGINT) AS n FROM (
  SELECT *, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS d FROM $segments) q) p) o"""
ENDS = """SELECT id, k, n, CAST(floor((x1 + (x2 - x1) * (k / n)) / 250) AS BIGINT) AS r, CAST(floor((y1 + (y2 - y1) * (k / n)) / 250) AS BIGINT) AS c FROM (
  SELECT *, unnest(generate_series(0, n)) AS k FROM (SELECT *, CAST(greatest(1, ceil(sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) / 50)) AS BIGINT) AS n FROM $segments) p) o"""
ZONE = "z.minx <= s.sx AND s.sx <= z.maxx AND z.miny <= s.sy AND s.sy <= z.maxy"


@query(f"SELECT s.id, z.map_id, round(sum(s.share), 4) AS yards FROM ({SAMPLES.format(step=64)}) s JOIN $zones z ON {ZONE} GROUP BY s.id, z.map_id")
def zone_yards(spark, sf):
    samples = raster.midpoint_samples(fixture(spark, sf, "segments"), 64).select("id", "share", "sx", "sy")
    samples = samples.withColumns({"bx": F.floor(F.col("sx") / 2000), "by": F.floor(F.col("sy") / 2000)})
    zones = in_buckets(fixture(spark, sf, "zones"), *map(F.col, ("minx", "maxx", "miny", "maxy")), 2000)
    hit = samples.join(zones, ["bx", "by"]).filter("minx <= sx AND sx <= maxx AND miny <= sy AND sy <= maxy")
    return hit.groupBy("id", "map_id").agg(F.round(F.sum("share"), 4).alias("yards"))


HOSTILE = f"""SELECT id, round(sum(share), 4) AS yards FROM (SELECT DISTINCT s.id, s.share, s.sx, s.sy FROM ({SAMPLES.format(step=25)}) s JOIN $circles b ON sqrt((s.sx - b.x) * (s.sx - b.x) + (s.sy - b.y) * (s.sy - b.y)) <= b.r) q GROUP BY id"""


@query(HOSTILE)
def hostile_yards(spark, sf):
    """Yards of each way inside any guard circle."""
    samples = raster.midpoint_samples(fixture(spark, sf, "segments"), 25).select("id", "share", F.col("sx").alias("x"), F.col("sy").alias("y"))
    circles = fixture(spark, sf, "circles").select("cid", "r", F.col("x").alias("cx"), F.col("y").alias("cy"))
    hit = points_in_circles(samples, circles, 100).select("id", "share", "x", "y").distinct()
    return hit.groupBy("id").agg(F.round(F.sum("share"), 4).alias("yards"))


@query(f"""SELECT s.id, count(*) AS samples, sum(CASE WHEN coalesce(g.v, 2) = 2 THEN 1 ELSE 0 END) AS blocked, round(sum(CASE WHEN g.v = 1 THEN 1 ELSE 0 END) / CAST(max(s.n) + 1 AS DOUBLE), 6) AS water,
bool_and(coalesce(g.v, 2) <> 2) AS clear FROM ({ENDS}) s LEFT JOIN $cells g ON g.r = s.r AND g.c = s.c GROUP BY s.id""")
def segment_cost(spark, sf):
    """Samples with both ends on the grid; outside the grid is blocked."""
    samples = raster.end_samples(fixture(spark, sf, "segments"), 50)
    samples = samples.select("id", "n", F.floor(F.col("sx") / 250).alias("r"), F.floor(F.col("sy") / 250).alias("c"))
    on = samples.join(fixture(spark, sf, "cells").select("r", "c", "v"), ["r", "c"], "left")
    blocked = F.coalesce("v", F.lit(2)) == 2
    return on.groupBy("id").agg(
        F.count("*").alias("samples"), F.count_if(blocked).alias("blocked"), F.round(F.count_if(F.col("v") == 1) / (F.max("n") + 1), 6).alias("water"), F.every(~blocked).alias("clear")
    )


@query("SELECT CAST(floor(r / 4) AS BIGINT) AS r, CAST(floor(c / 4) AS BIGINT) AS c, round(avg(CASE WHEN v = 2 THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN v = 2 THEN 1.0 ELSE 0.0 END) >= 0.25 AS blocked FROM $cells GROUP BY 1, 2")
def pooled_blocks(spark, sf):
    cells = fixture(spark, sf, "cells").withColumn("v", F.when(F.col("v") == 2, 1.0).otherwise(0.0))
    return raster.pooled(cells, 4).select("r", "c", F.round("mean", 6).alias("share"), (F.col("mean") >= 0.25).alias("blocked"))


N4 = "SELECT a.r, a.c, a.v, a.h, b.v AS other, b.h AS oh, b.r AS br, b.c AS bc FROM $cells a JOIN $cells b ON abs(a.r - b.r) + abs(a.c - b.c) = 1"


@query(f"SELECT r, c, max(abs(h - oh)) / 8.0 AS slope, CASE WHEN max(abs(h - oh)) / 8.0 > 1.19 * 4 THEN 2 WHEN max(abs(h - oh)) / 8.0 > 0.58 * 4 THEN 1 ELSE 0 END AS steepness FROM ({N4}) q GROUP BY r, c")
def steepest_slopes(spark, sf):
    cells = fixture(spark, sf, "cells").select("r", "c", F.col("h").alias("v"))
    met = raster.neighbours(cells, raster.CROSS).join(cells, ["r", "c"]).filter("other is not null")
    slope = met.groupBy("r", "c").agg((F.max(F.abs(F.col("v") - F.col("other"))) / 8.0).alias("slope"))
    return slope.withColumn("steepness", F.when(F.col("slope") > 1.19 * 4, 2).when(F.col("slope") > 0.58 * 4, 1).otherwise(0))


@query(f"SELECT r, c, greatest(CASE WHEN v = 2 THEN 1 ELSE 0 END, max(CASE WHEN other = 2 THEN 1 ELSE 0 END)) AS blocked FROM ({N4}) q GROUP BY r, c, v")
def dilate(spark, sf):
    return raster.dilated(fixture(spark, sf, "cells")).select("r", "c", F.when(F.col("v") == 2, 1).otherwise(0).alias("blocked"))


@query(f"SELECT r, c, min(CASE WHEN v = 2 AND other = 2 THEN 1 ELSE 0 END) AS core FROM ({N4}) q GROUP BY r, c")
def erode(spark, sf):
    cells = fixture(spark, sf, "cells")
    low = raster.around(cells, raster.CROSS, F.min(F.when(F.col("other").isNull() | (F.col("other") == 2), 1).otherwise(0)), "near")
    return low.select("r", "c", F.when((F.col("v") == 2) & (F.col("near") == 1), 1).otherwise(0).alias("core"))


@query("""SELECT r, min(c) AS first, max(c) AS last FROM (SELECT r, c, c - row_number() OVER (PARTITION BY r ORDER BY c) AS g FROM (
  SELECT a.r, a.c FROM $cells a JOIN $cells b ON b.r = a.r + 1 AND b.c = a.c WHERE (a.v = 2) <> (b.v = 2)) q) p GROUP BY r, g""")
def border_lines(spark, sf):
    """Borders between blocked and open cells of neighbouring rows, merged into lines."""
    cells = fixture(spark, sf, "cells")
    below = raster.neighbours(cells, [(1, 0)]).join(cells.select("r", "c", "v"), ["r", "c"]).filter((F.col("v") == 2) != (F.col("other") == 2))
    from pyspark.sql import Window

    w = Window.partitionBy("r").orderBy("c")
    lines = ordered.islands(below.select("r", "c"), ["r"], ["c"], F.col("c") - F.lag("c").over(w) > 1)
    return lines.groupBy("r", "island").agg(F.min("c").alias("first"), F.max("c").alias("last")).drop("island")


@query("""SELECT a.r, a.c, CAST(CASE WHEN a.v = 2 THEN 1 ELSE 0 END + CASE WHEN b.v = 2 THEN 2 ELSE 0 END + CASE WHEN d.v = 2 THEN 4 ELSE 0 END + CASE WHEN e.v = 2 THEN 8 ELSE 0 END AS BIGINT) AS square
FROM $cells a JOIN $cells b ON b.r = a.r AND b.c = a.c + 1 JOIN $cells d ON d.r = a.r + 1 AND d.c = a.c + 1 JOIN $cells e ON e.r = a.r + 1 AND e.c = a.c
WHERE CASE WHEN a.v = 2 THEN 1 ELSE 0 END + CASE WHEN b.v = 2 THEN 1 ELSE 0 END + CASE WHEN d.v = 2 THEN 1 ELSE 0 END + CASE WHEN e.v = 2 THEN 1 ELSE 0 END BETWEEN 1 AND 3""")
def outline_squares(spark, sf):
    return raster.marching_squares(fixture(spark, sf, "cells"))


@query("""SELECT a.r, a.c, b.r AS br, b.c AS bc, CASE WHEN a.r <> b.r AND a.c <> b.c THEN round(sqrt(2.0), 6) ELSE 1.0 END * CASE WHEN b.v = 1 THEN 1.5 ELSE 1.0 END AS cost
FROM $cells a JOIN $cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) LEFT JOIN $cells s ON s.r = a.r AND s.c = b.c LEFT JOIN $cells t ON t.r = b.r AND t.c = a.c
WHERE a.v < 2 AND b.v < 2 AND (a.r = b.r OR a.c = b.c OR (coalesce(s.v, 2) < 2 AND coalesce(t.v, 2) < 2))""")
def cell_steps(spark, sf):
    """Steps of an eight-way search without cutting corners; water costs half as much again."""
    cells = fixture(spark, sf, "cells").select("r", "c", "v")
    met = raster.neighbours(cells.filter("v < 2"), [(0, 0)]).select("r", "c")
    ring = raster.neighbours(cells, raster.RING).filter("other is not null")
    at = lambda cols: ring.select("r", "c", *cols)
    open_side = ring.filter("other < 2 AND (dr = 0 OR dc = 0)")
    straight = open_side.select("r", "c", "dr", "dc", "other")
    vertical = at(["dr", "other"]).where("dc = 0 AND other < 2").select("r", "c", F.col("dr").alias("vr"))
    across = at(["dc", "other"]).where("dr = 0 AND other < 2").select("r", "c", F.col("dc").alias("vc"))
    corner = ring.filter("other < 2 AND dr <> 0 AND dc <> 0")
    corner = corner.join(vertical, ["r", "c"]).filter("vr = dr").join(across, ["r", "c"]).filter("vc = dc").select("r", "c", "dr", "dc", "other")
    steps = straight.unionByName(corner).join(met, ["r", "c"])
    cost = F.when((F.col("dr") != 0) & (F.col("dc") != 0), F.round(F.sqrt(F.lit(2.0)), 6)).otherwise(1.0) * F.when(F.col("other") == 1, 1.5).otherwise(1.0)
    return steps.select("r", "c", (F.col("r") + F.col("dr")).alias("br"), (F.col("c") + F.col("dc")).alias("bc"), cost.alias("cost"))


@query("""SELECT r, c, min_by(v, rank) AS v FROM (SELECT r, c, 0 AS v, 1 AS rank FROM $cells WHERE (r + c) % 11 = 0 UNION ALL SELECT r, c, 2 AS v, 0 AS rank FROM $cells WHERE (r * 3 + c) % 13 = 0 UNION ALL SELECT r, c, v, 2 AS rank FROM $cells) q GROUP BY r, c""")
def layered_cells(spark, sf):
    """Walls go before erased-open cells, those before terrain."""
    cells = fixture(spark, sf, "cells")
    return raster.layered([cells.filter("(r * 3 + c) % 13 = 0").withColumn("v", F.lit(2)), cells.filter("(r + c) % 11 = 0").withColumn("v", F.lit(0)), cells])


@query(f"SELECT DISTINCT r, c FROM ({ENDS}) q")
def road_cells(spark, sf):
    samples = raster.end_samples(fixture(spark, sf, "segments"), 50)
    return samples.select(F.floor(F.col("sx") / 250).alias("r"), F.floor(F.col("sy") / 250).alias("c")).distinct()


@query(f"SELECT DISTINCT s.r, s.c FROM ({ENDS}) s JOIN $cells g ON g.r = s.r AND g.c = s.c WHERE g.v <> 2")
def road_cells_open(spark, sf):
    """Set intersection of two cell masks."""
    return road_cells(spark, sf).join(fixture(spark, sf, "cells").filter("v <> 2").select("r", "c"), ["r", "c"], "left_semi")


@query("""SELECT pid, round(h00 * (1 - fx) * (1 - fy) + h10 * fx * (1 - fy) + h01 * (1 - fx) * fy + h11 * fx * fy, 6) AS height FROM (
 SELECT p.pid, (p.x / 250) - floor(p.x / 250) AS fx, (p.y / 250) - floor(p.y / 250) AS fy, a.h AS h00, b.h AS h10, d.h AS h01, e.h AS h11 FROM $people p
 JOIN $cells a ON a.r = CAST(floor(p.x / 250) AS BIGINT) AND a.c = CAST(floor(p.y / 250) AS BIGINT) JOIN $cells b ON b.r = a.r + 1 AND b.c = a.c
 JOIN $cells d ON d.r = a.r AND d.c = a.c + 1 JOIN $cells e ON e.r = a.r + 1 AND e.c = a.c + 1) q""")
def bilinear_heights(spark, sf):
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (0, 1) for b in (0, 1)]))
    fx, fy = (F.col(n) / 250 - F.floor(F.col(n) / 250) for n in ("x", "y"))
    at = fixture(spark, sf, "people").select("pid", fx.alias("fx"), fy.alias("fy"), F.floor(F.col("x") / 250).alias("pr"), F.floor(F.col("y") / 250).alias("pc"), corners.alias("k"))
    at = at.select("pid", "fx", "fy", "k.dr", "k.dc", (F.col("pr") + F.col("k.dr")).alias("r"), (F.col("pc") + F.col("k.dc")).alias("c"))
    met = at.join(fixture(spark, sf, "cells").select("r", "c", "h"), ["r", "c"])
    weight = F.when(F.col("dr") == 1, F.col("fx")).otherwise(1 - F.col("fx")) * F.when(F.col("dc") == 1, F.col("fy")).otherwise(1 - F.col("fy"))
    return met.groupBy("pid").agg(F.round(F.sum(F.col("h") * weight), 6).alias("height"), F.count("*").alias("n")).filter("n = 4").drop("n")
