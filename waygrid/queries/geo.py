"""Coordinate systems and scalar geometry."""

from pyspark.sql import functions as F

from waygrid.functions import geo
from waygrid.queries import query
from waygrid.sources.fixtures import fixture

T = "533.3333333333334"


@query("SELECT s.id, z.map_id, round((z.maxy - s.y) / (z.maxy - z.miny), 6) AS u, round((z.maxx - s.x) / (z.maxx - z.minx), 6) AS v FROM $sites s JOIN $zones z ON s.kind = z.map_id")
def world_to_map(spark, sf):
    both = fixture(spark, sf, "sites").drop("name").join(fixture(spark, sf, "zones"), F.col("kind") == F.col("map_id"))
    u, v = geo.world_to_map(F.col("x"), F.col("y"))
    return both.select("id", "map_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("SELECT s.id, z.map_id, round(z.maxx - 0.25 * (z.maxx - z.minx), 6) AS x, round(z.maxy - 0.75 * (z.maxy - z.miny), 6) AS y FROM $sites s JOIN $zones z ON s.kind = z.map_id")
def map_to_world(spark, sf):
    both = fixture(spark, sf, "sites").select("id", "kind").join(fixture(spark, sf, "zones"), F.col("kind") == F.col("map_id"))
    x, y = geo.map_to_world(F.lit(0.75), F.lit(0.25))
    return both.select("id", "map_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"SELECT pid, CAST(floor(32.0 - y / {T}) AS BIGINT) AS tx, CAST(floor(32.0 - x / {T}) AS BIGINT) AS ty FROM $people")
def world_to_tile(spark, sf):
    tx, ty = geo.world_to_tile(F.col("x"), F.col("y"))
    return fixture(spark, sf, "people").select("pid", tx.alias("tx"), ty.alias("ty"))


@query("SELECT pid, round(x * cos(radians(30.0)) - y * sin(radians(30.0)), 5) AS sx, round(x * sin(radians(30.0)) + y * cos(radians(30.0)), 5) AS sy FROM $people")
def screen_rotation(spark, sf):
    x, y = geo.rotated(F.col("x"), F.col("y"), F.lit(30.0))
    return fixture(spark, sf, "people").select("pid", F.round(x, 5).alias("sx"), F.round(y, 5).alias("sy"))


@query("""SELECT id, round(b, 5) AS bearing, (['N','NE','E','SE','S','SW','W','NW'])[CAST(floor((b + 22.5) / 45) AS BIGINT) % 8 + 1] AS wind
FROM (SELECT id, CASE WHEN d < 0 THEN d + 360 ELSE d END AS b FROM (SELECT id, degrees(atan2(y1 - y2, x2 - x1)) AS d FROM $segments) q) p""")
def compass_bearing(spark, sf):
    b = geo.bearing(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return fixture(spark, sf, "segments").select("id", F.round(b, 5).alias("bearing"), geo.compass(b).alias("wind"))


@query("""SELECT id, round(CASE WHEN t > 180 THEN t - 360 ELSE t END, 5) AS turn FROM (
  SELECT id, CASE WHEN d < 0 THEN d + 360 ELSE d END AS t FROM (
    SELECT a.id, degrees(atan2(b.y2 - b.y1, b.x2 - b.x1)) - degrees(atan2(a.y2 - a.y1, a.x2 - a.x1)) AS d FROM $segments a JOIN $segments b ON b.id = a.id + 1) q) p""")
def turn_angle(spark, sf):
    a = fixture(spark, sf, "segments")
    b = a.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"n{c}") for c in ("x1", "y1", "x2", "y2")])
    heading = lambda p: F.degrees(F.atan2(F.col(f"{p}y2") - F.col(f"{p}y1"), F.col(f"{p}x2") - F.col(f"{p}x1")))
    return a.join(b, "id").select("id", F.round(geo.wrapped(heading("n") - heading("")), 5).alias("turn"))


@query("SELECT event_id, floor(value * 10 + 0.5) / 10 AS up, floor(-value * 10 + 0.5) / 10 AS down FROM @events")
def round_half_up(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select("event_id", geo.tenth(F.col("value")).alias("up"), geo.tenth(-F.col("value")).alias("down"))


@query("SELECT id, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS length, (x2 - x1) * (5000 - y1) - (y2 - y1) * (5000 - x1) > 0 AS left_of FROM $segments")
def segment_measures(spark, sf):
    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2")}
    side = geo.orient(c["x1"], c["y1"], c["x2"], c["y2"], F.lit(5000), F.lit(5000))
    return fixture(spark, sf, "segments").select("id", geo.distance(*c.values()).alias("length"), (side > 0).alias("left_of"))


@query("""SELECT event_id, CAST(1000 + ceil((event_id * 17 % 5000 - 1000) / 240.0) * 240 - event_id * 17 % 5000 AS BIGINT) AS wait FROM @events""")
def next_arrival(spark, sf):
    """Seconds until a cycle of 240 s that started at 1000 s comes round again."""
    now = F.col("event_id") * 17 % 5000
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select("event_id", (F.lit(1000) + F.ceil((now - 1000) / 240) * 240 - now).alias("wait"))


@query("""SELECT src, dst, CAST(floor(s / 60) AS BIGINT) AS minutes, printf('%d:%02d', CAST(floor(s / 60) AS BIGINT), CAST(floor(s) AS BIGINT) % 60) AS text
FROM (SELECT src, dst, yards / 32 + 15 AS s FROM $flights) q""")
def flight_time_text(spark, sf):
    s = F.col("yards") / 32 + 15
    minutes, rest = F.floor(s / 60), F.floor(s) % 60
    return fixture(spark, sf, "flights").select("src", "dst", minutes.alias("minutes"), F.format_string("%d:%02d", minutes, rest).alias("text"))


@query("SELECT p_partkey, 14 + greatest(0, CAST(p_size AS DOUBLE) / 50 - 0.3) / 0.02 AS safe_drop, CASE WHEN p_size <= 40 THEN p_size + 2 * (p_size % 7) END AS pending FROM @part")
def drop_and_pending_cost(spark, sf):
    size = F.col("p_size")
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.select("p_partkey", (14 + F.greatest(F.lit(0.0), size.cast("double") / 50 - 0.3) / 0.02).alias("safe_drop"), F.when(size <= 40, size + 2 * (size % 7)).alias("pending"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 0 THEN 14.0 WHEN c_mktsegment = 'MACHINERY' THEN 11.2 WHEN c_acctbal < 0 THEN 2.5 ELSE 7.0 END AS speed,
round(1000 * 1.35 / CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 0 THEN 14.0 WHEN c_mktsegment = 'MACHINERY' THEN 11.2 WHEN c_acctbal < 0 THEN 2.5 ELSE 7.0 END, 6) AS seconds FROM @customer""")
def speed_model(spark, sf):
    kind, left = F.col("c_mktsegment"), F.col("c_acctbal")
    speed = F.when((kind == "BUILDING") & (left > 0), 14.0).when(kind == "MACHINERY", 11.2).when(left < 0, 2.5).otherwise(7.0)
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    return customer.select("c_custkey", speed.alias("speed"), F.round(1000 * 1.35 / speed, 6).alias("seconds"))
