"""Ordered scans: runs, islands, linear referencing, retention."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waygrid.functions import geo
from waygrid.operators import ordered
from waygrid.queries import query
from waygrid.sources.fixtures import fixture

W = "(PARTITION BY user_id ORDER BY ts, event_id)"
UP_TO = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("""SELECT r, min(c) AS first, max(c) AS last, v FROM (SELECT *, sum(s) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (
  SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY r ORDER BY c) THEN 0 ELSE 1 END AS s FROM $cells) q) p GROUP BY r, g, v""")
def run_length_encode(spark, sf):
    return ordered.runs(fixture(spark, sf, "cells"), ["r"], "c", "v")


@query("""SELECT r, string_agg(CAST(v AS VARCHAR) || 'x' || CAST(n AS VARCHAR), ',' ORDER BY first) AS packed FROM (
  SELECT r, g, v, min(c) AS first, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (
  SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY r ORDER BY c) THEN 0 ELSE 1 END AS s FROM $cells) q) p GROUP BY r, g, v) o GROUP BY r""")
def encode_rows(spark, sf):
    """Each raster row as text of runs, the form in which grids are stored."""
    found = ordered.runs(fixture(spark, sf, "cells"), ["r"], "c", "v")
    item = F.struct("first", F.concat(F.col("v"), F.lit("x"), F.col("last") - F.col("first") + 1).alias("s"))
    return found.groupBy("r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda a: a["s"]), ",").alias("packed"))


@query("""SELECT user_id, min(event_id) AS first_event, count(*) AS n, event_type FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (
  SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS s FROM @events) q) p GROUP BY user_id, g, event_type""")
def event_runs(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marked = ordered.islands(events.withColumn("c", ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))), ["user_id"], ["ts", "event_id"], F.col("c"))
    return marked.groupBy("user_id", "island", "event_type").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).drop("island")


STEP = "sqrt((x - lag(x) OVER {w}) * (x - lag(x) OVER {w}) + (y - lag(y) OVER {w}) * (y - lag(y) OVER {w}))".format(w=W)


@query(f"SELECT user_id, event_id, round(sum(coalesce(step, 0.0)) OVER {UP_TO}, 4) AS along FROM (SELECT *, {STEP} AS step FROM $tracks) q")
def cumulative_length(spark, sf):
    return ordered.steps(fixture(spark, sf, "tracks"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.round("along", 4).alias("along"))


@query(f"""SELECT user_id, CAST(part AS BIGINT) AS part, count(*) AS points, max(x) - min(x) AS width, max(y) - min(y) AS height FROM (SELECT *, sum(CASE WHEN step > 22 THEN 1 ELSE 0 END) OVER {UP_TO} AS part FROM (SELECT *, {STEP} AS step FROM $tracks) q) p
GROUP BY user_id, part HAVING count(*) >= 2 AND sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y))) >= 20""")
def split_patrols(spark, sf):
    """Paths cut at long hops; parts of one point or with a small box are dropped."""
    cut = ordered.split_where_far(fixture(spark, sf, "tracks"), ["user_id"], ["ts", "event_id"], 22)
    parts = cut.groupBy("user_id", "part").agg(F.count("*").alias("points"), (F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"))
    return parts.filter((F.col("points") >= 2) & (F.sqrt(F.col("width") * F.col("width") + F.col("height") * F.col("height")) >= 20))


@query(f"""SELECT user_id, round(total, 3) AS total, round(gap / total, 5) AS straightness FROM (SELECT user_id, sum(step) AS total,
sqrt((max_by(x, event_id) - min_by(x, event_id)) * (max_by(x, event_id) - min_by(x, event_id)) + (max_by(y, event_id) - min_by(y, event_id)) * (max_by(y, event_id) - min_by(y, event_id))) AS gap
FROM (SELECT *, {STEP} AS step FROM $tracks) q GROUP BY user_id) p WHERE total >= 60 AND gap / total >= 0.01""")
def straight_paths(spark, sf):
    s = ordered.steps(fixture(spark, sf, "tracks"), ["user_id"], ["ts", "event_id"])
    end = lambda c: F.max_by(c, "event_id") - F.min_by(c, "event_id")
    got = s.groupBy("user_id").agg(F.sum("step").alias("total"), F.sqrt(end("x") * end("x") + end("y") * end("y")).alias("gap"))
    got = got.filter((F.col("total") >= 60) & (F.col("gap") / F.col("total") >= 0.01))
    return got.select("user_id", F.round("total", 3).alias("total"), F.round(F.col("gap") / F.col("total"), 5).alias("straightness"))


LEGS = """SELECT path, x, y, along, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(along) OVER w AS until, max(along) OVER (PARTITION BY path) AS total FROM (
  SELECT *, sum(coalesce(step, 0.0)) OVER (PARTITION BY path ORDER BY seq, l_partkey, x, y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS along FROM (
  SELECT *, sqrt((x - lag(x) OVER v) * (x - lag(x) OVER v) + (y - lag(y) OVER v) * (y - lag(y) OVER v)) AS step FROM $hops WINDOW v AS (PARTITION BY path ORDER BY seq, l_partkey, x, y)) q) p WINDOW w AS (PARTITION BY path ORDER BY seq, l_partkey, x, y)"""


@query("""WITH stepped AS (SELECT *, sqrt((x - lag(x) OVER v) * (x - lag(x) OVER v) + (y - lag(y) OVER v) * (y - lag(y) OVER v)) AS step FROM $hops WINDOW v AS (PARTITION BY path ORDER BY seq, l_partkey, x, y)),
summed AS (SELECT *, sum(coalesce(step, 0.0)) OVER (PARTITION BY path ORDER BY seq, l_partkey, x, y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS along FROM stepped),
legs AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(along) OVER w AS until, max(along) OVER (PARTITION BY path) AS total FROM summed WINDOW w AS (PARTITION BY path ORDER BY seq, l_partkey, x, y)),
asked AS (SELECT *, greatest(0.0, least(CAST(path % 7 AS DOUBLE) * 90, total)) AS s FROM legs)
SELECT path, round(x + (CASE WHEN until > along THEN (s - along) / (until - along) ELSE 0 END) * (coalesce(nx, x) - x), 4) AS px, round(y + (CASE WHEN until > along THEN (s - along) / (until - along) ELSE 0 END) * (coalesce(ny, y) - y), 4) AS py
FROM asked WHERE s >= along AND (s < until OR until IS NULL)""")
def point_at(spark, sf):
    lines = fixture(spark, sf, "hops")
    asked = lines.select("path").distinct().withColumn("at", (F.col("path") % 7).cast("double") * 90)
    found = ordered.points_at(lines, asked, ["path"], ["seq", "l_partkey", "x", "y"])
    return found.select("path", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


@query(f"SELECT user_id, CAST(max(x - low) AS BIGINT) AS rise FROM (SELECT user_id, x, min(x) OVER {UP_TO} AS low FROM $tracks) q GROUP BY user_id")
def draw_up(spark, sf):
    return ordered.draw_up(fixture(spark, sf, "tracks"), ["user_id"], ["ts", "event_id"], "x")


@query("SELECT event_id, user_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN CURRENT ROW AND 400 FOLLOWING) AS ahead FROM @events")
def turns_ahead(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type")
    return ordered.ahead_count(events, ["user_id"], "event_id", 400, F.col("event_type") == "error").drop("event_type")


@query("""SELECT path, sum(CASE WHEN cosine < -0.7 THEN 1 ELSE 0 END) AS hairpins FROM (SELECT path, ((x - lag(x) OVER w) * (lead(x) OVER w - x) + (y - lag(y) OVER w) * (lead(y) OVER w - y)) /
 nullif(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) * sqrt((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(y) OVER w - y) * (lead(y) OVER w - y)), 0) AS cosine
 FROM $hops WINDOW w AS (PARTITION BY path ORDER BY seq, l_partkey, x, y)) q GROUP BY path""")
def hairpins(spark, sf):
    w = Window.partitionBy("path").orderBy("seq", "l_partkey", "x", "y")
    ax, ay = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    bx, by = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    cosine = (ax * bx + ay * by) / F.nullif(F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by), F.lit(0))
    return fixture(spark, sf, "hops").withColumn("cosine", cosine).groupBy("path").agg(F.sum(F.when(F.col("cosine") < -0.7, 1).otherwise(0)).alias("hairpins"))


@query("""SELECT user_id, stretch, min(n) AS first, max(n) AS last FROM (SELECT user_id, n, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stretch FROM (
 SELECT user_id, n, CASE WHEN n - lag(n) OVER (PARTITION BY user_id ORDER BY n) > 1 OR (NOT o AND after) THEN 1 ELSE 0 END AS s FROM (
 SELECT *, coalesce(lag(o) OVER w, false) OR o OR coalesce(lead(o) OVER w, false) AS kept, lead(o) OVER w AS after FROM (
 SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type IN ('click', 'view') AS o FROM @events) q WINDOW w AS (PARTITION BY user_id ORDER BY n)) p WHERE kept) r) t GROUP BY user_id, stretch""")
def off_network_runs(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    samples = spark.read.parquet(f"{sf}/events.parquet").select("user_id", n.alias("n"), F.col("event_type").isin("click", "view").alias("o"))
    found = ordered.padded_stretches(samples, ["user_id"], "n", "o")
    return found.groupBy("user_id", "stretch").agg(F.min("n").alias("first"), F.max("n").alias("last"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM @events) q WHERE n <= 20")
def retain_last(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("n", n).filter("n <= 20").select("user_id", "event_id")


@query("SELECT user_id, max_by(event_type, struct_pack(t := ts, e := event_id)) AS kind, count(*) AS sightings FROM @events GROUP BY user_id")
def latest_snapshot(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.count("*").alias("sightings"))


@query(f"""SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, event_id) AS rank FROM (
 SELECT user_id, event_id, sqrt((x - 50) * (x - 50) + (y + 50) * (y + 50)) AS d FROM $tracks) q) p WHERE rank = 1""")
def rejoin_path(spark, sf):
    """The point of each path nearest to a player's place: where following resumes."""
    d = geo.distance(F.col("x"), F.col("y"), F.lit(50), F.lit(-50))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("d", "event_id"))
    return fixture(spark, sf, "tracks").withColumn("d", d).withColumn("rank", rank).filter("rank = 1").select("user_id", "event_id", "rank")
