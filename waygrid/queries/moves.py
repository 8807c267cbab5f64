"""Movement along lines and in time: bends, manoeuvres, slices, exposure, sightings, traces, arrivals, messages."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waygrid.functions import geo, text
from waygrid.operators import ordered
from waygrid.operators.spatial import as_of
from waygrid.queries import query
from waygrid.queries.streams import _events
from waygrid.sources.fixtures import fixture
from waygrid.streaming import detectors

ORDER = ["seq", "l_partkey", "x", "y"]
PATH = "PARTITION BY path ORDER BY seq, l_partkey, x, y"
UP_TO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
STEPPED = f"""stepped AS (SELECT *, sqrt((x - lag(x) OVER v) * (x - lag(x) OVER v) + (y - lag(y) OVER v) * (y - lag(y) OVER v)) AS step FROM $hops WINDOW v AS ({PATH})),
summed AS (SELECT *, sum(coalesce(step, 0.0)) OVER ({PATH} {UP_TO}) AS along FROM stepped),
legs AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(along) OVER w AS until, max(along) OVER (PARTITION BY path) AS total FROM summed WINDOW w AS ({PATH}))"""
POINT = """SELECT a.path, a.k, x + (CASE WHEN until > along THEN (s - along) / (until - along) ELSE 0 END) * (coalesce(nx, x) - x) AS px, y + (CASE WHEN until > along THEN (s - along) / (until - along) ELSE 0 END) * (coalesce(ny, y) - y) AS py
FROM (SELECT l.*, q.k, greatest(0.0, least(q.at_, l.total)) AS s FROM legs l JOIN ({asked}) q ON q.path = l.path) a WHERE s >= along AND (s < until OR until IS NULL)"""


def _along(path):
    """Wrapped angle between two steps, in degrees, as a column of their parts."""
    return geo.turned(F.degrees(geo.heading(F.col(f"{path[1]}y"), F.col(f"{path[1]}x")) - geo.heading(F.col(f"{path[0]}y"), F.col(f"{path[0]}x"))))


@query(f"""WITH {STEPPED}, p AS ({POINT.format(asked="SELECT path, k, 200.0 + k * 35 - 35 AS at_ FROM (SELECT DISTINCT path FROM $hops) h, (SELECT unnest(range(3)) AS k) r")}),
m AS (SELECT path, max(CASE WHEN k = 0 THEN px END) AS ax, max(CASE WHEN k = 0 THEN py END) AS ay, max(CASE WHEN k = 1 THEN px END) AS bx, max(CASE WHEN k = 1 THEN py END) AS b_y, max(CASE WHEN k = 2 THEN px END) AS cx, max(CASE WHEN k = 2 THEN py END) AS cy FROM p GROUP BY path),
d AS (SELECT path, bx - ax AS d1x, b_y - ay AS d1y, cx - bx AS d2x, cy - b_y AS d2y FROM m)
SELECT path, CASE WHEN d1x * d1x + d1y * d1y < 1 OR d2x * d2x + d2y * d2y < 1 THEN 0.0 ELSE round(CASE WHEN t > 180 THEN t - 360 WHEN t <= -180 THEN t + 360 ELSE t END, 3) END AS bend FROM (SELECT *, degrees(atan2(d2y, d2x) - atan2(d1y, d1x)) AS t FROM d) q""")
def bends(spark, sf):
    """The signed change of heading around a place on each path, between points 35 yards before and after it."""
    hops = fixture(spark, sf, "hops")
    asked = hops.select("path").distinct().withColumn("k", F.explode(F.expr("sequence(0, 2)"))).withColumn("at", 200.0 + F.col("k") * 35 - 35)
    at = ordered.points_at(hops, asked, ["path"], ORDER).groupBy("path").agg(*[F.max(F.when(F.col("k") == k, F.struct("px", "py"))).alias(f"p{k}") for k in (0, 1, 2)])
    parts = {f"{d}{c}": F.col(f"p{b}.p{c}") - F.col(f"p{a}.p{c}") for d, a, b in (("i", 0, 1), ("o", 1, 2)) for c in "xy"}
    at = at.withColumns(parts)
    short = (F.col("ix") * F.col("ix") + F.col("iy") * F.col("iy") < 1) | (F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy") < 1)
    return at.select("path", F.when(short, 0.0).otherwise(F.round(_along("io"), 3)).alias("bend"))


TURNS = f"""turns AS (SELECT *, CASE WHEN t > 180 THEN t - 360 WHEN t <= -180 THEN t + 360 ELSE t END AS turn FROM (SELECT *, degrees(atan2(ny - y, nx - x) - atan2(y - py, x - px)) AS t FROM (
 SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny, row_number() OVER w AS k FROM $hops WINDOW w AS ({PATH})) q WHERE px IS NOT NULL AND nx IS NOT NULL) p)"""


@query(f"""WITH {TURNS}, s AS (SELECT path, k, turn, CASE WHEN turn >= 20 THEN 1 WHEN turn <= -20 THEN -1 ELSE 0 END AS side FROM turns),
m AS (SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY path ORDER BY k) AND k = lag(k) OVER (PARTITION BY path ORDER BY k) + 1 THEN 0 ELSE 1 END AS starts FROM s WHERE side <> 0),
i AS (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY k {UP_TO}) AS n FROM m), g AS (SELECT path, n, min(k) AS k, sum(turn) AS angle, count(*) AS points FROM i GROUP BY path, n)
SELECT path, k, points, round(angle, 2) AS angle, CASE WHEN abs(a) < 20 THEN 'straight on' WHEN abs(a) < 60 THEN 'bear ' || d WHEN abs(a) < 120 THEN 'turn ' || d WHEN abs(a) < 160 THEN 'sharp ' || d ELSE 'turn around' END AS text FROM (SELECT *, round(angle, 2) AS a, CASE WHEN angle > 0 THEN 'left' ELSE 'right' END AS d FROM g) q""")
def maneuvers(spark, sf):
    """Bends to one side that follow each other as one turn, with its text."""
    w = Window.partitionBy("path").orderBy(*ORDER)
    rows = fixture(spark, sf, "hops").withColumns({"ix": F.col("x") - F.lag("x").over(w), "iy": F.col("y") - F.lag("y").over(w), "ox": F.lead("x").over(w) - F.col("x"), "oy": F.lead("y").over(w) - F.col("y"), "k": F.row_number().over(w)})
    rows = rows.filter("ix IS NOT NULL AND ox IS NOT NULL").withColumn("turn", _along("io"))
    rows = rows.withColumn("side", F.when(F.col("turn") >= 20, 1).when(F.col("turn") <= -20, -1)).filter("side IS NOT NULL").select("path", "k", "turn", "side")
    by_k = Window.partitionBy("path").orderBy("k")
    goes_on = (F.col("side") == F.lag("side").over(by_k)) & (F.col("k") == F.lag("k").over(by_k) + 1)
    found = ordered.islands(rows.withColumn("_new", ~F.coalesce(goes_on, F.lit(False))), ["path"], ["k"], F.col("_new"))
    found = found.groupBy("path", "island").agg(F.min("k").cast("bigint").alias("k"), F.round(F.sum("turn"), 2).alias("angle"), F.count("*").alias("points"))
    return found.select("path", "k", "points", "angle", text.turn_text(F.col("angle")).alias("text"))


@query(f"""WITH {STEPPED}, z AS (SELECT path, along, until - along AS len, (l_partkey * 13) % 60 AS z, lead((l_partkey * 13) % 60) OVER (PARTITION BY path ORDER BY seq, l_partkey, x, y) AS nz, row_number() OVER (PARTITION BY path ORDER BY seq, l_partkey, x, y) AS k FROM legs),
s AS (SELECT path, k, along, along + len AS fin, nz - z AS dz FROM z WHERE len > 0 AND abs(nz - z) / len >= 0.05),
m AS (SELECT *, CASE WHEN (dz > 0) = (lag(dz) OVER w > 0) AND along - lag(fin) OVER w <= 6 THEN 0 ELSE 1 END AS starts FROM s WINDOW w AS (PARTITION BY path ORDER BY k)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY k {UP_TO}) AS n FROM m)
SELECT path, round(min(along), 4) AS along, sum(dz) > 0 AS up, CAST(sum(dz) AS BIGINT) AS rise FROM i GROUP BY path, n HAVING abs(sum(dz)) >= 10""")
def floor_changes(spark, sf):
    """Rises and falls along a path: steep steps of one direction with small gaps, if they come to enough together."""
    w = Window.partitionBy("path").orderBy(*ORDER)
    rows = ordered.steps(fixture(spark, sf, "hops"), ["path"], ORDER).withColumns({"z": F.col("l_partkey") * 13 % 60, "k": F.row_number().over(w)})
    rows = rows.withColumns({"len": F.lead("along").over(w) - F.col("along"), "dz": F.lead("z").over(w) - F.col("z")})
    steep = rows.filter("len > 0 AND abs(dz) / len >= 0.05").select("path", "k", "along", (F.col("along") + F.col("len")).alias("fin"), "dz")
    by_k = Window.partitionBy("path").orderBy("k")
    goes_on = ((F.col("dz") > 0) == (F.lag("dz").over(by_k) > 0)) & (F.col("along") - F.lag("fin").over(by_k) <= 6)
    found = ordered.islands(steep.withColumn("_new", ~F.coalesce(goes_on, F.lit(False))), ["path"], ["k"], F.col("_new"))
    out = found.groupBy("path", "island").agg(F.round(F.min("along"), 4).alias("along"), F.sum("dz").cast("bigint").alias("rise")).filter("abs(rise) >= 10")
    return out.select("path", "along", (F.col("rise") > 0).alias("up"), "rise")


@query(f"""WITH {STEPPED}, p AS ({POINT.format(asked="SELECT path, k, 100.0 + k * 150 AS at_ FROM (SELECT DISTINCT path FROM $hops) h, (SELECT unnest(range(2)) AS k) r")}),
e AS (SELECT p.path, CASE WHEN k = 0 THEN 0.0 ELSE 1e9 END AS pos, p.px AS x, p.py AS y FROM p UNION ALL SELECT path, along AS pos, x, y FROM legs WHERE along > 100 AND along < 250)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY pos, x, y) AS k, round(x, 4) AS x, round(y, 4) AS y FROM e""")
def sliced_lines(spark, sf):
    """The stretch of each path from 100 to 250 yards: its two ends and what lies between."""
    hops = fixture(spark, sf, "hops")
    asked = hops.select("path").distinct().withColumn("k", F.explode(F.expr("sequence(0, 1)"))).withColumn("at", 100.0 + F.col("k") * 150)
    ends = ordered.points_at(hops, asked, ["path"], ORDER).select("path", F.when(F.col("k") == 0, 0.0).otherwise(1e9).alias("pos"), F.col("px").alias("x"), F.col("py").alias("y"))
    inner = ordered.steps(hops, ["path"], ORDER).filter("along > 100 AND along < 250").select("path", F.col("along").alias("pos"), "x", "y")
    k = F.row_number().over(Window.partitionBy("path").orderBy("pos", "x", "y"))
    return ends.unionByName(inner).select("path", k.cast("bigint").alias("k"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""WITH {STEPPED} SELECT path, seq, l_partkey, round(sum(CASE WHEN l_partkey % 4 = 0 THEN coalesce(step, 0.0) ELSE 0.0 END) OVER ({PATH} {UP_TO}), 3) AS exposed, x, y FROM summed""")
def prefix_exposure(spark, sf):
    """Hostile yards walked up to each point of a path."""
    rows = ordered.steps(fixture(spark, sf, "hops"), ["path"], ORDER)
    w = Window.partitionBy("path").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exposed = F.sum(F.when(F.col("l_partkey") % 4 == 0, F.coalesce("step", F.lit(0.0))).otherwise(0.0)).over(w)
    return rows.select("path", "seq", "l_partkey", F.round(exposed, 3).alias("exposed"), "x", "y")


@query(f"""WITH {TURNS} SELECT h.path, h.seq, h.l_partkey, h.x, h.y FROM (SELECT *, row_number() OVER ({PATH}) AS k FROM $hops) h LEFT JOIN turns t ON t.path = h.path AND t.k = h.k AND abs(t.turn) > 150 WHERE t.path IS NULL""")
def without_spikes(spark, sf):
    """Paths without the points at which they go out and straight back."""
    w = Window.partitionBy("path").orderBy(*ORDER)
    rows = fixture(spark, sf, "hops").withColumns({"ix": F.col("x") - F.lag("x").over(w), "iy": F.col("y") - F.lag("y").over(w), "ox": F.lead("x").over(w) - F.col("x"), "oy": F.lead("y").over(w) - F.col("y")})
    return rows.filter(~F.coalesce(F.abs(_along("io")) > 150, F.lit(False))).select("path", "seq", "l_partkey", "x", "y")


@query(f"""WITH {STEPPED}, d AS (SELECT path, along, seq, l_partkey, x, y, until, nx, ny, CASE WHEN until > along THEN greatest(0.0, least(1.0, ((150 - x) * (nx - x) + (120 - y) * (ny - y)) / ((nx - x) * (nx - x) + (ny - y) * (ny - y)))) ELSE 0.0 END AS t FROM legs WHERE nx IS NOT NULL),
m AS (SELECT path, along + t * (until - along) AS walked, sqrt((x + t * (nx - x) - 150) * (x + t * (nx - x) - 150) + (y + t * (ny - y) - 120) * (y + t * (ny - y) - 120)) AS off FROM d)
SELECT path, round(walked, 3) AS walked, round(off, 3) AS off, off > 30 AS lost FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(off, 6), round(walked, 6)) AS n FROM m) q WHERE n = 1""")
def followed_paths(spark, sf):
    """A player's place on each path: the length walked so far, the distance from it, and whether the path is lost."""
    w = Window.partitionBy("path").orderBy(*ORDER)
    legs = ordered.steps(fixture(spark, sf, "hops"), ["path"], ORDER).withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "until": F.lead("along").over(w)}).filter("nx IS NOT NULL")
    off, t = geo.segment_distance(F.lit(150), F.lit(120), F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))
    met = legs.select("path", off.alias("off"), (F.col("along") + t * (F.col("until") - F.col("along"))).alias("walked"))
    best = met.groupBy("path").agg(F.min(F.struct(F.round("off", 6).alias("o"), F.round("walked", 6).alias("w"), "off", "walked")).alias("b"))
    return best.select("path", F.round("b.walked", 3).alias("walked"), F.round("b.off", 3).alias("off"), (F.col("b.off") > 30).alias("lost"))


@query("""SELECT user_id, event_id, round(CASE WHEN n BETWEEN 1 AND 40 AND abs(gap / n - 3600) < 72 THEN gap / n ELSE 3600 END, 4) AS cycle FROM (SELECT *, floor(gap / 3600 + 0.5) AS n FROM (
 SELECT user_id, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM @events WHERE event_type = 'purchase') q WHERE gap IS NOT NULL) p""")
def sharpened_cycles(spark, sf):
    """A timetable's cycle, sharpened by two departures that lie whole cycles apart and agree with it closely."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    left = _events(spark.read.parquet(f"{sf}/events.parquet")).filter("event_type = 'purchase'")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = left.withColumn("gap", (micros - F.lag(micros).over(w)) / 1e6).filter("gap IS NOT NULL")
    n = F.floor(F.col("gap") / 3600 + 0.5)
    sharp = n.between(1, 40) & (F.abs(F.col("gap") / n - 3600) < 72)
    return rows.select("user_id", "event_id", F.round(F.when(sharp, F.col("gap") / n).otherwise(3600), 4).alias("cycle"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, x, y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM $tracks),
run AS (SELECT user_id, n, event_id, x AS hx, y AS hy, true AS kept FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN (e.x - hx) * (e.x - hx) + (e.y - hy) * (e.y - hy) >= 400 THEN e.x ELSE hx END AS hx,
 CASE WHEN (e.x - hx) * (e.x - hx) + (e.y - hy) * (e.y - hy) >= 400 THEN e.y ELSE hy END AS hy, (e.x - hx) * (e.x - hx) + (e.y - hy) * (e.y - hy) >= 400 AS kept FROM run r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id FROM run WHERE kept""")
def trip_traces(spark, sf):
    """A trip's samples far enough from the one kept before."""
    tracks = fixture(spark, sf, "tracks").select("user_id", "event_id", "ts", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return detectors.over_table(tracks, "user_id", ["event_id", "x", "y"], detectors.spaced(20), (None, None), "user_id bigint, event_id bigint", ["ts", "event_id"])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, x, y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM $tracks),
run AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, 0 AS stop, false AS there FROM e WHERE n = 1 UNION ALL
 SELECT e.user_id, e.n, e.event_id, CASE WHEN (e.x - stop * 10) * (e.x - stop * 10) + (e.y + stop * 5) * (e.y + stop * 5) <= 400 THEN (stop + 1) % 6 ELSE stop END AS stop, (e.x - stop * 10) * (e.x - stop * 10) + (e.y + stop * 5) * (e.y + stop * 5) <= 400 AS there
 FROM run r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, (stop + 5) % 6 AS stop FROM run WHERE there""")
def arrivals(spark, sf):
    """Arrivals at the stops of a loop in turn: coming near the next one moves on to the one after it."""
    tracks = fixture(spark, sf, "tracks").select("user_id", "event_id", "ts", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    stops = [(i * 10.0, -i * 5.0) for i in range(6)]
    return detectors.over_table(tracks, "user_id", ["event_id", "x", "y"], detectors.arriving(stops, 20), (0,), "user_id bigint, event_id bigint, stop int", ["ts", "event_id"])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS time, event_id % 2 AS message, event_id % 3 + 1 AS number, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM @events),
run AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS message, CAST(0 AS DOUBLE) AS since, [0, 0, 0] AS parts, CAST(NULL AS BIGINT) AS done, false AS whole FROM e WHERE n = 1 UNION ALL
 SELECT user_id, n, CASE WHEN list_min(parts) > 0 THEN -1 ELSE message END AS message, time AS since, CASE WHEN list_min(parts) > 0 THEN [0, 0, 0] ELSE parts END AS parts, event_id AS done, list_min(parts) > 0 AS whole FROM (
 SELECT e.user_id, e.n, e.message, e.time, e.event_id, list_transform(CASE WHEN r.message <> e.message OR e.time - r.since > 200000 THEN [0, 0, 0] ELSE r.parts END, lambda v, i: CASE WHEN i = e.number THEN 1 ELSE v END) AS parts
 FROM run r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) q)
SELECT user_id, done AS event_id FROM run WHERE whole""")
def received_messages(spark, sf):
    """Messages put together of three parts each, whatever their order; a pause or another message starts anew."""
    events = _events(spark.read.parquet(f"{sf}/events.parquet")).withColumns({"message": (F.col("event_id") % 2).cast("string"), "number": (F.col("event_id") % 3 + 1).cast("int"), "of": F.lit(3), "part": F.col("event_id").cast("string")})
    step = detectors.reassembly(200000)

    def last_part(state, row):
        state, found = step(state, row[:5])
        return state, [(row[5],) for _ in found]

    return detectors.over_table(events, "user_id", ["time", "message", "number", "of", "part", "event_id"], last_part, ("", 0, 0.0, ""), "user_id bigint, event_id bigint", ["time", "event_id"])


@query("""SELECT c.event_id, count(k.event_id) > 0 AS killed FROM @events c LEFT JOIN @events k ON k.user_id = c.user_id AND k.event_type = 'error' AND k.ts <= c.ts AND epoch_us(c.ts) - epoch_us(k.ts) <= 10800000000 WHERE c.event_type = 'view' GROUP BY c.event_id""")
def kill_flags(spark, sf):
    """Whether a kill in the three hours before still counts, at each look."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    kills = events.filter("event_type = 'error'").select("user_id", "ts", F.col("ts").alias("kill"))
    looks = events.filter("event_type = 'view'").drop("event_type")
    return as_of(looks, kills, "user_id", "ts", 10800, "kill").select("event_id", F.col("kill").isNotNull().alias("killed"))


@query("""SELECT id, round(((sx - x1) * (x2 - x1) + (sy - y1) * (y2 - y1)) / nullif(sqrt((sx - x1) * (sx - x1) + (sy - y1) * (sy - y1)) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 5) AS cosine FROM (SELECT *, x1 + 60 AS sx, y1 + (id * 37) % 90 - 45 AS sy FROM $segments) q""")
def first_headings(spark, sf):
    """The cosine between the first sixty yards of a way and the direction of its goal."""
    rows = fixture(spark, sf, "segments").withColumns({"ax": F.lit(60.0), "ay": F.col("id") * 37 % 90 - 45.0, "gx": F.col("x2") - F.col("x1"), "gy": F.col("y2") - F.col("y1")})
    size = lambda x, y: F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    cosine = (F.col("ax") * F.col("gx") + F.col("ay") * F.col("gy")) / F.nullif(size("ax", "ay") * size("gx", "gy"), F.lit(0))
    return rows.select("id", F.round(cosine, 5).alias("cosine"))
