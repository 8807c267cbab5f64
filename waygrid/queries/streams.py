"""Streams replayed to their end, and stored samples run through the same detectors."""

import uuid

from pyspark.sql import functions as F

from waygrid.plans.scratch import shared_dir
from waygrid.queries import query
from waygrid.streaming import detectors, replay, upsert


def _events(df):
    return df.withColumn("time", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query("SELECT user_id, count(*) AS samples, round(avg(value), 6) AS seconds FROM @events GROUP BY user_id")
def running_means(spark, sf):
    """Learned times as running means, kept in streaming state."""
    stream = replay.table_stream(spark, sf, "events")
    means = stream.groupBy("user_id").agg(F.count("*").alias("samples"), F.avg("value").alias("seconds"))
    return replay.run_to_end(means, "complete").withColumn("seconds", F.round("seconds", 6))


@query("SELECT CAST(epoch_us(ts) // 21600000000 AS BIGINT) AS span, event_type, count(*) AS n, round(max(value), 2) AS worst FROM @events GROUP BY 1, 2")
def perf_windows(spark, sf):
    """Counters in tumbling windows of six hours by event time, with a watermark for what comes late."""
    stream = replay.table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    spans = stream.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("worst"))
    got = replay.run_to_end(spans, "complete")
    return got.select(F.floor(F.unix_seconds("window.start") / 21600).alias("span"), "event_type", "n", F.round("worst", 2).alias("worst"))


@query("SELECT DISTINCT user_id, event_type FROM @events")
def imported_once(spark, sf):
    """A polled folder imported with each key once, however often its files come again."""
    stream = replay.table_stream(spark, sf, "events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return replay.run_to_end(stream)


RIDES = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS time, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM @events),
run AS (SELECT user_id, n, CASE WHEN kind = 'signup' THEN 'boarded' ELSE '' END AS phase, CASE WHEN kind = 'signup' THEN time ELSE 0 END AS since, CAST(NULL AS DOUBLE) AS departed, time FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n,
 CASE WHEN e.kind = 'signup' THEN 'boarded' WHEN r.phase <> '' AND e.time - r.since > 864000 THEN '' WHEN e.kind = 'purchase' AND r.phase = 'boarded' THEN 'away' WHEN e.kind = 'view' AND r.phase = 'away' THEN '' ELSE r.phase END AS phase,
 CASE WHEN e.kind = 'signup' THEN e.time WHEN r.phase <> '' AND e.time - r.since > 864000 THEN 0 WHEN e.kind = 'purchase' AND r.phase = 'boarded' THEN e.time WHEN e.kind = 'view' AND r.phase = 'away' THEN 0 ELSE r.since END AS since,
 CASE WHEN e.kind = 'view' AND r.phase = 'away' AND e.time - r.since <= 864000 THEN r.since END AS departed, e.time FROM run r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, round(departed, 3) AS departed, round(time, 3) AS arrived, round(time - departed, 3) AS seconds FROM run WHERE departed IS NOT NULL"""


def _rides(df):
    return df.select("user_id", F.round("departed", 3).alias("departed"), F.round("arrived", 3).alias("arrived"), F.round("seconds", 3).alias("seconds"))


@query(RIDES)
def rides(spark, sf):
    """Rides from boarding to arrival over stored sightings."""
    events = _events(spark.read.parquet(f"{sf}/events.parquet"))
    step = detectors.rides("signup", "purchase", "view", 864000)
    return _rides(detectors.over_table(events, "user_id", ["time", "event_type"], step, ("", 0.0), "user_id bigint, departed double, arrived double, seconds double", ["time", "event_id"]))


@query(RIDES)
def rides_stream(spark, sf):
    """The same rides from a stream, with keyed state."""
    stream = _events(replay.table_stream(spark, sf, "events"))
    step = detectors.rides("signup", "purchase", "view", 864000)
    out = "user_id bigint, departed double, arrived double, seconds double"
    return _rides(replay.run_to_end(detectors.over_stream(stream, "user_id", ["time", "event_type"], step, ("", 0.0), "phase string, since double", out, ["time", "event_id"])))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS time, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM @events),
run AS (SELECT user_id, n, time, value, true AS passed FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.time - r.time >= 36000 AND abs(e.value - r.value) >= 8 THEN e.time ELSE r.time END AS time,
 CASE WHEN e.time - r.time >= 36000 AND abs(e.value - r.value) >= 8 THEN e.value ELSE r.value END AS value, e.time - r.time >= 36000 AND abs(e.value - r.value) >= 8 AS passed FROM run r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, round(time, 3) AS time, value FROM run WHERE passed""")
def reroutes(spark, sf):
    """A new route only after enough time and enough change."""
    events = _events(spark.read.parquet(f"{sf}/events.parquet"))
    got = detectors.over_table(events, "user_id", ["time", "value"], detectors.debounce(36000, 8), (None, None), "user_id bigint, time double, value double", ["time", "event_id"])
    return got.select("user_id", F.round("time", 3).alias("time"), "value")


#: Samples of trips, row by row: three-day targets, deaths, arrivals, now and then another level.
SAMPLES = """CAST((event_id * 37) % 101 AS DOUBLE) AS x, CAST((event_id * 53) % 97 AS DOUBLE) AS y, CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END AS level, CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(floor(time / 259200) AS BIGINT) END AS target, event_type = 'error' AND event_id % 2 = 0 AS away, event_type = 'purchase' AS arrived, CAST(100000 + event_id % 7 * 30000 AS DOUBLE) AS estimate"""
SESSIONS = f"""WITH RECURSIVE t AS (SELECT *, epoch_us(ts) / 1e6 AS time FROM @events), e AS (SELECT user_id, event_id, time, {SAMPLES}, row_number() OVER (PARTITION BY user_id ORDER BY time, event_id) AS k FROM t),
run AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS dest, CAST(0 AS DOUBLE) AS began, 0 AS floor_, CAST(0 AS DOUBLE) AS est, 0 AS points, CAST(0 AS DOUBLE) AS px, CAST(0 AS DOUBLE) AS py, CAST(0 AS DOUBLE) AS last, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS got, CAST(NULL AS DOUBLE) AS got_began, CAST(NULL AS DOUBLE) AS actual, 0 AS got_points FROM e WHERE k = 1
UNION ALL SELECT user_id, k, CASE WHEN arrived OR away OR target IS NULL OR (d0 = target AND level <> floor_) THEN NULL ELSE target END AS dest, CASE WHEN d0 = target THEN began ELSE time END AS began, CASE WHEN d0 = target THEN floor_ ELSE level END AS floor_, CASE WHEN d0 = target THEN est ELSE estimate END AS est,
 CASE WHEN d0 = target THEN CASE WHEN far THEN points + 1 ELSE points END ELSE 1 END AS points, CASE WHEN d0 = target AND NOT far THEN px ELSE x END AS px, CASE WHEN d0 = target AND NOT far THEN py ELSE y END AS py, time AS last, event_id,
 CASE WHEN arrived AND d0 = target AND time - began >= 20000 AND time - began <= 0.85 * est AND points >= 2 THEN target END AS got, began AS got_began, time - began AS actual, points + 1 AS got_points FROM (
 SELECT e.*, CASE WHEN e.time - r.last > 400000 THEN NULL ELSE r.dest END AS d0, r.began, r.floor_, r.est, r.points, r.px, r.py, (e.x - r.px) * (e.x - r.px) + (e.y - r.py) * (e.y - r.py) >= 400 AS far FROM run r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) q)
SELECT user_id, event_id, got AS target, round(got_began, 3) AS began, round(actual, 3) AS actual, got_points AS points FROM run WHERE got IS NOT NULL"""
SAMPLE = ["event_id", "time", "x", "y", "level", "target", "away", "arrived", "estimate"]
TRIP = "user_id bigint, event_id bigint, target bigint, began double, actual double, points int"


def _samples(df):
    return _events(df).selectExpr("user_id", "event_id", "time", *SAMPLES.split(", "))


def _trip_rule():
    return detectors.trip_session(step_length=20, most_points=3000, least_seconds=20000, faster=0.85, least_points=2, idle=400000)


def _rounded(trips):
    return trips.withColumns({c: F.round(c, 3) for c in ("began", "actual")})


@query(SESSIONS)
def trip_sessions(spark, sf):
    """Trips that were traced to their target and are worth keeping, from stored samples."""
    rows = _samples(spark.read.parquet(f"{sf}/events.parquet"))
    return _rounded(detectors.over_table(rows, "user_id", SAMPLE, _trip_rule(), detectors.NO_TRIP, TRIP, ["time", "event_id"]))


@query(SESSIONS)
def trip_sessions_stream(spark, sf):
    """The same machine over a stream."""
    rows = _samples(replay.table_stream(spark, sf, "events"))
    state = "target bigint, began double, level int, estimate double, points int, x double, y double, last double"
    return _rounded(replay.run_to_end(detectors.over_stream(rows, "user_id", SAMPLE, _trip_rule(), detectors.NO_TRIP, state, TRIP, ["time", "event_id"])))


@query("""WITH RECURSIVE s AS (SELECT CAST(user_id % 3 AS BIGINT) AS level, event_type AS name, CAST((event_id * 7919) % 1009 AS DOUBLE) AS x, CAST((event_id * 104729) % 1013 AS DOUBLE) AS y, epoch_us(ts) / 1e6 AS time, event_id AS id FROM @events),
o AS (SELECT *, row_number() OVER (PARTITION BY level, name ORDER BY time, id) AS n FROM s),
run AS (SELECT level, name, CAST(1 AS BIGINT) AS n, [{'id': id, 'x': x, 'y': y}] AS kept, id AS joined FROM o WHERE n = 1 UNION ALL
 SELECT level, name, n, CASE WHEN len(near) = 0 THEN list_append(kept, {'id': id, 'x': x, 'y': y}) ELSE kept END AS kept, CASE WHEN len(near) = 0 THEN id ELSE near[1].id END AS joined FROM (
 SELECT o.level, o.name, o.n, o.id, o.x, o.y, r.kept, list_filter(r.kept, lambda k: (k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y) <= 22500) AS near FROM run r JOIN o ON o.level = r.level AND o.name = r.name AND o.n = r.n + 1) q)
SELECT level, name, joined AS place, count(*) AS n FROM run GROUP BY level, name, joined""")
def learned_places(spark, sf):
    """Places learned from a stream of sightings: one within 150 of an earlier place of its name counts there."""
    sightings = _events(replay.table_stream(spark, sf, "events")).selectExpr(
        "CAST(user_id % 3 AS BIGINT) AS level", "event_type AS name", "CAST((event_id * 7919) % 1009 AS DOUBLE) AS x", "CAST((event_id * 104729) % 1013 AS DOUBLE) AS y", "time", "event_id AS id"
    )
    places = upsert.learned_places(sightings, f"{shared_dir(spark)}/waygrid/places-{uuid.uuid4().hex}", 150)
    return places.select("level", "name", F.col("o.id").alias("place"), "n")
