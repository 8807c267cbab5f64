"""Typed lines and messages, pins, exports, heights along edges, ways in, doors, nearest roads without a reach."""

from pyspark.sql import functions as F

from waygrid.functions import text
from waygrid.operators import doors
from waygrid.operators.spatial import nearest_segment_anywhere
from waygrid.queries import query
from waygrid.queries.streams import _events
from waygrid.sources.fixtures import fixture, run_sql
from waygrid.streaming import detectors, replay


@query("""SELECT id, CASE WHEN id % 6 IN (2, 3) THEN CAST(kind AS INTEGER) END AS map_id, CASE id % 6 WHEN 0 THEN 'Old Town' WHEN 1 THEN 'Sector7' END AS zone, CASE WHEN id % 6 < 4 THEN CAST(id % 100 AS DOUBLE) END AS x, CASE WHEN id % 6 < 4 THEN id % 50 + 0.5e0 END AS y, CASE WHEN id % 6 IN (0, 3) THEN name END AS text FROM $sites""")
def loose_way_lines(spark, sf):
    """Lines typed in any of their forms: without the command, with a zone, commas, or no text; others are null."""
    k, x, y = F.col("id"), F.col("id") % 100, F.col("id") % 50
    line = (
        F.when(k % 6 == 0, F.format_string("/way Old Town, %d %d.5 %s", x, y, F.col("name")))
        .when(k % 6 == 1, F.format_string("Sector7 %d, %d.5", x, y))
        .when(k % 6 == 2, F.format_string("  #%d %d,%d.5  ", F.col("kind"), x, y))
        .when(k % 6 == 3, F.format_string("/TWAY #%d %d %d.5 %s", F.col("kind"), x, y, F.col("name")))
        .when(k % 6 == 4, F.format_string("/way Old Town %d north", x))
        .otherwise(F.format_string("/way %d 250", x))
    )
    return fixture(spark, sf, "sites").withColumn("w", text.way_line(line)).select("id", "w.map_id", "w.zone", "w.x", "w.y", "w.text")


@query("""SELECT event_id, CASE WHEN ok THEN CAST(event_id % 3 + 1 AS INTEGER) END AS part, CASE WHEN ok THEN CAST((event_id * 37) % 30000 AS DOUBLE) END AS x, CASE WHEN ok AND event_id % 5 > 0 THEN event_type END AS name FROM (SELECT *, event_id % 7 > 0 AND event_id % 4 < 2 AND event_id % 3 + 1 <= event_id % 5 + 1 AND (event_id * 53) % 31000 <= 30000 AS ok FROM @events) q""")
def valid_messages(spark, sf):
    """Parts of shared routes that keep to the protocol and to its ranges."""
    k = F.col("event_id")
    name = F.when(k % 5 > 0, F.col("event_type")).otherwise("")
    line = F.format_string("%d\tr%d\t%d\t%d\t%d\t%d\t-%d\t%s", F.when(k % 7 > 0, 1).otherwise(2), k % 9, k % 3 + 1, k % 5 + 1, k % 4, (k * 37) % 30000, (k * 53) % 31000, name)
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("m", text.shared_message(line))
    return rows.select("event_id", F.col("m.i").alias("part"), "m.x", "m.name")


@query("""SELECT p_partkey AS id, round(p_size * 1.37e0, 1) AS x, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'icons/x-' || CAST(p_size AS VARCHAR) || '.png' ELSE 'mark' END AS icon, CASE WHEN p_partkey % 9 = 0 THEN 'Pin' ELSE substr(p_name, 1, 20) END AS name FROM @part""")
def checked_pins(spark, sf):
    """Pins with icons and names made safe; what can't be is the default."""
    k, size = F.col("p_partkey"), F.col("p_size")
    given = F.when(k % 4 == 0, F.concat(F.lit(" "), size.cast("string"))).when(k % 4 == 1, F.format_string("icons/x-%d .png", size)).when(k % 4 == 2, F.lit("a|b<script>")).otherwise("")
    named = F.when(k % 9 == 0, F.lit(" \t| ")).otherwise(F.col("p_name"))
    parts = spark.read.parquet(f"{sf}/part.parquet")
    return parts.select(k.alias("id"), F.round(size * 1.37, 1).alias("x"), F.coalesce(text.clean_icon(given), F.lit("mark")).alias("icon"), F.coalesce(text.clean_name(named, 20), F.lit("Pin")).alias("name"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM @events),
a AS (SELECT user_id, list({'id': event_id, 'rank': n} ORDER BY n) FILTER (event_type = 'purchase' AND n <= 5) AS roads, list({'id': event_id, 'rank': n} ORDER BY n) FILTER (event_type = 'view' AND n <= 3) AS trips FROM r GROUP BY user_id)
SELECT user_id, CAST(to_json({'format': 1, 'roads': coalesce(roads, []), 'trips': coalesce(trips, [])}) AS VARCHAR) AS document FROM a""")
def feedback_documents(spark, sf):
    """One document for each user: the latest roads and trips, as many as are kept."""
    from pyspark.sql import Window

    events = spark.read.parquet(f"{sf}/events.parquet")
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    latest = events.select("user_id", "event_id", "event_type", n.alias("n"))
    item = F.struct(F.col("n").alias("rank"), F.col("event_id").alias("id"))
    few = lambda kind, most: F.array_sort(F.collect_list(F.when((F.col("event_type") == kind) & (F.col("n") <= most), item)))  # noqa: E731  as many as are kept
    lists = latest.groupBy("user_id").agg(few("purchase", 5).alias("roads"), few("view", 3).alias("trips"))
    turned = lambda c: F.transform(c, lambda x: F.struct(x["id"].alias("id"), x["rank"].alias("rank")))
    return lists.select("user_id", F.to_json(F.struct(F.lit(1).alias("format"), turned("roads").alias("roads"), turned("trips").alias("trips"))).alias("document"))


@query("""SELECT t.a, t.b, round(CASE WHEN za IS NULL OR zb IS NULL THEN coalesce(za, zb) ELSE za + (zb - za) * greatest(0.0, least(1.0, (t.a % 60) / greatest(t.w, 1))) END, 6) AS z FROM $trees t
JOIN (SELECT p_partkey AS a, CASE WHEN p_size % 7 > 0 THEN CAST(p_size AS DOUBLE) END AS za FROM @part) x ON x.a = t.a JOIN (SELECT p_partkey AS b, CASE WHEN p_size % 7 > 0 THEN CAST(p_size AS DOUBLE) END AS zb FROM @part) y ON y.b = t.b""")
def edge_heights(spark, sf):
    """The height at a distance along each edge, between those of its ends; that of one end where the other has none."""
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") % 7 > 0, F.col("p_size").cast("double")).alias("z"))
    end = lambda c: parts.select(F.col("node").alias(c), F.col("z").alias(f"z{c}"))
    met = fixture(spark, sf, "trees").join(end("a"), "a").join(end("b"), "b")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("a") % 60) / F.greatest("w", F.lit(1.0))))
    z = F.coalesce(F.col("za") + (F.col("zb") - F.col("za")) * share, "za", "zb")
    return met.select("a", "b", F.round(z, 6).alias("z"))


@query("""SELECT pid, wid, round(d, 5) AS d FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, wid) AS n FROM (SELECT pid, wid, sqrt((x - x1 - t * (x2 - x1)) * (x - x1 - t * (x2 - x1)) + (y - y1 - t * (y2 - y1)) * (y - y1 - t * (y2 - y1))) AS d FROM (
 SELECT p.id AS pid, w.*, p.x, p.y, greatest(0.0, least(1.0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM $sites p, $walls w) q) q) q WHERE n = 1""")
def nearest_roads(spark, sf):
    """The nearest road of each site, however far."""
    sites = fixture(spark, sf, "sites").select(F.col("id").alias("pid"), "x", "y")
    found = nearest_segment_anywhere(sites, fixture(spark, sf, "walls"), "pid", "wid", 50)
    return found.select("pid", "wid", F.round("d", 5).alias("d"))


WAY_IN = """SELECT user_id, event_id, inside, o.x AS x, o.y AS y FROM (SELECT user_id, event_id, inside, time, lag(inside) OVER w AS before, last_value(CASE WHEN inside IS NULL THEN struct_pack(x := px, y := py, at_ := time) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM (
 SELECT user_id, event_id, epoch_us(ts) / 1e6 AS time, CASE WHEN event_type = 'purchase' THEN event_id % 4 END AS inside, CAST((event_id * 37) % 101 AS DOUBLE) AS px, CAST((event_id * 53) % 97 AS DOUBLE) AS py FROM @events) q WINDOW w AS (PARTITION BY user_id ORDER BY time, event_id)) q WHERE inside IS NOT NULL AND before IS NULL AND time - o.at_ <= 20000"""


@query(WAY_IN)
def ways_in(spark, sf):
    """Where each way in was entered from, by a machine over a stream: the last place outside, if it is fresh."""
    rows = _events(replay.table_stream(spark, sf, "events")).selectExpr("user_id", "event_id", "time", "CAST((event_id * 37) % 101 AS DOUBLE) AS x", "CAST((event_id * 53) % 97 AS DOUBLE) AS y", "CASE WHEN event_type = 'purchase' THEN event_id % 4 END AS inside")
    state = "x double, y double, at_ double, was_in boolean"
    out = detectors.over_stream(rows, "user_id", ["event_id", "time", "x", "y", "inside"], detectors.entering(20000), detectors.NOT_OUTSIDE, state, "user_id bigint, event_id bigint, inside bigint, x double, y double", ["time", "event_id"])
    return replay.run_to_end(out)


INS = "SELECT s_suppkey AS door, s_nationkey AS map, concat(n_name, CASE s_suppkey % 4 WHEN 0 THEN ' - Entering' WHEN 1 THEN ' Entrance' WHEN 2 THEN ' (Back Door) Start' ELSE ': Inside the' END) AS name, CASE WHEN s_suppkey % 3 = 0 THEN CAST((s_suppkey * 7919) % 10007 AS DOUBLE) END AS trigger_x, CASE WHEN s_suppkey % 3 = 0 THEN CAST((s_suppkey * 104729) % 10009 AS DOUBLE) END AS trigger_y FROM @supplier JOIN @nation ON n_nationkey = s_nationkey"
OUTS = "SELECT c_custkey AS out, concat(CASE WHEN c_nationkey >= 20 THEN concat(split_part(n_name, ' ', 1), ' Way') ELSE n_name END, CASE c_custkey % 3 WHEN 0 THEN ' - Exiting' WHEN 1 THEN ' Exit' ELSE ' Tunnel' END) AS name, CAST((c_custkey * 6007) % 10007 AS DOUBLE) AS x, CAST((c_custkey * 15013) % 10009 AS DOUBLE) AS y FROM @customer JOIN @nation ON n_nationkey = c_nationkey"
GHOSTS = "SELECT id AS map, x AS gx, y AS gy FROM $docks"
KEY = "array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(name), '\\(.*?\\)', ' ', 'g'), '[^a-z'' ]', ' ', 'g'), ' '), lambda w: w NOT IN ('entering', 'exiting', 'entrance', 'exit', 'instance', 'start', 'end', 'inside', 'the', '')), ' ')"


@query(f"""WITH i AS (SELECT q.*, split_part(key, ' ', 1) AS word, g.gx, g.gy FROM (SELECT *, {KEY} AS key FROM ({INS}) q) q LEFT JOIN ({GHOSTS}) g ON g.map = q.map), o AS (SELECT *, split_part(key, ' ', 1) AS word FROM (SELECT *, {KEY} AS key FROM ({OUTS}) q) q),
m AS (SELECT i.door, CASE WHEN o.key = i.key THEN 'key' ELSE 'word' END AS way, o.out, o.x, o.y, CASE WHEN gx IS NULL THEN 0 ELSE sqrt((o.x - gx) * (o.x - gx) + (o.y - gy) * (o.y - gy)) END AS d FROM i JOIN o ON o.word = i.word),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY door ORDER BY way, d, out) AS n FROM m) q WHERE n = 1 AND d < 1500)
SELECT i.door, coalesce(b.way, CASE WHEN trigger_x IS NOT NULL THEN 'trigger' WHEN gx IS NOT NULL THEN 'ghost' END) AS way, b.out, coalesce(b.x, trigger_x, gx) AS x, coalesce(b.y, trigger_y, gy) AS y FROM i LEFT JOIN b ON b.door = i.door WHERE b.way IS NOT NULL OR trigger_x IS NOT NULL OR gx IS NOT NULL""")
def paired_doors(spark, sf):
    """Ways in with where they start from: by name, by first word, their own place, or the ghosts' place."""
    return doors.paired_doors(run_sql(spark, sf, INS), run_sql(spark, sf, OUTS), run_sql(spark, sf, GHOSTS), 1500)


@query("""WITH b AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS body, list(event_id ORDER BY event_id) FILTER (event_type = 'signup' AND event_id % 3 = 0) AS stops FROM @events GROUP BY user_id)
SELECT user_id, CASE WHEN body IS NULL THEN coalesce(list_filter(stops, lambda s: s % 2 = 0), []) ELSE list_prepend(body, coalesce(list_filter(stops, lambda s: s % 2 = 0), [])) END AS stops FROM b""")
def stops_after_death(spark, sf):
    """Stops without those of old bodies (odd ones), the way to the present body first."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    kept = (F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0)
    rows = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("body"), F.sort_array(F.collect_list(F.when(kept, F.col("event_id")))).alias("stops"))
    alive = F.filter("stops", lambda s: s % 2 == 0)
    return rows.select("user_id", F.when(F.col("body").isNull(), alive).otherwise(F.concat(F.array("body"), alive)).alias("stops"))
