"""Aggregates, top-k, set operations and search."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waygrid.operators import aggregates
from waygrid.queries import query
from waygrid.sources.fixtures import fixture


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("SELECT CAST(floor(x / 400) AS BIGINT) AS cx, CAST(floor(y / 400) AS BIGINT) AS cy, round(avg(x), 4) AS x, round(avg(y), 4) AS y, max(r) + 10 AS r, count(*) AS n FROM $circles GROUP BY 1, 2")
def merge_circles(spark, sf):
    m = aggregates.merged_circles(fixture(spark, sf, "circles"), 400, 10)
    return m.withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


@query("""WITH m AS (SELECT kind, avg(x) AS mx, avg(y) AS my, count(*) AS size FROM $people GROUP BY kind HAVING count(*) >= 2)
SELECT kind, pid, size FROM (SELECT p.kind, p.pid, m.size, row_number() OVER (PARTITION BY p.kind ORDER BY round(sqrt((p.x - m.mx) * (p.x - m.mx) + (p.y - m.my) * (p.y - m.my)), 6), p.pid) AS n FROM $people p JOIN m ON m.kind = p.kind) q WHERE n = 1""")
def town_labels(spark, sf):
    return aggregates.central_members(fixture(spark, sf, "people"), "kind", "pid")


@query("SELECT l_suppkey % 25 AS src, l_partkey % 25 AS dst, round(avg(l_quantity), 6) AS seconds, count(*) AS samples FROM @lineitem GROUP BY 1, 2")
def learned_flight_times(spark, sf):
    return _read(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 25).alias("src"), (F.col("l_partkey") % 25).alias("dst")).agg(F.round(F.avg("l_quantity"), 6).alias("seconds"), F.count("*").alias("samples"))


@query("SELECT event_type, round(sum(value), 2) AS total, max(value) AS worst, count(*) AS n, count(*) FILTER (value > 16) AS slow FROM @events GROUP BY event_type")
def timing_stats(spark, sf):
    return _read(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("worst"), F.count("*").alias("n"), F.count_if(F.col("value") > 16).alias("slow"))


@query("SELECT round(sum(value), 2) AS total FROM @events WHERE event_type IN ('click', 'view')")
def perf_total(spark, sf):
    return _read(spark, sf, "events").filter(F.col("event_type").isin("click", "view")).agg(F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT c.c_nationkey AS zone, count(*) AS trips, count(*) FILTER (o.o_totalprice > 250000) AS detours, count(*) FILTER (o.o_orderstatus = 'F') AS blocked, count(DISTINCT o.o_custkey) AS walkers
FROM @orders o JOIN @customer c ON c.c_custkey = o.o_custkey GROUP BY c.c_nationkey""")
def zone_check(spark, sf):
    both = _read(spark, sf, "orders").join(_read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy(F.col("c_nationkey").alias("zone")).agg(
        F.count("*").alias("trips"), F.count_if(F.col("o_totalprice") > 250000).alias("detours"), F.count_if(F.col("o_orderstatus") == "F").alias("blocked"), F.countDistinct("o_custkey").alias("walkers")
    )


@query("SELECT l_partkey % 40 AS texture, l_returnflag AS layer, round(sum(l_extendedprice * (1 - l_discount)), 2) AS weight FROM @lineitem GROUP BY 1, 2")
def texture_weights(spark, sf):
    weight = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return _read(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 40).alias("texture"), F.col("l_returnflag").alias("layer")).agg(F.round(F.sum(weight), 2).alias("weight"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM @events GROUP BY event_type")
def kind_counts(spark, sf):
    return _read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""SELECT user_id, string_agg(event_type || ':' || CAST(n AS VARCHAR), ',' ORDER BY event_type) AS summary FROM (SELECT user_id, event_type, count(*) AS n FROM @events GROUP BY 1, 2) q GROUP BY user_id""")
def summarize_users(spark, sf):
    counts = _read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    items = F.array_sort(F.collect_list(F.struct("event_type", "n")))  # at most one for each kind of event
    return counts.groupBy("user_id").agg(F.array_join(F.transform(items, lambda i: F.concat(i["event_type"], F.lit(":"), i["n"])), ",").alias("summary"))


@query("SELECT id, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, least(x1, x2) AS minx, greatest(x1, x2) AS maxx, least(y1, y2) AS miny, greatest(y1, y2) AS maxy FROM $segments")
def edge_boxes(spark, sf):
    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2")}
    return fixture(spark, sf, "segments").select(
        "id", ((c["x1"] + c["x2"]) / 2).alias("mx"), ((c["y1"] + c["y2"]) / 2).alias("my"), F.least("x1", "x2").alias("minx"), F.greatest("x1", "x2").alias("maxx"), F.least("y1", "y2").alias("miny"), F.greatest("y1", "y2").alias("maxy")
    )


SEARCH = """SELECT p_partkey, p_name, rank FROM (SELECT p_partkey, p_name, CASE WHEN starts_with(lower(p_name), '{t}') THEN 0 WHEN contains(lower(p_name), '{t}') OR ({w}) THEN 1 END AS rank FROM @part) q WHERE rank IS NOT NULL ORDER BY rank, length(p_name), p_name, p_partkey LIMIT 8"""


@query(SEARCH.format(t="ri", w="regexp_matches(lower(p_name), '(^|\\s)ri')"))
def search_places(spark, sf):
    return aggregates.search(_read(spark, sf, "part").select("p_partkey", "p_name"), "Ri", "p_name", "p_partkey")


@query(SEARCH.format(t="wi re", w="regexp_matches(lower(p_name), '(^|\\s)wi') AND regexp_matches(lower(p_name), '(^|\\s)re')"))
def search_word_starts(spark, sf):
    return aggregates.search(_read(spark, sf, "part").select("p_partkey", "p_name"), "wi re", "p_name", "p_partkey")


@query("""SELECT id, name, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), gx, gy ORDER BY source, id) AS n FROM (
 SELECT s_suppkey AS id, 'Spot ' || CAST(s_nationkey AS VARCHAR) AS name, 0 AS gx, 0 AS gy, 0 AS source FROM @supplier UNION ALL SELECT c_custkey AS id, 'spot ' || CAST(c_nationkey % 30 AS VARCHAR) AS name, CAST(c_custkey % 3 AS INTEGER) AS gx, 0 AS gy, 1 AS source FROM @customer) q) p WHERE n = 1""")
def search_index(spark, sf):
    """Union of sources; of places with one name in one square the first source's stays."""
    first = _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Spot "), "s_nationkey").alias("name"), F.lit(0).alias("gx"), F.lit(0).alias("gy"))
    second = _read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("spot "), F.col("c_nationkey") % 30).alias("name"), (F.col("c_custkey") % 3).cast("int").alias("gx"), F.lit(0).alias("gy"))
    return aggregates.first_wins([first, second], [F.lower("name"), F.col("gx"), F.col("gy")], ["id", "name", "gx", "gy"]).select("id", "name", "source")


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w AS rank, l_extendedprice - min(l_extendedprice) OVER (PARTITION BY l_orderkey) AS behind FROM @lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey)) q WHERE rank <= 8 AND behind <= 40000")
def candidates(spark, sf):
    """The cheapest eight of each group within a slack of the first."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey"))
    behind = F.col("l_extendedprice") - F.min("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    return _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rank.alias("rank"), behind.alias("behind")).filter("rank <= 8 AND behind <= 40000")


@query("SELECT user_id, event_id, event_type FROM @events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM @events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.ts > e.ts)")
def merge_pins(spark, sf):
    """What was added after the last removal of the same user."""
    events = _read(spark, sf, "events")
    last = events.filter("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("cut"))
    return events.filter("event_type <> 'error'").join(last, "user_id", "left").filter("cut IS NULL OR ts >= cut").select("user_id", "event_id", "event_type")


@query("""SELECT region, zone, trips, grouping_level FROM (SELECT r.r_name AS region, n.n_name AS zone, count(*) AS trips, grouping(r.r_name, n.n_name) AS grouping_level FROM @supplier s JOIN @nation n ON n.n_nationkey = s.s_nationkey JOIN @region r ON r.r_regionkey = n.n_regionkey GROUP BY ROLLUP (r.r_name, n.n_name)) q""")
def regional_rollup(spark, sf):
    n = _read(spark, sf, "supplier").join(_read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("zone")).agg(F.count("*").alias("trips"), F.grouping_id().alias("grouping_level"))


@query("SELECT id, quest, line FROM (SELECT c_custkey AS id, c_mktsegment AS quest, 'base' AS line FROM @customer UNION ALL SELECT s_suppkey AS id, 'SUPPLY' AS quest, 'overlay' AS line FROM @supplier) q WHERE coalesce(quest <> 'BUILDING', true)")
def visible_kinds(spark, sf):
    """Union of layers with one kind switched off; kinds without a switch are on."""
    base = _read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("quest"), F.lit("base").alias("line"))
    over = _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("SUPPLY").alias("quest"), F.lit("overlay").alias("line"))
    return base.unionByName(over).filter(F.coalesce(F.col("quest") != "BUILDING", F.lit(True)))


@query("""SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rank FROM @part GROUP BY p_brand, p_type) q WHERE rank = 1""")
def zone_mode(spark, sf):
    """The most frequent kind of each group."""
    counts = _read(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    best = counts.groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("m"), "p_type")).alias("b"))
    return best.select("p_brand", "b.p_type", (-F.col("b.m")).alias("n"))


@query("SELECT n_nationkey AS zone, low, high, high < low + 3 AS red FROM (SELECT n_nationkey, min(s_suppkey % 40) AS low, max(s_suppkey % 40) AS high FROM @nation JOIN @supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey) q")
def red_zones(spark, sf):
    level = F.col("s_suppkey") % 40
    z = _read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("zone")).agg(F.min(level).alias("low"), F.max(level).alias("high"))
    return z.join(_read(spark, sf, "nation"), F.col("zone") == F.col("n_nationkey"), "left_semi").withColumn("red", F.col("high") < F.col("low") + 3)


@query("SELECT user_id, bool_or(event_type = 'purchase') AND (bool_or(event_type = 'view') OR bool_or(event_type = 'signup')) AS guard_menu FROM @events GROUP BY user_id")
def guard_menus(spark, sf):
    on = lambda k: F.some(F.col("event_type") == k)
    return _read(spark, sf, "events").groupBy("user_id").agg((on("purchase") & (on("view") | on("signup"))).alias("guard_menu"))
