"""Places: lookups in runs, frames, floors and settings; spots around a place; lists read from text."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from waygrid.functions import geo, text
from waygrid.operators import lines, ordered, raster
from waygrid.operators.spatial import in_buckets, nearest_segments, nearest_within, point_buckets
from waygrid.plans.scratch import shared_dir, written
from waygrid.queries import query
from waygrid.sources.fixtures import fixture


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


RUNS = """SELECT r, min(c) AS first, max(c) AS last, v FROM (SELECT *, sum(s) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (
  SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY r ORDER BY c) THEN 0 ELSE 1 END AS s FROM $cells) q) p WHERE v > 0 GROUP BY r, g, v"""


@query(f"SELECT p.pid, coalesce(z.v, 0) AS v FROM (SELECT pid, CAST(floor(x / 250) AS BIGINT) AS r, CAST(floor(y / 200) AS BIGINT) AS c FROM $people) p LEFT JOIN ({RUNS}) z ON z.r = p.r AND p.c BETWEEN z.first AND z.last")
def zone_in_runs(spark, sf):
    """The value of the run that holds each place's cell; 0 where none does."""
    runs = ordered.runs(fixture(spark, sf, "cells"), ["r"], "c", "v").filter("v > 0")
    at = fixture(spark, sf, "people").select("pid", F.floor(F.col("x") / 250).alias("r"), F.floor(F.col("y") / 200).alias("c"))
    return ordered.in_runs(at, runs, ["r"], "c", "v").select("pid", F.coalesce("v", F.lit(0)).alias("v"))


@query("""SELECT s.id, CASE WHEN t.map_id IS NULL THEN NULL WHEN f.map_id = t.map_id THEN s.x ELSE round(t.maxx - (f.maxx - s.x) / (f.maxx - f.minx) * (t.maxx - t.minx), 4) END AS x,
 CASE WHEN t.map_id IS NULL THEN NULL WHEN f.map_id = t.map_id THEN s.y ELSE round(t.maxy - (f.maxy - s.y) / (f.maxy - f.miny) * (t.maxy - t.miny), 4) END AS y
FROM $sites s JOIN $zones f ON f.map_id = s.kind LEFT JOIN $zones t ON t.map_id = (s.kind * 7) % 30""")
def to_other_frame(spark, sf):
    """Places of one level as fractions of its frame, laid into the frame of another; null where that has none."""
    zones = fixture(spark, sf, "zones").drop("name")
    own, other = (zones.select([F.col(c).alias(f"{p}{c}") for c in zones.columns]) for p in ("f_", "t_"))
    both = fixture(spark, sf, "sites").join(own, F.col("kind") == F.col("f_map_id")).join(other, F.col("kind") * 7 % 30 == F.col("t_map_id"), "left")
    u, v = geo.world_to_map(F.col("x"), F.col("y"), "f_")
    x, y = geo.map_to_world(u, v, "t_")
    same = F.col("f_map_id") == F.col("t_map_id")
    return both.select("id", F.when(same, F.col("x")).otherwise(F.round(x, 4)).alias("x"), F.when(same, F.col("y")).otherwise(F.round(y, 4)).alias("y"))


@query("SELECT p.p_partkey AS level, coalesce(n.n_regionkey, p.p_partkey) AS base FROM @part p LEFT JOIN @nation n ON n.n_nationkey = p.p_partkey AND n.n_regionkey > 0")
def base_levels(spark, sf):
    """The level that a level is drawn on; itself if it has no base."""
    bases = _table(spark, sf, "nation").filter("n_regionkey > 0").select(F.col("n_nationkey").alias("level"), F.col("n_regionkey").alias("under"))
    levels = _table(spark, sf, "part").select(F.col("p_partkey").alias("level"))
    return levels.join(bases, "level", "left").select("level", F.coalesce("under", "level").alias("base"))


@query("""SELECT event_id, round(dy * cos(f) + dx * sin(f), 6) AS north, round(dy * sin(f) - dx * cos(f), 6) AS west FROM (SELECT event_id, ((event_id * 37) % 141 - 70) * 3.5 AS dx, ((event_id * 53) % 141 - 70) * 3.5 AS dy, (event_id % 63) / 10.0 AS f FROM @events) q""")
def minimap_offsets(spark, sf):
    """World offsets of points on a turned round map: right and up in units, 3.5 yards each."""
    dx, dy = ((F.col("event_id") * k % 141 - 70) * 3.5 for k in (37, 53))
    f = F.col("event_id") % 63 / 10.0
    return _table(spark, sf, "events").select("event_id", F.round(dy * F.cos(f) + dx * F.sin(f), 6).alias("north"), F.round(dy * F.sin(f) - dx * F.cos(f), 6).alias("west"))


OPEN = """SELECT s.id, s.x, s.y, k, d * 100 AS d, s.x + cos(k * pi() / 4) * d * 100 AS ox, s.y + sin(k * pi() / 4) * d * 100 AS oy FROM $sites s, (SELECT unnest(range(8)) AS k) a, (SELECT unnest(range(1, 13)) AS d) b"""


#: Sites that are worth a task, each with its 96 spots.
SITES = 5_000


def spot_at():
    """``ox, oy`` of the ``n``th spot at bearing ``k``; the bearing is multiplied first, as in the SQL, to the last bit."""
    a = F.col("k") * F.pi() / 4
    return {"ox": F.col("x") + F.cos(a) * F.col("n") * 100, "oy": F.col("y") + F.sin(a) * F.col("n") * 100}


def open_spots(sites):
    """Spots ``k, n, d, ox, oy`` around each site in eight bearings."""
    spots = sites.select("id", "x", "y", F.explode(F.expr("sequence(0, 7)")).alias("k")).withColumn("n", F.explode(F.expr("sequence(1, 12)"))).withColumn("d", F.col("n") * 100)
    return spots.withColumns(spot_at())


@query(f"""WITH o AS (SELECT p.*, row_number() OVER (PARTITION BY id, k ORDER BY d) AS n FROM ({OPEN}) p JOIN $cells g ON g.r = CAST(floor(p.ox / 250) AS BIGINT) AND g.c = CAST(floor(p.oy / 250) AS BIGINT) AND g.v < 2),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS place FROM o WHERE n = 1), a AS (SELECT * FROM f WHERE place = 1),
b AS (SELECT f.*, row_number() OVER (PARTITION BY f.id ORDER BY f.place) AS m FROM f JOIN a ON a.id = f.id AND f.place > 1 AND sqrt((f.ox - a.ox) * (f.ox - a.ox) + (f.oy - a.oy) * (f.oy - a.oy)) >= 400)
SELECT id, k, d FROM a UNION ALL SELECT id, k, d FROM b WHERE m = 1""")
def open_around(spark, sf):
    """The nearest open spot in each of eight bearings; of these the nearest and the next one far enough from it."""
    sites = fixture(spark, sf, "sites").select("id", "x", "y")
    cell = lambda v: F.floor(F.col(v) / 250)
    spots = open_spots(sites.repartition(sites.count() // SITES + 1)).withColumns({"r": cell("ox"), "c": cell("oy")})
    # Cells farther than any spot are left out first, so that few cells needn't have all spots sent to them.
    seen = sites.agg(*(f(cell(v)).alias(f"{n}{v}") for v in "xy" for n, f in (("low", F.min), ("high", F.max)))).first()
    free = fixture(spark, sf, "cells").filter("v < 2").select("r", "c")
    if seen["lowx"] is not None and seen["lowy"] is not None:
        free = free.filter(F.col("r").between(seen["lowx"] - 6, seen["highx"] + 6) & F.col("c").between(seen["lowy"] - 6, seen["highy"] + 6))
    free = spots.join(written(free, "cells"), ["r", "c"])
    # The nearest spot is told by its number alone and its place worked out again: a least row would have all spots sorted.
    nearest = free.groupBy("id", "x", "y", "k").agg(F.min("n").alias("n"))
    found = nearest.select("id", F.struct((F.col("n") * 100).alias("d"), "k", *(c.alias(n) for n, c in spot_at().items())).alias("s"))
    found = found.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("s"))  # eight at most
    far = F.filter("s", lambda p: geo.distance(p["ox"], p["oy"], F.col("s")[0]["ox"], F.col("s")[0]["oy"]) >= 400)
    return found.select("id", F.explode(F.concat(F.slice("s", 1, 1), F.slice(far, 1, 1))).alias("p")).select("id", F.col("p.k").cast("bigint").alias("k"), F.col("p.d").cast("bigint").alias("d"))


@query("""SELECT w.wid, k, round(x1 + (x2 - x1) * least(1.0, k * 50 / l), 4) AS x, round(y1 + (y2 - y1) * least(1.0, k * 50 / l), 4) AS y FROM (SELECT *, unnest(generate_series(0, CAST(ceil(l / 50) AS BIGINT))) AS k FROM (
 SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS l FROM $walls) q) w""")
def along_points(spark, sf):
    """Points every 50 yards along each road, and its end."""
    c = [F.col(n) for n in ("x1", "y1", "x2", "y2")]
    rows = fixture(spark, sf, "walls").withColumn("l", geo.distance(*c)).withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("l") / 50).cast("int"))))
    t = F.least(F.lit(1.0), F.col("k") * 50 / F.col("l"))
    return rows.select("wid", F.col("k").cast("bigint").alias("k"), F.round(c[0] + (c[2] - c[0]) * t, 4).alias("x"), F.round(c[1] + (c[3] - c[1]) * t, 4).alias("y"))


@query("""SELECT id, bool_or(coalesce(v, 0) = 1) AS hilly FROM (SELECT s.id, g.v FROM (SELECT *, unnest(generate_series(0, n)) AS k FROM (SELECT *, CAST(greatest(1, ceil(sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) / 100)) AS BIGINT) AS n FROM $segments) q) s
 LEFT JOIN $cells g ON g.r = CAST(floor((x1 + (x2 - x1) * (k / n)) / 250) AS BIGINT) AND g.c = CAST(floor((y1 + (y2 - y1) * (k / n)) / 250) AS BIGINT)) p GROUP BY id""")
def hilly_along(spark, sf):
    """Whether any sample of a way lies on a hill."""
    samples = raster.end_samples(fixture(spark, sf, "segments"), 100).select("id", F.floor(F.col("sx") / 250).alias("r"), F.floor(F.col("sy") / 250).alias("c"))
    met = samples.join(fixture(spark, sf, "cells").select("r", "c", "v"), ["r", "c"], "left")
    return met.groupBy("id").agg(F.bool_or(F.coalesce("v", F.lit(0)) == 1).alias("hilly"))


@query("""SELECT id, r, c FROM (SELECT s.id, g.r, g.c, row_number() OVER (PARTITION BY s.id ORDER BY sqrt((s.x - (g.r * 250 + 125)) * (s.x - (g.r * 250 + 125)) + (s.y - (g.c * 250 + 125)) * (s.y - (g.c * 250 + 125))), g.r, g.c) AS n FROM $sites s JOIN $cells g
 ON g.v = 0 AND sqrt((s.x - (g.r * 250 + 125)) * (s.x - (g.r * 250 + 125)) + (s.y - (g.c * 250 + 125)) * (s.y - (g.c * 250 + 125))) <= 600) q WHERE n = 1""")
def snapped_places(spark, sf):
    """Each place moved to the nearest cell that can be walked on, within reach."""
    cells = fixture(spark, sf, "cells").filter("v = 0").select(F.struct("r", "c").alias("cell"), (F.col("r") * 250.0 + 125).alias("tx"), (F.col("c") * 250.0 + 125).alias("ty"))
    return nearest_within(fixture(spark, sf, "sites"), cells, 600, "id", "cell", k=1).select("id", "cell.r", "cell.c")


@query("""SELECT p.pid FROM $people p WHERE NOT EXISTS (SELECT 1 FROM $sites s WHERE s.kind = p.kind AND (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) <= 250000)""")
def new_entrances(spark, sf):
    """Entrances with no known one of their level within 500 yards."""
    people = fixture(spark, sf, "people")
    known = fixture(spark, sf, "sites").select(F.col("id").alias("known"), "kind", F.col("x").alias("tx"), F.col("y").alias("ty"))
    return people.join(nearest_within(people, known, 500, "pid", "known", k=1, same=("kind",)).select("pid"), "pid", "left_anti").select("pid")


@query("""WITH RECURSIVE o AS (SELECT p.kind, p.pid, p.x, p.y, row_number() OVER (PARTITION BY p.kind ORDER BY p.pid) AS n FROM $people p WHERE NOT EXISTS (SELECT 1 FROM $sites s WHERE s.kind = p.kind AND (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) <= 250000)),
run AS (SELECT kind, CAST(1 AS BIGINT) AS n, [{'pid': pid, 'x': x, 'y': y}] AS kept FROM o WHERE n = 1 UNION ALL
 SELECT o.kind, o.n, CASE WHEN len(list_filter(r.kept, lambda k: (k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y) <= 250000)) = 0 THEN list_append(r.kept, {'pid': o.pid, 'x': o.x, 'y': o.y}) ELSE r.kept END AS kept FROM run r JOIN o ON o.kind = r.kind AND o.n = r.n + 1)
SELECT kind, k.pid AS pid FROM (SELECT kind, unnest(kept) AS k FROM (SELECT kind, kept, row_number() OVER (PARTITION BY kind ORDER BY n DESC) AS m FROM run) q WHERE m = 1) p""")
def merged_entrances(spark, sf):
    """Found entrances that are new: none known near, and none of an earlier find near."""
    fresh = fixture(spark, sf, "people").join(new_entrances(spark, sf), "pid", "left_semi").select("kind", "pid", "x", "y")
    return lines.merged_near(fresh, ["kind"], "pid", 500).select("kind", F.col("kept").alias("pid"))


@query("""SELECT pid, id FROM (SELECT p.pid, s.id, row_number() OVER (PARTITION BY p.pid ORDER BY sqrt((s.x - p.x - 100) * (s.x - p.x - 100) + (s.y - p.y - 50) * (s.y - p.y - 50)), s.id) AS n FROM $people p JOIN $sites s
 ON sqrt((s.x - p.x - 100) * (s.x - p.x - 100) + (s.y - p.y - 50) * (s.y - p.y - 50)) <= 450 AND (s.x - p.x) * 100 + (s.y - p.y) * 50 > 0) q WHERE n = 1""")
def places_toward(spark, sf):
    """The named place nearest to a point ahead of each traveller, among those that lie ahead."""
    people = fixture(spark, sf, "people").select("pid", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("x") + 100).alias("x"), (F.col("y") + 50).alias("y"))
    places = fixture(spark, sf, "sites").select("id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    ahead = (F.col("tx") - F.col("px")) * 100 + (F.col("ty") - F.col("py")) * 50 > 0
    return nearest_within(people, places, 450, "pid", "id", k=1, allowed=ahead).select("pid", "id")


@query("""SELECT pid, wid FROM (SELECT *, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM $people p, $walls w WHERE x >= x1 - 200 AND x <= x2 + 200 AND y >= least(y1, y2) - 200 AND y <= greatest(y1, y2) + 200
 AND abs((x2 - x1) * 3 + (y2 - y1) * 1) >= 0.866 * sqrt(10.0) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) q WHERE sqrt((x - x1 - t * (x2 - x1)) * (x - x1 - t * (x2 - x1)) + (y - y1 - t * (y2 - y1)) * (y - y1 - t * (y2 - y1))) <= 150""")
def under_lines(spark, sf):
    """Roads that come close to each traveller's place and run about along the way (3, 1) taken there."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = F.abs(dx * 3 + dy) >= 0.866 * F.sqrt(F.lit(10.0)) * F.sqrt(dx * dx + dy * dy)
    return nearest_segments(fixture(spark, sf, "people"), fixture(spark, sf, "walls").filter(along), "pid", "wid", 150, k=2**31 - 1).select("pid", "wid")


@query("""SELECT o.id, o.dock FROM (SELECT s.id, f.dst AS dock, d.x, d.y FROM $sites s JOIN $flights f ON f.src = s.kind JOIN $docks d ON d.id = f.dst) o WHERE NOT EXISTS (
 SELECT 1 FROM $circles g, (SELECT unnest(range(16)) AS k) a, (SELECT unnest([25, 50, 75, 100]) AS q) b WHERE g.side <> o.dock AND (o.x + q * cos(k * pi() / 8) - g.x) * (o.x + q * cos(k * pi() / 8) - g.x) + (o.y + q * sin(k * pi() / 8) - g.y) * (o.y + q * sin(k * pi() / 8) - g.y) <= g.r * g.r / 25)""")
def rides_allowed(spark, sf):
    """Rides to docks with no guard circle near, told by samples in sixteen bearings at four distances."""
    docks = fixture(spark, sf, "docks").toDF("dock", "dx", "dy")
    spots = docks.withColumn("k", F.explode(F.expr("sequence(0, 15)"))).withColumn("q", F.explode(F.array(*map(F.lit, (25, 50, 75, 100)))))
    spots = spots.select("dock", (F.col("dx") + F.col("q") * F.cos(F.col("k") * F.pi() / 8)).alias("sx"), (F.col("dy") + F.col("q") * F.sin(F.col("k") * F.pi() / 8)).alias("sy"))
    guards = in_buckets(fixture(spark, sf, "circles"), F.col("x") - F.col("r"), F.col("x") + F.col("r"), F.col("y") - F.col("r"), F.col("y") + F.col("r"), 100)
    inside = (F.col("sx") - F.col("x")) * (F.col("sx") - F.col("x")) + (F.col("sy") - F.col("y")) * (F.col("sy") - F.col("y")) <= F.col("r") * F.col("r") / 25
    watched = point_buckets(spots, 100, "sx", "sy").join(guards, ["bx", "by"]).filter((F.col("side") != F.col("dock")) & inside).select("dock").distinct()
    rides = fixture(spark, sf, "sites").join(fixture(spark, sf, "flights"), F.col("kind") == F.col("src")).select("id", F.col("dst").alias("dock"))
    rides = rides.join(docks, "dock", "left_semi")
    return rides.join(watched, "dock", "left_anti").select("id", "dock")


@query("""SELECT r, min(c) AS first, max(c) AS last, height FROM (SELECT *, sum(s) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (
 SELECT *, CASE WHEN height = lag(height) OVER (PARTITION BY r ORDER BY c) THEN 0 ELSE 1 END AS s FROM (SELECT r, c, CAST(floor(h / 8) AS BIGINT) AS height FROM $cells) z) q) p GROUP BY r, g, height""")
def height_runs(spark, sf):
    """Heights in steps of eight, as runs."""
    return ordered.runs(fixture(spark, sf, "cells").select("r", "c", F.floor(F.col("h") / 8).alias("height")), ["r"], "c", "height")


@query("SELECT p_partkey, contains(lower(p_name), 'blue') AND contains(lower(p_name), 'ring') OR regexp_matches(lower(p_name), '(small|large) (bolt|gear)') AS service FROM @part")
def services(spark, sf):
    """Titles that hold all words of a service, or that match its rank rule."""
    title = F.lower("p_name")
    words = F.forall(F.array(F.lit("blue"), F.lit("ring")), lambda w: F.contains(title, w))
    return _table(spark, sf, "part").select("p_partkey", (words | title.rlike("(small|large) (bolt|gear)")).alias("service"))


@query("""SELECT s_suppkey, CASE WHEN (s_nationkey & 1) <> 0 AND (s_nationkey & 2) = 0 THEN 'red' WHEN (s_nationkey & 2) <> 0 AND (s_nationkey & 1) = 0 THEN 'blue' END AS side FROM @supplier WHERE (s_suppkey & 4) <> 0 OR regexp_matches(s_name, '7$')""")
def guard_sides(spark, sf):
    """Guards by a flag bit or by name; exactly one of two enemy bits decides their side."""
    bit = lambda c, n: F.col(c).bitwiseAND(F.lit(n)) != 0
    red, blue = bit("s_nationkey", 1), bit("s_nationkey", 2)
    guards = _table(spark, sf, "supplier").filter(bit("s_suppkey", 4) | F.col("s_name").rlike("7$"))
    return guards.select("s_suppkey", F.when(red & ~blue, "red").when(blue & ~red, "blue").alias("side"))


@query("SELECT cid, x, y FROM $circles WHERE side IN (1, 4, 9) AND x BETWEEN 2000 AND 8000 AND y BETWEEN 1000 AND 9000 ORDER BY cid LIMIT 150")
def layout_pois(spark, sf):
    """The first 150 points of the kinds switched on, inside the view."""
    shown = F.col("side").isin(1, 4, 9) & F.col("x").between(2000, 8000) & F.col("y").between(1000, 9000)
    return fixture(spark, sf, "circles").filter(shown).orderBy("cid").limit(150).select("cid", "x", "y")


@query("SELECT p.p_partkey AS id, 'world/' || lower(p.p_name) || '/' || CAST(p.p_partkey AS VARCHAR) || '.bin' AS path, l.n AS uses FROM @part p JOIN (SELECT l_partkey, count(*) AS n FROM @lineitem GROUP BY l_partkey) l ON l.l_partkey = p.p_partkey")
def file_list(spark, sf):
    """Ids met with their lower-case paths, from lines ``id;path``."""
    rows = _table(spark, sf, "part").select(F.format_string("%d;World/%s/%d.BIN", "p_partkey", "p_name", "p_partkey").alias("line"))
    listed = rows.select(F.split("line", ";", 2).alias("f")).select(F.col("f")[0].cast("bigint").alias("id"), F.lower(F.col("f")[1]).alias("path"))
    used = _table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("uses"))
    return listed.join(used, "id").select("id", "path", "uses")


@query("SELECT o_orderkey AS id, o_orderpriority || ', it''s (' || CAST(o_custkey AS VARCHAR) || ')' AS name, CAST(o_totalprice AS DOUBLE) AS price, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS owner FROM @orders")
def dump_tuples(spark, sf):
    """Rows of an INSERT statement, with quoted, escaped and null fields, taken apart by one pattern."""
    owner = F.when(F.col("o_orderkey") % 7 == 0, "NULL").otherwise(F.col("o_custkey").cast("string"))
    name = F.concat("o_orderpriority", F.lit(", it\\'s ("), F.col("o_custkey").cast("string"), F.lit(")"))
    row = F.concat(F.lit("("), F.concat_ws(",", F.col("o_orderkey").cast("string"), F.concat(F.lit("'"), name, F.lit("'")), F.col("o_totalprice").cast("string"), owner), F.lit(")"))
    dump = _table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).alias("page")).agg(F.concat(F.lit("INSERT INTO t VALUES "), F.array_join(F.collect_list(row), ","), F.lit(";")).alias("line"))
    value = r"('(?:\\.|[^'\\])*'|[^,()']+)"
    tuples = dump.select(F.explode(F.regexp_extract_all("line", F.lit(rf"\(({value},{value},{value},{value})\)"), F.lit(1))).alias("t"))
    at = lambda i: F.regexp_extract("t", ",".join([value] * 4), i)
    plain = lambda i: F.nullif(at(i), F.lit("NULL"))
    unquoted = F.regexp_replace(F.regexp_replace(at(2), "^'|'$", ""), r"\\(.)", "$1")
    return tuples.select(plain(1).cast("bigint").alias("id"), unquoted.alias("name"), plain(3).cast("double").alias("price"), plain(4).cast("bigint").alias("owner"))


RULES = "road:\n  include:\n    - ring\n    - 'bolt'\n  # not these\n  exclude:\n    - small\nwater:\n  include:\n    - blue\n"


@query("""SELECT p_partkey, kind FROM @part, (VALUES ('road'), ('water')) AS k(kind) WHERE CASE WHEN kind = 'road' THEN (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt')) AND NOT contains(lower(p_name), 'small') ELSE contains(lower(p_name), 'blue') END""")
def keyword_rules(spark, sf):
    """Names by rules read from indented lists of keywords (two levels of keys, then dashes)."""
    lines_ = spark.createDataFrame([(i, x) for i, x in enumerate(RULES.split("\n"))], "n int, line string").filter(~F.col("line").rlike(r"^\s*(#.*)?$"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a rules file is a few lines
    key = lambda pattern: F.last(F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")), ignorenulls=True).over(w)
    rules = lines_.select("line", key(r"^(\w+):").alias("kind"), key(r"^  (\w+):").alias("part")).withColumn("word", F.regexp_extract("line", r"^\s+- *'?([^']*)'?$", 1)).filter("word <> ''")
    hit = _table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("name")).join(F.broadcast(rules), F.contains("name", "word"))
    found = hit.groupBy("p_partkey", "kind").agg(F.bool_or(F.col("part") == "include").alias("i"), F.bool_or(F.col("part") == "exclude").alias("e"))
    return found.filter("i AND NOT e").select("p_partkey", "kind")


@query("""SELECT c_custkey, key, CASE WHEN key = 'hz' AND c_custkey % 3 = 0 THEN CAST(c_nationkey AS VARCHAR) WHEN key = 'size' AND c_custkey % 2 = 0 THEN 'big' ELSE d END AS value FROM @customer, (VALUES ('hz', '15'), ('size', 'small'), ('beacon', 'true')) AS k(key, d)""")
def settings_with_defaults(spark, sf):
    """Stored settings over defaults: what a user has set stays, what is missing is filled in."""
    pairs = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v)))
    defaults = pairs(hz=F.lit("15"), size=F.lit("small"), beacon=F.lit("true"))
    own = F.map_concat(
        F.when(F.col("c_custkey") % 3 == 0, pairs(hz=F.col("c_nationkey").cast("string"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))),
        F.when(F.col("c_custkey") % 2 == 0, pairs(size=F.lit("big"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))),
    )
    merged = F.map_concat(own, F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k)))
    return _table(spark, sf, "customer").select("c_custkey", F.explode(merged).alias("key", "value"))


@query("""SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN 'home' WHEN event_type = 'click' AND value > 20 THEN 'stone' WHEN event_type = 'purchase' THEN 'spell' END AS teleport FROM @events
WHERE (event_type = 'view' OR (event_type = 'click' AND value > 20) OR event_type = 'purchase') AND (event_id * 13) % 40 / 10.0 <= 1.5 AND event_id % 5 > 0""")
def teleports_available(spark, sf):
    """Teleports by priority that are known, not cooling down for more than a moment, and of which an item is left."""
    kind = F.when(F.col("event_type") == "view", "home").when((F.col("event_type") == "click") & (F.col("value") > 20), "stone").when(F.col("event_type") == "purchase", "spell")
    cooldown, items = F.col("event_id") * 13 % 40 / 10.0, F.col("event_id") % 5
    return _table(spark, sf, "events").select("event_id", "user_id", kind.alias("teleport")).filter(F.col("teleport").isNotNull() & (cooldown <= 1.5) & (items > 0))


@query("SELECT l_orderkey AS path, max(l_linenumber * 30 + l_partkey % 30) + 10 AS period, count(*) AS stops FROM @lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def transport_periods(spark, sf):
    """The period of each path: its last stop's time and the wait there."""
    at = F.col("l_linenumber") * 30 + F.col("l_partkey") % 30
    return _table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg((F.max(at) + 10).alias("period"), F.count("*").alias("stops")).filter("stops > 1")


@query("SELECT n.n_nationkey AS map_id, min(s.s_suppkey) AS assignment, count(*) AS candidates FROM @nation n LEFT JOIN @supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 0 GROUP BY n.n_nationkey HAVING count(s.s_suppkey) = 1 OR count(s.s_suppkey) > 1")
def zone_assignments(spark, sf):
    """The assignment row of each map: the first of those that match; maps without one are left out."""
    rows = _table(spark, sf, "supplier").filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("map_id")).agg(F.min("s_suppkey").alias("assignment"), F.count("*").alias("candidates"))
    return _table(spark, sf, "nation").select(F.col("n_nationkey").alias("map_id")).join(rows, "map_id")


@query("SELECT n.n_nationkey AS map_id, n.n_name AS name, r.r_name AS parent, a.first_site FROM @nation n LEFT JOIN @region r ON r.r_regionkey = n.n_regionkey AND r.r_regionkey <> 0 LEFT JOIN (SELECT kind, min(id) AS first_site FROM $sites GROUP BY kind) a ON a.kind = n.n_nationkey")
def ui_maps(spark, sf):
    """All maps with their parents and full-map assignments where they have them."""
    maps, regions = _table(spark, sf, "nation"), _table(spark, sf, "region").filter("r_regionkey <> 0")
    first = fixture(spark, sf, "sites").groupBy("kind").agg(F.min("id").alias("first_site"))
    met = maps.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(first, F.col("n_nationkey") == F.col("kind"), "left")
    return met.select(F.col("n_nationkey").alias("map_id"), F.col("n_name").alias("name"), F.col("r_name").alias("parent"), "first_site")


@query(f"SELECT r, c, round((32 - (c + 0.5) / 16) * {1600 / 3}, 4) AS y, round((32 - (r + 0.5) / 16) * {1600 / 3}, 4) AS x FROM $cells")
def chunk_centers(spark, sf):
    """World positions of the centres of terrain chunks, sixteen to a tile's side."""
    at = lambda i: F.round((32 - (F.col(i) + 0.5) / 16) * geo.TILE, 4)
    return fixture(spark, sf, "cells").select("r", "c", at("r").alias("x"), at("c").alias("y"))


@query("SELECT r * 16 + i AS row, c * 16 + j AS col, v * 10 + (i * 16 + j) % 3 AS area FROM $cells, (SELECT unnest(range(16)) AS i) a, (SELECT unnest(range(16)) AS j) b WHERE r < 3 AND v < 2 AND v * 10 + (i * 16 + j) % 3 > 0")
def area_grid(spark, sf):
    """The ids of all chunks of tiles in one grid; chunks without an area are left out."""
    chunks = fixture(spark, sf, "cells").filter("r < 3 AND v < 2").withColumn("k", F.explode(F.expr("sequence(0L, 255L)")))
    i, j = F.floor(F.col("k") / 16), F.col("k") % 16
    return chunks.select((F.col("r") * 16 + i).alias("row"), (F.col("c") * 16 + j).alias("col"), (F.col("v") * 10 + F.col("k") % 3).alias("area")).filter("area > 0")


@query("SELECT s_suppkey AS node, CASE (s_suppkey & 3) WHEN 1 THEN 'A' WHEN 2 THEN 'H' ELSE 'B' END AS faction, s_name AS name FROM @supplier WHERE (s_suppkey & 3) <> 0")
def taxi_pois(spark, sf):
    """Flight masters with the factions that may use them, by two bits."""
    bits = F.col("s_suppkey").bitwiseAND(F.lit(3))
    faction = F.when(bits == 1, "A").when(bits == 2, "H").otherwise("B")
    return _table(spark, sf, "supplier").filter(bits != 0).select(F.col("s_suppkey").alias("node"), faction.alias("faction"), F.col("s_name").alias("name"))


@query("""SELECT l.l_orderkey AS wing, row_number() OVER (PARTITION BY l.l_orderkey ORDER BY coalesce(n.place, 1000), l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS seq, l.l_partkey AS boss FROM @lineitem l LEFT JOIN (SELECT p_partkey, p_size AS place FROM @part WHERE p_size % 3 <> 0) n ON n.p_partkey = l.l_partkey WHERE l.l_returnflag <> 'R'""")
def boss_order(spark, sf):
    """The bosses of a wing that aren't optional, in the stated order, those without one after."""
    places = _table(spark, sf, "part").filter("p_size % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("place"))
    bosses = _table(spark, sf, "lineitem").filter("l_returnflag <> 'R'").join(places, "l_partkey", "left")
    w = Window.partitionBy("l_orderkey").orderBy(F.coalesce("place", F.lit(1000)), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return bosses.select(F.col("l_orderkey").alias("wing"), F.row_number().over(w).cast("bigint").alias("seq"), F.col("l_partkey").alias("boss"))


@query("""SELECT c_custkey, CASE WHEN a IS NOT NULL THEN a ELSE f END AS ability FROM (SELECT c_custkey, max(CASE WHEN k = c_custkey % 5 AND c_custkey % 2 = 0 THEN k END) AS a, arg_max(k, (k * 7 + c_custkey) % 11 * 10 - k) AS f FROM @customer, (SELECT unnest(range(4)) AS k) q GROUP BY c_custkey) p""")
def move_abilities(spark, sf):
    """The way of moving that is in use, else the fastest one known."""
    ways = _table(spark, sf, "customer").select("c_custkey", F.explode(F.expr("sequence(0L, 3L)")).alias("k"))
    active = F.max(F.when((F.col("k") == F.col("c_custkey") % 5) & (F.col("c_custkey") % 2 == 0), F.col("k")))
    fastest = F.max_by("k", (F.col("k") * 7 + F.col("c_custkey")) % 11 * 10 - F.col("k"))
    return ways.groupBy("c_custkey").agg(F.coalesce(active, fastest).alias("ability"))


@query("""SELECT pid, box FROM (SELECT p.pid, b.box, row_number() OVER (PARTITION BY p.pid ORDER BY b.box) AS n FROM $people p JOIN $boxes b ON p.x BETWEEN b.minx AND b.maxx AND p.y BETWEEN b.miny AND b.maxy AND (b.box % 4 = 0 OR abs((p.pid % 40) - (b.box % 40)) <= 8)) q WHERE n = 1""")
def floors_at(spark, sf):
    """The first level, in list order, that holds a place and its height; a level without heights holds any."""
    boxes = in_buckets(fixture(spark, sf, "boxes"), F.col("minx"), F.col("maxx"), F.col("miny"), F.col("maxy"), 200)
    near = point_buckets(fixture(spark, sf, "people"), 200).join(boxes, ["bx", "by"])
    holds = F.col("x").between(F.col("minx"), F.col("maxx")) & F.col("y").between(F.col("miny"), F.col("maxy"))
    floor = (F.col("box") % 4 == 0) | (F.abs(F.col("pid") % 40 - F.col("box") % 40) <= 8)
    return near.filter(holds & floor).groupBy("pid").agg(F.min("box").alias("box"))


@query("SELECT wid, x1, y1, x2, y2, CAST(wid % 3 AS INTEGER) AS level FROM $walls")
def roads_by_level(spark, sf):
    """Roads stored in one folder a level, and read again."""
    path = f"{shared_dir(spark)}/waygrid/roads-{uuid.uuid4().hex}"
    fixture(spark, sf, "walls").withColumn("level", (F.col("wid") % 3).cast("int")).repartition("level").write.partitionBy("level").parquet(path)
    return spark.read.schema("wid bigint, x1 double, y1 double, x2 double, y2 double, level int").parquet(path)


@query("SELECT a, b, w FROM $arcs WHERE a <> b")
def graph_json(spark, sf):
    """Networks as JSON documents of sixteen nodes each, and their edges read again."""
    edges = fixture(spark, sf, "arcs").filter("a <> b").withColumn("part", F.floor(F.col("a") / 16))
    doc = F.to_json(F.struct(F.collect_list(F.struct("a", "b", F.col("w").alias("length"))).alias("edges")))
    back = edges.groupBy("part").agg(doc.alias("json")).select(F.explode(F.from_json("json", "edges array<struct<a:bigint,b:bigint,length:double>>")["edges"]).alias("e"))
    return back.select("e.a", "e.b", F.col("e.length").alias("w"))


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'R add ' || CAST(c_nationkey AS VARCHAR) || ' ' || CAST(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 1 THEN 'P ' || c_mktsegment ELSE 'T ' || CAST(c_nationkey AS VARCHAR) || ' ' || CAST(c_custkey % 7 AS VARCHAR) || ',' || CAST(c_custkey % 11 AS VARCHAR) || ' 0,1' END AS line FROM @customer WHERE c_nationkey <> 3")
def exported_lines(spark, sf):
    """Roads, pins and trips as typed lines, kinds that are switched off left out."""
    rows = _table(spark, sf, "customer").filter("c_nationkey <> 3")
    k = F.col("c_custkey")
    road = F.concat_ws(" ", F.lit("R add"), F.col("c_nationkey").cast("string"), k.cast("string"))
    trip = F.concat_ws(" ", F.lit("T"), F.col("c_nationkey").cast("string"), F.array_join(F.transform(F.array(F.struct((k % 7).alias("x"), (k % 11).alias("y")), F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(1).cast("bigint").alias("y"))), lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " "))
    parts = [rows.filter(k % 3 == 0).select(road.alias("line")), rows.filter(k % 3 == 1).select(F.concat_ws(" ", F.lit("P"), "c_mktsegment").alias("line")), rows.filter(k % 3 == 2).select(trip.alias("line"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
