"""Text import and export, keywords, encodings, JSON."""

from pyspark.sql import functions as F

from waygrid.functions import text
from waygrid.operators import ordered
from waygrid.queries import query
from waygrid.sources.fixtures import fixture
from waygrid.sources.literals import parsed_literal

WAY = r"^\s*/way\s+#(\d+)\s+(-?\d+(?:\.\d+)?)[,\s]+(-?\d+(?:\.\d+)?)\s+(.*?)\s*$"


@query(f"SELECT id, CAST(regexp_extract(line, '{WAY}', 1) AS INTEGER) AS map_id, CAST(regexp_extract(line, '{WAY}', 2) AS DOUBLE) AS x, CAST(regexp_extract(line, '{WAY}', 3) AS DOUBLE) AS y, regexp_extract(line, '{WAY}', 4) AS text FROM $way_lines")
def parse_way_lines(spark, sf):
    got = fixture(spark, sf, "way_lines").withColumn("w", text.way_line(F.col("line")))
    return got.select("id", "w.map_id", "w.x", "w.y", "w.text")


@query("SELECT id, printf('/way #%d %.2f %.2f %s', kind, x / 100, y / 100, name) AS line FROM $sites")
def export_way_lines(spark, sf):
    sites = fixture(spark, sf, "sites")
    return sites.select("id", text.way_text(F.col("kind"), F.col("x") / 100, F.col("y") / 100, F.col("name")).alias("line"))


@query("SELECT id, line = '/way #' || CAST(map_id AS VARCHAR) || ' ' || CAST(x AS VARCHAR) || ' ' || CAST(y AS VARCHAR) || ' ' || name AS same FROM (SELECT w.id, w.line, s.kind AS map_id, (s.id * 37) % 100 + 0.5 AS x, (s.id * 53) % 100 + 0.25 AS y, s.name FROM $way_lines w JOIN $sites s ON s.id = w.id) q")
def way_round_trip(spark, sf):
    got = fixture(spark, sf, "way_lines").withColumn("w", text.way_line(F.col("line")))
    back = F.concat(F.lit("/way #"), "w.map_id", F.lit(" "), F.col("w.x").cast("string"), F.lit(" "), F.col("w.y").cast("string"), F.lit(" "), "w.text")
    return got.select("id", (F.col("line") == back).alias("same"))


KINDS = [("ring", "jeweller"), ("widget", "engineer"), ("gear", "engineer"), ("bolt", "smith")]


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'jeweller' WHEN contains(lower(p_name), 'widget') THEN 'engineer' WHEN contains(lower(p_name), 'gear') THEN 'engineer' WHEN contains(lower(p_name), 'bolt') THEN 'smith' ELSE 'other' END AS kind FROM @part")
def node_kinds(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", text.first_keyword(F.col("p_name"), KINDS, "other").alias("kind"))


@query("""SELECT p_partkey, CASE WHEN lower(p_name) IN ('small ring') THEN false WHEN lower(p_name) IN ('red widget') THEN true WHEN contains(lower(p_name), 'small') OR contains(lower(p_name), 'blue') THEN false
ELSE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt') END AS road FROM @part""")
def road_textures(spark, sf):
    road = text.is_included(F.col("p_name"), ["small ring"], ["red widget"], ["small", "blue"], ["ring", "bolt"])
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", road.alias("road"))


@query("SELECT event_id, CASE WHEN y < 1000 THEN printf('%d yd', CAST(floor(y + 0.5) AS BIGINT)) ELSE printf('%d.%d k', CAST(floor(y / 1000) AS BIGINT), CAST(floor(y % 1000 / 100) AS BIGINT)) END AS text FROM (SELECT event_id, value * 37 AS y FROM @events) q")
def distance_texts(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", text.distance_text(F.col("value") * 37).alias("text"))


@query("""SELECT event_id, CASE WHEN abs(t) < 20 THEN 'straight on' WHEN abs(t) < 60 THEN 'bear ' || s WHEN abs(t) < 120 THEN 'turn ' || s WHEN abs(t) < 160 THEN 'sharp ' || s ELSE 'turn around' END AS text
FROM (SELECT event_id, t, CASE WHEN t > 0 THEN 'left' ELSE 'right' END AS s FROM (SELECT event_id, (event_id * 37) % 361 - 180 AS t FROM @events) q) p""")
def turn_texts(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", text.turn_text(F.col("event_id") * 37 % 361 - 180).alias("text"))


@query("SELECT p_partkey, p_partkey * 13 % 4096 AS number, 2 AS digits, sha1(p_name) AS stamp FROM @part")
def packed_numbers(spark, sf):
    """Numbers packed into two digits and read again, with the stamp of what they came from."""
    packed = text.packed_pair(F.col("p_partkey") * 13 % 4096)
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", text.unpacked_pair(packed).cast("bigint").alias("number"), F.length(packed).alias("digits"), F.sha1("p_name").alias("stamp"))


@query("SELECT event_id, CAST(json_extract(props, '/k') AS BIGINT) AS k, CAST(json_extract(props, '/k') AS BIGINT) % 2 = 0 AS even FROM @events")
def json_properties(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", k.alias("k"), (k % 2 == 0).alias("even"))


@query("SELECT id, CAST(x1 AS BIGINT) AS x1, CAST(y2 AS BIGINT) AS y2, 2 AS points FROM $segments")
def geojson_lines(spark, sf):
    """Lines written as GeoJSON features and read back."""
    point = lambda x, y: F.array(F.col(x).cast("bigint"), F.col(y).cast("bigint"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.array(point("x1", "y1"), point("x2", "y2")).alias("coordinates")).alias("geometry"), F.struct("id").alias("properties"))
    written = fixture(spark, sf, "segments").select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("json"))
    schema = "features array<struct<geometry:struct<coordinates:array<array<bigint>>>,properties:struct<id:bigint>>>"
    got = written.select(F.explode(F.from_json("json", schema)["features"]).alias("f"))
    at = F.col("f.geometry.coordinates")
    return got.select("f.properties.id", at[0][0].alias("x1"), at[1][1].alias("y2"), F.size(at).alias("points"))


@query("SELECT event_id, user_id, event_type AS kind, value, CAST(json_extract(props, '/k') AS BIGINT) AS second FROM @events")
def saved_variables(spark, sf):
    """Events written as table literals and read by the parser of saved variables."""
    literal = F.format_string('{["user"] = %d, kind = "%s", value = %s, {10, %s}, ["nothing"] = nil, -- note\n}', "user_id", "event_type", F.col("value").cast("string"), F.from_json("props", "k bigint")["k"].cast("string"))
    got = spark.read.parquet(f"{sf}/events.parquet").select("event_id", parsed_literal(literal).alias("v"))
    take = lambda path, kind: F.variant_get("v", path, kind)
    return got.select("event_id", take("$.user", "bigint").alias("user_id"), take("$.kind", "string").alias("kind"), take("$.value", "double").alias("value"), take("$['1'][1]", "bigint").alias("second"))


@query("SELECT r, c, v FROM $cells")
def decode_rows(spark, sf):
    """Rows packed as runs and unpacked to cells again."""
    found = ordered.runs(fixture(spark, sf, "cells"), ["r"], "c", "v")
    item = F.struct("first", F.concat(F.col("v"), F.lit("x"), F.col("last") - F.col("first") + 1).alias("s"))
    rows = found.groupBy("r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda a: a["s"]), ",").alias("packed"))
    each = F.transform(F.split("packed", ","), lambda s: F.struct(F.split(s, "x")[0].cast("int").alias("v"), F.split(s, "x")[1].cast("int").alias("n")))
    cells = F.flatten(F.transform(each, lambda e: F.array_repeat(e["v"], e["n"])))
    return rows.select("r", F.posexplode(cells).alias("c", "v")).withColumn("c", F.col("c").cast("bigint"))


@query("""SELECT CASE CAST(c_custkey % 4 AS INTEGER) WHEN 0 THEN 'R' WHEN 1 THEN 'T' WHEN 2 THEN 'P' ELSE 'E' END AS line_type, 0 AS level, c_custkey AS id, c_mktsegment AS name, CAST(c_acctbal AS DOUBLE) AS x FROM @customer WHERE c_custkey % 5 <> 4""")
def shared_lines(spark, sf):
    """Line-typed text with attributes by name, in any order; lines of unknown kinds are left out."""
    kind = F.when(F.col("c_custkey") % 5 == 4, "Z").otherwise(F.element_at(F.array(*map(F.lit, "RTPE")), (F.col("c_custkey") % 4 + 1).cast("int")))
    fields = [F.concat(F.lit("id="), F.col("c_custkey").cast("string")), F.concat(F.lit("name="), "c_mktsegment"), F.concat(F.lit("x="), F.col("c_acctbal").cast("string"))]
    mixed = F.when(F.col("c_custkey") % 2 == 0, F.array(*fields)).otherwise(F.array(*reversed(fields)))
    lines = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(kind, F.lit("  0 "), F.array_join(mixed, " ")).alias("line"))
    got = lines.select(F.split("line", r"\s+").alias("w")).filter(F.col("w")[0].isin("R", "T", "P", "E"))
    of = F.str_to_map(F.array_join(F.slice("w", 3, 10), "\t"), F.lit("\t"), F.lit("="))
    return got.select(F.col("w")[0].alias("line_type"), F.col("w")[1].cast("int").alias("level"), of["id"].cast("bigint").alias("id"), of["name"].alias("name"), of["x"].cast("double").alias("x"))


@query(r"""SELECT c_custkey, substr(trim(regexp_replace(regexp_replace(c_name || chr(9) || '|x  ' || c_mktsegment || ' ' || c_name || ' ' || c_name, '[\x00-\x1f|]', ' ', 'g'), '\s+', ' ', 'g')), 1, 40) AS name FROM @customer""")
def clean_names(spark, sf):
    """Typed names without control characters and bars, single blanks, forty characters at most."""
    raw = F.concat("c_name", F.lit("\t|x  "), "c_mktsegment", F.lit(" "), "c_name", F.lit(" "), "c_name")
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", text.clean_name(raw).alias("name"))
