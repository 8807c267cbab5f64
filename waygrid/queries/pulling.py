"""Ways pulled straight over open ground, and rid of their jogs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waygrid.operators import pulling
from waygrid.queries import query
from waygrid.queries.moves import ORDER, PATH
from waygrid.sources.fixtures import fixture

#: The lines ``l(line, r1, c1, r2, c2)`` that cross a cell for which a condition holds, or an absent one.
HIT = """pt AS (SELECT *, unnest(generate_series(1, n)) AS s FROM (SELECT *, greatest(abs(r2 - r1), abs(c2 - c1)) AS n FROM l) q WHERE n > 0),
q AS (SELECT line, r1 + floor((r2 - r1) * s / n + 0.5) AS r, c1 + floor((c2 - c1) * s / n + 0.5) AS c, r1 + floor((r2 - r1) * (s - 1) / n + 0.5) AS pr, c1 + floor((c2 - c1) * (s - 1) / n + 0.5) AS pc FROM pt),
asked AS (SELECT line, r, c FROM q UNION ALL SELECT line, pr AS r, c FROM q WHERE r <> pr AND c <> pc UNION ALL SELECT line, r, pc AS c FROM q WHERE r <> pr AND c <> pc),
hit AS (SELECT DISTINCT line FROM asked LEFT JOIN $cells g ON g.r = asked.r AND g.c = asked.c WHERE coalesce(g.v, 2) = 2)"""


@query(f"""WITH RECURSIVE p AS (SELECT path, row_number() OVER ({PATH}) - 1 AS i, CAST(floor(y / 40) AS BIGINT) AS r, CAST(floor(x / 40) AS BIGINT) AS c, count(*) OVER (PARTITION BY path) - 1 AS n FROM $hops),
l AS (SELECT struct_pack(path := a.path, i := a.i, k := b.i) AS line, a.r AS r1, a.c AS c1, b.r AS r2, b.c AS c2 FROM p a JOIN p b ON b.path = a.path AND b.i > a.i + 1), {HIT},
walk AS (SELECT path, n, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(1 AS BIGINT) AS jump, CAST(NULL AS BIGINT) AS far FROM p WHERE i = 0
UNION ALL SELECT path, n, CASE WHEN k IS NULL THEN j ELSE i END AS i, CASE WHEN k IS NULL THEN j + 1 WHEN sees THEN k ELSE j END AS j, CASE WHEN k IS NULL THEN 1 WHEN sees AND far IS NULL THEN jump * 2 ELSE jump END AS jump, CASE WHEN k IS NULL THEN NULL WHEN sees THEN far ELSE k END AS far FROM (
 SELECT s.*, h.line IS NULL AS sees FROM (SELECT *, CASE WHEN far IS NULL AND j < n THEN least(n, j + jump) WHEN far - j > 1 THEN (far + j) // 2 END AS k FROM walk WHERE i < n) s LEFT JOIN hit h ON h.line.path = s.path AND h.line.i = s.i AND h.line.k = s.k) t)
SELECT DISTINCT path, i FROM walk WHERE i <= n""")
def pulled_ways(spark, sf):
    """The points of ways that are left when these are pulled straight over open ground."""
    at = F.row_number().over(Window.partitionBy("path").orderBy(*ORDER)).cast("bigint") - 1
    points = fixture(spark, sf, "hops").select("path", at.alias("i"), F.floor(F.col("y") / 40).alias("r"), F.floor(F.col("x") / 40).alias("c"))
    return pulling.pulled(points, fixture(spark, sf, "cells"), F.col("v") == 2)


#: Length of ``o(line, x1, y1, x2, y2)`` in circles, by midpoints.
EXPOSED = """(SELECT line, sum(share) AS exposed FROM (SELECT DISTINCT m.line, m.k, m.share FROM (SELECT line, k, d / n AS share, x1 + (x2 - x1) * ((k + 0.5) / n) AS sx, y1 + (y2 - y1) * ((k + 0.5) / n) AS sy FROM (
 SELECT *, unnest(generate_series(0, n - 1)) AS k FROM (SELECT *, CAST(greatest(1, ceil(d)) AS BIGINT) AS n FROM (SELECT *, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS d FROM {o}) q) q) q) m
 JOIN guards g ON sqrt((m.sx - g.x) * (m.sx - g.x) + (m.sy - g.y) * (m.sy - g.y)) <= g.r) q GROUP BY line)"""


@query(f"""WITH RECURSIVE guards AS (SELECT x / 500 AS x, y / 500 AS y, r / 40 AS r FROM $circles WHERE cid < 30),
p AS (SELECT path, row_number() OVER ({PATH}) - 1 AS i, count(*) OVER (PARTITION BY path) - 1 AS n, x / 32 AS x, y / 32 AS y, CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN 'off' ELSE 'road' END AS kind, l_partkey % 9 = 0 AS junction FROM $hops),
g AS (SELECT a.path, a.i, a.kind, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, struct_pack(path := a.path, i := a.i) AS line, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS len FROM p a JOIN p b ON b.path = a.path AND b.i = a.i + 1),
up AS (SELECT DISTINCT line FROM (SELECT line, x1 + (x2 - x1) * (k / n) AS sx, y1 + (y2 - y1) * (k / n) AS sy FROM (SELECT *, unnest(generate_series(0, n)) AS k FROM (SELECT *, CAST(greatest(1, ceil(len / 10)) AS BIGINT) AS n FROM g) q) q) s JOIN $cells c ON c.r = floor(sy) AND c.c = floor(sx) WHERE c.h >= 46),
f AS (SELECT g.*, coalesce(e.exposed, 0) AS risk, up.line IS NOT NULL AS climbs FROM g LEFT JOIN {EXPOSED.format(o="g")} e ON e.line = g.line LEFT JOIN up ON up.line = g.line),
s AS (SELECT a.path, a.i, b.i AS j, a.kind, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sum(m.len) AS way, sum(m.risk) AS risk, bool_or(m.climbs) AS climbs FROM p a JOIN p b ON b.path = a.path AND b.i > a.i + 1 JOIN f m ON m.path = a.path AND m.i >= a.i AND m.i < b.i GROUP BY ALL HAVING bool_and(m.kind IS NOT DISTINCT FROM a.kind) AND a.kind IS NOT NULL AND sum(m.len) <= 20),
d AS (SELECT s.*, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS chord FROM s),
t AS (SELECT d.path, d.i, d.j, max(CASE WHEN chord = 0 THEN sqrt((m.x - x1) * (m.x - x1) + (m.y - y1) * (m.y - y1)) ELSE sqrt((m.x - x1 - z.t * (x2 - x1)) * (m.x - x1 - z.t * (x2 - x1)) + (m.y - y1 - z.t * (y2 - y1)) * (m.y - y1 - z.t * (y2 - y1))) END) AS stray, bool_or(m.junction) AS junction
 FROM d JOIN p m ON m.path = d.path AND m.i > d.i AND m.i < d.j, LATERAL (SELECT CASE WHEN chord = 0 THEN 0 ELSE greatest(0.0, least(1.0, ((m.x - x1) * (x2 - x1) + (m.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) END AS t) z GROUP BY d.path, d.i, d.j),
o AS (SELECT struct_pack(path := d.path, i := d.i, j := d.j) AS line, d.* FROM d JOIN t USING (path, i, j) WHERE chord >= 1 AND NOT (kind = 'road' AND junction) AND (stray <= 0.6 OR way >= chord * 1.2 AND NOT climbs)),
l AS (SELECT line, CAST(floor(y1) AS BIGINT) AS r1, CAST(floor(x1) AS BIGINT) AS c1, CAST(floor(y2) AS BIGINT) AS r2, CAST(floor(x2) AS BIGINT) AS c2 FROM o), {HIT},
b AS (SELECT o.path, o.i, max(o.j) AS j FROM o LEFT JOIN {EXPOSED.format(o="o")} e ON e.line = o.line WHERE o.line NOT IN (SELECT line FROM hit) AND coalesce(e.exposed, 0) <= o.risk + 1 GROUP BY o.path, o.i),
walk AS (SELECT path, n, CAST(0 AS BIGINT) AS i FROM p WHERE i = 0 UNION ALL SELECT w.path, w.n, coalesce(b.j, w.i + 1) AS i FROM walk w LEFT JOIN b ON b.path = w.path AND b.i = w.i WHERE w.i < w.n)
SELECT path, i FROM walk""")
def smoothed_ways(spark, sf):
    """The points of ways that are left when jogs go: short ones, on one kind of way, over open and no riskier ground, not where a climb winds."""
    at = F.row_number().over(Window.partitionBy("path").orderBy(*ORDER)).cast("bigint") - 1
    k = F.col("l_partkey")
    kind = F.when(k % 7 == 0, None).when(k % 3 == 0, "off").otherwise("road")
    points = fixture(spark, sf, "hops").select("path", at.alias("i"), (F.col("x") / 32).alias("x"), (F.col("y") / 32).alias("y"), kind.alias("kind"), (k % 9 == 0).alias("junction"))
    guards = fixture(spark, sf, "circles").filter("cid < 30").select("cid", (F.col("x") / 500).alias("cx"), (F.col("y") / 500).alias("cy"), (F.col("r") / 40).alias("r"))
    return pulling.smoothed(points, fixture(spark, sf, "cells"), guards, F.col("v") == 2, F.col("h") >= 46, span=20, ratio=1.2, tolerance=0.6, step=1)
