"""Spoken directions by the full rule."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waygrid.operators import manoeuvres
from waygrid.queries import query
from waygrid.queries.moves import ORDER, PATH, POINT, STEPPED
from waygrid.sources.fixtures import fixture

KINDS = "CASE l_partkey % 6 WHEN 0 THEN 'off' WHEN 1 THEN 'off' WHEN 2 THEN CASE WHEN l_partkey % 5 < 2 THEN 'drop' ELSE 'road' END WHEN 3 THEN CASE WHEN l_partkey % 5 < 2 THEN 'up' ELSE 'road' END ELSE 'road' END"
WRAP = "CASE WHEN {t} > 180 THEN {t} - 360 WHEN {t} < -180 THEN {t} + 360 ELSE {t} END"
ANGLE = "degrees(atan2({b}[2] - {a}[2], {b}[1] - {a}[1]))"
FAR = "(({b}[1] - {a}[1]) * ({b}[1] - {a}[1]) + ({b}[2] - {a}[2]) * ({b}[2] - {a}[2]))"


def _wide(name: str, asked: str, letters: str = "abcd") -> str:
    """A CTE of the points asked for, as lists by letter; the key of a row is ``k // 10``."""
    columns = ", ".join(f"max(CASE WHEN k % 10 = {i} THEN [px, py] END) AS {c}" for i, c in enumerate(letters))
    return f"{name} AS (SELECT path, k // 10 AS i, {columns} FROM ({POINT.format(asked=asked)}) z GROUP BY path, k // 10)"


def _asked(rows: str, *places: str) -> str:
    return " UNION ALL ".join(f"SELECT path, i * 10 + {n} AS k, {at} AS at_ FROM {rows}" for n, at in enumerate(places))


TURN_TEXT = "CASE WHEN abs(a) < 20 THEN 'straight on' WHEN abs(a) < 60 THEN 'bear ' || d WHEN abs(a) < 120 THEN 'turn ' || d WHEN abs(a) < 160 THEN 'sharp ' || d ELSE 'turn around' END"
ITEM = "struct_pack(dist := {dist}, kind := {kind}, angle := {angle}, text := {text}, alone := {alone}, road := {road}, merged := {merged})"


@query(f"""WITH RECURSIVE hp AS (SELECT path, seq, l_partkey, x / 4 AS x, y / 4 AS y FROM $hops), {STEPPED.replace("$hops", "hp")},
v AS (SELECT path, along, total, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY path) - 1 AS last, {KINDS} AS kind, lag({KINDS}) OVER w AS before, l_partkey % 4 = 0 AS junction FROM legs WINDOW w AS ({PATH})),
{_wide("p1", _asked("v WHERE i > 0 AND i < last AND along >= 5", "along - 35", "along", "along + 35"), "abc")},
bd AS (SELECT v.*, {WRAP.format(t="t")} AS bend FROM (SELECT path, i, {ANGLE.format(a="b", b="c")} - {ANGLE.format(a="a", b="b")} AS t FROM p1 WHERE {FAR.format(a="a", b="b")} >= 1 AND {FAR.format(a="b", b="c")} >= 1) q JOIN v USING (path, i)),
bn AS (SELECT *, CASE WHEN along - lag(along) OVER w <= 35 AND (bend > 0) = (lag(bend) OVER w > 0) THEN 0 ELSE 1 END AS starts FROM bd WHERE abs(bend) >= 8 WINDOW w AS (PARTITION BY path ORDER BY i)),
gi AS (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY i) AS g FROM bn),
gr AS (SELECT path, CAST(g AS BIGINT) AS i, min(along) AS first, max(along) AS until, arg_min(along, struct_pack(b := -abs(bend), i := i)) AS s, min(i) AS i0, max(i) AS i1, max(total) AS total FROM gi GROUP BY path, g),
{_wide("p2", _asked("gr", "first - 35", "first", "until", "until + 35"))},
gt AS (SELECT gr.path, gr.total, coalesce(js, s) AS dist, angle, CASE WHEN NOT road THEN 50 WHEN js IS NOT NULL THEN 40 ELSE 75 END AS need FROM (SELECT gr.path, gr.i, bool_or(v.kind = 'road' OR v.before = 'road') AS road, min(CASE WHEN v.junction THEN v.along END) AS js FROM gr JOIN v ON v.path = gr.path AND v.i BETWEEN gr.i0 AND gr.i1 GROUP BY gr.path, gr.i) r
 JOIN gr USING (path, i) JOIN (SELECT path, i, {WRAP.format(t="t")} AS angle FROM (SELECT path, i, {ANGLE.format(a="c", b="d")} - {ANGLE.format(a="a", b="b")} AS t FROM p2) q) h USING (path, i)),
tn AS (SELECT *, CASE WHEN dist - lag(dist) OVER (PARTITION BY path ORDER BY dist, angle) > 60 THEN 1 ELSE 0 END AS starts FROM gt WHERE abs(angle) >= need),
tr AS (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY dist, angle) AS run FROM tn),
rn AS (SELECT path, CAST(run AS BIGINT) AS i, min(dist) AS s0, max(dist) AS s1, max(total) AS total FROM tr GROUP BY path, run),
{_wide("p3", _asked("rn", "s0 - 70", "s0 - 35", "s1 + 35", "s1 + 70"))},
jg AS (SELECT * FROM (SELECT path, i, {FAR.format(a="a", b="b")} AS f1, {FAR.format(a="c", b="d")} AS f2, {ANGLE.format(a="c", b="d")} - {ANGLE.format(a="a", b="b")} AS t, abs((b[1] - a[1]) * (c[2] - a[2]) - (b[2] - a[2]) * (c[1] - a[1])) AS cr FROM p3) q JOIN rn USING (path, i) WHERE f1 >= 1 AND f2 >= 1 AND abs({WRAP.format(t="t")}) < 50 AND cr <= 12 * sqrt(f1)),
sm AS (SELECT path, i, unnest(generate_series(0, CAST(floor((least(total, s1 + 35) - greatest(0.0, s0 - 35)) / 10) AS BIGINT))) AS m, greatest(0.0, s0 - 35) AS low FROM jg),
cl AS (SELECT DISTINCT path, k // 1000 AS i FROM ({POINT.format(asked="SELECT path, i * 1000 + m AS k, low + m * 10 AS at_ FROM sm")}) z JOIN $cells g ON g.r = floor(py / 2) AND g.c = floor(px / 2) WHERE g.h >= 49),
ok AS (SELECT tr.* FROM tr WHERE NOT EXISTS (SELECT 1 FROM jg WHERE jg.path = tr.path AND jg.i = tr.run AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.path = jg.path AND cl.i = jg.i))),
al AS (SELECT path, dist, 3 AS rank, angle, 'turn' AS kind, {TURN_TEXT} AS text, total FROM (SELECT *, angle AS a, CASE WHEN angle > 0 THEN 'left' ELSE 'right' END AS d FROM ok) q
 UNION ALL SELECT path, along AS dist, 0 AS rank, NULL AS angle, 'drop' AS kind, 'jump down' AS text, total FROM v WHERE i > 0 AND i < last AND kind = 'drop' AND before <> 'drop' UNION ALL SELECT path, along AS dist, 1 AS rank, NULL AS angle, 'lift' AS kind, 'take the lift ' || kind AS text, total FROM v WHERE i > 0 AND i < last AND kind IN ('up', 'down') AND before <> kind
 UNION ALL SELECT path, along AS dist, 2 AS rank, NULL AS angle, CASE WHEN kind = 'road' THEN 'join' ELSE 'leave' END AS kind, CASE WHEN kind = 'road' THEN 'join the road' ELSE 'leave the road' END AS text, total FROM v WHERE i > 0 AND i < last AND along >= 5 AND (kind <> 'off') <> (before <> 'off')),
no AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY dist, rank, angle) AS n FROM al WHERE dist <= total - 25),
fold AS (SELECT DISTINCT path, CAST(0 AS BIGINT) AS n, total, list_filter([{ITEM.format(dist="CAST(0 AS DOUBLE)", kind="'x'", angle="CAST(NULL AS DOUBLE)", text="'x'", alone="CAST(NULL AS VARCHAR)", road="CAST(NULL AS VARCHAR)", merged="false")}], lambda z: z.dist > 0) AS done FROM v
 UNION ALL SELECT path, n, total, CASE WHEN hop AND turned THEN list_append(rest, {ITEM.format(dist="l.dist", kind="l.kind", angle="l.angle", text="coalesce(l.alone, l.text)", alone="CAST(NULL AS VARCHAR)", road="CAST(NULL AS VARCHAR)", merged="false")}) WHEN hop THEN rest
  WHEN both_ THEN list_append(rest, {ITEM.format(dist="l.dist", kind="'turn'", angle="CASE WHEN turned THEN l.angle ELSE angle END", text="CASE WHEN turned THEN l.text ELSE text END || CASE WHEN CASE WHEN turned THEN kind ELSE l.kind END = 'join' THEN ' onto the road' ELSE ' off the road' END", alone="CASE WHEN turned THEN l.text ELSE text END", road="CASE WHEN turned THEN kind ELSE l.kind END", merged="true")})
  ELSE list_append(done, {ITEM.format(dist="dist", kind="kind", angle="angle", text="text", alone="CAST(NULL AS VARCHAR)", road="CASE WHEN kind IN ('join', 'leave') THEN kind END", merged="false")}) END AS done FROM (
  SELECT *, l.kind = 'turn' AS turned, coalesce(dist - l.dist < 60 AND kind IN ('join', 'leave') AND l.road <> kind, false) AS hop, coalesce(dist - l.dist < 15 AND NOT l.merged AND (l.kind = 'turn') <> (kind = 'turn') AND (l.road IS NOT NULL OR kind IN ('join', 'leave')), false) AS both_ FROM (
  SELECT f.path, no.n, f.total, f.done, f.done[len(f.done)] AS l, f.done[1:len(f.done) - 1] AS rest, no.dist, no.kind, no.angle, no.text FROM fold f JOIN no ON no.path = f.path AND no.n = f.n + 1) q) q),
fi AS (SELECT path, arg_max(done, n) AS done, max(total) AS total FROM fold GROUP BY path),
ex AS (SELECT path, i - 1 AS n, done[i] AS m FROM (SELECT path, done, unnest(generate_series(1, len(done))) AS i FROM fi) q)
SELECT path, n, round(m.dist, 4) AS dist, m.kind AS kind, round(m.angle, 3) AS angle, m.text AS text FROM ex UNION ALL SELECT path, CAST(len(done) AS BIGINT) AS n, round(total, 4) AS dist, 'arrive' AS kind, NULL AS angle, 'arrive' AS text FROM fi""")
def spoken_turns(spark, sf):
    """Turns, roads joined and left, drops and lifts along ways, without jogs and short hops, and the arrival."""
    at = F.row_number().over(Window.partitionBy("path").orderBy(*ORDER)).cast("bigint") - 1
    points = fixture(spark, sf, "hops").select("path", at.alias("i"), (F.col("x") / 4).alias("x"), (F.col("y") / 4).alias("y"), F.expr(KINDS).alias("kind"), (F.col("l_partkey") % 4 == 0).alias("junction"))
    hilly = fixture(spark, sf, "cells").filter("h >= 49").select("r", "c")
    found = manoeuvres.manoeuvres(points, hilly, 2)
    return found.withColumns({"dist": F.round("dist", 4), "angle": F.round("angle", 3)})
