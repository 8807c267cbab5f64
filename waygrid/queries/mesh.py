"""Solids of triangles on a grid, and roads drawn over each other."""

from pyspark.sql import functions as F

from waygrid.operators import edits, mesh
from waygrid.queries import query
from waygrid.sources.fixtures import fixture, run_sql

#: A tetrahedron for each supplier, by corners and by faces.
CORNERS = """SELECT s_suppkey AS solid, CAST((s_suppkey * 7919) % 997 AS DOUBLE) AS ax, CAST((s_suppkey * 104729) % 1009 AS DOUBLE) AS ay, 0.0e0 AS az, CAST((s_suppkey * 7919) % 997 + 20 + s_suppkey % 7 AS DOUBLE) AS bx, CAST((s_suppkey * 104729) % 1009 + 3 AS DOUBLE) AS b_y, CAST(s_suppkey % 3 AS DOUBLE) AS bz,
 CAST((s_suppkey * 7919) % 997 + 5 AS DOUBLE) AS cx, CAST((s_suppkey * 104729) % 1009 + 25 + s_suppkey % 5 AS DOUBLE) AS cy, 1.0e0 AS cz, CAST((s_suppkey * 7919) % 997 + 9 AS DOUBLE) AS dx, CAST((s_suppkey * 104729) % 1009 + 8 AS DOUBLE) AS dy, CAST(30 + s_suppkey % 11 AS DOUBLE) AS dz FROM @supplier"""
FACE = "SELECT solid, solid * 4 + {n} AS tri, {a} AS x1, {b} AS y1, {c} AS z1, {d} AS x2, {e} AS y2, {f} AS z2, {g} AS x3, {h} AS y3, {i} AS z3 FROM ({s}) q"
CORNER = {"a": ("ax", "ay", "az"), "b": ("bx", "b_y", "bz"), "c": ("cx", "cy", "cz"), "d": ("dx", "dy", "dz")}
TRIANGLES = " UNION ALL ".join(FACE.format(n=n, s=CORNERS, **dict(zip("abcdefghi", [x for k in face for x in CORNER[k]]))) for n, face in enumerate(("abc", "abd", "bcd", "cad")))


@query(f"""WITH t AS (SELECT *, (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1) AS area FROM ({TRIANGLES}) q), o AS (SELECT tri, abs(area) AS area, x1, y1, z1, CASE WHEN area < 0 THEN x3 ELSE x2 END AS x2, CASE WHEN area < 0 THEN y3 ELSE y2 END AS y2, CASE WHEN area < 0 THEN z3 ELSE z2 END AS z2, CASE WHEN area < 0 THEN x2 ELSE x3 END AS x3, CASE WHEN area < 0 THEN y2 ELSE y3 END AS y3, CASE WHEN area < 0 THEN z2 ELSE z3 END AS z3 FROM t WHERE area <> 0),
g AS (SELECT *, unnest(generate_series(CAST(floor(least(x1, x2, x3)) AS BIGINT) - 1, CAST(ceil(greatest(x1, x2, x3)) AS BIGINT) + 1)) AS c FROM (SELECT *, unnest(generate_series(CAST(floor(least(y1, y2, y3)) AS BIGINT) - 1, CAST(ceil(greatest(y1, y2, y3)) AS BIGINT) + 1)) AS r FROM o) q),
e AS (SELECT *, (x3 - x2) * (r + 0.5 - y2) - (y3 - y2) * (c + 0.5 - x2) AS e1, (x1 - x3) * (r + 0.5 - y3) - (y1 - y3) * (c + 0.5 - x3) AS e2, (x2 - x1) * (r + 0.5 - y1) - (y2 - y1) * (c + 0.5 - x1) AS e3 FROM g)
SELECT r, c, count(*) AS layers, round(max((e1 * z1 + e2 * z2 + e3 * z3) / area), 6) AS top FROM e WHERE (e1 > 0 OR e1 = 0 AND (y3 < y2 OR y3 = y2 AND x3 > x2)) AND (e2 > 0 OR e2 = 0 AND (y1 < y3 OR y1 = y3 AND x1 > x3)) AND (e3 > 0 OR e3 = 0 AND (y2 < y1 OR y2 = y1 AND x2 > x1)) GROUP BY r, c""")
def mesh_heights(spark, sf):
    """The highest face over each cell, and how many faces lie over it."""
    cells = mesh.covered_cells(run_sql(spark, sf, TRIANGLES))
    return cells.groupBy("r", "c").agg(F.count("*").alias("layers"), F.round(F.max("z"), 6).alias("top"))


#: The cells of each solid at a height, by counting the faces' crossings to the left of every middle.
INSIDE = f"""t AS ({TRIANGLES}), k AS (SELECT solid, tri, CASE WHEN (z1 < 10.5) <> (z2 < 10.5) THEN [x1 + (x2 - x1) * ((z1 - 10.5) / (z1 - 10.5 - (z2 - 10.5))), y1 + (y2 - y1) * ((z1 - 10.5) / (z1 - 10.5 - (z2 - 10.5)))] END AS p, CASE WHEN (z2 < 10.5) <> (z3 < 10.5) THEN [x2 + (x3 - x2) * ((z2 - 10.5) / (z2 - 10.5 - (z3 - 10.5))), y2 + (y3 - y2) * ((z2 - 10.5) / (z2 - 10.5 - (z3 - 10.5)))] END AS q, CASE WHEN (z3 < 10.5) <> (z1 < 10.5) THEN [x3 + (x1 - x3) * ((z3 - 10.5) / (z3 - 10.5 - (z1 - 10.5))), y3 + (y1 - y3) * ((z3 - 10.5) / (z3 - 10.5 - (z1 - 10.5)))] END AS s FROM t),
l AS (SELECT solid, coalesce(p, q) AS a, CASE WHEN p IS NULL OR q IS NULL THEN s ELSE q END AS b FROM k WHERE (p IS NOT NULL) OR (q IS NOT NULL)),
box AS (SELECT solid, min(least(a[1], b[1])) AS x1, max(greatest(a[1], b[1])) AS x2, min(least(a[2], b[2])) AS y1, max(greatest(a[2], b[2])) AS y2 FROM l GROUP BY solid),
g AS (SELECT solid, r, unnest(generate_series(CAST(floor(x1) AS BIGINT), CAST(ceil(x2) AS BIGINT))) AS c FROM (SELECT *, unnest(generate_series(CAST(floor(y1) AS BIGINT), CAST(ceil(y2) AS BIGINT))) AS r FROM box) q),
inside AS (SELECT g.solid, g.r, g.c FROM g JOIN l ON l.solid = g.solid AND least(a[2], b[2]) <= g.r + 0.5 AND g.r + 0.5 < greatest(a[2], b[2]) AND a[1] + (b[1] - a[1]) * ((g.r + 0.5 - a[2]) / (b[2] - a[2])) <= g.c + 0.5 GROUP BY g.solid, g.r, g.c HAVING count(*) % 2 = 1)"""


@query(f"WITH {INSIDE} SELECT solid, r, min(c) AS first, max(c) AS last FROM inside GROUP BY solid, r")
def mesh_slices(spark, sf):
    """The rows of cells inside of each solid at one height."""
    cut = mesh.slices(run_sql(spark, sf, TRIANGLES), F.lit(10.5), carry=("solid",))
    return mesh.filled(cut, "solid")


@query(f"WITH {INSIDE} SELECT CAST(floor(r / 5) AS BIGINT) AS r, CAST(floor(c / 5) AS BIGINT) AS c, count(*) / 25.0 AS share FROM (SELECT DISTINCT r, c FROM inside) q GROUP BY 1, 2 HAVING count(*) / 25.0 >= 0.4")
def mesh_footprints(spark, sf):
    """Blocks of cells of which solids cover two fifths or more at one height."""
    cut = mesh.slices(run_sql(spark, sf, TRIANGLES), F.lit(10.5), carry=("solid",))
    return mesh.shares(mesh.filled(cut, "solid"), 5).filter("share >= 0.4")


NEAR = """CASE WHEN long > 0 AND {h} * {h} - long * ((x1 - {x}) * (x1 - {x}) + (y1 - {y}) * (y1 - {y}) - 3600) >= 0 THEN struct_pack(lo := (-{h} - sqrt({h} * {h} - long * ((x1 - {x}) * (x1 - {x}) + (y1 - {y}) * (y1 - {y}) - 3600))) / long, hi := (-{h} + sqrt({h} * {h} - long * ((x1 - {x}) * (x1 - {x}) + (y1 - {y}) * (y1 - {y}) - 3600))) / long) END"""


@query(f"""WITH d AS (SELECT wid AS id, wid % 3 AS level, wid % 4 = 0 AS erases, x1, y1, x2, y2 FROM $walls),
p AS (SELECT e.id, e.x1, e.y1, l.id AS lid, l.erases, l.x1 AS cx, l.y1 AS cy, l.x2 AS ex, l.y2 AS ey, e.x2 - e.x1 AS dx, e.y2 - e.y1 AS dy, l.x2 - l.x1 AS ux, l.y2 - l.y1 AS uy FROM d e JOIN d l ON l.level = e.level AND l.id > e.id AND NOT e.erases AND least(l.x1, l.x2) <= greatest(e.x1, e.x2) + 60 AND greatest(l.x1, l.x2) >= least(e.x1, e.x2) - 60 AND least(l.y1, l.y2) <= greatest(e.y1, e.y2) + 60 AND greatest(l.y1, l.y2) >= least(e.y1, e.y2) - 60),
q AS (SELECT *, dx * dx + dy * dy AS long, ux * ux + uy * uy AS wide, dx * (x1 - cx) + dy * (y1 - cy) AS h1, dx * (x1 - ex) + dy * (y1 - ey) AS h2, ux * (y1 - cy) - uy * (x1 - cx) AS c0, ux * dy - uy * dx AS c1, ux * (x1 - cx) + uy * (y1 - cy) AS p0, ux * dx + uy * dy AS p1 FROM p WHERE erases OR abs(dx * ux + dy * uy) >= 0.866 * sqrt(dx * dx + dy * dy) * sqrt(ux * ux + uy * uy)),
s AS (SELECT id, list_filter([{NEAR.format(h="h1", x="cx", y="cy")}, {NEAR.format(h="h2", x="ex", y="ey")}, struct_pack(lo := greatest(CASE WHEN c1 = 0 THEN CASE WHEN abs(c0) <= 60 * sqrt(wide) THEN 0 ELSE 9 END ELSE least((-60 * sqrt(wide) - c0) / c1, (60 * sqrt(wide) - c0) / c1) END, CASE WHEN p1 = 0 THEN CASE WHEN p0 BETWEEN 0 AND wide THEN 0 ELSE 9 END ELSE least((0 - p0) / p1, (wide - p0) / p1) END),
 hi := least(CASE WHEN c1 = 0 THEN 1 ELSE greatest((-60 * sqrt(wide) - c0) / c1, (60 * sqrt(wide) - c0) / c1) END, CASE WHEN p1 = 0 THEN 1 ELSE greatest((0 - p0) / p1, (wide - p0) / p1) END))], lambda z: z.lo <= z.hi) AS parts FROM q),
v AS (SELECT id, round(greatest(0.0, list_min(list_transform(parts, lambda z: z.lo))), 6) AS lo, round(least(1.0, list_max(list_transform(parts, lambda z: z.hi))), 6) AS hi FROM s WHERE len(parts) > 0), k AS (SELECT * FROM v WHERE lo < hi),
b AS (SELECT id, 0.0e0 AS s1 FROM d WHERE NOT erases UNION SELECT id, hi AS s1 FROM k)
SELECT id, s1, s2 FROM (SELECT b.id, b.s1, least(1.0, coalesce((SELECT min(lo) FROM k WHERE k.id = b.id AND k.lo > b.s1), 1.0)) AS s2 FROM b WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.id = b.id AND k.lo <= b.s1 AND k.hi > b.s1)) q WHERE s1 < s2""")
def surviving_roads(spark, sf):
    """What is left of roads drawn in order: stretches that no later eraser, nor a later road about parallel, comes near."""
    drawn = fixture(spark, sf, "walls").select(F.col("wid").alias("id"), (F.col("wid") % 3).alias("level"), (F.col("wid") % 4 == 0).alias("erases"), "x1", "y1", "x2", "y2")
    return edits.surviving(drawn, 60, 0.866)
