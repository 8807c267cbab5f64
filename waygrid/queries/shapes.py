"""Shapes from cells: lines and outlines as ordered points, skeletons."""

from pyspark.sql import functions as F

from waygrid.operators import raster
from waygrid.queries import query
from waygrid.queries.terrain import KEY
from waygrid.sources.fixtures import fixture

#: Labels of the nodes of links ``e(a, b)`` (both ways) among ``k(node)``, the start of each chain, and a walk from there.
WALK = """l(node, label) USING KEY (node) AS (SELECT node, node AS label FROM k UNION SELECT q.node, min(q.label) AS label FROM (SELECT e.b AS node, f.label FROM l f JOIN e ON e.a = f.node) q JOIN recurring.l o ON o.node = q.node WHERE q.label < o.label GROUP BY q.node),
d AS (SELECT l.node, l.label, count(e.b) AS n, min(e.b) AS low FROM l LEFT JOIN e ON e.a = l.node GROUP BY l.node, l.label),
s AS (SELECT label, coalesce(min(CASE WHEN n < 2 THEN node END), min(node)) AS start, min(CASE WHEN n < 2 THEN node END) IS NULL AS closed FROM d GROUP BY label),
walk AS (SELECT s.label, s.closed, s.start, CAST(0 AS BIGINT) AS seq, s.start AS node, CAST(NULL AS BIGINT) AS prev FROM s
UNION ALL SELECT w.label, w.closed, w.start, w.seq + 1 AS seq, e.b AS node, w.node AS prev FROM walk w JOIN d ON d.node = w.node JOIN e ON e.a = w.node WHERE e.b <> w.start AND CASE WHEN w.prev IS NULL THEN e.b = d.low ELSE e.b <> w.prev END)"""


@query(f"""WITH RECURSIVE x AS (SELECT r, c, {KEY} AS node FROM $cells WHERE v > 0), y AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.node <> b.node),
k AS (SELECT a AS node FROM y GROUP BY a HAVING count(*) = 2), e AS (SELECT a, b FROM y WHERE a IN (SELECT node FROM k) AND b IN (SELECT node FROM k)), {WALK}
SELECT label AS line, seq, CAST(node // 2147483648 AS BIGINT) AS r, node % 2147483648 AS c, closed FROM walk""")
def line_points(spark, sf):
    """The cells of each line of a skeleton in order."""
    return raster.line_points(fixture(spark, sf, "cells").filter("v > 0"))


@query(f"""WITH RECURSIVE x AS (SELECT DISTINCT r, c FROM $cells WHERE v = 2), q AS (SELECT DISTINCT r - i AS r, c - j AS c FROM x, (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j) o),
b AS (SELECT q.r, q.c, EXISTS (SELECT 1 FROM x WHERE x.r = q.r AND x.c = q.c) AS a, EXISTS (SELECT 1 FROM x WHERE x.r = q.r + 1 AND x.c = q.c) AS b, EXISTS (SELECT 1 FROM x WHERE x.r = q.r + 1 AND x.c = q.c + 1) AS c_, EXISTS (SELECT 1 FROM x WHERE x.r = q.r AND x.c = q.c + 1) AS d FROM q),
p AS (SELECT list_filter([CASE WHEN a <> b THEN (2 * r + 5) * 2147483648 + 2 * c + 4 END, CASE WHEN b <> c_ THEN (2 * r + 6) * 2147483648 + 2 * c + 5 END, CASE WHEN c_ <> d THEN (2 * r + 5) * 2147483648 + 2 * c + 6 END, CASE WHEN d <> a THEN (2 * r + 4) * 2147483648 + 2 * c + 5 END], lambda z: z IS NOT NULL) AS p FROM b),
g AS (SELECT p[1] AS a, p[2] AS b FROM p WHERE len(p) > 0 UNION ALL SELECT p[3] AS a, p[4] AS b FROM p WHERE len(p) = 4), e AS (SELECT a, b FROM g UNION SELECT b AS a, a AS b FROM g), k AS (SELECT DISTINCT a AS node FROM e), {WALK}
SELECT label AS ring, seq, CAST(node // 2147483648 AS BIGINT) - 4 AS r2, node % 2147483648 - 4 AS c2 FROM walk""")
def outline_rings(spark, sf):
    """Outlines of blocked ground as closed rings of ordered points."""
    return raster.outline_rings(fixture(spark, sf, "cells").filter("v = 2"))


RING = "CASE WHEN EXISTS (SELECT 1 FROM t o WHERE o.r = t.r + {dr} AND o.c = t.c + {dc}) THEN 0 ELSE 1 END AS o{i}"
RINGS = ", ".join(RING.format(dr=dr, dc=dc, i=i) for i, (dr, dc) in enumerate(raster.TURN))


@query(f"""WITH RECURSIVE t AS (SELECT 0 AS turn, 0 AS quiet, r, c, true AS edge FROM (SELECT DISTINCT r, c FROM $cells WHERE v < 2) q
UNION ALL SELECT turn + 1 AS turn, CASE WHEN turn % 5 = 0 THEN 0 ELSE quiet + CAST(sum(CASE WHEN taken THEN 1 ELSE 0 END) OVER () AS INT) END AS quiet, r, c, CASE WHEN turn % 5 = 0 THEN o0 + o2 + o4 + o6 > 0 ELSE edge END AS edge FROM (
 SELECT *, turn % 5 > 0 AND edge AND r % 2 = CASE WHEN turn % 5 IN (2, 4) THEN 1 ELSE 0 END AND c % 2 = CASE WHEN turn % 5 IN (2, 3) THEN 1 ELSE 0 END AND 8 - (o0 + o1 + o2 + o3 + o4 + o5 + o6 + o7) >= 2 AND o0 - o0 * o1 * o2 + o2 - o2 * o3 * o4 + o4 - o4 * o5 * o6 + o6 - o6 * o7 * o0 = 1 AS taken
 FROM (SELECT t.*, {RINGS} FROM t WHERE turn = 0 OR turn % 5 > 0 OR quiet > 0) a) b QUALIFY NOT taken)
SELECT r, c FROM t WHERE turn = (SELECT max(turn) FROM t)""")
def thinned_cells(spark, sf):
    """A skeleton of open ground by parallel thinning."""
    return raster.thinned(fixture(spark, sf, "cells").filter("v < 2"))
