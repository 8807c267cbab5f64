"""Terrain: classes of cells, clean-up of blocked ground, roads found in it, straight lines and searches by blocks."""

from pyspark.sql import functions as F

from waygrid.operators import raster
from waygrid.plans import blocks
from waygrid.queries import query
from waygrid.sources.fixtures import fixture

KEY = "r * 2147483648 + c"


@query("""SELECT CAST(floor(r / 3) AS BIGINT) AS r, CAST(floor(c / 3) AS BIGINT) AS c, CASE WHEN sum(CASE WHEN h % 2 = 0 THEN 1 ELSE 0 END) / 9.0 >= 0.5 OR count(*) / 9.0 < 0.5 THEN 2
 WHEN sum(CASE WHEN h % 3 = 0 THEN 1 ELSE 0 END) / 9.0 >= 0.5 THEN 1 ELSE 0 END AS v FROM $cells GROUP BY 1, 2""")
def continent_cells(spark, sf):
    """Open ground, water and blocked ground of blocks of quads."""
    quads = fixture(spark, sf, "cells").select("r", "c", (F.col("h") % 3 == 0).alias("water"), (F.col("h") % 2 == 0).alias("steep"))
    return raster.classified(quads, 3)


@query("""WITH RECURSIVE n AS (SELECT r, c, h FROM $cells WHERE h >= 30), reach AS (SELECT r, c FROM n WHERE h >= 48 UNION SELECT n.r, n.c FROM reach q JOIN n ON abs(n.r - q.r) + abs(n.c - q.c) = 1) SELECT r, c FROM reach""")
def road_mask(spark, sf):
    """Weak traces of a road where they hang together with a strong one."""
    return raster.hysteresis(fixture(spark, sf, "cells"), 30, 48, "h")


def _labels(name, cells, what):
    """CTEs ``{name}``: ``node, label`` of the regions of the cells of a CTE for which a condition holds."""
    return f"""{name}_n AS (SELECT r, c, {KEY} AS node FROM {cells} WHERE {what}),
{name}_e AS (SELECT a.node AS a, b.node AS b FROM {name}_n a JOIN {name}_n b ON b.r = a.r AND abs(a.c - b.c) = 1 UNION ALL SELECT a.node AS a, b.node AS b FROM {name}_n a JOIN {name}_n b ON b.c = a.c AND abs(a.r - b.r) = 1),
{name}(node, label) USING KEY (node) AS (SELECT node, node AS label FROM {name}_n UNION SELECT q.node, min(q.label) AS label FROM (SELECT e.b AS node, f.label FROM {name} f JOIN {name}_e e ON e.a = f.node) q JOIN recurring.{name} o ON o.node = q.node WHERE q.label < o.label GROUP BY q.node),
{name}_few AS (SELECT node FROM (SELECT node, count(*) OVER (PARTITION BY label) AS size FROM {name}) q WHERE size < 6)"""


@query(f"""WITH RECURSIVE c0 AS (SELECT r, c, CASE WHEN h <= 24 THEN 2 WHEN h <= 32 THEN 1 ELSE 0 END AS v FROM $cells),
{_labels("k0", "c0", "v = 2")}, c1 AS (SELECT r, c, CASE WHEN {KEY} IN (SELECT node FROM k0_few) THEN 0 ELSE v END AS v FROM c0),
g AS (SELECT a.r, a.c FROM c1 a WHERE EXISTS (SELECT 1 FROM c1 b WHERE b.v = 2 AND abs(a.r - b.r) + abs(a.c - b.c) <= 1)),
s AS (SELECT a.r, a.c FROM g a JOIN g b ON abs(a.r - b.r) + abs(a.c - b.c) <= 1 GROUP BY a.r, a.c HAVING count(*) = 5),
c2 AS (SELECT c1.r, c1.c, CASE WHEN s.r IS NOT NULL THEN 2 ELSE c1.v END AS v FROM c1 LEFT JOIN s ON s.r = c1.r AND s.c = c1.c),
{_labels("k2", "c2", "v < 2")}, c3 AS (SELECT r, c, CASE WHEN {KEY} IN (SELECT node FROM k2_few) THEN 2 ELSE v END AS v FROM c2),
{_labels("k3", "c3", "v = 1")} SELECT r, c, CASE WHEN {KEY} IN (SELECT node FROM k3_few) THEN 0 ELSE v END AS v FROM c3""")
def despeckled_cells(spark, sf):
    """Ground without specks, gaps, pockets and puddles."""
    h = F.col("h")
    cells = fixture(spark, sf, "cells").select("r", "c", F.when(h <= 24, 2).when(h <= 32, 1).otherwise(0).alias("v"))
    return raster.despeckled(cells, 6, 6)


@query("""WITH l AS (SELECT r * 50 + c AS id, r AS r1, c AS c1, r + h % 9 - 4 AS r2, c + h % 7 - 3 AS c2 FROM $cells WHERE v = 0), s AS (SELECT *, greatest(abs(r2 - r1), abs(c2 - c1)) AS n, least(abs(r2 - r1), abs(c2 - c1)) AS m FROM l),
p AS (SELECT *, unnest(generate_series(1, n)) AS i FROM s WHERE n > 0), q AS (SELECT id, r1 + floor((r2 - r1) * i / n + 0.5) AS r, c1 + floor((c2 - c1) * i / n + 0.5) AS c, r1 + floor((r2 - r1) * (i - 1) / n + 0.5) AS pr, c1 + floor((c2 - c1) * (i - 1) / n + 0.5) AS pc FROM p),
asked AS (SELECT id, r, c FROM q UNION ALL SELECT id, pr AS r, c FROM q WHERE r <> pr AND c <> pc UNION ALL SELECT id, r, pc AS c FROM q WHERE r <> pr AND c <> pc),
hit AS (SELECT DISTINCT id FROM asked LEFT JOIN $cells g ON g.r = asked.r AND g.c = asked.c WHERE coalesce(g.v, 2) <> 0)
SELECT id, round(n + (sqrt(2.0) - 1) * m, 4) AS cost FROM s WHERE id NOT IN (SELECT id FROM hit)""")
def open_cell_lines(spark, sf):
    """Straight lines from open cells to cells around that nothing closes."""
    cells = fixture(spark, sf, "cells")
    r, c, h = F.col("r"), F.col("c"), F.col("h")
    lines = cells.filter("v = 0").select((r * 50 + c).alias("id"), r.alias("r1"), c.alias("c1"), (r + h % 9 - 4).alias("r2"), (c + h % 7 - 3).alias("c2"))
    return raster.open_lines(lines, cells, "id", F.col("v") != 0).select("id", F.round("cost", 4).alias("cost"))


@query("SELECT CAST(floor(r / 4) AS BIGINT) AS r, CAST(floor(c / 4) AS BIGINT) AS c, round(avg(CASE WHEN v = 2 THEN 1.0 ELSE 0.0 END), 4) AS share FROM $cells GROUP BY 1, 2 HAVING avg(CASE WHEN v = 2 THEN 1.0 ELSE 0.0 END) >= 0.25")
def footprint_cells(spark, sf):
    """Cells of which a building's slice covers a quarter or more."""
    fine = fixture(spark, sf, "cells").select("r", "c", F.when(F.col("v") == 2, 1.0).otherwise(0.0).alias("v"))
    return raster.pooled(fine, 4).filter("mean >= 0.25").select("r", "c", F.round("mean", 4).alias("share"))


GRID = f"""n AS (SELECT r, c, {KEY} AS node, floor(r / 5) AS br, floor(c / 5) AS bc FROM $cells WHERE v < 2),
e AS (SELECT a.node AS a, b.node AS b, a.br <> b.br OR a.bc <> b.bc AS crosses FROM n a JOIN n b ON b.r = a.r AND abs(a.c - b.c) = 1 UNION ALL SELECT a.node AS a, b.node AS b, a.br <> b.br OR a.bc <> b.bc AS crosses FROM n a JOIN n b ON b.c = a.c AND abs(a.r - b.r) = 1),
p AS (SELECT DISTINCT a AS node FROM e WHERE crosses)"""


@query(f"""WITH RECURSIVE {GRID}, w(src, node, d) USING KEY (src, node) AS (SELECT node AS src, node, CAST(0 AS DOUBLE) AS d FROM p UNION SELECT q.src, q.node, min(q.d) AS d FROM (SELECT f.src, e.b AS node, f.d + 1 AS d FROM w f JOIN e ON e.a = f.node AND NOT e.crosses) q
LEFT JOIN recurring.w o ON o.src = q.src AND o.node = q.node WHERE o.d IS NULL OR q.d < o.d GROUP BY q.src, q.node)
SELECT src AS a, node AS b, d AS w, false AS crosses FROM w WHERE node IN (SELECT node FROM p) AND src <> node UNION ALL SELECT a, b, 1.0 AS w, crosses FROM e WHERE crosses""")
def block_walks(spark, sf):
    """Portals of blocks of five cells: walks between those of one block, and steps over the borders."""
    return blocks.block_graph(fixture(spark, sf, "cells").filter("v < 2"), 5)


@query(f"""WITH RECURSIVE {GRID}, w(node, d) USING KEY (node) AS (SELECT min(node) AS node, CAST(0 AS DOUBLE) AS d FROM p UNION SELECT q.node, min(q.d) AS d FROM (SELECT e.b AS node, f.d + 1 AS d FROM w f JOIN e ON e.a = f.node) q
LEFT JOIN recurring.w o ON o.node = q.node WHERE o.d IS NULL OR q.d < o.d GROUP BY q.node) SELECT node, d AS cost FROM w WHERE node IN (SELECT node FROM p)""")
def block_routes(spark, sf):
    """Least steps from one portal to all others, searched over portals alone; the twin searches all cells."""
    graph = blocks.block_graph(fixture(spark, sf, "cells").filter("v < 2"), 5)
    return blocks.block_search(graph, graph.filter("crosses").agg(F.min("a").alias("node")))


@query(f"""WITH RECURSIVE after AS (SELECT r, c FROM $cells WHERE (v < 2) <> (h % 17 = 0 AND c < 8)), {GRID.replace("$cells WHERE v < 2", "after")}, w(src, node, d) USING KEY (src, node) AS (SELECT node AS src, node, CAST(0 AS DOUBLE) AS d FROM p UNION SELECT q.src, q.node, min(q.d) AS d FROM (SELECT f.src, e.b AS node, f.d + 1 AS d FROM w f JOIN e ON e.a = f.node AND NOT e.crosses) q
LEFT JOIN recurring.w o ON o.src = q.src AND o.node = q.node WHERE o.d IS NULL OR q.d < o.d GROUP BY q.src, q.node),
k AS (SELECT count(DISTINCT struct_pack(r := floor((r + dr) / 5), c := floor((c + dc) / 5))) AS rebuilt FROM (SELECT r, c FROM $cells WHERE h % 17 = 0 AND c < 8) q, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dr, dc))
SELECT src AS a, node AS b, d AS w, false AS crosses, rebuilt FROM w, k WHERE node IN (SELECT node FROM p) AND src <> node UNION ALL SELECT a, b, 1.0 AS w, crosses, rebuilt FROM e, k WHERE crosses""")
def maintained_blocks(spark, sf):
    """The graph of blocks after edits in a strip of the map, with only the blocks built anew that these touch; the twin builds all."""
    cells = fixture(spark, sf, "cells")
    edited = (F.col("h") % 17 == 0) & (F.col("c") < 8)
    before, changed = blocks.block_graph(cells.filter("v < 2"), 5), cells.filter(edited).select("r", "c")
    now = blocks.maintained(before, cells.filter((F.col("v") < 2) != edited).select("r", "c"), changed, 5)
    return now.withColumn("rebuilt", F.lit(blocks.touched_blocks(changed, 5).count()))
