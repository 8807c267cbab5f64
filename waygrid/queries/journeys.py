"""Routes between places off the roads."""

from pyspark.sql import functions as F

from waygrid.plans import journeys
from waygrid.queries import query
from waygrid.sources.fixtures import fixture, run_sql

ROADS = "SELECT id * 2 AS edge, id AS a, CAST(floor(id / 2) AS BIGINT) AS b, 1 + (id % 4) * 0.25e0 AS ratio, id % 6 = 0 AS one_way FROM $sites WHERE id > 0 UNION ALL SELECT id * 2 + 1 AS edge, id AS a, (id * 7 + 3) % (SELECT max(s_suppkey) + 1 FROM @supplier) AS b, 1 + (id % 3) * 0.5e0 AS ratio, id % 5 = 0 AS one_way FROM $sites"
ASKED = "SELECT s.id AS req, s.x + 150 AS sx, s.y - 90 AS sy, t.x - 70 AS tx, t.y + 110 AS ty FROM $sites s JOIN $sites t ON t.id = (s.id * 13 + 5) % (SELECT max(s_suppkey) + 1 FROM @supplier)"


@query(f"""WITH RECURSIVE rd AS (SELECT e.*, s.x AS x1, s.y AS y1, t.x AS x2, t.y AS y2, sqrt((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y)) * ratio AS w FROM ({ROADS}) e JOIN $sites s ON s.id = e.a JOIN $sites t ON t.id = e.b),
rq AS ({ASKED}), en AS (SELECT req, 's' AS side, sx AS x, sy AS y FROM rq UNION ALL SELECT req, 't' AS side, tx AS x, ty AS y FROM rq),
pr AS (SELECT *, sqrt((x - x1 - t * (x2 - x1)) * (x - x1 - t * (x2 - x1)) + (y - y1 - t * (y2 - y1)) * (y - y1 - t * (y2 - y1))) AS d FROM (SELECT en.*, rd.*, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) END AS t FROM en, rd) q),
nr AS (SELECT *, x1 + t * (x2 - x1) AS px, y1 + t * (y2 - y1) AS py FROM (SELECT *, row_number() OVER (PARTITION BY req, side ORDER BY d, edge) AS k FROM pr WHERE d <= 400) q WHERE k <= 4),
ln AS (SELECT req, side, edge, x AS x1, y AS y1, px AS x2, py AS y2 FROM nr UNION ALL SELECT req, '-' AS side, CAST(NULL AS BIGINT) AS edge, sx AS x1, sy AS y1, tx AS x2, ty AS y2 FROM rq),
o AS (SELECT ln.*, (w.x2 - w.x1) * (ln.y1 - w.y1) - (w.y2 - w.y1) * (ln.x1 - w.x1) AS oa, (w.x2 - w.x1) * (ln.y2 - w.y1) - (w.y2 - w.y1) * (ln.x2 - w.x1) AS ob, (ln.x2 - ln.x1) * (w.y1 - ln.y1) - (ln.y2 - ln.y1) * (w.x1 - ln.x1) AS oc, (ln.x2 - ln.x1) * (w.y2 - ln.y1) - (ln.y2 - ln.y1) * (w.x2 - ln.x1) AS od FROM ln, $walls w),
hit AS (SELECT DISTINCT req, side, edge FROM o WHERE oa * ob < 0 AND oc * od <= 0),
lg AS (SELECT ln.req, ln.side, ln.edge, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) * 3.0 + CASE WHEN h.req IS NOT NULL THEN 500.0 ELSE 0 END AS leg FROM ln LEFT JOIN hit h ON h.req = ln.req AND h.side = ln.side AND h.edge IS NOT DISTINCT FROM ln.edge),
m AS (SELECT nr.*, lg.leg FROM nr JOIN lg ON lg.req = nr.req AND lg.side = nr.side AND lg.edge = nr.edge),
ent AS (SELECT req, b AS node, leg + (1 - t) * w AS cost, edge, px, py FROM m WHERE side = 's' UNION ALL SELECT req, a AS node, leg + t * w AS cost, edge, px, py FROM m WHERE side = 's' AND NOT one_way),
ext AS (SELECT req, a AS node, leg + t * w AS cost, edge, px, py FROM m WHERE side = 't' UNION ALL SELECT req, b AS node, leg + (1 - t) * w AS cost, edge, px, py FROM m WHERE side = 't' AND NOT one_way),
one AS (SELECT s.req, min(struct_pack(cost := s.leg + abs(t.t - s.t) * s.w + t.leg, edge := s.edge, x1 := s.px, y1 := s.py, x2 := t.px, y2 := t.py)) AS o FROM m s JOIN m t ON t.req = s.req AND t.edge = s.edge WHERE s.side = 's' AND t.side = 't' AND (NOT s.one_way OR t.t >= s.t) GROUP BY s.req),
wy AS (SELECT a, b, min(struct_pack(w := w, edge := edge, one_way := one_way)) AS e FROM (SELECT a, b, w, edge, one_way FROM rd UNION ALL SELECT b AS a, a AS b, w, edge, one_way FROM rd WHERE NOT one_way) q WHERE a <> b GROUP BY a, b),
best(req, node, cost) USING KEY (req, node) AS (SELECT req, node, min(cost) AS cost FROM ent GROUP BY req, node UNION SELECT n.req, n.node, min(n.cost) AS cost FROM (SELECT f.req, y.b AS node, f.cost + y.e.w AS cost FROM best f JOIN wy y ON y.a = f.node) n LEFT JOIN recurring.best o ON o.req = n.req AND o.node = n.node WHERE o.cost IS NULL OR n.cost < o.cost GROUP BY n.req, n.node),
ov AS (SELECT b.req, min(struct_pack(total := b.cost + x.cost, node := x.node, edge := x.edge, px := x.px, py := x.py)) AS v FROM best b JOIN ext x ON x.req = b.req AND x.node = b.node GROUP BY b.req),
tl AS (SELECT q.*, q.cost = q.across AS flat, q.cost < q.across AND q.cost = q.o.cost AS stays FROM (SELECT rq.*, lg.leg AS across, one.o, ov.v, least(lg.leg, coalesce(one.o.cost, lg.leg), coalesce(ov.v.total, lg.leg)) AS cost FROM rq JOIN lg ON lg.req = rq.req AND lg.side = '-' LEFT JOIN one ON one.req = rq.req LEFT JOIN ov ON ov.req = rq.req) q),
pv AS (SELECT t.req, t.node, min(f.node) AS prev FROM best f JOIN wy y ON y.a = f.node JOIN best t ON t.req = f.req AND t.node = y.b AND t.cost = f.cost + y.e.w GROUP BY t.req, t.node),
bk AS (SELECT req, v.node AS node, CAST(NULL AS BIGINT) AS nxt, 0 AS k FROM tl WHERE NOT flat AND NOT coalesce(stays, false) UNION ALL SELECT b.req, p.prev AS node, b.node AS nxt, b.k + 1 AS k FROM bk b JOIN pv p ON p.req = b.req AND p.node = b.node),
on_ AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY k DESC) AS n, lag(node) OVER (PARTITION BY req ORDER BY k DESC) AS prev, count(*) OVER (PARTITION BY req) AS size FROM bk),
ei AS (SELECT on_.req, min(struct_pack(cost := ent.cost, edge := ent.edge, px := ent.px, py := ent.py)) AS e FROM on_ JOIN ent ON ent.req = on_.req AND ent.node = on_.node WHERE n = 1 GROUP BY on_.req),
pt AS (SELECT req, CAST(0 AS BIGINT) AS seq, sx AS x, sy AS y, CAST(NULL AS VARCHAR) AS kind FROM tl
UNION ALL SELECT req, CASE WHEN flat THEN 1 WHEN stays THEN 3 ELSE 3 + (SELECT max(size) FROM on_ WHERE on_.req = tl.req) END AS seq, tx AS x, ty AS y, 'off' AS kind FROM tl
UNION ALL SELECT req, 1 AS seq, o.x1 AS x, o.y1 AS y, 'off' AS kind FROM tl WHERE stays UNION ALL SELECT req, 2 AS seq, o.x2 AS x, o.y2 AS y, CASE WHEN one_way THEN 'drop' ELSE 'road' END AS kind FROM tl JOIN rd ON rd.edge = o.edge WHERE stays
UNION ALL SELECT req, 1 AS seq, e.px AS x, e.py AS y, 'off' AS kind FROM ei
UNION ALL SELECT on_.req, on_.n + 1 AS seq, s.x, s.y, CASE WHEN CASE WHEN on_.n = 1 THEN rd.one_way ELSE y.e.one_way END THEN 'drop' ELSE 'road' END AS kind FROM on_ JOIN $sites s ON s.id = on_.node JOIN ei ON ei.req = on_.req JOIN rd ON rd.edge = ei.e.edge LEFT JOIN wy y ON y.a = on_.prev AND y.b = on_.node
UNION ALL SELECT tl.req, 2 + (SELECT max(size) FROM on_ WHERE on_.req = tl.req) AS seq, v.px AS x, v.py AS y, CASE WHEN one_way THEN 'drop' ELSE 'road' END AS kind FROM tl JOIN rd ON rd.edge = v.edge WHERE NOT flat AND NOT coalesce(stays, false))
SELECT pt.req, seq, round(x, 4) AS x, round(y, 4) AS y, kind, round(cost, 4) AS cost FROM pt JOIN tl ON tl.req = pt.req""")
def place_routes(spark, sf):
    """Routes from place to place: legs off the roads, parts of edges, drops one way, walls at a price."""
    nodes = fixture(spark, sf, "sites").select(F.col("id").alias("node"), "x", "y")
    walls = fixture(spark, sf, "walls").select(F.col("wid").alias("wall"), F.col("x1").alias("wx1"), F.col("y1").alias("wy1"), F.col("x2").alias("wx2"), F.col("y2").alias("wy2"))
    found = journeys.journeys(nodes, run_sql(spark, sf, ROADS), run_sql(spark, sf, ASKED), walls, reach=400, k=4, off=3.0)
    return found.select("req", "seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "kind", F.round("cost", 4).alias("cost"))
