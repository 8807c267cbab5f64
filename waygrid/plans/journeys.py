"""Routes between any two places: off the roads to a road, along roads from and to the middle of an edge, or straight across."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waygrid.functions import geo
from waygrid.operators import spatial
from waygrid.plans import paths
from waygrid.plans.scratch import written


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A written table whose joins are merges, as all of them grow with the requests or the roads and none goes through the driver."""
    return written(df, name).hint("merge")


def _legs(lines: DataFrame, walls: DataFrame, off: float, penalty: float, size: float) -> DataFrame:
    """``line, leg``: what it costs to walk the straight ``lines`` (``line, x1, y1, x2, y2``), with a penalty for crossing a wall.

    One wall is enough, so a line meets those of its beginning first.
    """
    lines = _kept(lines, "lines")
    hit = spatial.first_crossings(lines, walls, "line", size).select("line")
    crossing = F.when(F.col("hit"), float(penalty)).otherwise(0.0)
    return lines.join(hit.withColumn("hit", F.lit(True)), "line", "left").select("line", (geo.distance(*map(F.col, ("x1", "y1", "x2", "y2"))) * off + crossing).alias("leg"))


def journeys(nodes: DataFrame, edges: DataFrame, requests: DataFrame, walls: DataFrame, reach: float, k: int = 8, off: float = 1.35, penalty: float = 500.0) -> DataFrame:
    """``req, seq, x, y, kind, cost``: the points of the cheapest route of each request, the kind of the leg that leads to each, and the cost of the whole.

    ``nodes`` has ``node, x, y``; ``edges`` has ``edge, a, b, ratio, one_way`` (``ratio``: cost for a yard; a one-way edge is a drop from ``a`` to ``b``); ``requests`` has
    ``req, sx, sy, tx, ty``; ``walls`` has ``wall, wx1, wy1, wx2, wy2``.  Both places of a request are joined to the ``k``
    nearest edges within ``reach`` at their closest points, by straight legs that cost ``off`` a yard and ``penalty`` more across a wall.  A route may stay on
    one edge, or be the straight line, which is also the limit of its search: no request looks at roads that cost more.

    All requests are one search, keyed by request; parts of edges are costs of entering and leaving nodes, so that no
    edge is split and the network is read as it is.
    """
    nodes = nodes.hint("merge")
    place = lambda c, i: nodes.select(F.col("node").alias(c), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    roads = edges.join(place("a", 1), "a").join(place("b", 2), "b").withColumn("w", geo.distance(*map(F.col, ("x1", "y1", "x2", "y2"))) * F.col("ratio"))
    roads = _kept(roads.select("edge", "a", "b", "one_way", "w", "x1", "y1", "x2", "y2"), "roads")
    ends = requests.select("req", F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("sx").alias("x"), F.col("sy").alias("y")), F.struct(F.lit("t").alias("side"), F.col("tx").alias("x"), F.col("ty").alias("y")))).alias("e"))
    ends = ends.select(F.struct("req", "e.side").alias("end"), "e.x", "e.y")
    near = spatial.nearest_segments(ends, roads.select("edge", "x1", "y1", "x2", "y2"), "end", "edge", reach, k=k, slack=reach).select("end", "edge", "t", "x", "y")
    near = near.join(roads, "edge").withColumns({"px": F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1")), "py": F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1"))})
    near = _kept(near.select(F.struct("end.req", "end.side", "edge").alias("line"), "a", "b", "one_way", "w", "t", "x", "y", "px", "py"), "near")
    straight = requests.select(F.struct("req", F.lit("-").alias("side"), F.lit(None).cast(edges.schema["edge"].dataType).alias("edge")).alias("line"), F.col("sx").alias("x1"), F.col("sy").alias("y1"), F.col("tx").alias("x2"), F.col("ty").alias("y2"))
    lines = near.select("line", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("px").alias("x2"), F.col("py").alias("y2")).unionByName(straight)
    legs = _kept(_legs(lines, walls, off, penalty, reach), "legs")
    met = _kept(near.join(legs, "line").select("line.req", "line.side", "line.edge", "a", "b", "one_way", "w", "t", "px", "py", "leg"), "joins")
    to_b, to_a = F.col("leg") + (1 - F.col("t")) * F.col("w"), F.col("leg") + F.col("t") * F.col("w")

    def options(side: str, forward, back) -> DataFrame:
        """Costs of getting between a place and the two ends of its edges; ``back`` is against the way of a drop."""
        both = F.array(F.struct(F.col(forward[0]).alias("node"), forward[1].alias("cost")), F.when(~F.col("one_way"), F.struct(F.col(back[0]).alias("node"), back[1].alias("cost"))))
        rows = met.filter(F.col("side") == side).select("req", "edge", "px", "py", F.explode(both).alias("o")).filter("o IS NOT NULL")
        best = F.min(F.struct("o.cost", "edge", "px", "py")).alias("best")
        return _kept(rows.groupBy("req", "o.node").agg(best).select("req", "node", "best.*"), "options")

    entries, exits = options("s", ("b", to_b), ("a", to_a)), options("t", ("a", to_a), ("b", to_b))
    left = met.filter("side = 's'").select("req", "edge", "one_way", "w", F.col("t").alias("t1"), F.col("px").alias("x1"), F.col("py").alias("y1"), F.col("leg").alias("leg1"))
    right = met.filter("side = 't'").select("req", "edge", F.col("t").alias("t2"), F.col("px").alias("x2"), F.col("py").alias("y2"), F.col("leg").alias("leg2"))
    same = left.join(right, ["req", "edge"]).filter("NOT one_way OR t2 >= t1")
    same = same.withColumn("cost", F.col("leg1") + F.abs(F.col("t2") - F.col("t1")) * F.col("w") + F.col("leg2"))
    same = same.groupBy("req").agg(F.min(F.struct("cost", "edge", "x1", "y1", "x2", "y2")).alias("same"))
    across = legs.filter("line.side = '-'").select(F.col("line.req").alias("req"), F.col("leg").alias("across"))
    limits = across.join(same, "req", "left")
    limits = _kept(limits.select("req", "across", "same", F.least("across", F.coalesce("same.cost", "across")).alias("limit")), "limits")
    ways = roads.select("a", "b", "w", "edge", "one_way").unionByName(roads.filter("NOT one_way").select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "edge", "one_way"))
    ways = _kept(ways.filter("a <> b").groupBy("a", "b").agg(F.min(F.struct("w", "edge", "one_way")).alias("best")).select("a", "b", "best.*"), "ways")
    costs = paths.shortest_paths(ways, entries.select(F.col("req").alias("source"), "node", "cost"), limits=limits.select(F.col("req").alias("source"), "limit"))
    costs = _kept(costs, "costs")
    found = costs.toDF("req", "node", "there").join(exits, ["req", "node"]).withColumn("total", F.col("there") + F.col("cost"))
    found = found.groupBy("req").agg(F.min(F.struct("total", "node", "edge", "px", "py")).alias("over")).hint("merge")
    # Of equal costs the straight line goes first, then one edge.
    told = _kept(requests.join(limits, "req").join(found, "req", "left").withColumn("cost", F.least("limit", F.coalesce("over.total", "limit"))), "told")
    how = F.when(F.col("cost") == F.col("across"), "across").when(F.col("cost") == F.col("same.cost"), "same").otherwise("over")
    told = told.withColumn("how", how)
    over = told.filter("how = 'over'")
    nodes_on = paths.routes(costs, ways, over.select(F.col("req").alias("source"), F.col("over.node").alias("target"))).toDF("req", "target", "n", "node", "there")
    w = Window.partitionBy("req").orderBy("n")
    nodes_on = _kept(nodes_on.withColumn("before", F.lag("node").over(w)), "nodes")
    kinds = nodes_on.join(ways.select(F.col("a").alias("before"), F.col("b").alias("node"), "one_way"), ["before", "node"], "left").join(nodes, "node")
    between = kinds.select("req", (F.col("n") + 1).cast("bigint").alias("seq"), "x", "y", F.when(F.col("one_way"), "drop").otherwise("road").alias("kind"))
    first = nodes_on.filter("n = 1").select("req", "node").join(entries.select("req", "node", "edge", F.col("px").alias("ex"), F.col("py").alias("ey")), ["req", "node"])
    kind_of = lambda c: roads.select(F.col("edge").alias(c), F.when(F.col("one_way"), "drop").otherwise("road").alias(f"{c}_kind"))
    # The part of the edge that a route enters by leads to its first node, that it leaves by to the exit.
    into = first.withColumnRenamed("edge", "in").join(kind_of("in"), "in").select("req", "ex", "ey", "in_kind").hint("merge")
    sizes = nodes_on.groupBy("req").agg(F.max("n").cast("bigint").alias("n"))
    done = over.join(into, "req").join(sizes, "req").withColumn("out", F.col("over.edge")).join(kind_of("out"), "out")
    point = lambda seq, x, y, kind: F.struct(seq.cast("bigint").alias("seq"), x.alias("x"), y.alias("y"), kind.alias("kind"))
    off_road, none = F.lit("off"), F.lit(None).cast("string")
    start, n = point(F.lit(0), F.col("sx"), F.col("sy"), none), F.col("n")
    ends_over = F.array(start, point(F.lit(1), F.col("ex"), F.col("ey"), off_road), point(n + 2, F.col("over.px"), F.col("over.py"), F.col("out_kind")), point(n + 3, F.col("tx"), F.col("ty"), off_road))
    entered = between.join(into.select("req", "in_kind"), "req").select("req", "seq", "x", "y", F.when(F.col("seq") == 2, F.col("in_kind")).otherwise(F.col("kind")).alias("kind"))
    on_one = told.filter("how = 'same'").withColumn("out", F.col("same.edge")).join(kind_of("out"), "out")
    one = F.array(start, point(F.lit(1), F.col("same.x1"), F.col("same.y1"), off_road), point(F.lit(2), F.col("same.x2"), F.col("same.y2"), F.col("out_kind")), point(F.lit(3), F.col("tx"), F.col("ty"), off_road))
    flat = F.array(start, point(F.lit(1), F.col("tx"), F.col("ty"), off_road))
    rows = done.select("req", F.explode(ends_over).alias("p")).unionByName(on_one.select("req", F.explode(one).alias("p"))).unionByName(told.filter("how = 'across'").select("req", F.explode(flat).alias("p")))
    return rows.select("req", "p.*").unionByName(entered).join(told.select("req", "cost"), "req")
