"""Raster algebra over cell tables ``r, c, v`` and sampling of segments on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygrid.functions import geo
from waygrid.operators.chains import ordered_chains
from waygrid.operators.ordered import islands
from waygrid.operators.spatial import bucket, segment_buckets
from waygrid.plans.components import connected_components
from waygrid.plans.scratch import discard, written


def midpoint_samples(segments: DataFrame, step: float) -> DataFrame:
    """Repeat each segment ``x1..y2`` at the midpoints of equal parts of at most ``step``: adds ``sx, sy, share``.

    ``share`` is the length that a sample stands for, so sums over samples are lengths.
    """
    c = [F.col(n) for n in ("x1", "y1", "x2", "y2")]
    d = geo.distance(*c)
    n = F.greatest(F.lit(1), F.ceil(d / step)).cast("int")
    rows = segments.withColumns({"share": d / n, "_n": n}).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = (F.col("_k") + 0.5) / F.col("_n")
    return rows.withColumns({"sx": c[0] + (c[2] - c[0]) * t, "sy": c[1] + (c[3] - c[1]) * t}).drop("_n", "_k")


def end_samples(segments: DataFrame, step: float) -> DataFrame:
    """Repeat each segment at both ends and between, at most ``step`` apart: adds ``k, n, sx, sy``."""
    c = [F.col(n) for n in ("x1", "y1", "x2", "y2")]
    rows = segments.withColumn("n", parts(step)).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t = F.col("k") / F.col("n")
    return rows.withColumns({"sx": c[0] + (c[2] - c[0]) * t, "sy": c[1] + (c[3] - c[1]) * t})


def parts(step: float) -> Column:
    """How many equal parts of at most ``step`` a segment ``x1..y2`` falls into, one at least."""
    return F.greatest(F.lit(1), F.ceil(geo.distance(*(F.col(n) for n in ("x1", "y1", "x2", "y2"))) / step)).cast("int")


#: Samples that are worth a task.
TASK_SAMPLES = 500_000


def near_runs(legs: DataFrame, roads: DataFrame, leg_id: str, step: float, reach: float) -> DataFrame:
    """``leg_id, k0, k1``: the longest runs of ``end_samples`` of each leg ``x1..y2`` that lie within ``reach`` of any of ``roads`` (``wx1..wy2``).

    Legs and roads are dealt to buckets, and a leg is sampled only there, for the part in that bucket; a sample looks for one road that is
    near and not for the nearest, so it meets few where roads lie close together.  What leaves a task is runs, not samples.
    """
    c, side = ["x1", "y1", "x2", "y2"], 8.0 * reach
    x1, y1, x2, y2 = ends = [F.col(n) for n in c]
    w = [F.col(f"w{n}") for n in c]
    legs = legs.select(leg_id, *c).withColumn("n", parts(step))
    tasks = (legs.agg(F.sum("n")).first()[0] or 0) // TASK_SAMPLES + 1
    dealt = segment_buckets(legs, *ends, side).repartition(tasks, "bx", "by")
    near = segment_buckets(roads.select(*w), *w, side, reach).withColumnsRenamed({"bx": "wbx", "by": "wby"}).repartition(tasks, "wbx", "wby")
    # The samples of a bucket lie between its borders along the longer axis, to one.
    flat = F.abs(x2 - x1) >= F.abs(y2 - y1)
    start, width, low = F.when(flat, x1).otherwise(y1), F.when(flat, x2 - x1).otherwise(y2 - y1), F.when(flat, F.col("bx")).otherwise(F.col("by")) * side
    at = [F.try_divide(low + more - start, width) * F.col("n") for more in (0.0, side)]
    bounds = {"_first": F.greatest(F.lit(0), F.floor(F.least(*at)).cast("int") - 1), "_last": F.least("n", F.ceil(F.greatest(*at)).cast("int") + 1)}
    samples = dealt.withColumns(bounds).filter("_first <= _last").withColumn("k", F.explode(F.sequence("_first", "_last")))
    t = F.col("k") / F.col("n")
    samples = samples.select(leg_id, "bx", "by", "k", (x1 + (x2 - x1) * t).alias("x"), (y1 + (y2 - y1) * t).alias("y"))
    samples = samples.filter((bucket(F.col("x"), side) == F.col("bx")) & (bucket(F.col("y"), side) == F.col("by")))
    d, _ = geo.segment_distance(F.col("x"), F.col("y"), *w)
    hit = samples.join(near.hint("merge"), (F.col("bx") == F.col("wbx")) & (F.col("by") == F.col("wby")) & (d <= reach), "left_semi")
    here, along = Window.partitionBy("bx", "by", leg_id), Window.partitionBy(leg_id).orderBy("k0")
    hit = islands(hit.withColumn("_new", F.col("k") - F.lag("k").over(here.orderBy("k")) > 1), ["bx", "by", leg_id], ["k"], F.col("_new"), "_run")
    runs = hit.groupBy("bx", "by", leg_id, "_run").agg(F.min("k").alias("k0"), F.max("k").alias("k1"))
    runs = islands(runs.withColumn("_new", F.col("k0") - F.lag("k1").over(along) > 1), [leg_id], ["k0"], F.col("_new"), "_joined")
    return runs.groupBy(leg_id, "_joined").agg(F.min("k0").alias("k0"), F.max("k1").alias("k1")).select(leg_id, "k0", "k1")


def neighbours(cells: DataFrame, offsets: list[tuple[int, int]], value: str = "v") -> DataFrame:
    """For each cell one row for each offset: ``r, c, dr, dc, other``; ``other`` is null beyond the grid.

    Each cell is sent to the places that look at it and meets them in an equi-join on the place, so the cost is one
    shuffle of offsets times cells, with no range join.
    """
    sent = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets]))
    looks = cells.select("r", "c", F.col(value).alias("other"), sent.alias("o")).select((F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), "o.dr", "o.dc", "other")
    own = cells.select("r", "c")
    return own.join(looks.hint("merge"), ["r", "c"], "left")  # not broadcast: looks are many times the cells that Spark reckons with


def pooled(cells: DataFrame, k: int, value: str = "v") -> DataFrame:
    """Means of k x k blocks: ``r, c, mean``."""
    return cells.groupBy(F.floor(F.col("r") / k).alias("r"), F.floor(F.col("c") / k).alias("c")).agg(F.avg(value).alias("mean"))


def around(cells: DataFrame, offsets: list[tuple[int, int]], column: Column, name: str) -> DataFrame:
    """Adds ``name``: an aggregate of ``other`` over a cell's neighbours at ``offsets``."""
    return cells.join(neighbours(cells, offsets).groupBy("r", "c").agg(column.alias(name)), ["r", "c"])


CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]
RING = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def dilated(cells: DataFrame, blocked: int = 2) -> DataFrame:
    """Blocked cells and their four neighbours are blocked."""
    grown = around(cells, CROSS, F.max(F.when(F.col("other") == blocked, 1).otherwise(0)), "near")
    return grown.withColumn("v", F.when(F.col("near") == 1, blocked).otherwise(F.col("v"))).drop("near")


def layered(layers: list[DataFrame]) -> DataFrame:
    """One value for each cell: that of the first layer in list order that has the cell."""
    ranked = reduce(DataFrame.unionByName, [df.select("r", "c", "v").withColumn("rank", F.lit(i)) for i, df in enumerate(layers)])
    return ranked.groupBy("r", "c").agg(F.min_by("v", "rank").alias("v"))


def marching_squares(cells: DataFrame, blocked: int = 2) -> DataFrame:
    """``r, c, square``: the case number of the four cells at and after each corner (1, 2, 4, 8), uniform ones left out."""
    bits = {(0, 0): 1, (0, 1): 2, (1, 1): 4, (1, 0): 8}
    bit = reduce(lambda a, b: a + b, [F.when((F.col("dr") == k[0]) & (F.col("dc") == k[1]) & (F.col("other") == blocked), n).otherwise(0) for k, n in bits.items()])
    got = neighbours(cells, list(bits)).groupBy("r", "c").agg(F.sum(bit).alias("square"), F.count("other").alias("have"))
    return got.filter("have = 4 AND square BETWEEN 1 AND 14").select("r", "c", "square")


def classified(quads: DataFrame, k: int) -> DataFrame:
    """``r, c, v`` of k x k blocks of quads ``r, c, water, steep``: 0 open, 1 water, 2 blocked.

    Half a block of water makes it water; half a block of steep ground blocks it, and so does less than half a block of
    land.  Quads that are absent are no land.
    """
    share = lambda name: F.count_if(F.col(name)) / (k * k)
    masks = quads.groupBy(F.floor(F.col("r") / k).alias("r"), F.floor(F.col("c") / k).alias("c")).agg(share("water").alias("water"), share("steep").alias("steep"), (F.count("*") / (k * k)).alias("land"))
    return masks.select("r", "c", F.when((F.col("steep") >= 0.5) | (F.col("land") < 0.5), 2).when(F.col("water") >= 0.5, 1).otherwise(0).alias("v"))


def cell_key(r: Column, c: Column) -> Column:
    """One number for a cell; columns below 2^31."""
    return r * (1 << 31) + c


def square(r: Column, c: Column, size: int = 512) -> Column:
    """One number for the square of ``size`` cells that a cell lies in."""
    return cell_key(F.floor(r / size), F.floor(c / size))


def regions(cells: DataFrame) -> DataFrame:
    """``r, c, region`` of the cells given: cells that touch at a side are of one region, named by its smallest cell's key."""
    own = cells.select("r", "c", F.lit(1).alias("v"))
    key = cell_key(F.col("r"), F.col("c"))
    links = neighbours(own, [(0, 1), (1, 0)]).filter("other = 1").select(key.alias("a"), cell_key(F.col("r") + F.col("dr"), F.col("c") + F.col("dc")).alias("b"))
    found = connected_components(links.unionByName(own.select(key.alias("a"), key.alias("b"))))
    return found.select(F.shiftright("node", 31).alias("r"), F.pmod("node", F.lit(1 << 31)).alias("c"), F.col("component").alias("region"))


def hysteresis(cells: DataFrame, low: float, high: float, value: str = "v") -> DataFrame:
    """``r, c`` of the cells of at least ``low`` in regions that hold one of at least ``high``."""
    kept = cells.filter(F.col(value) >= low).select("r", "c", value)
    found = regions(kept).join(kept, ["r", "c"])
    strong = found.groupBy("region").agg(F.max(value).alias("top")).filter(F.col("top") >= high)
    return found.join(strong, "region", "left_semi").select("r", "c")


def despeckled(cells: DataFrame, speck: int, pocket: int) -> DataFrame:
    """Ground without noise, ``r, c, v`` (0 open, 1 water, 2 blocked).

    In this order: blocked regions smaller than ``speck`` open; gaps of one cell in ridges close, which is what a dilation
    followed by an erosion of the blocked cells adds, with all open beyond the grid; other regions smaller than ``pocket``
    are blocked; water regions smaller than ``speck`` open.
    """

    def settled(df: DataFrame, what: Column, least: int, to: int) -> DataFrame:
        found = regions(df.filter(what))
        few = found.groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") < least)
        small = found.join(few, "region", "left_semi").select("r", "c", F.lit(to).alias("_to"))
        return written(df.join(small, ["r", "c"], "left").select("r", "c", F.coalesce("_to", "v").alias("v")), "cells")

    blocked = F.col("v") == 2
    out = settled(cells.select("r", "c", "v"), blocked, speck, 0)
    grown = dilated(out).select("r", "c", F.when(blocked, 1).otherwise(0).alias("v"))
    shut = around(grown, CROSS, F.count_if(F.col("other") == 1), "held").filter("v = 1 AND held = 4").select("r", "c", F.lit(2).alias("_to"))
    out = written(out.join(shut, ["r", "c"], "left").select("r", "c", F.coalesce("_to", "v").alias("v")), "cells")
    out = settled(out, ~blocked, pocket, 2)
    return settled(out, F.col("v") == 1, speck, 0)


def open_lines(lines: DataFrame, cells: DataFrame, line_id: str, closed: Column) -> DataFrame:
    """``line_id, cost`` of the straight lines ``r1, c1, r2, c2`` between cells that run over open cells alone.

    The start is not asked.  A diagonal step asks for both corners beside it.  ``cost`` counts a diagonal step as the root
    of two.  Cells that are absent are closed; a line from a cell to itself is open.
    """
    a, b = F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1")
    rows = lines.withColumn("_n", F.greatest(F.abs(a), F.abs(b)).cast("int"))
    at = lambda start, d, i: (F.col(start) + F.floor(d * i / F.col("_n") + 0.5)).cast("bigint")
    i = F.col("_i")
    each = rows.filter("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(line_id, at("r1", a, i).alias("r"), at("c1", b, i).alias("c"), at("r1", a, i - 1).alias("pr"), at("c1", b, i - 1).alias("pc"))
    corners = F.when((F.col("r") != F.col("pr")) & (F.col("c") != F.col("pc")), F.array(F.struct(F.col("pr").alias("r"), "c"), F.struct("r", F.col("pc").alias("c"))))
    asked = each.select(line_id, F.explode(F.concat(F.array(F.struct("r", "c")), F.coalesce(corners, F.array()))).alias("p")).select(line_id, "p.r", "p.c")
    hit = asked.join(cells.filter(~closed).select("r", "c"), ["r", "c"], "left_anti").select(line_id).distinct()
    low, long = F.least(F.abs(a), F.abs(b)), F.col("_n")
    return rows.join(hit, line_id, "left_anti").select(line_id, (long + (F.sqrt(F.lit(2.0)) - 1) * low).alias("cost"))


def traced_lines(cells: DataFrame) -> DataFrame:
    """Lines of a skeleton of cells ``r, c``: ``line, a, b, cells, length``, in cells.

    A cell with two of its eight neighbours lies on a line; all others that touch are one node.  Lines and nodes are named by
    their smallest cell (``r * 2^31 + c``); ``a <= b`` are the nodes that a line joins, and a ring without a node joins
    itself.  A line cell has two neighbours only, so half the steps of a line are its cells and no path is walked.
    """
    key = lambda r, c: r * 2147483648 + c
    seen = neighbours(cells.select("r", "c", F.lit(1).alias("v")).distinct(), RING)
    here = key(F.col("r"), F.col("c"))
    kinds = written(seen.groupBy(here.alias("node")).agg((F.count("other") == 2).alias("on_line")), "kinds")
    step = F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double"))
    met = seen.filter("other IS NOT NULL").select(here.alias("a"), key(F.col("r") + F.col("dr"), F.col("c") + F.col("dc")).alias("b"), step.alias("step"))
    for end in ("a", "b"):
        met = met.join(kinds.select(F.col("node").alias(end), F.col("on_line").alias(f"line_{end}")), end)
    met = written(met, "steps")
    alone = kinds.select(F.col("node").alias("a"), F.col("node").alias("b"))
    parts = connected_components(met.filter("line_a = line_b").select("a", "b").unionByName(alone))
    ways = met.filter("line_a")
    for end in ("a", "b"):
        ways = ways.join(parts.select(F.col("node").alias(end), F.col("component").alias(f"part_{end}")), end)
    node = F.when(~F.col("line_b"), F.col("part_b"))
    length = F.sum(F.when(F.col("line_b"), F.col("step") / 2).otherwise(F.col("step")))
    found = ways.groupBy(F.col("part_a").alias("line")).agg(F.min(node).alias("a"), F.max(node).alias("b"), F.expr("count(*) div 2").alias("cells"), length.alias("length"))
    return found.withColumns({end: F.coalesce(end, "line") for end in ("a", "b")})


def line_points(cells: DataFrame) -> DataFrame:
    """``line, seq, r, c, closed``: the cells of the lines of ``traced_lines`` in order, from the end with the smaller cell on."""
    key = lambda r, c: r * 2147483648 + c
    seen = neighbours(cells.select("r", "c", F.lit(1).alias("v")).distinct(), RING)
    here, there = key(F.col("r"), F.col("c")), key(F.col("r") + F.col("dr"), F.col("c") + F.col("dc"))
    kinds = written(seen.groupBy(here.alias("node")).agg(F.count("other").alias("n")).filter("n = 2").select("node"), "kinds")
    met = seen.filter("other IS NOT NULL").select(here.alias("a"), there.alias("b"))
    for end in ("a", "b"):
        met = met.join(kinds.select(F.col("node").alias(end)), end)
    found = ordered_chains(met.select("a", "b").unionByName(kinds.select(F.col("node").alias("a"), F.col("node").alias("b"))))
    return found.select(F.col("chain").alias("line"), "seq", F.shiftright("node", 31).alias("r"), F.pmod("node", F.lit(1 << 31)).alias("c"), "closed")


def outline_rings(cells: DataFrame) -> DataFrame:
    """``ring, seq, r2, c2``: the outlines of the cells ``r, c`` as closed rings of points, in halves of a cell.

    Between a cell of the shape and one outside of it lies a point; each square of four cells joins the points on its sides, and
    where all four sides have one, those around its second and around its fourth cell.  So every point has two neighbours.
    """
    own = cells.select("r", "c").distinct()
    bits = {(0, 0): 1, (1, 0): 2, (1, 1): 4, (0, 1): 8}
    sent = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(n).alias("bit")) for (a, b), n in bits.items()]))
    squares = own.select("r", "c", sent.alias("s")).select((F.col("r") - F.col("s.dr")).alias("r"), (F.col("c") - F.col("s.dc")).alias("c"), "s.bit")
    squares = squares.groupBy("r", "c").agg(F.sum("bit").alias("square")).filter("square < 15")
    point = lambda r, c: cell_key(2 * F.col("r") + r + 4, 2 * F.col("c") + c + 4)
    inside = lambda n: F.col("square").bitwiseAND(n) > 0
    sides = [(1, 2, point(1, 0)), (2, 4, point(2, 1)), (4, 8, point(1, 2)), (8, 1, point(0, 1))]
    met = F.filter(F.array(*[F.when(inside(a) != inside(b), p) for a, b, p in sides]), lambda x: x.isNotNull())
    link = lambda i: F.struct(F.get("p", F.lit(i)).alias("a"), F.get("p", F.lit(i + 1)).alias("b"))
    links = squares.select(met.alias("p")).select(F.explode(F.array(link(0), link(2))).alias("l")).filter("l.a IS NOT NULL")
    found = ordered_chains(links.select("l.a", "l.b"))
    place = lambda of: (F.shiftright(of, 31) - 4, F.pmod(of, F.lit(1 << 31)) - 4)
    r, c = place("node")
    return found.select(F.col("chain").alias("ring"), "seq", r.alias("r2"), c.alias("c2"))


#: The ring around a cell, in turn, beginning to the east; even places share a side with the cell.
TURN = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]


def thinned(cells: DataFrame) -> DataFrame:
    """``r, c`` of a skeleton of the cells ``r, c``: thin lines that keep the number of pieces and of holes.

    A round takes the cells that had a side open when it began, in four turns, one for each of the four sub-fields of even
    and odd rows and columns.  Cells of one sub-field never touch, so a turn may take all of its cells that are simple (of which the
    taking neither parts nor joins anything) and have two neighbours or more.  It ends with a round that takes none.
    A turn is one join of the cells with their neighbours; the rounds are as many as half the greatest width.
    """
    left = written(cells.select("r", "c").distinct(), "cells")
    n = left.count()
    bit = reduce(lambda a, b: a + b, [F.when((F.col("dr") == d[0]) & (F.col("dc") == d[1]) & F.col("other").isNotNull(), 1 << i).otherwise(0) for i, d in enumerate(TURN)])

    def with_ring(df: DataFrame) -> DataFrame:
        ring = neighbours(df.withColumn("v", F.lit(1)), TURN).groupBy("r", "c").agg(F.sum(bit).cast("int").alias("ring"))
        return df.join(ring, ["r", "c"])

    has = lambda i: F.shiftright("ring", i % 8).bitwiseAND(1)
    # Beginnings of runs of open cells that hold one at a side: one of them makes a cell simple.
    openings = reduce(lambda a, b: a + b, [(1 - has(i)) - (1 - has(i)) * (1 - has(i + 1)) * (1 - has(i + 2)) for i in (0, 2, 4, 6)])
    while True:
        edge = reduce(lambda a, b: a | b, [has(i) == 0 for i in (0, 2, 4, 6)])
        at = written(with_ring(left).select("r", "c", edge.alias("edge")), "cells")
        discard(left)
        for dr, dc in ((0, 0), (1, 1), (0, 1), (1, 0)):
            mine = (F.pmod("r", F.lit(2)) == dr) & (F.pmod("c", F.lit(2)) == dc)
            taken = mine & F.col("edge") & (openings == 1) & (F.bit_count("ring") >= 2)
            new = written(with_ring(at).filter(~taken).select("r", "c", "edge"), "cells")
            discard(at)
            at = new
        left = at.select("r", "c")
        now = left.count()
        if now == n:
            return left
        n = now
