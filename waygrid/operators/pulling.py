"""Ways pulled straight: from each kept point to the farthest one that a rule allows, for all points at once.

Where a way goes from a point doesn't depend on how it came there.  So the next point is looked for at every point of every
way together, in as many rounds as one search takes, and the kept points are then found by following these pointers
with doubling: log n rounds, not one for each kept point.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygrid.functions import geo
from waygrid.operators import raster
from waygrid.operators.spatial import in_buckets, point_buckets
from waygrid.plans.scratch import discard, written


#: Pointers up to which a way is followed in one row, points ahead that a point carries with it, and lines that are sent to all places.
SHORT, AHEAD, SENT = 64, 16, 100_000


def followed(pointers: DataFrame, path: str = "path") -> DataFrame:
    """``path, i``: the places that following ``i -> to`` from place 0 of each path meets, 0 included.

    ``pointers`` has one row for each place but the last; each leads onward.  Ways of up to ``SHORT`` pointers are followed in one row each,
    longer ones by doubling.
    """
    sized = written(pointers.select(path, "i", "to", F.count("*").over(Window.partitionBy(path)).alias("_n")), "pointers")
    start = F.lit(0).cast(pointers.schema["i"].dataType)
    short = sized.filter(F.col("_n") <= SHORT).groupBy(path).agg(F.array_sort(F.collect_list(F.struct("i", "to"))).alias("p"))
    way = F.aggregate("p", F.array(start), lambda met, p: F.when(F.element_at(met, -1) == p["i"], F.concat(met, F.array(p["to"]))).otherwise(met))
    found, long = short.select(path, F.explode(way).alias("i")), sized.filter(F.col("_n") > SHORT).select(path, "i", "to")
    return found.unionByName(_doubled(long, path)) if long.limit(1).count() else found


def _doubled(pointers: DataFrame, path: str) -> DataFrame:
    """``followed`` for long ways: each round follows pointers twice as long."""
    jumps = written(pointers, "jumps")
    met = written(jumps.select(path).distinct().withColumn("i", F.lit(0).cast(jumps.schema["i"].dataType)), "met")
    n = met.count()
    while True:
        new = written(met.join(jumps, [path, "i"]).select(path, F.col("to").alias("i")).unionByName(met).distinct(), "met")
        further = jumps.select(path, F.col("i").alias("to"), F.col("to").alias("further"))
        twice = written(jumps.join(further, [path, "to"]).select(path, "i", F.col("further").alias("to")), "jumps")
        discard(met, jumps)
        met, jumps, now = new, twice, new.count()
        if now == n:
            discard(jumps)
            return met
        n = now


def pulled(points: DataFrame, cells: DataFrame, closed: Column, path: str = "path") -> DataFrame:
    """``path, i`` of the points that are left of each way when it is pulled straight; ``points`` has ``path, i, r, c``, ``i`` from 0 on.

    From a kept point the way goes to the next one at least.  It then looks one further than what it has seen, two further, four and so on,
    until it doesn't see a point (a straight line to it would cross a ``closed`` or absent cell, or pass between two that
    touch at a corner), and halves the stretch between the last seen and that one.  So a bend may be taken early where the
    sight opens again further on, which keeps the number of lines small.  Each round asks for one line for every place that hasn't settled, and each
    different line once; points carry the next ``AHEAD`` with them, so only looks beyond these meet the points again.
    """
    whole = Window.partitionBy(path)
    ahead = F.collect_list(F.struct("r", "c")).over(whole.orderBy("i").rowsBetween(1, AHEAD))
    spots = written(points.select(path, "i", "r", "c").withColumns({"n": F.max("i").over(whole), "ahead": ahead}), "points")
    begun = {"j": F.col("i") + 1, "jump": F.lit(1).cast("bigint"), "far": F.lit(None).cast("bigint")}
    state = spots.filter("i < n").select(path, "i", "n", F.col("r").alias("r1"), F.col("c").alias("c1"), "ahead").withColumns(begun)
    asks = F.when(F.col("far").isNull() & (F.col("j") < F.col("n")), F.least("n", F.col("j") + F.col("jump"))).when(F.col("far") - F.col("j") > 1, F.floor((F.col("far") + F.col("j")) / 2))
    state = written(state.withColumn("k", asks), "sight")
    to = state.filter("k IS NULL").select(path, "i", F.col("j").alias("to"))
    line = ["r1", "c1", "r2", "c2"]
    while state.filter("k IS NOT NULL").limit(1).count():
        asking, carried = state.filter("k IS NOT NULL"), F.get("ahead", (F.col("k") - F.col("i") - 1).cast("int"))
        near = asking.filter(F.col("k") - F.col("i") <= AHEAD).withColumns({"r2": carried["r"], "c2": carried["c"]})
        beyond = asking.filter(F.col("k") - F.col("i") > AHEAD)
        if beyond.limit(1).count():
            near = near.unionByName(beyond.join(spots.select(path, F.col("i").alias("k"), F.col("r").alias("r2"), F.col("c").alias("c2")), [path, "k"]))
        lines = near.select(*line).distinct().withColumn("line", F.struct(*line))
        seen = written(raster.open_lines(lines, cells, "line", closed).select(*[F.col(f"line.{x}").alias(f"s_{x}") for x in line], F.lit(True).alias("sees")), "seen")
        seen = F.broadcast(seen) if seen.count() <= SENT else seen.hint("merge")
        met = near.join(seen, reduce(and_, [F.col(x).eqNullSafe(F.col(f"s_{x}")) for x in line]), "left")
        sees, widening = F.coalesce("sees", F.lit(False)), F.col("far").isNull()
        new = met.select(
            path,
            "i",
            "n",
            "r1",
            "c1",
            "ahead",
            F.when(sees, F.col("k")).otherwise(F.col("j")).alias("j"),
            F.when(widening & sees, F.col("jump") * 2).otherwise(F.col("jump")).alias("jump"),
            F.when(~sees, F.col("k")).otherwise(F.col("far")).alias("far"),
        )
        state = written(new.withColumn("k", asks), "sight")
        to = to.unionByName(state.filter("k IS NULL").select(path, "i", F.col("j").alias("to")))
    return followed(to, path).unionByName(spots.filter("n = 0").select(path, "i"))


def smoothed(points: DataFrame, cells: DataFrame, circles: DataFrame, closed: Column, hilly: Column, span: float, ratio: float, tolerance: float, size: float = 1.0, step: float = 5.0, path: str = "path") -> DataFrame:
    """``path, i`` of the points that are left of each way without its jogs.

    ``points`` has ``path, i, x, y, kind, junction``: ``kind`` is that of the leg that begins there (null: not to be touched).
    From a kept point the way goes to the last point within ``span`` along legs of its kind for which all holds: no junction
    lies between on a road; either what lies between strays ``tolerance`` at most from the straight line, or the way is ``ratio``
    times as long and no leg of it is hilly; the line crosses no closed cell (squares of ``size``); and it is no more than
    one longer inside of ``circles`` (``cx, cy, r``) than the way.  Else it goes to the next point.
    """
    # Ways and the lines between their points stay among these cells; few of them are sent to all samples by Spark itself.
    box = points.agg(*(f(F.floor(F.col(v) / size)).alias(f"{n}{v}") for v in "xy" for n, f in (("low", F.min), ("high", F.max)))).first()
    if box["lowx"] is not None and box["lowy"] is not None:
        cells = cells.filter(F.col("r").between(box["lowy"] - 1, box["highy"] + 1) & F.col("c").between(box["lowx"] - 1, box["highx"] + 1))
    cells = written(cells, "cells")
    w = Window.partitionBy(path).orderBy("i")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    legs = points.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    legs = legs.withColumn("len", geo.distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")))
    ends = legs.filter("nx IS NOT NULL").select(F.struct(path, "i").alias("leg"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("nx").alias("x2"), F.col("ny").alias("y2"))
    ends = written(ends, "legs")
    cell = {"r": F.floor(F.col("sy") / size), "c": F.floor(F.col("sx") / size)}
    slopes = raster.end_samples(ends, 10).withColumns(cell).join(cells.filter(hilly).select("r", "c"), ["r", "c"], "left_semi").select("leg").distinct()
    facts = legs.withColumn("leg", F.struct(path, "i")).join(exposure(ends, circles, "leg", step), "leg", "left").join(slopes.withColumn("climbs", F.lit(1)), "leg", "left")
    facts = facts.withColumns({"exposed": F.coalesce("exposed", F.lit(0.0)), "climbs": F.coalesce("climbs", F.lit(0))})
    facts = facts.withColumn("changes", F.when(F.col("kind").eqNullSafe(F.lag("kind").over(w)), 0).otherwise(1))
    # Sums over the legs before each point, so that those of a stretch are differences.
    total = lambda c: F.sum(c).over(so_far) - F.coalesce(c, F.lit(0))
    facts = facts.withColumns({"along": total(F.coalesce("len", F.lit(0.0))), "risk": total(F.col("exposed")), "climb": total(F.col("climbs")), "run": F.sum("changes").over(so_far), "cross": F.sum(F.col("junction").cast("int")).over(so_far)})
    facts = written(facts.select(path, "i", "x", "y", "kind", "along", "risk", "climb", "run", "cross"), "facts")
    ahead = F.expr(f"collect_list(struct(i, x, y, along, risk, climb, run, cross)) OVER (PARTITION BY {path} ORDER BY along RANGE BETWEEN CURRENT ROW AND {float(span)}D FOLLOWING)")
    near = facts.withColumn("ahead", F.filter(F.array_sort(ahead), lambda p: p["i"] > F.col("i")))
    at = near.filter("kind IS NOT NULL").select(path, "i", F.col("x").alias("x1"), F.col("y").alias("y1"), "kind", "along", "risk", "climb", "run", "cross", "ahead", F.posexplode("ahead").alias("m", "p"))
    # Legs of one kind up to the point: the run of the leg that ends there is that of the point before it.
    same = F.when(F.col("m") == 0, F.col("run")).otherwise(F.get("ahead", F.col("m") - 1)["run"]) == F.col("run")
    x2, y2 = F.col("p.x"), F.col("p.y")
    between = F.slice("ahead", 1, F.col("m"))
    stray = F.array_max(F.transform(between, lambda q: geo.segment_distance(q["x"], q["y"], F.col("x1"), F.col("y1"), x2, y2)[0]))
    chord, way = geo.distance(F.col("x1"), F.col("y1"), x2, y2), F.col("p.along") - F.col("along")
    clear = (F.get("ahead", F.col("m") - 1)["cross"] == F.col("cross")) | (F.col("kind") != "road")
    pairs = at.filter((F.col("m") >= 1) & same).withColumns({"stray": stray, "chord": chord, "way": way, "clear": clear})
    jog = (F.col("way") >= F.col("chord") * ratio) & (F.col("stray") > tolerance) & (F.col("p.climb") == F.col("climb"))
    pairs = pairs.filter((F.col("chord") >= 1) & F.col("clear") & (jog | (F.col("stray") <= tolerance)))
    pairs = written(pairs.select(F.struct(path, "i", F.col("p.i").alias("j")).alias("line"), "x1", "y1", x2.alias("x2"), y2.alias("y2"), (F.col("p.risk") - F.col("risk")).alias("risk")), "chords")
    grid = lambda c: F.floor(F.col(c) / size)
    lines = pairs.select("line", grid("y1").alias("r1"), grid("x1").alias("c1"), grid("y2").alias("r2"), grid("x2").alias("c2"))
    sound = raster.open_lines(lines, cells, "line", closed).select("line")
    kept = pairs.join(sound, "line").join(exposure(pairs, circles, "line", step), "line", "left").filter(F.coalesce("exposed", F.lit(0.0)) <= F.col("risk") + 1)
    best = kept.groupBy(F.col(f"line.{path}").alias(path), F.col("line.i").alias("i")).agg(F.max("line.j").alias("j"))
    placed = facts.withColumn("last", F.max("i").over(Window.partitionBy(path))).select(path, "i", "last")
    onward = placed.filter("i < last").join(best, [path, "i"], "left").select(path, "i", F.coalesce("j", F.col("i") + 1).alias("to"))
    return followed(onward, path).unionByName(placed.filter("last = 0").select(path, "i"))


def exposure(lines: DataFrame, circles: DataFrame, line_id: str, step: float) -> DataFrame:
    """``line_id, exposed``: the length of each line inside of any circle, by midpoints of parts of at most ``step``."""
    samples = raster.midpoint_samples(lines.select(line_id, "x1", "y1", "x2", "y2"), step).select(line_id, "share", F.col("sx").alias("x"), F.col("sy").alias("y"))
    # A sample counts once, however many circles hold it, so it looks for one; a few circles are sent to the samples.
    x, y, cx, cy, r = (F.col(c) for c in ("x", "y", "cx", "cy", "r"))
    dealt = in_buckets(circles.select("cx", "cy", "r"), cx - r, cx + r, cy - r, cy + r, 50).withColumnsRenamed({"bx": "cbx", "by": "cby"})
    few = circles.limit(SENT + 1).count() <= SENT
    inside = (F.col("bx") == F.col("cbx")) & (F.col("by") == F.col("cby")) & (geo.distance(x, y, cx, cy) <= r)
    hit = point_buckets(samples, 50).join(F.broadcast(dealt) if few else dealt, inside, "left_semi")
    return hit.groupBy(line_id).agg(F.sum("share").alias("exposed"))
