"""What to say along a way: turns of bends and junctions, roads joined and left, drops and lifts, without jogs and hops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygrid.functions import geo, text
from waygrid.operators import ordered
from waygrid.plans.scratch import written


@dataclass(frozen=True)
class Rules:
    """Fixed values, in yards and degrees."""

    window: float = 35  # before and after a place, to tell how much the way bends there
    begins: float = 8  # a bend
    off_road: float = 50  # a turn off the roads
    at_junction: float = 40  # a turn at a junction
    on_road: float = 75  # a turn along a road
    ahead: float = 5  # nearer than this it is being taken
    quiet: float = 25  # before the end
    hop: float = 60  # a shorter stretch on or off a road isn't said
    joined: float = 15  # a turn so near to where a road is joined or left is said with it
    jog: float = 60  # between turns of one jog
    aside: float = 12  # how far beside its line a way goes on after a jog


def _wrapped(angle: Column) -> Column:
    return F.when(angle > 180, angle - 360).when(angle < -180, angle + 360).otherwise(angle)


def _heading(a: str, b: str) -> Column:
    return F.degrees(geo.heading(F.col(f"{b}.y") - F.col(f"{a}.y"), F.col(f"{b}.x") - F.col(f"{a}.x")))


def _far(a: str, b: str) -> Column:
    return (F.col(f"{b}.x") - F.col(f"{a}.x")) * (F.col(f"{b}.x") - F.col(f"{a}.x")) + (F.col(f"{b}.y") - F.col(f"{a}.y")) * (F.col(f"{b}.y") - F.col(f"{a}.y"))


#: Points of a way around a place on it that tell whether turns are a jog.
SPOTS = ("m2", "m1", "p1", "p2")


def _with_spots(rows: DataFrame, window: float) -> DataFrame:
    """Adds structs ``x, y`` of the way's points two windows (``m2``) and one (``m1``) before each row, there (``p0``), and one and two behind it (``p1, p2``), clamped to its ends.

    ``rows`` are a way's points with ``along``.  The leg that such a place lies on is the last one that begins at or before it: a frame over the
    rows in the order of the way, so nothing is asked for by a row of its own and no row leaves its task.
    """
    w = Window.partitionBy("path").orderBy("i")
    rows = rows.withColumn("_leg", F.struct("along", "i", F.lead("along").over(w).alias("until"), "x", "y", F.lead("x").over(w).alias("nx"), F.lead("y").over(w).alias("ny")))
    names = {"m2": -2 * window, "m1": -window, "p0": 0.0, "p1": window, "p2": 2 * window}
    end = lambda d: "CURRENT ROW" if d == 0 else f"{abs(float(d))}D {'PRECEDING' if d < 0 else 'FOLLOWING'}"
    rows = rows.withColumn("_zero", F.max(F.when(F.col("along") <= 0, F.col("_leg"))).over(Window.partitionBy("path")))
    rows = rows.withColumns({f"_{n}": F.expr(f"max(_leg) OVER (PARTITION BY path ORDER BY along RANGE BETWEEN UNBOUNDED PRECEDING AND {end(d)})") for n, d in names.items()})
    rows = rows.withColumns({f"_{n}": F.coalesce(f"_{n}", "_zero") for n in names})

    def spot(n: str, d: float) -> Column:
        leg, at = F.col(f"_{n}"), F.greatest(F.lit(0.0), F.col("along") + d)
        share = F.when(leg["until"] > leg["along"], (at - leg["along"]) / (leg["until"] - leg["along"])).otherwise(0.0)
        return F.struct(*((leg[v] + share * (F.coalesce(leg[f"n{v}"], leg[v]) - leg[v])).alias(v) for v in "xy"))

    return rows.withColumns({n: spot(n, d) for n, d in names.items()}).drop("_leg", "_zero", *(f"_{n}" for n in names))


def manoeuvres(points: DataFrame, hilly: DataFrame, size: float, rules: Rules = Rules()) -> DataFrame:
    """``path, n, dist, kind, angle, text`` of ways ``path, i, x, y, kind, junction``, ``i`` from 0 on; ``kind`` is that of the leg that begins there.

    Legs are ``road``, ``off``, ``drop``, ``up`` or ``down`` (lifts).  Bends to one side that follow each other within the window are one turn,
    by the heading before the first and after the last of them, at the first junction among them or else where it is sharpest; how much makes
    a turn depends on road and junction.  Turns close together that lead back to the line before them are a jog and not said,
    unless a cell of ``hilly`` (``r, c``, squares of ``size``) lies there.  Last, one fold along each way puts a turn and a road joined or
    left beside it together and drops short hops onto and off a road.  Everything before the fold is windows and joins by the way,
    so its points are sent to one task once, and again only of the ways that have a jog.
    """
    w = Window.partitionBy("path").orderBy("i")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ordered.steps(points, ["path"], ["i"])
    rows = rows.withColumns({"before": F.lag("kind").over(w), "total": F.max("along").over(Window.partitionBy("path")), "last": F.max("i").over(Window.partitionBy("path"))})
    road = (F.col("kind") == "road") | (F.col("before") == "road")
    rows = _with_spots(rows, rules.window)
    corner = F.when(F.col("junction"), F.struct("i", "along", *SPOTS))
    rows = rows.withColumns({"roads": F.count_if(road).over(so_far), "next": F.first(corner, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    inner = rows.filter("i > 0 AND i < last")
    bent = inner.filter(F.col("along") >= rules.ahead)
    bent = bent.filter((_far("m1", "p0") >= 1) & (_far("p0", "p1") >= 1))
    # A filter would be pushed below the heading, which would be worked out twice.
    turned = F.explode(F.filter(F.array(_wrapped(_heading("p0", "p1") - _heading("m1", "p0"))), lambda b: F.abs(b) >= rules.begins))
    bent = bent.select("path", "i", "along", "total", "p0", *SPOTS, "next", "roads", (F.col("roads") - F.when(road, 1).otherwise(0)).alias("before"), turned.alias("bend"))
    goes_on = (F.col("along") - F.lag("along").over(w) <= rules.window) & ((F.col("bend") > 0) == (F.lag("bend").over(w) > 0))
    bent = ordered.islands(bent.withColumn("_new", ~F.coalesce(goes_on, F.lit(False))), ["path"], ["i"], F.col("_new"), "g")
    sharpest = F.min_by(F.struct("along", *SPOTS), F.struct(-F.abs("bend"), F.col("i")))
    ends = [f(n, "i").alias(c) for c, f, n in (("a", F.min_by, "m1"), ("b", F.min_by, "p0"), ("c", F.max_by, "p0"), ("d", F.max_by, "p1"))]
    groups = bent.groupBy("path", "g", "total").agg(*ends, sharpest.alias("s"), F.max("i").alias("i1"), F.min_by("next", "i").alias("next"), F.min_by("before", "i").alias("r0"), F.max_by("roads", "i").alias("r1"))
    angle = _wrapped(_heading("c", "d") - _heading("a", "b"))
    corner = F.when(F.col("next.i") <= F.col("i1"), F.struct(*(F.col(f"next.{c}").alias(c) for c in ("along", *SPOTS))))
    need = F.when(F.col("r1") == F.col("r0"), rules.off_road).when(corner.isNotNull(), rules.at_junction).otherwise(rules.on_road)
    turns = groups.withColumn("angle", angle).filter(F.abs("angle") >= need)
    turns = turns.withColumn("at", F.coalesce(corner, F.col("s"))).select("path", F.col("at.along").alias("dist"), "at", "angle", "total")
    # Turns that come to nothing.
    by_dist = Window.partitionBy("path").orderBy("dist", "angle")
    turns = ordered.islands(turns.withColumn("_new", F.coalesce(F.col("dist") - F.lag("dist").over(by_dist) > rules.jog, F.lit(False))), ["path"], ["dist", "angle"], F.col("_new"), "run")
    ends = [f(f"at.{n}", "dist").alias(c) for c, f, n in (("a", F.min_by, "m2"), ("b", F.min_by, "m1"), ("c", F.max_by, "p1"), ("d", F.max_by, "p2"))]
    runs = turns.groupBy("path", "run", "total").agg(F.min("dist").alias("s0"), F.max("dist").alias("s1"), *ends, F.collect_list(F.struct("dist", "angle")).alias("turns"))
    window = rules.window
    known = (_far("a", "b") >= 1) & (_far("c", "d") >= 1)
    aside = F.abs((F.col("b.x") - F.col("a.x")) * (F.col("c.y") - F.col("a.y")) - (F.col("b.y") - F.col("a.y")) * (F.col("c.x") - F.col("a.x")))
    back = known & (F.abs(_wrapped(_heading("c", "d") - _heading("a", "b"))) < rules.off_road) & (aside <= rules.aside * F.sqrt(_far("a", "b")))
    runs = written(runs.select("path", "run", "total", "s0", "s1", "turns", F.coalesce(back, F.lit(False)).alias("back")), "runs")
    jogs = runs.filter("back").select("path", "run", "total", "s0", "s1")
    low, high = F.greatest(F.lit(0.0), F.col("s0") - window), F.least("total", F.col("s1") + window)
    samples = jogs.select("path", "run", low.alias("low"), F.explode(F.sequence(F.lit(0), F.floor((high - low) / 10).cast("int"))).alias("k"))
    lines = points.select("path", "i", "x", "y").join(jogs.select("path").distinct().hint("merge"), "path", "left_semi")
    samples = ordered.points_at(lines, samples.select("path", "run", (F.col("low") + F.col("k") * 10).alias("at")), ["path"], ["i"])
    climbs = samples.select("path", "run", F.floor(F.col("py") / size).alias("r"), F.floor(F.col("px") / size).alias("c")).join(hilly, ["r", "c"], "left_semi").select("path", "run").distinct()
    quiet = jogs.select("path", "run").join(climbs, ["path", "run"], "left_anti").groupBy("path").agg(F.collect_set("run").alias("quiet"))
    turns = runs.select("path", "run", "total", "turns").join(quiet.hint("merge"), "path", "left").filter(~F.coalesce(F.array_contains("quiet", F.col("run")), F.lit(False)))
    turns = turns.select("path", "total", F.explode("turns").alias("t")).select("path", "total", "t.dist", "t.angle", F.lit("turn").alias("kind"), text.turn_text(F.col("t.angle")).alias("text"), F.lit(3).alias("rank"))
    roadish = lambda c: F.col(c) != "off"
    said = [
        ((F.col("kind") == "drop") & (F.col("before") != "drop"), "drop", F.lit("jump down"), 0),
        (F.col("kind").isin("up", "down") & (F.col("before") != F.col("kind")), "lift", F.concat(F.lit("take the lift "), F.col("kind")), 1),
        ((F.col("along") >= rules.ahead) & (roadish("kind") != roadish("before")) & (F.col("kind") == "road"), "join", F.lit("join the road"), 2),
        ((F.col("along") >= rules.ahead) & (roadish("kind") != roadish("before")) & (F.col("kind") != "road"), "leave", F.lit("leave the road"), 2),
    ]
    others = inner.select("path", "along", "total", F.explode(F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), t.alias("text"), F.lit(n).alias("rank"))) for c, k, t, n in said]), lambda x: x.isNotNull())).alias("m"))
    others = others.select("path", F.col("along").alias("dist"), "m.kind", F.lit(None).cast("double").alias("angle"), "m.text", "total", "m.rank")
    item = F.struct("dist", "rank", "angle", "kind", "text", F.lit(None).cast("string").alias("alone"), F.when(F.col("kind").isin("join", "leave"), F.col("kind")).alias("road"), F.lit(False).alias("merged"))
    listed = lambda df, name: df.filter(F.col("dist") <= F.col("total") - rules.quiet).groupBy("path").agg(F.collect_list(item).alias(name)).hint("merge")
    ways = rows.groupBy("path").agg(F.max("total").alias("total"))
    told = ways.join(listed(turns, "turns"), "path", "left").join(listed(others, "others"), "path", "left")
    every = F.concat(*(F.coalesce(c, F.array().cast(told.schema["others"].dataType)) for c in ("turns", "others")))
    told = told.select("path", "total", F.array_sort(every).alias("all"))
    told = told.select("path", "total", _merged(F.col("all"), rules).alias("all"))
    arrive = F.struct(F.col("total").alias("dist"), F.lit(9).alias("rank"), F.lit(None).cast("double").alias("angle"), F.lit("arrive").alias("kind"), F.lit("arrive").alias("text"), F.lit(None).cast("string").alias("alone"), F.lit(None).cast("string").alias("road"), F.lit(False).alias("merged"))
    out = told.select("path", F.posexplode(F.concat("all", F.array(arrive))).alias("n", "m"))
    return out.select("path", F.col("n").cast("bigint").alias("n"), "m.dist", "m.kind", "m.angle", "m.text")


def _merged(items: Column, rules: Rules) -> Column:
    """One fold in order: each item stands alone, goes with the one before, or takes it away."""

    def changed(m: Column, **new: Column) -> Column:
        return F.struct(*[new.get(c, m[c]).alias(c) for c in ("dist", "rank", "angle", "kind", "text", "alone", "road", "merged")])

    def step(done: Column, m: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        others = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        gap, on_off = m["dist"] - last["dist"], m["kind"].isin("join", "leave")
        hop = F.coalesce((gap < rules.hop) & on_off & (last["road"] != m["kind"]), F.lit(False))
        turned, turns = last["kind"] == "turn", m["kind"] == "turn"
        together = F.coalesce((gap < rules.joined) & ~last["merged"] & (turned != turns) & (last["road"].isNotNull() | on_off), F.lit(False))
        turn_text, road = F.when(turned, last["text"]).otherwise(m["text"]), F.when(turned, m["kind"]).otherwise(last["kind"])
        both = changed(last, kind=F.lit("turn"), angle=F.when(turned, last["angle"]).otherwise(m["angle"]), alone=turn_text, road=road, merged=F.lit(True), text=F.concat(turn_text, F.when(road == "join", " onto the road").otherwise(" off the road")))
        alone = changed(last, text=F.coalesce(last["alone"], last["text"]), alone=F.lit(None).cast("string"), road=F.lit(None).cast("string"), merged=F.lit(False))
        return F.when(hop & turned, F.concat(others, F.array(alone))).when(hop, others).when(together, F.concat(others, F.array(both))).otherwise(F.concat(done, F.array(m)))

    return F.aggregate(items, F.slice(items, 1, 0), step)
