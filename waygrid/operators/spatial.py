"""Spatial joins as equi-joins on grid buckets with the exact test behind.

A bare range join would compare all pairs; here each side is put into square buckets, so Spark shuffles on the
bucket and a task sees neighbours only.  A row of the smaller extent goes to one bucket, a row with an extent to
each bucket that it touches; sizes of buckets are parameters and should be near the usual extent.  Dealt rows carry a
hint for a shuffle: Spark takes them for as few as the rows they come from and would broadcast them through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygrid.functions import geo
from waygrid.plans.scratch import discard, written


def bucket(value: Column, size: float) -> Column:
    return F.floor(value / size)


def in_buckets(df: DataFrame, minx: Column, maxx: Column, miny: Column, maxy: Column, size: float) -> DataFrame:
    """Repeat each row for every bucket ``bx, by`` that its box touches."""
    df = df.withColumn("bx", F.explode(F.sequence(bucket(minx, size), bucket(maxx, size))))
    return df.withColumn("by", F.explode(F.sequence(bucket(miny, size), bucket(maxy, size)))).hint("merge")


def point_buckets(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({"bx": bucket(F.col(x), size), "by": bucket(F.col(y), size)})


def segment_buckets(df: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column, size: float | Column, margin: float | Column = 0.0) -> DataFrame:
    """Repeat each row for every bucket that its segment passes through or comes within ``margin`` of, column by column of buckets.

    So a segment costs its length, not its bounding box.  A trace of slack keeps rounding from losing a bucket.
    """
    trace, width = 1e-6 * size, x2 - x1
    slack = trace + margin
    df = df.withColumn("bx", F.explode(F.sequence(bucket(F.least(x1, x2) - slack, size), bucket(F.greatest(x1, x2) + slack, size))))
    at = lambda x: y1 + (y2 - y1) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - x1) / width))
    a = F.when(F.abs(width) <= trace, y1).otherwise(at(F.col("bx") * size - slack))
    b = F.when(F.abs(width) <= trace, y2).otherwise(at((F.col("bx") + 1) * size + slack))
    return df.withColumn("by", F.explode(F.sequence(bucket(F.least(a, b) - slack, size), bucket(F.greatest(a, b) + slack, size)))).hint("merge")


#: Pairs that one task tries, and the fewest rows that are worth a task.
TASK_PAIRS, TASK_ROWS = 16_000_000, 20_000


def evenly(left: DataFrame, right: DataFrame, on: list[str], right_on: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join ``on`` buckets (``right_on``: their names on the right), dealt to as many tasks as their pairs need.

    Spark reckons with bytes and would put a join of few megabytes into a task or two, however many pairs its buckets hold; so these are counted.
    A bucket stays in one task.
    """
    right_on = right_on or on
    sides = [df.groupBy(*[F.col(c).alias(k) for c, k in zip(keys, on)]).agg(F.count("*").alias(n)) for df, keys, n in ((left, on, "n"), (right, right_on, "m"))]
    both = sides[0].hint("merge").join(sides[1], on, "full").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    pairs, rows = both.agg(F.sum(F.col("n").cast("double") * F.col("m")), F.sum(F.col("n") + F.col("m"))).first()
    tasks = int(min((pairs or 0) / TASK_PAIRS, (rows or 0) / TASK_ROWS)) + 1
    if tasks == 1:
        return left, right
    return left.repartition(tasks, *on), right.repartition(tasks, *right_on).hint("merge")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Pairs of points ``x, y`` and boxes ``minx, maxx, miny, maxy``, borders included."""
    dealt = in_buckets(boxes, F.col("minx"), F.col("maxx"), F.col("miny"), F.col("maxy"), size)
    inside = "x >= minx AND x <= maxx AND y >= miny AND y <= maxy"
    placed, dealt = evenly(point_buckets(points, size), dealt, ["bx", "by"])
    return placed.join(dealt, ["bx", "by"]).filter(inside).drop("bx", "by")


def smallest_box(points: DataFrame, boxes: DataFrame, point_id: str, box_id: str, size: float) -> DataFrame:
    """For each point in any box the smallest one; at equal areas the lowest id."""
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    pairs = points_in_boxes(points.select(point_id, "x", "y"), boxes, size)
    return pairs.groupBy(point_id).agg(F.min_by(box_id, F.struct(area.alias("area"), F.col(box_id).alias("id"))).alias(box_id))


def points_in_circles(points: DataFrame, circles: DataFrame, size: float, same: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points ``x, y`` and circles ``cx, cy, r`` of the ``same`` columns, the border included; adds ``d``."""
    r = F.col("r")
    dealt = in_buckets(circles, F.col("cx") - r, F.col("cx") + r, F.col("cy") - r, F.col("cy") + r, size)
    d = geo.distance(*(F.col(c) for c in ("x", "y", "cx", "cy")))
    return point_buckets(points, size).join(dealt, ["bx", "by", *same]).withColumn("d", d).filter("d <= r").drop("bx", "by")


def _first_reach(targets: DataFrame, x: Column, y: Column, reach: float, k: int, long: float = 0.0, same: tuple[str, ...] = ()) -> float:
    """A reach at which about ``4 k`` of evenly spread targets (of the ``same`` columns) lie, as a share of ``reach`` by powers of two; only the work depends on it.

    Targets that are ``long`` come into a reach along their length.
    """
    n, width, height = targets.agg(F.count("*"), F.max(x) - F.min(x), F.max(y) - F.min(y)).first()
    if not n or width is None or not 0 < width * height < float("inf"):
        return reach
    kinds = targets.select(*same).distinct().count() if same else 1
    near = ((long / 3.14159) ** 2 + 4 * k * width * height * kinds / (n * 3.14159)) ** 0.5 - long / 3.14159
    while reach / 2 >= near:
        reach /= 2
    return reach


def _in_rounds(points: DataFrame, point_id: str, reach: float, first: float, search: Callable[[DataFrame, float], DataFrame], done: Callable[[DataFrame, float], DataFrame]) -> DataFrame:
    """What ``search`` finds for each point within ``reach``, looking within ``first``, then twice as far and so on.

    A round carries on only the points that aren't ``done``, for which something farther could still count, so where targets lie
    close together no point meets more than a few times those it keeps.
    """
    if first >= reach:
        return search(points, reach)
    left, size, found = written(points, "points"), first, None
    while size < reach and left.limit(1).count():
        near = written(search(left, size), "nearest")
        settled = written(done(near, size).select(point_id).distinct(), "settled").hint("merge")
        kept = near.join(settled, point_id, "left_semi")
        found = kept if found is None else found.unionByName(kept)
        rest = written(left.join(settled, point_id, "left_anti"), "points")
        discard(left)
        left, size = rest, size * 2
    rest = search(left, reach)
    return rest if found is None else found.select(*rest.columns).unionByName(rest)


def _met_within(points: DataFrame, targets: DataFrame, size: float, same: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points and ``targets`` of the ``same`` columns within ``size``, with ``d``; the points are dealt out, as each round has fewer of them."""
    x, y = F.col("x"), F.col("y")
    dealt = in_buckets(points, x - size, x + size, y - size, y + size, size)
    d = geo.distance(x, y, F.col("tx"), F.col("ty"))
    return dealt.join(point_buckets(targets, size, "tx", "ty"), ["bx", "by", *same]).withColumn("d", d).filter(F.col("d") <= size).drop("bx", "by")


def nearest_within(points: DataFrame, targets: DataFrame, reach: float, point_id: str, target_id: str, k: int = 1, allowed: Column | None = None, same: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` nearest ``targets`` (``tx, ty``) of each point within ``reach``: adds ``target_id, d, rank``; ties by id.

    Rounds of growing reach; a point with ``k`` allowed targets in it is done.  Columns that have to be the ``same`` on both sides go into the join.
    """
    order = Window.partitionBy(point_id).orderBy("d", target_id)

    def search(left: DataFrame, size: float) -> DataFrame:
        pairs = _met_within(left, targets, size, same)
        pairs = pairs if allowed is None else pairs.filter(allowed)
        return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    full = lambda near, size: near.filter((F.col("rank") == k) & (F.col("d") < size * (1 - 1e-9)))
    return _in_rounds(points, point_id, reach, _first_reach(targets, F.col("tx"), F.col("ty"), reach, k, same=same), search, full)


def _cell_of(points: DataFrame, longest: float) -> float:
    """The side of buckets that hold some fifty of evenly spread points ``x, y``, no more than ``longest``: smaller ones would only cut segments into more rows."""
    n, width, height = points.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    if not n or width is None or not 0 < width * height < float("inf"):
        return longest
    return min(longest, (50 * width * height / n) ** 0.5)


def nearest_segments(points: DataFrame, segments: DataFrame, point_id: str, segment_id: str, reach: float, k: int = 8, slack: float = 400.0) -> DataFrame:
    """The nearest segments ``x1, y1, x2, y2`` of each point: at most ``k``, within ``reach`` and ``slack`` of the nearest.

    Adds ``d`` and ``t``, the share of the segment at its closest point.  A segment is dealt to the buckets that it comes near to, so a
    diagonal one costs its length, and a point to its own, so a pair meets once and is ranked where it met.  Rounds of growing reach; a point
    with ``k`` segments in it is done, and one whose nearest leaves nothing within ``slack`` beyond it.
    """
    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2")}
    here = Window.partitionBy("bx", "by", point_id)
    every = k >= 2**31 - 1
    long = segments.agg(F.avg(geo.distance(*c.values()))).first()[0] or 0.0
    cell = _cell_of(points, long)

    def search(left: DataFrame, size: float) -> DataFrame:
        side = max(size, cell)
        spots = segment_buckets(segments.select(segment_id, *c), *c.values(), side, size)
        d, t = geo.segment_distance(F.col("x"), F.col("y"), *c.values())
        pairs = point_buckets(left, side).join(spots, ["bx", "by"]).withColumns({"d": d, "t": t}).filter(F.col("d") <= size)
        if every and slack >= size:
            return pairs.drop("bx", "by")
        pairs = pairs.withColumns({"rank": F.row_number().over(here.orderBy("d", segment_id)), "best": F.min("d").over(here)})
        return pairs.filter((F.col("rank") <= k) & (F.col("d") <= F.col("best") + slack)).drop("bx", "by", "best")

    def full(near: DataFrame, size: float) -> DataFrame:
        inside = size * (1 - 1e-9)
        return near.filter(((F.col("rank") == k) & (F.col("d") < inside)) | ((F.col("rank") == 1) & (F.col("d") + slack < inside)))

    first = reach if every else _first_reach(segments, c["x1"], c["y1"], reach, k, long)
    return _in_rounds(points, point_id, reach, first, search, full)


def nearest_anywhere(points: DataFrame, targets: DataFrame, reach: float, point_id: str, target_id: str) -> DataFrame:
    """``point_id, target_id, d``: the nearest of ``targets`` (``tx, ty``) of each point, however far; ties by id.

    Rounds look within ``reach``, then twice as far and so on; a round carries on only the points that found nothing
    before, so no point meets targets much farther than its nearest.  Ids of points are unique; points without a place
    find nothing, nor does any where there are no targets.
    """
    left = written(points.select(point_id, "x", "y").dropna(), "points")
    targets = written(targets.select(target_id, "tx", "ty").dropna(), "targets")
    kinds = f"{point_id} {points.schema[point_id].dataType.simpleString()}, {target_id} {targets.schema[target_id].dataType.simpleString()}, d double"
    found = points.sparkSession.createDataFrame([], kinds)
    while targets.limit(1).count() and left.limit(1).count():
        pairs = points_in_circles(left, targets.withColumns({"cx": F.col("tx"), "cy": F.col("ty"), "r": F.lit(float(reach))}), reach)
        best = written(pairs.groupBy(point_id).agg(F.min(F.struct("d", target_id)).alias("b")).select(point_id, f"b.{target_id}", "b.d"), "nearest")
        found = found.unionByName(best)
        rest = written(left.join(best, point_id, "left_anti"), "points")
        discard(left)
        left, reach = rest, reach * 2
    return found


def nearest_segment_anywhere(points: DataFrame, segments: DataFrame, point_id: str, segment_id: str, reach: float) -> DataFrame:
    """``point_id, segment_id, d, t``: the nearest of ``segments`` of each point, however far; ties by id.

    As ``nearest_anywhere``: rounds of twice the reach, with the points alone that have found nothing yet.
    """
    left = written(points.select(point_id, "x", "y").dropna(), "points")
    segments = written(segments.select(segment_id, "x1", "y1", "x2", "y2").dropna(), "segments")
    kinds = f"{point_id} {points.schema[point_id].dataType.simpleString()}, {segment_id} {segments.schema[segment_id].dataType.simpleString()}, d double, t double"
    found = points.sparkSession.createDataFrame([], kinds)
    while segments.limit(1).count() and left.limit(1).count():
        best = written(nearest_segments(left, segments, point_id, segment_id, reach, k=1).select(point_id, segment_id, "d", "t"), "nearest")
        found = found.unionByName(best)
        rest = written(left.join(best, point_id, "left_anti"), "points")
        discard(left)
        left, reach = rest, reach * 2
    return found


def _beside_walls(paths: DataFrame, ends: list[Column], walls: DataFrame, size: float) -> DataFrame:
    """Pairs of paths and the walls ``wx1..wy2`` near their stretch ``ends``; a pair meets once.

    A wall goes to the one bucket of its middle, of a side by powers of two of ``size`` that is as long as the wall; a stretch goes to all
    buckets that it comes within half a side of, of each side that walls have.
    """
    w = [F.col(c) for c in ("wx1", "wy1", "wx2", "wy2")]
    extent = F.greatest(F.abs(w[2] - w[0]), F.abs(w[3] - w[1]))
    level = F.greatest(F.lit(-2.0), F.ceil(F.log2(F.greatest(extent, F.lit(1e-300)) / size)).cast("double"))
    placed = walls.withColumn("side", F.pow(F.lit(2.0), level) * size).withColumn("side", F.when(extent > F.col("side"), F.col("side") * 2).otherwise(F.col("side")))
    placed = placed.withColumns({"bx": bucket((w[0] + w[2]) / 2, F.col("side")), "by": bucket((w[1] + w[3]) / 2, F.col("side"))})
    sides = [r["side"] for r in placed.select("side").dropna().distinct().collect()]  # a few: one for each doubling of length
    dealt = paths.withColumn("side", F.explode(F.array(*map(F.lit, sides)).cast("array<double>")))
    return segment_buckets(dealt, *ends, F.col("side"), F.col("side") / 2).join(placed, ["side", "bx", "by"]).drop("side", "bx", "by")


def _crossed(pairs: DataFrame) -> DataFrame:
    """The pairs whose path ``x1..y2`` and wall ``wx1..wy2`` cross properly, with ``t``, the share of the path at the crossing."""
    p = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    w = [F.col(c) for c in ("wx1", "wy1", "wx2", "wy2")]
    a, b = geo.orient(*w, p[0], p[1]), geo.orient(*w, p[2], p[3])
    c, d = geo.orient(*p, w[0], w[1]), geo.orient(*p, w[2], w[3])
    return pairs.filter((a * b < 0) & (c * d <= 0)).withColumn("t", a / (a - b))


def crossings(paths: DataFrame, walls: DataFrame, path_id: str, wall_id: str, size: float) -> DataFrame:
    """Pairs of a path segment ``x1..y2`` and a wall ``wx1..wy2`` that cross properly; a touching start doesn't count.

    Adds ``t``, the share of the path at the crossing.
    """
    p = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    return _crossed(_beside_walls(paths.select(path_id, *p), p, walls, size)).select(path_id, wall_id, "t")


def first_crossings(paths: DataFrame, walls: DataFrame, path_id: str, size: float) -> DataFrame:
    """``path_id, t`` of the first of the ``crossings`` of each path that has any.

    Rounds look at the beginning of each path, then at four times as much and so on; a round carries on only paths that haven't met a wall
    so far, so where walls stand close together no path meets many that lie behind its first.
    """
    x1, y1, x2, y2 = p = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    left = written(paths.select(path_id, *p), "paths")
    far = left.agg(F.max(geo.distance(*p))).first()[0] or 0.0
    long = walls.agg(F.avg(geo.distance(*(F.col(f"w{c}") for c in ("x1", "y1", "x2", "y2"))))).first()[0] or 0.0
    reach = _first_reach(walls, F.col("wx1"), F.col("wy1"), float(far), 1, long) if far > 0 else 1.0
    found = None
    while left.limit(1).count():
        share = F.least(F.lit(1.0), F.try_divide(F.lit(float(reach)), geo.distance(*p)))
        begun = left.withColumn("share", F.coalesce(share, F.lit(1.0)))
        ends = [x1, y1, *(F.when(F.col("share") == 1, b).otherwise(a + (b - a) * F.col("share")) for a, b in ((x1, x2), (y1, y2)))]
        met = _crossed(_beside_walls(begun, ends, walls, size)).groupBy(path_id).agg(F.min("t").alias("t"), F.first("share").alias("share"))
        best = written(met.filter("share = 1 OR t < share * (1 - 1e-9)").select(path_id, "t"), "first")
        found = best if found is None else found.unionByName(best)
        rest = written(begun.filter("share < 1").join(best, path_id, "left_anti").select(path_id, *p), "paths")
        discard(left)
        left, reach = rest, reach * 4
    return left.select(path_id, F.lit(0.0).alias("t")) if found is None else found


def nearest_by_sector(points: DataFrame, targets: DataFrame, reach: float, point_id: str, target_id: str, k: int = 3) -> DataFrame:
    """The ``k`` nearest targets in each of eight bearings within ``reach``: adds ``sector, d, rank``.

    Rounds of growing reach; a point with ``k`` targets in every bearing is done.
    """
    sector = F.pmod(F.floor((F.degrees(F.atan2(F.col("ty") - F.col("y"), F.col("tx") - F.col("x"))) + 22.5) / 45), F.lit(8))
    order = Window.partitionBy(point_id, "sector").orderBy("d", target_id)

    def search(left: DataFrame, size: float) -> DataFrame:
        pairs = _met_within(left, targets, size).filter("d > 0").withColumn("sector", sector)
        return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def full(near: DataFrame, size: float) -> DataFrame:
        last = near.filter((F.col("rank") == k) & (F.col("d") < size * (1 - 1e-9)))
        return last.groupBy(point_id).count().filter("count = 8")

    return _in_rounds(points, point_id, reach, _first_reach(targets, F.col("tx"), F.col("ty"), reach, 8 * k), search, full)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, tolerance_seconds: float, value: str) -> DataFrame:
    """For each left row the last ``value`` of the right side with the same key at or before its time.

    One pass over the union of both sides in time order, so no pair of rows is ever formed.
    """
    both = left.withColumn("_r", F.lit(None).cast(f"struct<t:{right.schema[time].dataType.simpleString()},v:{right.schema[value].dataType.simpleString()}>")).withColumn("_side", F.lit(1))
    other = right.select(*[F.col(c) if c in (key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_r"), F.lit(0).alias("_side"))
    seen = F.last("_r", ignorenulls=True).over(Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = both.unionByName(other).withColumn("_last", seen).filter("_side = 1")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    fresh = micros(time) - micros("_last.t") <= int(tolerance_seconds * 1e6)
    return rows.withColumn(value, F.when(fresh, F.col("_last.v"))).drop("_r", "_side", "_last")
