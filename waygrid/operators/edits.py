"""Roads drawn one after the other: what is left of each, as stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygrid.operators.spatial import TASK_ROWS, bucket, segment_buckets
from waygrid.plans.scratch import discard, written


def with_stretch(pairs: DataFrame, a: list[str], b: list[str], reach: float) -> DataFrame:
    """Adds ``lo, hi``, the shares of segment ``a`` between which it lies within ``reach`` of segment ``b``; null where it never does.

    What is near a segment is convex, so this is one stretch: from the least to the greatest share at which ``a`` is near either end
    of ``b`` or runs beside it.  The sums are columns of steps, each worked out once a pair: as one expression they grow too
    large to be compiled.
    """
    ax, ay, bx, by = (F.col(x) for x in a)
    cx, cy, ex, ey = (F.col(x) for x in b)
    c = {n: F.col(f"_{n}") for n in "dx dy ux uy long wide h1 h2 rest1 rest2 root1 root2 side lo1 hi1 lo2 hi2 c0 c1 p0 p1 alo ahi blo bhi lo3 hi3".split()}
    far = lambda px, py: (ax - px) * (ax - px) + (ay - py) * (ay - py) - reach * reach

    def between(at0: Column, slope: Column, low: Column, high: Column) -> tuple[Column, Column]:
        """Shares for which ``at0 + t * slope`` lies between two values."""
        p, q = F.try_divide(low - at0, slope), F.try_divide(high - at0, slope)
        always = (at0 >= low) & (at0 <= high)
        return F.when(slope == 0, F.when(always, 0.0)).otherwise(F.least(p, q)), F.when(slope == 0, F.when(always, 1.0)).otherwise(F.greatest(p, q))

    across, along = between(c["c0"], c["c1"], -c["side"], c["side"]), between(c["p0"], c["p1"], F.lit(0.0), c["wide"])
    both = c["alo"].isNotNull() & c["blo"].isNotNull()
    steps = [
        {"dx": bx - ax, "dy": by - ay, "ux": ex - cx, "uy": ey - cy},
        {"long": c["dx"] * c["dx"] + c["dy"] * c["dy"], "wide": c["ux"] * c["ux"] + c["uy"] * c["uy"], "h1": c["dx"] * (ax - cx) + c["dy"] * (ay - cy), "h2": c["dx"] * (ax - ex) + c["dy"] * (ay - ey)},
        {"rest1": c["h1"] * c["h1"] - c["long"] * far(cx, cy), "rest2": c["h2"] * c["h2"] - c["long"] * far(ex, ey), "side": reach * F.sqrt(c["wide"])},
        {f"root{i}": F.when((c[f"rest{i}"] >= 0) & (c["long"] > 0), F.sqrt(F.greatest(c[f"rest{i}"], F.lit(0.0)))) for i in (1, 2)}
        | {"c0": c["ux"] * (ay - cy) - c["uy"] * (ax - cx), "c1": c["ux"] * c["dy"] - c["uy"] * c["dx"], "p0": c["ux"] * (ax - cx) + c["uy"] * (ay - cy), "p1": c["ux"] * c["dx"] + c["uy"] * c["dy"]},
        {f"lo{i}": F.try_divide(-c[f"h{i}"] - c[f"root{i}"], c["long"]) for i in (1, 2)} | {f"hi{i}": F.try_divide(-c[f"h{i}"] + c[f"root{i}"], c["long"]) for i in (1, 2)}
        | {"alo": across[0], "ahi": across[1], "blo": along[0], "bhi": along[1]},
        {"lo3": F.when(both, F.greatest(c["alo"], c["blo"])), "hi3": F.when(both, F.least(c["ahi"], c["bhi"]))},
    ]
    for step in steps:
        pairs = pairs.withColumns({f"_{n}": v for n, v in step.items()})
    parts = [c[f"lo{i}"] <= c[f"hi{i}"] for i in (1, 2, 3)]
    pairs = pairs.withColumns({f"_{e}": f(*(F.when(p, c[f"{e}{i}"]) for i, p in enumerate(parts, 1))) for e, f in (("lo", F.least), ("hi", F.greatest))})
    # Greatest and least pass over nulls, so a pair that is nowhere near must be kept out of them.
    lo, hi = F.when(F.col("_lo").isNotNull(), F.greatest(F.lit(0.0), F.col("_lo"))), F.when(F.col("_hi").isNotNull(), F.least(F.lit(1.0), F.col("_hi")))
    return pairs.withColumns({"lo": lo, "hi": hi}).drop("_lo", "_hi", *(f"_{n}" for n in c))


#: Later edits that a road meets in the first look at its tile; each look takes four times as many.
LATEST = 64


def surviving(edits: DataFrame, reach: float, cosine: float) -> DataFrame:
    """``id, s1, s2``: the stretches left of each drawn road, as shares of it to six places.

    ``edits`` has ``id, level, erases, x1, y1, x2, y2``; ids rise with time.  A later eraser takes what lies within ``reach`` of
    it on its level, a later road what lies so near and is about parallel.  What was taken doesn't come back, whatever
    happens to the later road, so the log needs no replay: the stretches that later edits cover are joined by a sweep
    along each road, and what they leave open is the result.

    A road goes to the tile of its middle, which is as long as the road, an edit to each tile from which a road may come near it, so a
    pair meets once and the sweep is made where it met.  A look takes the last edits of each tile; the next one, of more of them, is for roads
    alone that still have an open stretch and later edits that weren't looked at, so where roads are drawn over each other no road meets all of them.
    """
    c, late = _columns(""), _columns("l_")
    x1, y1, x2, y2 = ends = [F.col(x) for x in c]
    extent = F.greatest(F.abs(x2 - x1), F.abs(y2 - y1), F.lit(2.0 * reach))
    side = F.pow(F.lit(2.0), F.ceil(F.log2(extent / (2 * reach))).cast("double")) * (2 * reach)
    side = F.when(extent > side, side * 2).otherwise(side)
    tile = F.xxhash64("side", "bx", "by").alias("tile")  # tiles that share a number only meet more edits
    key = ["tile", "level"]
    placed = edits.filter("NOT erases").select("id", "level", *c).withColumn("side", side)
    placed = placed.withColumns({"bx": bucket((x1 + x2) / 2, F.col("side")), "by": bucket((y1 + y2) / 2, F.col("side"))})
    left = written(placed.select("id", "level", *c, "side", tile), "roads")
    sides = [r["side"] for r in left.select("side").dropna().distinct().collect()]  # a few: one for each doubling of length
    dealt = edits.select(F.col("id").alias("l_id"), "level", "erases", *(F.col(x).alias(f"l_{x}") for x in c))
    # Edits of many rows lie in few files; each is dealt to several tiles.
    dealt = dealt.repartition(edits.count() // TASK_ROWS + 1).withColumn("side", F.explode(F.array(*map(F.lit, sides)).cast("array<double>")))
    dealt = segment_buckets(dealt, *(F.col(x) for x in late), F.col("side"), F.col("side") / 2 + reach).select("l_id", "level", "erases", *late, tile)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("l_id")))
    near = (F.col("tile") == F.col("l_tile")) & (F.col("level") == F.col("l_level")) & (F.col("l_id") > F.col("id"))
    box, l_box = {}, {}
    for v in "xy":
        box |= {f"low{v}": F.least(f"{v}1", f"{v}2") - reach, f"high{v}": F.greatest(f"{v}1", f"{v}2") + reach}
        l_box |= {f"l_low{v}": F.least(f"l_{v}1", f"l_{v}2"), f"l_high{v}": F.greatest(f"l_{v}1", f"l_{v}2")}
        near = near & (F.col(f"l_low{v}") <= F.col(f"high{v}")) & (F.col(f"l_high{v}") >= F.col(f"low{v}"))
    dx, dy, ux, uy = x2 - x1, y2 - y1, F.col("l_x2") - F.col("l_x1"), F.col("l_y2") - F.col("l_y1")
    near = near & (F.col("erases") | (F.abs(dx * ux + dy * uy) >= cosine * F.sqrt(dx * dx + dy * dy) * F.sqrt(ux * ux + uy * uy)))
    sweep = Window.partitionBy(*key, "id").orderBy("lo", "hi")
    open_, through = (F.coalesce(F.max("hi").over(sweep.rowsBetween(Window.unboundedPreceding, n)), F.lit(0.0)) for n in (-1, 0))
    most, found = LATEST, None
    while True:
        seen = dealt if found is None else dealt.join(left.select(*key).distinct(), key, "left_semi")
        seen = written(seen.withColumn("nth", nth).filter(F.col("nth") <= most + 1), "edits")
        further = seen.filter(F.col("nth") == most + 1).select(*key, F.col("l_id").alias("further"))
        later = seen.drop("nth").withColumnsRenamed({k: f"l_{k}" for k in key}).withColumns(l_box)
        met = left.withColumns(box).join(further.hint("merge"), key, "left").join(later.hint("merge"), near, "left")
        met = with_stretch(met.select(*key, "id", "further", *c, *late), c, late, reach)
        # A pair that isn't near after all covers nothing.
        covers = F.col("lo") <= F.col("hi")
        met = met.select(*key, "id", "further", *(F.when(covers, F.round(e, 6)).otherwise(0.0).alias(e) for e in ("lo", "hi")))
        swept = met.withColumns({"open": open_, "through": through, "last": F.lead("id").over(sweep).isNull()})
        gaps = F.array(F.when((F.col("lo") < F.col("hi")) & (F.col("open") < F.col("lo")), F.struct(F.col("open").alias("s1"), F.col("lo").alias("s2"))), F.when(F.col("last") & (F.col("through") < 1), F.struct(F.col("through").alias("s1"), F.lit(1.0).alias("s2"))))
        looked = written(swept.select("id", "further", F.explode(F.filter(gaps, lambda g: g.isNotNull())).alias("g")).select("id", "further", "g.s1", "g.s2"), "stretches")
        kept = looked.filter("further IS NULL OR further <= id").select("id", "s1", "s2")
        found = kept if found is None else found.unionByName(kept)
        rest = written(left.join(looked.filter("further > id").select("id").distinct().hint("merge"), "id", "left_semi").select(*left.columns), "roads")
        discard(left, seen)
        left, most = rest, most * 4
        if not left.limit(1).count():
            discard(left)
            return found


def _columns(before: str) -> list[str]:
    return [f"{before}{x}" for x in ("x1", "y1", "x2", "y2")]
