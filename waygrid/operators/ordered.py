"""Ordered scans as window operators: runs and islands, linear referencing, path measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygrid.functions import geo
from waygrid.plans.scratch import discard, written


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the stretches of each group; ``starts`` is true where a new one begins."""
    w = Window.partitionBy(*by).orderBy(*order)
    flag = F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0)
    return df.withColumn("_starts", flag).withColumn(name, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_starts")


def runs(df: DataFrame, by: list[str], position: str, value: str) -> DataFrame:
    """Run-length encoding: ``*by, first, last, value`` of the maximal equal runs in position order."""
    w = Window.partitionBy(*by).orderBy(position)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w))
    marked = islands(df.withColumn("_changed", changed), by, [position], F.col("_changed"))
    return marked.groupBy(*by, "island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.first(value).alias(value)).drop("island")


def steps(df: DataFrame, by: list[str], order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Adds ``step``, the distance from the point before (null at the first), and ``along``, its running sum."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = geo.distance(F.lag(x).over(w), F.lag(y).over(w), F.col(x), F.col(y))
    df = df.withColumn("step", step)
    return df.withColumn("along", F.sum(F.coalesce("step", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def split_where_far(df: DataFrame, by: list[str], order: list[str], gap: float) -> DataFrame:
    """Adds ``part``: a path is cut before each point farther than ``gap`` from the one before."""
    return islands(steps(df, by, order), by, order, F.col("step") > gap, "part")


def points_at(lines: DataFrame, asked: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Linear referencing: for each ``at`` of ``asked`` the point of the line there, clamped to its ends.

    ``lines`` has points ``x, y``; both share the columns ``by``.  One pass over both sides in order of the distance
    along the line, so no pair of a place and a leg is formed.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    ends = {"nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "until": F.lead("along").over(w)}
    marked = steps(lines, by, order).withColumns(ends)
    leg = F.struct("along", "until", "x", "y", "nx", "ny").alias("_leg")
    legs = marked.select(*by, F.col("along").alias("_s"), F.lit(0).alias("_side"), F.struct(*order).alias("_order"), leg)
    legs = legs.withColumn("_asked", F.lit(None).cast(asked.select(F.struct(*asked.columns).alias("a")).schema["a"].dataType))
    places = asked.select(*by, F.greatest(F.lit(0.0), "at").alias("_s"), F.lit(1).alias("_side"), F.struct(*asked.columns).alias("_asked"))
    both = legs.unionByName(places, allowMissingColumns=True)
    last = F.last("_leg", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_s", "_side", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.withColumn("_leg", last).filter("_side = 1 AND _leg IS NOT NULL").select("_asked.*", "_leg", "_s")
    share = F.when(F.col("_leg.until") > F.col("_leg.along"), (F.col("_s") - F.col("_leg.along")) / (F.col("_leg.until") - F.col("_leg.along"))).otherwise(0.0)
    lerp = lambda a, b: F.col(a) + share * (F.coalesce(b, a) - F.col(a))
    return met.select(*asked.columns, lerp("_leg.x", "_leg.nx").alias("px"), lerp("_leg.y", "_leg.ny").alias("py"))


def in_runs(rows: DataFrame, encoded: DataFrame, by: list[str], position: str, value: str) -> DataFrame:
    """Adds ``value`` of the run ``first..last`` that holds each row's position; null where none does.

    Runs of a group don't overlap, so the last one that starts at or before a row is the only one in question: one
    ordered pass over both sides, and no range join.
    """
    held = F.struct(F.col("last").alias("last"), F.col(value).alias("v")).alias("_run")
    runs_ = encoded.select(*by, F.col("first").alias("_at"), F.lit(0).alias("_side"), held)
    asked = rows.select(*by, F.col(position).alias("_at"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"))
    both = runs_.unionByName(asked, allowMissingColumns=True)
    last = F.last("_run", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.withColumn("_run", last).filter("_side = 1")
    return met.select("_row.*", F.when(F.col("_at") <= F.col("_run.last"), F.col("_run.v")).alias(value))


def padded_stretches(samples: DataFrame, by: list[str], order: str, off: str) -> DataFrame:
    """The stretches of samples that are ``off`` the network, each with one sample of padding on either side."""
    w = Window.partitionBy(*by).orderBy(order)
    near = F.coalesce(F.lag(off).over(w), F.lit(False)) | F.col(off) | F.coalesce(F.lead(off).over(w), F.lit(False))
    kept = samples.withColumns({"_kept": near, "_before": F.lag(off).over(w), "_after": F.lead(off).over(w)}).filter("_kept")
    gap = Window.partitionBy(*by).orderBy(order)
    return islands(kept, by, [order], (F.col(order) - F.lag(order).over(gap) > 1) | (~F.col(off) & F.col("_after")), "stretch").drop("_kept", "_before", "_after")


def draw_up(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The largest rise of ``value`` over its minimum so far, of each group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_low", F.min(value).over(w)).groupBy(*by).agg(F.max(F.col(value) - F.col("_low")).alias("rise"))


def ahead_count(df: DataFrame, by: list[str], along: str, reach: float, counted: Column) -> DataFrame:
    """Adds ``ahead``: how many rows for which ``counted`` holds lie from here to ``reach`` further along."""
    w = Window.partitionBy(*by).orderBy(along).rangeBetween(Window.currentRow, reach)
    return df.withColumn("ahead", F.count_if(counted).over(w))


def cut_where_bent(samples: DataFrame, by: list[str], order: str, along: str, value: str, tolerance: float) -> DataFrame:
    """Adds ``cut``: true at the ends of each line and where it must be cut so that ``value`` runs straight between cuts.

    Each round cuts every piece at its sample farthest from straight, the first of equals, if that is farther than
    ``tolerance``.  Samples without a value are never cut at; an end without one takes the next that is known.
    """
    w = Window.partitionBy(*by).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = F.coalesce(value, F.first(value, ignorenulls=True).over(after), F.last(value, ignorenulls=True).over(before))
    state = samples.withColumns({"cut": F.lag(F.lit(1)).over(w).isNull() | F.lead(F.lit(1)).over(w).isNull(), "_known": known})
    state = written(state, "cuts")
    n = state.filter("cut").count()
    while True:
        end = F.when(F.col("cut"), F.struct(F.col(along).alias("s"), F.col("_known").alias("v")))
        ends = {"_a": F.last(end, ignorenulls=True).over(before), "_b": F.first(end, ignorenulls=True).over(after), "_piece": F.count_if("cut").over(before)}
        span = F.col("_b.s") - F.col("_a.s")
        line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(along) - F.col("_a.s")) / span
        off = F.when(~F.col("cut") & (span > 0), F.abs(F.col(value) - line))
        first = F.row_number().over(Window.partitionBy(*by, "_piece").orderBy(F.col("_off").desc_nulls_last(), order)) == 1
        new = state.withColumns(ends).withColumn("_off", off)
        new = written(new.withColumn("cut", F.col("cut") | (first & F.coalesce(F.col("_off") > tolerance, F.lit(False)))).select(*state.columns), "cuts")
        discard(state)
        state, found = new, new.filter("cut").count()
        if found == n:
            return state.drop("_known")
        n = found
