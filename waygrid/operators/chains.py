"""Lines as ordered points: list ranking by pointer doubling over edges that hang together in chains and rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.plans.components import connected_components
from waygrid.plans.scratch import discard, written


def ordered_chains(links: DataFrame) -> DataFrame:
    """``chain, seq, node, closed``: the nodes of each chain of undirected ``links`` (``a, b``) in order, from 0 on.

    No node may have more than two neighbours.  A chain is named by its smallest node and starts at the smaller of its two
    ends; a ring (``closed``) starts at its smallest node and goes to the smaller neighbour first.  A loop alone is a
    node without neighbours.

    Each link is two steps, one each way, and a step knows the step before it.  A round lets every step jump as far back again as
    it has come, so a chain of n nodes takes log n rounds of one equi-join, whatever its length; both ways are ranked together
    and the one that comes from the start is kept.
    """
    pairs = links.select("a", "b").dropna()
    parts = written(connected_components(pairs), "parts")
    steps = pairs.filter("a <> b")
    steps = written(steps.union(steps.select("b", "a")).distinct().toDF("u", "v"), "steps")
    sides = written(steps.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).select("u", "low", "high", (F.col("low") == F.col("high")).alias("end")), "sides")
    of_part = parts.join(sides, F.col("node") == F.col("u"), "left")
    first = F.min(F.when(F.col("end"), F.col("node")))
    starts = of_part.groupBy("component").agg(first.alias("end"), F.min("node").alias("least")).select("component", F.coalesce("end", "least").alias("start"), F.col("end").isNull().alias("closed"))
    starts = written(starts.join(sides.select(F.col("u").alias("start"), F.col("low").alias("second")), "start", "left"), "starts")
    alone = starts.filter("second IS NULL").select(F.col("component").alias("chain"), F.col("start").alias("node"), F.lit(0).cast("bigint").alias("seq"), F.lit(False).alias("closed"))
    # The step before (u, v) comes to u from its other neighbour; none comes before a step out of the start.
    begins = starts.select(F.col("start").alias("u"), F.lit(True).alias("begins"))
    before = F.when(~F.col("end") & F.col("begins").isNull(), F.when(F.col("low") == F.col("v"), F.col("high")).otherwise(F.col("low")))
    at = steps.join(sides, "u").join(begins, "u", "left").select("u", "v", before.alias("pu"))
    # pu, pv: the step that this one points back to; n: how many steps lie between.
    at = written(at.select("u", "v", "pu", F.when(F.col("pu").isNotNull(), F.col("u")).alias("pv"), F.col("pu").isNotNull().cast("bigint").alias("n"), F.coalesce("pu", "u").alias("ru"), F.when(F.col("pu").isNotNull(), F.col("u")).otherwise(F.col("v")).alias("rv")), "ranks")
    while at.filter("pu IS NOT NULL").limit(1).count():
        back = at.select(F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("pu").alias("_pu"), F.col("pv").alias("_pv"), F.col("n").alias("_n"), F.col("ru").alias("_ru"), F.col("rv").alias("_rv"))
        going = at.filter("pu IS NOT NULL").join(back, (F.col("pu") == F.col("_u")) & (F.col("pv") == F.col("_v")))
        moved = going.select("u", "v", F.col("_pu").alias("pu"), F.col("_pv").alias("pv"), (F.col("n") + F.col("_n")).alias("n"), F.col("_ru").alias("ru"), F.col("_rv").alias("rv"))
        new = written(at.filter("pu IS NULL").unionByName(moved), "ranks")
        discard(at)
        at = new
    right = at.join(starts.filter("second IS NOT NULL"), (F.col("ru") == F.col("start")) & (F.col("rv") == F.col("second")))
    placed = right.filter("v <> start").select(F.col("component").alias("chain"), F.col("v").alias("node"), (F.col("n") + 1).alias("seq"), "closed")
    heads = starts.filter("second IS NOT NULL").select(F.col("component").alias("chain"), F.col("start").alias("node"), F.lit(0).cast("bigint").alias("seq"), "closed")
    return placed.unionByName(heads).unionByName(alone).select("chain", "seq", "node", "closed")
