"""Road networks as node and edge tables: degrees, clean-up, connection to roads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waygrid.functions import geo
from waygrid.operators.spatial import _first_reach, in_buckets, point_buckets
from waygrid.plans.components import connected_components
from waygrid.plans.scratch import discard, written


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree`` of undirected ``edges`` (``a, b``)."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def incident(edges: DataFrame) -> DataFrame:
    """``node, others``: the sorted neighbours of each node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"))
    return ends.select("e.*").distinct().groupBy("node").agg(F.array_sort(F.collect_list("other")).alias("others"))


def junctions(edges: DataFrame) -> DataFrame:
    return degrees(edges).filter("degree >= 3")


def without_spurs(edges: DataFrame, length: float, rounds: int = 1) -> DataFrame:
    """``rounds`` of pruning: edges that end at a dead end and are shorter than ``length`` go; lone edges stay."""
    for _ in range(rounds):
        ends = degrees(edges)
        a, b = (ends.select(F.col("node").alias(c), F.col("degree").alias(f"d{c}")) for c in ("a", "b"))
        met = edges.join(a, "a").join(b, "b")
        spur = (F.least("da", "db") == 1) & (F.greatest("da", "db") > 1) & (F.col("w") < length)
        edges = written(met.filter(~spur).select(*edges.columns), "pruned")
    return edges


def without_stubs(edges: DataFrame, cut: DataFrame, length: float, rounds: int = 3) -> DataFrame:
    """``rounds`` of taking away edges shorter than ``length`` whose dead end is one of the nodes that ``cut`` (``node``) made."""
    cut = cut.select("node").distinct().withColumn("cut", F.lit(True))
    for _ in range(rounds):
        ends = degrees(edges).join(cut, "node", "left").select("node", ((F.col("degree") == 1) & F.col("cut").isNotNull()).alias("stub"))
        a, b = (ends.select(F.col("node").alias(c), F.col("stub").alias(f"s{c}")) for c in ("a", "b"))
        gone = (F.col("w") < length) & (F.col("sa") | F.col("sb"))
        edges = written(edges.join(a, "a").join(b, "b").filter(~gone).select(*edges.columns), "pruned")
    return edges


def contracted(edges: DataFrame, salt: int = 0) -> DataFrame:
    """One round of joining through nodes of degree two: ``a, b, w``.

    Of two neighbouring such nodes only the one of smaller hash under ``salt`` is taken out, so rounds never compete for an edge.
    """
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), F.col(c).alias("n"))
    deg = degrees(edges).filter("degree = 2").select("node")
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    ways = both.join(deg, F.col("a") == F.col("node")).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "w"))).alias("ways"))  # two each
    rival = both.join(deg, F.col("a") == F.col("node")).select("a", "b").join(deg.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min(rank("b")).alias("rival"))
    chosen = ways.join(rival, "a", "left").filter(F.col("rival").isNull() | (rank("a") < F.col("rival"))).filter("ways[0].b <> ways[1].b")
    gone = chosen.select(F.col("a").alias("gone"))
    joined = chosen.select(F.col("ways")[0]["b"].alias("a"), F.col("ways")[1]["b"].alias("b"), (F.col("ways")[0]["w"] + F.col("ways")[1]["w"]).alias("w"))
    kept = edges.select("a", "b", "w").join(gone, F.col("a") == F.col("gone"), "left_anti").join(gone, F.col("b") == F.col("gone"), "left_anti")
    return kept.unionByName(joined)


def contracted_fully(edges: DataFrame) -> DataFrame:
    """``contracted`` until no round takes out an edge.

    Each round draws new ranks, and about a third of a chain's nodes rank below both neighbours, so a chain of n nodes takes
    some log n rounds however its nodes are named.
    """
    edges = written(edges.select("a", "b", "w"), "edges")
    n, salt = edges.count(), 0
    while True:
        new, salt = written(contracted(edges, salt), "contracted"), salt + 1
        discard(edges)
        left = new.count()
        if left == n:
            return new
        edges, n = new, left


def hanging(ways: DataFrame, drops: DataFrame, keep: DataFrame) -> DataFrame:
    """``piece`` of the pieces of two-way ``ways`` (``a, b``) that are left only by one-way ``drops`` (``a, b``) and that nothing leads into.

    Pieces that hold a node of ``keep`` stay.
    """
    piece = written(connected_components(ways), "pieces")
    of = lambda c, name: piece.select(F.col("node").alias(c), F.col("component").alias(name))
    moves = drops.select("a", "b").join(of("a", "src"), "a").join(of("b", "dst"), "b").filter("src <> dst").select("src", "dst")
    held = moves.select(F.col("dst").alias("piece")).unionByName(keep.select("node").join(piece, "node").select(F.col("component").alias("piece")))
    return moves.select(F.col("src").alias("piece")).distinct().join(held, "piece", "left_anti")


def closest_links(points: DataFrame, group: str, reach: float) -> DataFrame:
    """``u, v, w``: a least spanning forest over all groups of ``points`` (``group, x, y``), each link as long as the closest pair of its groups.

    Pairs are looked for within ``reach`` first; groups that this leaves apart are looked for within twice the reach, and so on.  From
    the second round on, only points outside of the largest piece look for others, and never inside their own piece.
    """
    places = points.select(F.col(group).alias("g"), "x", "y").dropna().distinct()
    names = written(places.select("g").distinct().select("g", F.col("g").alias("piece")), "groups")
    places, taken = written(places, "places"), None
    while names.select("piece").distinct().limit(2).count() > 1:
        placed = places.join(names, "g")
        most = placed.groupBy("piece").count().orderBy(F.desc("count"), "piece").first()["piece"]
        looking = placed.filter(F.col("piece") != F.lit(most)) if taken is not None else placed
        left = in_buckets(looking, F.col("x") - reach, F.col("x") + reach, F.col("y") - reach, F.col("y") + reach, reach)
        right = point_buckets(placed.toDF("o_g", "o_x", "o_y", "o_piece"), reach, "o_x", "o_y")
        w = geo.distance(F.col("x"), F.col("y"), F.col("o_x"), F.col("o_y"))
        pairs = left.join(right, ["bx", "by"]).filter("piece <> o_piece").withColumn("w", w).filter(F.col("w") <= reach)
        closest = pairs.groupBy(F.least("g", "o_g").alias("gu"), F.greatest("g", "o_g").alias("gv")).agg(F.min("w").alias("w"))
        of = lambda c: names.select(F.col("g").alias(f"g{c}"), F.col("piece").alias(c))
        links = closest.join(of("u"), "gu").join(of("v"), "gv")
        # Of pieces each pair is linked once, by its shortest pair of groups.
        one = written(links.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct("w", "gu", "gv")).alias("link")), "closest")
        forest = spanning_links(one.select("u", "v", F.col("link.w").alias("w")))
        now = written(forest.select("u", "v").join(one, ["u", "v"]).select("link.gu", "link.gv", "link.w"), "taken")
        reach *= 2
        if not now.limit(1).count():
            continue
        taken = now if taken is None else taken.unionByName(now)
        joined = connected_components(taken, "gu", "gv")
        names = written(names.select("g").join(joined.select(F.col("node").alias("g"), "component"), "g", "left").select("g", F.coalesce("component", "g").alias("piece")), "groups")
    if taken is None:
        return points.sparkSession.createDataFrame([], f"u {dict(names.dtypes)['g']}, v {dict(names.dtypes)['g']}, w double")
    return taken.select(F.col("gu").alias("u"), F.col("gv").alias("v"), "w")


def without_small(edges: DataFrame, length: float) -> DataFrame:
    """Edges of components whose edges add up to ``length`` at least."""
    found = connected_components(edges).withColumnRenamed("node", "a")
    met = edges.join(found, "a")
    large = met.groupBy("component").agg(F.sum("w").alias("total")).filter(F.col("total") >= length).select("component")
    return met.join(large, "component", "left_semi").select(*edges.columns)


def merged_close(nodes: DataFrame, edges: DataFrame, length: float) -> tuple[DataFrame, DataFrame]:
    """Nodes ``node, x, y`` joined by edges shorter than ``length`` become one, at their mean; edges within it go.

    Gives nodes (named by the smallest of each group) and edges; of parallel edges the shortest stays.
    """
    groups = connected_components(edges.filter(F.col("w") < length))
    named = written(nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    places = named.groupBy(F.col("component").alias("node")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    of = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"new_{c}"))
    moved = edges.join(of("a"), "a").join(of("b"), "b").filter("new_a <> new_b")
    return places, moved.groupBy(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).agg(F.min("w").alias("w"))


def spanning_links(candidates: DataFrame) -> DataFrame:
    """Links ``u, v, w`` of a least spanning forest over groups: each group takes its cheapest link to another, groups that are
    linked become one, and so on.

    Each round at least halves the groups.  Links are told apart by ``w, u, v``, so the forest is the only one.
    """
    pairs = candidates.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("w").cast("double").alias("w")).filter("u <> v")
    open_ = written(pairs.groupBy("u", "v").agg(F.min("w").alias("w")).select("u", "v", "w", F.col("u").alias("gu"), F.col("v").alias("gv")), "links")
    taken = None
    while open_.limit(1).count():
        ends = open_.select(F.explode(F.array("gu", "gv")).alias("g"), F.struct("w", "u", "v", "gu", "gv").alias("link"))
        best = written(ends.groupBy("g").agg(F.min("link").alias("link")).select("link.*").distinct(), "taken")
        taken = best if taken is None else taken.unionByName(best)
        joined = connected_components(best, "gu", "gv")
        of = lambda g: joined.select(F.col("node").alias(g), F.col("component").alias(f"new_{g}"))
        left = open_.join(of("gu"), "gu").join(of("gv"), "gv").filter("new_gu <> new_gv")
        left = written(left.select("u", "v", "w", F.col("new_gu").alias("gu"), F.col("new_gv").alias("gv")), "links")
        discard(open_)
        open_ = left
    return open_.select("u", "v", "w") if taken is None else taken.select("u", "v", "w")


def _ends(links: DataFrame) -> DataFrame:
    """``end, had``: how many of ``links`` each end has."""
    return links.select(F.explode(F.array("u", "v")).alias("end")).groupBy("end").agg(F.count("*").alias("had"))


def few_links(links: DataFrame, most: int, begun: DataFrame | None = None) -> DataFrame:
    """The shortest links ``u, v, w`` taken one by one in order of ``w, u, v``, as long as both ends have fewer than ``most``.

    ``begun`` (``end, had``) says how many links ends have already.

    Settled in rounds: a link that stands, among the undecided ones of either end, within what that end may still take is
    taken whatever becomes of the others; a full end's links go.  The shortest one left always settles.
    """
    left, taken = written(links.select("u", "v", "w").dropna().distinct(), "links"), None
    while left.limit(1).count():
        ends = left.select("u", "v", "w", F.explode(F.array("u", "v")).alias("end"))
        had = begun if taken is None else _ends(taken) if begun is None else _ends(taken).unionByName(begun).groupBy("end").agg(F.sum("had").alias("had"))
        ends = ends.withColumn("had", F.lit(0)) if had is None else ends.join(had, "end", "left").fillna(0, ["had"])
        place = F.row_number().over(Window.partitionBy("end").orderBy("w", "u", "v")) + F.col("had")
        told = ends.withColumns({"full": F.col("had") >= most, "sure": place <= most}).groupBy("u", "v", "w")
        told = written(told.agg(F.bool_and("sure").alias("sure"), F.bool_or("full").alias("full")), "told")
        now = told.filter("sure").select("u", "v", "w")
        taken = now if taken is None else taken.unionByName(now)
        discard(left)
        left = written(told.filter("NOT sure AND NOT full").select("u", "v", "w"), "links")
    return left if taken is None else taken


def few_links_within(points: DataFrame, point_id: str, reach: float, most: int) -> DataFrame:
    """``few_links`` of all pairs of ``points`` (``point_id, x, y``) no more than ``reach`` apart.

    Rounds of growing reach: links that are longer come after all shorter ones, so a round meets only points that
    shorter links have left with fewer than ``most``, and no others are ever paired.
    """
    left = written(points.select(F.col(point_id).alias("u"), "x", "y"), "points")
    size, low, taken = _first_reach(left, F.col("x"), F.col("y"), reach, most), -1.0, None
    while True:
        x, y = F.col("x"), F.col("y")
        near = in_buckets(left, x - size, x + size, y - size, y + size, size)
        w = geo.distance(x, y, F.col("o_x"), F.col("o_y"))
        links = near.join(point_buckets(left.toDF("v", "o_x", "o_y"), size, "o_x", "o_y"), ["bx", "by"]).withColumn("w", w)
        links = links.filter((F.col("u") < F.col("v")) & (F.col("w") <= size) & (F.col("w") > low)).select("u", "v", "w")
        now = few_links(links, most, None if taken is None else _ends(taken))
        taken = now if taken is None else written(taken.unionByName(now), "taken")
        if size >= reach:
            return taken
        rest = written(left.join(_ends(taken).filter(F.col("had") >= most), F.col("u") == F.col("end"), "left_anti"), "points")
        discard(left)
        left, low, size = rest, size, size * 2
