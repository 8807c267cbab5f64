"""Shortest paths and itineraries as iterated joins."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, written


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A written table whose joins are merges: packed in its file it looks small enough to be sent through the driver, each round anew."""
    return written(df, name).hint("merge")


def shortest_paths(edges: DataFrame, sources: DataFrame, rounds: int | None = None, limits: DataFrame | None = None) -> DataFrame:
    """``source, node, cost``: least cost from each of ``sources`` (``source, node, cost``) along ``edges`` (``a, b, w``).

    Min-plus relaxation of the frontier: a round joins only the nodes that improved in the round before with their
    edges, keeps the minimum for each node, and writes the new costs.  It ends when nothing improves (or after
    ``rounds``, which then bounds the hops); the driver sees one number a round.  Weights must not be negative.
    With ``limits`` (``source, limit``) a source goes no farther than its limit, so many short searches in one don't flood the network.
    Edges are written once, and both sides of the join are plain scans, so hubs are split by the adaptive join.
    """
    edges = _kept(edges.select("a", "b", F.col("w").cast("double").alias("w")).dropna(), "edges")
    if limits is not None:
        limits = limits.hint("merge")
    best = written(sources.groupBy("source", "node").agg(F.min(F.col("cost").cast("double")).alias("cost")), "costs")
    frontier, done = best, 0
    while rounds is None or done < rounds:
        reached = frontier.join(edges, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("cost"))
        if limits is not None:
            reached = reached.join(limits, "source").filter(F.col("cost") <= F.col("limit")).drop("limit")
        both = reached.withColumn("old", F.lit(None).cast("double")).unionByName(best.withColumn("old", F.col("cost")))
        both = both.groupBy("source", "node").agg(F.min("cost").alias("cost"), F.min("old").alias("old"))
        both = written(both.withColumn("improved", F.col("old").isNull() | (F.col("cost") < F.col("old"))), "costs")
        discard(best)
        best, frontier, done = both.select("source", "node", "cost"), both.filter("improved").select("source", "node", "cost"), done + 1
        if not frontier.limit(1).count():
            break
    discard(edges)
    return best


def _walker() -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The search inside one part; made here so that workers get the function itself, not a name to import."""

    def walked(roads: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        """Searches inside one part from the labels that came in (``fresh``), each beyond what the part knew before.

        Gives the part's labels and those of the nodes of other parts that its roads lead to.
        """
        nodes, at = np.unique(np.concatenate([labels["node"], roads["a"], roads["b"]]), return_inverse=True)
        held, starts, ends = np.split(at, [len(labels), len(labels) + len(roads)])
        own = np.full(len(nodes), labels["part"].iloc[0])
        own[ends] = roads["pb"]
        here, order = (own == labels["part"].iloc[0]).tolist(), np.argsort(starts, kind="stable")
        first = np.searchsorted(starts[order], np.arange(len(nodes) + 1)).tolist()
        to, weight = ends[order].tolist(), roads["w"].to_numpy()[order].tolist()
        out = []
        for source, rows in labels.assign(at=held).groupby("source", sort=False):
            cost = [np.inf] * len(nodes)
            known = rows[~rows["fresh"]]
            for i, c in zip(known["at"].tolist(), known["cost"].tolist()):
                cost[i] = c
            came = rows[rows["fresh"]]
            heap = []
            for i, c in zip(came["at"].tolist(), came["cost"].tolist()):
                if c < cost[i]:
                    cost[i] = c
                    heap.append((c, i))
            heapq.heapify(heap)
            while heap:
                c, i = heapq.heappop(heap)
                if c > cost[i] or not here[i]:
                    continue
                for k in range(first[i], first[i + 1]):
                    j, there = to[k], c + weight[k]
                    if there < cost[j]:
                        cost[j] = there
                        heapq.heappush(heap, (there, j))
            cost = np.array(cost)
            met = np.isfinite(cost)
            out.append(pd.DataFrame({"source": source, "node": nodes[met], "part": own[met], "cost": cost[met], "fresh": ~np.array(here)[met]}))
        return pd.concat(out)

    return walked


def shortest_paths_by_parts(edges: DataFrame, sources: DataFrame, part: Callable[[Column], Column]) -> DataFrame:
    """What ``shortest_paths`` gives, for long ways through graphs that fall into ``part``s of bounded size with few edges between them.

    ``part`` is the number of a node's part.  A round searches inside all parts that labels came into, each in one group, and sends on what
    crosses to others, so there are about as many rounds as a way crosses parts, not as many as it has nodes.  Costs are the same sums in the same order.
    """
    edges = edges.select("a", "b", F.col("w").cast("double").alias("w")).dropna()
    edges = written(edges.withColumns({"pa": part(F.col("a")), "pb": part(F.col("b"))}), "edges")
    frontier = sources.groupBy("source", "node").agg(F.min(F.col("cost").cast("double")).alias("cost"))
    frontier = written(frontier.withColumn("part", part(F.col("node"))).select("source", "node", "part", "cost"), "frontier")
    best = written(frontier.limit(0), "costs")
    schema = f"source {dict(best.dtypes)['source']}, node {dict(best.dtypes)['node']}, part bigint, cost double, fresh boolean"
    while frontier.limit(1).count():
        active = frontier.select("part").distinct()
        labels = best.join(active, "part", "left_semi").withColumn("fresh", F.lit(False)).unionByName(frontier.withColumn("fresh", F.lit(True)))
        roads = edges.join(active.withColumnRenamed("part", "pa"), "pa", "left_semi")
        met = written(roads.groupBy("pa").cogroup(labels.groupBy("part")).applyInPandas(_walker(), schema), "met")
        kept = written(best.join(active, "part", "left_anti").select(*best.columns).unionByName(met.filter("NOT fresh").drop("fresh")), "costs")
        out = met.filter("fresh").groupBy("source", "node", "part").agg(F.min("cost").alias("cost"))
        old = kept.select("source", "node", F.col("cost").alias("old"))
        new = written(out.join(old, ["source", "node"], "left").filter("old IS NULL OR cost < old").select(*best.columns), "frontier")
        discard(best, frontier, met)
        best, frontier = kept, new
    discard(edges)
    return best.select("source", "node", "cost")


def labelled_search(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``node, source, cost``: of each node the source that reaches it soonest (the smallest of several) along ``edges`` (``a, b, w``).

    One label a node: a round relaxes only the nodes that changed, so the cost is that of one search, however many sources
    (``source, node, cost``) there are.
    """
    edges = written(edges.select("a", "b", F.col("w").cast("double").alias("w")).dropna(), "edges")
    label = F.struct(F.col("cost").cast("double").alias("cost"), "source").alias("label")
    best = written(sources.select("node", label).groupBy("node").agg(F.min("label").alias("label")), "labels")
    frontier = best
    while True:
        step = F.struct((F.col("label.cost") + F.col("w")).alias("cost"), F.col("label.source").alias("source")).alias("label")
        reached = frontier.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node"), step, F.lit(None).cast(best.schema["label"].dataType).alias("old"))
        both = reached.unionByName(best.withColumn("old", F.col("label"))).groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old"))
        both = written(both.withColumn("improved", F.col("old").isNull() | (F.col("label") < F.col("old"))), "labels")
        discard(best)
        best, frontier = both.select("node", "label"), both.filter("improved").select("node", "label")
        if not frontier.limit(1).count():
            discard(edges)
            return best.select("node", "label.source", "label.cost")


def ancestors(tree: DataFrame, starts: DataFrame) -> DataFrame:
    """``node``: the nodes that following ``node -> prev`` of ``tree`` from ``starts`` (``node``) meets, these included.

    By doubling: each round follows pointers twice as long, so a way of n steps takes log n rounds.
    """
    jumps = written(tree.filter("prev IS NOT NULL").select("node", "prev"), "jumps")
    met = written(starts.select("node").distinct(), "met")
    n = met.count()
    while True:
        new = written(met.join(jumps, "node").select(F.col("prev").alias("node")).unionByName(met).distinct(), "met")
        twice = written(jumps.join(jumps.toDF("prev", "further"), "prev").select("node", F.col("further").alias("prev")), "jumps")
        discard(met, jumps)
        met, jumps, now = new, twice, new.count()
        if now == n:
            discard(jumps)
            return met
        n = now


def street_network(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """``a, b, w``: a small part of undirected ``edges`` (``a, b, w``) that joins all ``terminals`` (``node``) that hang together.

    Each node belongs to its nearest terminal; two terminals are linked by the cheapest way over an edge between their
    regions; a least spanning forest of these links is taken, with the ways that its links stand for.  That costs at most
    twice the least, and every dead end is a terminal.
    """
    from waygrid.operators.network import spanning_links

    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = written(edges.filter("a <> b").groupBy(low.alias("a"), high.alias("b")).agg(F.min(F.col("w").cast("double")).alias("w")), "edges")
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "edges")
    found = written(labelled_search(both, terminals.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost"))), "labels")
    of = lambda c: found.select(F.col("node").alias(c), F.col("source").alias(f"s{c}"), F.col("cost").alias(f"c{c}"))
    met = edges.join(of("a"), "a").join(of("b"), "b")
    links = met.filter("sa <> sb").select(F.least("sa", "sb").alias("u"), F.greatest("sa", "sb").alias("v"), F.struct((F.col("ca") + F.col("w") + F.col("cb")).alias("over"), "a", "b", "w").alias("link"))
    links = written(links.groupBy("u", "v").agg(F.min("link").alias("link")), "links")
    taken = spanning_links(links.select("u", "v", F.col("link.over").alias("w"))).select("u", "v").join(links, ["u", "v"]).select("link.a", "link.b", "link.w")
    taken = written(taken, "taken")
    inside = both.join(of("a"), "a").join(of("b"), "b").filter((F.col("sa") == F.col("sb")) & (F.col("ca") + F.col("w") == F.col("cb")))
    tree = written(inside.groupBy(F.col("b").alias("node")).agg(F.min(F.struct("a", "w")).alias("best")).select("node", F.col("best.a").alias("prev"), "best.w"), "tree")
    nodes = ancestors(tree, taken.select(F.explode(F.array("a", "b")).alias("node")))
    ways = nodes.join(tree, "node").select(F.least("node", "prev").alias("a"), F.greatest("node", "prev").alias("b"), "w")
    return ways.unionByName(taken).distinct()


def predecessors(costs: DataFrame, edges: DataFrame) -> DataFrame:
    """``source, node, cost, prev``: the node before each on a cheapest way (the smallest of several); null at a source.

    ``costs`` is what ``shortest_paths`` gives; an edge is on a cheapest way if it makes up the whole difference.  One join
    after the search, so the search itself carries no ways.  Weights must be positive, or ways could turn in circles.
    """
    ends = costs.select(F.col("source").alias("_s"), F.col("node").alias("_n"), F.col("cost").alias("_c")).hint("merge")
    costs = costs.hint("merge")
    steps = costs.join(edges.select("a", "b", "w"), F.col("node") == F.col("a")).select("source", F.col("node").alias("prev"), F.col("b").alias("to"), (F.col("cost") + F.col("w")).alias("there"))
    steps = steps.join(ends, (F.col("source") == F.col("_s")) & (F.col("to") == F.col("_n")) & (F.col("there") == F.col("_c")))
    best = steps.groupBy(F.col("source").alias("_s"), F.col("to").alias("_n")).agg(F.min("prev").alias("prev"))
    return costs.join(best, (F.col("source") == F.col("_s")) & (F.col("node") == F.col("_n")), "left").select("source", "node", "cost", "prev")


def routes(costs: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target, seq, node, cost``: the nodes of a cheapest way to each of ``targets`` (``source, target``), from the start on.

    All ways are walked back together and by doubling: each round goes from every place found so far as many steps back as there have
    been, so the longest way of n nodes takes log n rounds.
    """
    key = ["source", "node"]
    tree = _kept(predecessors(costs, edges), "tree")
    jumps = _kept(tree.filter("prev IS NOT NULL").select(*key, "prev"), "jumps")
    rows = written(targets.select("source", "target", F.col("target").alias("node"), F.lit(0).alias("back")), "route")
    n, steps = rows.count(), 1
    while True:
        further = rows.join(jumps, key).select("source", "target", F.col("prev").alias("node"), (F.col("back") + steps).alias("back"))
        new = written(rows.unionByName(further), "route")
        twice = _kept(jumps.join(jumps.toDF("source", "prev", "further"), ["source", "prev"]).select(*key, F.col("further").alias("prev")), "jumps")
        discard(rows, jumps)
        rows, jumps, now, steps = new, twice, new.count(), steps * 2
        if now == n:
            break
        n = now
    discard(jumps)
    seq = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.desc("back")))
    return rows.join(tree.select(*key, "cost"), key).select("source", "target", seq.alias("seq"), "node", "cost")


#: Stops up to which every order is weighed.
EXACT_STOPS = 7


def best_orders(legs: DataFrame, most: int = EXACT_STOPS) -> DataFrame:
    """``trip, stops, total``: a cheap order of all stops of each trip, starting at stop 0.

    ``legs`` has ``trip, i, j, cost`` for ordered pairs of the stops 0..n.  Trips with up to ``most`` stops after the
    first get the cheapest order: partial orders with the same set and last stop keep only the cheapest, so a trip never
    has more than 2^n * n of them; equal totals take the smaller list of stops.  Longer trips get the nearest-neighbour
    order improved by 2-opt on the mean of both directions, but for the leg from the start.
    """
    legs = written(legs, "legs")
    sizes = written(legs.groupBy("trip").agg(F.max("i").cast("int").alias("n")), "sizes")
    short = legs.join(sizes.filter(F.col("n") <= most), "trip")
    state = short.filter("i = 0 AND j > 0").select("trip", "n", F.expr("shiftleft(1, CAST(j AS INT))").alias("seen"), F.col("j").alias("last"), "cost", F.array("j").alias("stops"))
    full = state.filter("n = 1")
    longest = min(most, sizes.agg(F.max("n")).first()[0] or 0)
    for done in range(2, longest + 1):
        step = state.filter(F.col("n") >= done).join(legs.select("trip", "i", F.col("j").alias("to"), F.col("cost").alias("leg")), "trip")
        step = step.filter("i = last AND to > 0 AND shiftright(seen, CAST(to AS INT)) % 2 = 0")
        step = step.select("trip", "n", F.expr("seen + shiftleft(1, CAST(to AS INT))").alias("seen"), F.col("to").alias("last"), (F.col("cost") + F.col("leg")).alias("cost"), F.concat("stops", F.array("to")).alias("stops"))
        step = step.groupBy("trip", "n", "seen", "last").agg(F.min(F.struct("cost", "stops")).alias("best")).select("trip", "n", "seen", "last", "best.cost", "best.stops")
        state = written(step, "orders")
        full = full.unionByName(state.filter(F.col("n") == done))
    exact = full.groupBy("trip").agg(F.min(F.struct("cost", "stops")).alias("best")).select("trip", F.col("best.stops").alias("stops"), F.col("best.cost").alias("total"))
    return exact.unionByName(_two_opt_orders(legs.join(sizes.filter(F.col("n") > most), "trip").select("trip", "i", "j", "cost")))


def worthwhile_orders(legs: DataFrame, gain: float, share: float) -> DataFrame:
    """``trip, stops, total, changed``: the order of ``best_orders``, or 1..n as it stands.

    A trip changes only if that saves at least ``gain`` and at least ``share`` of what its present order costs.  A trip
    that lacks a leg of its present order has nothing to keep and changes.
    """
    legs = written(legs, "legs")
    sizes = legs.groupBy("trip").agg(F.max("i").alias("n"))
    now = legs.filter("j = i + 1").groupBy("trip").agg(F.sum("cost").alias("now"), F.count("*").alias("known"))
    now = now.join(sizes, "trip").withColumn("now", F.when(F.col("known") == F.col("n"), F.col("now"))).drop("known")
    met = best_orders(legs).join(now, "trip", "left")
    better = F.col("now").isNull() | (F.col("total") <= F.col("now") - F.greatest(F.lit(float(gain)), F.col("now") * share))
    stands = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: k.cast(legs.schema["j"].dataType))
    met = met.withColumn("changed", better & ~((F.col("stops") == stands) & F.col("now").isNotNull()))
    return met.select("trip", F.when(F.col("changed"), F.col("stops")).otherwise(stands).alias("stops"), F.when(F.col("changed"), F.col("total")).otherwise(F.col("now")).alias("total"), "changed")


def _two_opt_orders(legs: DataFrame) -> DataFrame:
    """``trip, stops, total`` of trips with many stops; a trip is one itinerary typed by a person, handled by one call."""
    import numpy as np
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in legs.schema.fields}

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(max(rows["i"].max(), rows["j"].max())) + 1
        cost = np.zeros((n, n))
        cost[rows["i"].astype(int), rows["j"].astype(int)] = rows["cost"]
        mean, way, left = (cost + cost.T) / 2, [0], set(range(1, n))
        mean[0] = cost[0]  # from the start there is one way only
        while left:
            way.append(min(left, key=lambda j: (mean[way[-1], j], j)))
            left.remove(way[-1])
        better = True
        while better:  # an open way: its end has no leg after it
            better = False
            for i in range(1, n - 1):
                for j in range(i + 1, n):
                    after = mean[way[j], way[j + 1]] - mean[way[i], way[j + 1]] if j + 1 < n else 0.0
                    if mean[way[i - 1], way[i]] - mean[way[i - 1], way[j]] + after > 1e-9:
                        way[i : j + 1] = way[i : j + 1][::-1]
                        better = True
        total = float(sum(cost[a, b] for a, b in zip(way, way[1:])))
        return pd.DataFrame({"trip": rows["trip"].iloc[:1], "stops": [way[1:]], "total": [total]})

    return legs.groupBy("trip").applyInPandas(order, f"trip {kinds['trip']}, stops array<{kinds['j']}>, total double")


def loop_orders(stops: DataFrame) -> DataFrame:
    """``trip, seq, stop``: a closed tour of each trip's stops (``trip, stop, x, y``), by nearest neighbour and 2-opt.

    A trip is one small group (an itinerary typed by a person), handled by one call in a task.
    """
    import numpy as np
    import pandas as pd

    def tour(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("stop").reset_index(drop=True)
        at = rows[["x", "y"]].to_numpy(float)
        d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
        left, order = set(range(1, len(at))), [0]
        while left:
            order.append(min(left, key=lambda j: (d[order[-1], j], j)))
            left.remove(order[-1])
        n, improved, passes = len(order), True, 0
        while improved and passes < 50:
            improved, passes = False, passes + 1
            for i in range(n - 1):
                for j in range(i + 2, n - (i == 0)):
                    a, b, c, e = order[i], order[i + 1], order[j], order[(j + 1) % n]
                    if d[a, c] + d[b, e] < d[a, b] + d[c, e] - 1e-9:
                        order[i + 1 : j + 1] = order[i + 1 : j + 1][::-1]
                        improved = True
        return pd.DataFrame({"trip": rows["trip"].iloc[0], "seq": range(n), "stop": rows["stop"].to_numpy()[order]})

    kinds = {f.name: f.dataType.simpleString() for f in stops.schema.fields}
    return stops.groupBy("trip").applyInPandas(tour, f"trip {kinds['trip']}, seq bigint, stop {kinds['stop']}")
