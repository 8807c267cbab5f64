"""Traced lines, cuts, links, orders and late rows against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from waygrid.operators import network, ordered, raster
from waygrid.plans import paths
from waygrid.streaming import replay


def test_lines_of_a_ring_with_a_tail(spark):
    ring = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 2), (3, 1), (2, 0), (1, 0)]
    alone = [(9, 9), (20, 1), (20, 2), (20, 3)]
    loop = [(r + 40, c) for r, c in ring]
    cells = spark.createDataFrame([*ring, (0, 4), (-1, 5), *alone, *loop, *loop], "r long, c long")
    got = {r["line"]: r for r in raster.traced_lines(cells).collect()}
    lone = [r for r in got.values() if r["cells"] == 1 and r["a"] >> 31 == 20]
    assert len(lone) == 1 and (lone[0]["a"] & (2**31 - 1), lone[0]["b"] & (2**31 - 1)) == (1, 3) and lone[0]["length"] == 2.0
    rings = [r for r in got.values() if r["a"] == r["b"] == r["line"]]
    assert [(r["cells"], round(r["length"], 6)) for r in rings] == [(8, round(4 + 4 * 2**0.5, 6))]
    assert raster.traced_lines(spark.createDataFrame([], "r long, c long")).count() == 0


def _cuts(z, s, tolerance):
    known = [v for v in z if v is not None]
    ends = {0: z[0] if z[0] is not None else (known or [None])[0], len(z) - 1: z[-1] if z[-1] is not None else (known or [None])[-1]}
    value = lambda k: ends.get(k, z[k])
    cut, todo = {0, len(z) - 1}, [(0, len(z) - 1)]
    while todo:
        a, b = todo.pop()
        if value(a) is None or value(b) is None:
            continue
        off = [(abs(z[k] - (value(a) + (value(b) - value(a)) * (s[k] - s[a]) / (s[b] - s[a]))), -k) for k in range(a + 1, b) if z[k] is not None]
        if off and max(off)[0] > tolerance:
            at = -max(off)[1]
            cut.add(at)
            todo += [(a, at), (at, b)]
    return cut


def test_cuts_equal_recursion(spark):
    deal = random.Random(5)
    lines = {n: [None if deal.random() < 0.2 else float(deal.randrange(20)) for _ in range(n)] for n in (1, 2, 3, 9, 30)} | {6: [None] * 6}
    rows = [(n, k, float(k * k + k), v) for n, z in lines.items() for k, v in enumerate(z)]
    df = spark.createDataFrame(rows, "line long, k long, s double, z double")
    got = {}
    for r in ordered.cut_where_bent(df, ["line"], "k", "s", "z", 1.5).filter("cut").collect():
        got.setdefault(r["line"], set()).add(r["k"])
    assert got == {n: _cuts(z, [float(k * k + k) for k in range(n)], 1.5) for n, z in lines.items()}
    assert ordered.cut_where_bent(df.limit(0), ["line"], "k", "s", "z", 1.5).count() == 0


def test_few_links_equal_the_greedy_loop(spark):
    deal = random.Random(8)
    links = sorted({(float(deal.randrange(9)), a, b) for _ in range(300) for a, b in [sorted(deal.sample(range(30), 2))]})
    had, want = dict.fromkeys(range(30), 0), set()
    for w, a, b in links:
        if had[a] < 3 and had[b] < 3:
            want.add((a, b, w))
            had[a] += 1
            had[b] += 1
    df = spark.createDataFrame([(a, b, w) for w, a, b in links], "u long, v long, w double")
    assert {tuple(r) for r in network.few_links(df.unionByName(df), 3).collect()} == want
    assert network.few_links(df.limit(0), 3).count() == 0


def test_orders_change_only_for_a_gain(spark):
    at = {1: [0, 10, 20, 30], 2: [0, 30, 10, 20], 3: [0, 100, 99, 98.5]}
    legs = [(t, i, j, float(abs(a - b))) for t, x in at.items() for i, a in enumerate(x) for j, b in enumerate(x) if i != j]
    got = {r["trip"]: r for r in paths.worthwhile_orders(spark.createDataFrame(legs, "trip long, i int, j int, cost double"), 15, 0.1).collect()}
    assert {t: (r["changed"], r["stops"], r["total"]) for t, r in got.items()} == {1: (False, [1, 2, 3], 30.0), 2: (True, [2, 3, 1], 30.0), 3: (False, [1, 2, 3], 101.5)}


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d, 12)
    for batch in ([(day(1), 1), (day(20), 2)], [(day(19), 3), (day(3), 4)], [(day(2), 5), (day(28), 6)]):
        spark.createDataFrame(batch, "ts timestamp, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = stream.withWatermark("ts", "3 days").groupBy(F.window("ts", "1 day")).agg(F.collect_list("v").alias("v"))
    got = sorted(v for r in replay.run_to_end(counts).collect() for v in r["v"])
    assert got == [1, 2, 3, 4]  # a batch drops rows behind the watermark of the batch before its own: 5 is too late, 4 isn't; the last window is open
