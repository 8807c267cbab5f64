"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform) turns each unit vector; its hash is
the nearest signed axis.  A table's bucket joins the axes of ``depth`` rotations, so that the number of buckets grows
with the number of rows and a bucket stays at some ``ROOM`` rows.  A query probes the buckets that it misses by least,
over all tables at once; candidates are ranked by their exact distance on the original vectors.

How many buckets are probed is measured: for a sample of at most ``SAMPLE`` queries the exact neighbours are found by
comparison with all rows, and the number is the least that reaches a share of ``RECALL`` of them.  On clustered
vectors, and the more of them there are, the fewer buckets that takes.  So is the depth: the number of rows proposes it, and
where its probes can't reach that share (a query combines its ``AXES`` nearest axes only) one rotation less is
taken.  With one rotation every bucket can be probed, which is a comparison with all rows if need be.

Buckets are split on both sides into blocks of bounded size, each a matrix product in one task, so a bucket that holds
a third of all rows or is asked by a third of all queries is more blocks and not a longer task.  A block answers each
probing query with its own nearest rows only, so what leaves it grows with the queries.  Equal vectors are one
candidate: at most ``k + 1`` of the smallest ids of a vector can ever be in an answer, and these are put back at the end.

Cases: vectors that are null or empty, zero, of another length than the index, or that hold null or non-finite
components take no part as query or candidate; a null id neither; ties go to the smaller id; with fewer
candidates than ``k`` all that are found are returned; an empty table gives an empty one; extra columns are
ignored; rows that repeat id and vector count once, and an id with several vectors counts with its nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Tables, rows and queries of one block, rows that a bucket should have, the most rotations of a bucket.
TABLES, BLOCK, ASKED, ROOM, DEEPEST = 12, 4096, 512, 4096, 3
#: Nearest axes of a rotation that probes may combine, by depth.
AXES = {1: 1 << 20, 2: 64, 3: 24}
#: Queries whose exact neighbours are looked up, and the share of these neighbours that probing has to reach.
SAMPLE, RECALL = 128, 0.96


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n = x.shape[1]
    half = 1
    while half < n:
        x = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        half *= 2
    return x / np.sqrt(n)


def projections(x: np.ndarray, rotation: int) -> np.ndarray:
    """Signed projections on the axes of one rotation, unit vectors padded to a power of two: +e1.. then -e1.."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng(1000 + rotation)
    turned = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, width - x.shape[1])))
    for _ in range(3):
        turned = hadamard(turned * rng.choice([-1.0, 1.0], width))
    return np.hstack([turned, -turned])


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def depth_for(rows: int, axes: int) -> int:
    """Rotations of a bucket, for buckets of some ``ROOM`` rows."""
    depth = 1
    while depth < DEEPEST and rows > ROOM * axes**depth:
        depth += 1
    return depth


def own_buckets(x: np.ndarray, table: int, depth: int) -> np.ndarray:
    """The bucket of each row in one table."""
    bucket = np.zeros(len(x), np.int64)
    for level in range(depth):
        p = projections(x, table * DEEPEST + level)
        bucket = bucket * p.shape[1] + p.argmax(axis=1)
    return bucket * TABLES + table


def probes(row: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all tables that a vector can probe, by the squares of what it misses their axes by; least first."""
    buckets, misses = [], []
    for table in range(TABLES):
        bucket, miss = np.zeros(1, np.int64), np.zeros(1)
        for level in range(depth):
            p = projections(row[None], table * DEEPEST + level)[0]
            near = np.argsort(-p, kind="stable")[: AXES[depth]]
            bucket = (bucket[:, None] * len(p) + near).reshape(-1)
            miss = (miss[:, None] + (p[near[0]] - p[near]) ** 2).reshape(-1)
        buckets.append(bucket * TABLES + table)
        misses.append(miss)
    bucket, miss = np.concatenate(buckets), np.concatenate(misses)
    order = np.argsort(miss, kind="stable")
    return bucket[order], miss[order]


def _indexed(rows: DataFrame, depth: int) -> DataFrame:
    """``id, vector`` to ``bucket, id, vector``, one row for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(1))
                for table in range(TABLES):
                    yield pa.RecordBatch.from_arrays([pa.array(own_buckets(x, table, depth)), *batch.columns], names=["bucket", "id", "vector"])

    return rows.select("id", "vector").mapInArrow(run, f"bucket bigint, {_columns(rows)}")


def _probing(asked: DataFrame, depth: int, most: int) -> DataFrame:
    """``id, vector`` to ``bucket, id, vector``, one row for each of the ``most`` buckets missed by least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                x = _vectors(batch.column(1).slice(at, 16))
                near = [probes(row, depth)[0][:most] for row in x]
                taken = batch.slice(at, 16).take(pa.array(np.repeat(np.arange(len(x)), list(map(len, near)))))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(near)), *taken.columns], names=["bucket", "id", "vector"])

    return asked.select("id", "vector").mapInArrow(run, f"bucket bigint, {_columns(asked)}")


def _columns(rows: DataFrame) -> str:
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "vector"))


def _closest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``q`` the places of the ``most`` nearest rows of ``x`` (ties by ``ids``) and their exact distances.

    A matrix product picks those that can be among them; distances are taken of the differences themselves.
    """
    at = np.argsort(ids, kind="stable")
    x = x[at]
    square, last = (x * x).sum(axis=1), min(most, len(x)) - 1
    for row, near in zip(q, square - 2 * (q @ x.T)):
        edge = np.partition(near, last)[last]
        close = np.nonzero(near <= edge + 1e-9 * (1 + abs(edge) + square.max()))[0]
        exact = np.sqrt(((x[close] - row) ** 2).sum(axis=1))
        best = np.argsort(exact, kind="stable")[:most]
        yield at[close[best]], exact[best]


def probes_needed(rows: DataFrame, asked: DataFrame, depth: int, k: int) -> tuple[int, int]:
    """The depth, at most ``depth``, and how many probes reach a share of ``RECALL`` of the exact neighbours of a sample of queries.

    The sample goes to all rows, each task of which passes on its nearest ones only; the driver sees the sample and
    ``k`` neighbours of each.
    """
    sample = asked.select("id", "vector").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not sample:
        return depth, 1
    q = np.array([r["vector"] for r in sample], float)
    sent = rows.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty((0, q.shape[1])), np.empty(0))] * len(sent.value)
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(1))
                for n, (at, exact) in enumerate(_closest(x, np.arange(len(x)), sent.value, k + 1)):
                    vectors, scores = np.vstack([held[n][0], x[at]]), np.append(held[n][1], exact)
                    best = np.argsort(scores, kind="stable")[: k + 1]
                    held[n] = vectors[best], scores[best]
        sizes = [len(scores) for _, scores in held]
        vectors = pa.array([v for vectors, _ in held for v in vectors], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(held)), sizes).astype(np.int32)), pa.array(np.concatenate([scores for _, scores in held])), vectors], names=["n", "score", "vector"])

    found = rows.select("id", "vector").mapInArrow(run, "n int, score double, vector array<double>")
    rank = F.row_number().over(Window.partitionBy("n").orderBy("score", "vector"))
    found = found.filter("score > 0").withColumn("rank", rank).filter(F.col("rank") <= k).select("n", "vector").toArrow()
    if not found.num_rows:
        return depth, 1
    x, n = _vectors(found["vector"].combine_chunks()), found["n"].to_numpy()
    while True:
        own = [own_buckets(x, table, depth) for table in range(TABLES)]
        needed = np.full(len(x), np.inf)
        for i, row in enumerate(q):
            place = {bucket: rank for rank, bucket in enumerate(probes(row, depth)[0].tolist(), 1)}
            for j in np.nonzero(n == i)[0]:
                needed[j] = min(place.get(int(o[j]), np.inf) for o in own)
        most = np.sort(needed)[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]
        if np.isfinite(most):
            return depth, int(most)
        depth -= 1  # at depth one nothing is out of reach


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", depth: int | None = None) -> DataFrame:
    """``query_id, rank, <key>, score``: for each row of ``queries`` (rows of ``vectors``) the nearest rows found.

    ``depth`` is the depth to begin with, by default that for the number of rows.
    """

    def usable(df: DataFrame) -> DataFrame:
        df = df.select(df[key].alias("id"), df[vector].alias("vector")).filter("id is not null and size(vector) > 0")
        good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
        return df.filter(good)

    rows, asked = usable(vectors), usable(queries).distinct()
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = length["n"] if length else 0
    rows, asked = (df.filter(F.size("vector") == size) for df in (rows, asked))
    # One candidate for each distinct vector; the smallest id stands for it.
    kind = vectors.schema[key].dataType.simpleString()
    print_ = F.sha2(F.concat_ws(",", F.transform("vector", lambda x: (x + 0.0).cast("string"))), 256)
    rows = rows.withColumn("print", print_)
    prints = written(rows.select("id", "print").distinct(), "prints")
    stands = written(prints.groupBy("print").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "stands")
    standing = written(rows.join(stands.select("print", "id"), ["print", "id"]).select("id", "vector").distinct(), "standing")
    asked = written(asked, "asked")
    depth, most = probes_needed(standing, asked, depth or depth_for(standing.count(), 2 << max(1, (size - 1).bit_length())), k)
    index = written(_indexed(standing, depth), "index")
    probing = written(_probing(asked, depth, most), "probing")
    parts = lambda df, most, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = written(parts(index, BLOCK, "blocks").join(parts(probing, ASKED, "groups"), "bucket"), "buckets")
    one_of = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = F.struct("bucket", "part", "group").alias("block")
    placed = index.join(sizes, "bucket").withColumn("part", one_of("blocks")).withColumn("group", all_of("groups")).select(block, "id", "vector")
    asking = probing.join(sizes, "bucket").withColumn("group", one_of("groups")).withColumn("part", all_of("blocks")).select(block, "id", "vector")

    def answer(candidates: pa.Table, questions: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        types = [questions.schema.field("id").type, candidates.schema.field("id").type, pa.float64()]
        if not candidates.num_rows or not questions.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        x, q = (_vectors(t["vector"].combine_chunks()) for t in (candidates, questions))
        ids = np.asarray(candidates["id"].to_pylist(), dtype=object)
        got_q, got_i, got_s = [], [], []
        for (at, exact), query in zip(_closest(x, ids, q, k + 1), questions["id"].to_pylist()):
            got_q += [query] * len(at)
            got_i += ids[at].tolist()
            got_s += exact.tolist()
        return pa.Table.from_arrays([pa.array(got_q, types[0]), pa.array(got_i, types[1]), pa.array(got_s, types[2])], names=names)

    found = placed.groupBy("block").cogroup(asking.groupBy("block")).applyInArrow(answer, f"query_id {kind}, id {kind}, score double")
    found = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    # At most k + 1 distinct vectors matter to a query, and of each the k + 1 smallest ids.
    first = Window.partitionBy("query_id").orderBy("score", "id")
    found = written(found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k + 1).select("query_id", "id", "score"), "found")
    copied = stands.filter("copies > 1").join(found.select("id").distinct(), "id", "left_semi").select("print", F.col("id").alias("stand"))
    copies = prints.join(copied.select("print"), "print", "left_semi")
    smallest = _smallest(copies, k + 1).join(copied, "print").select("stand", F.col("id").alias("copy"))
    smallest = smallest.groupBy("stand").agg(F.collect_list("copy").alias("ids"))  # at most k + 1 each
    out = found.join(smallest, F.col("id") == F.col("stand"), "left").select("query_id", "score", F.explode(F.coalesce("ids", F.array("id"))).alias("id"))
    out = out.filter("id <> query_id").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(key), "score")


def _smallest(copies: DataFrame, most: int) -> DataFrame:
    """The ``most`` smallest ids of each print, chosen in salted parts first, so that a hot print isn't one task's."""
    for part in (F.pmod(F.xxhash64("id"), F.lit(256)), F.lit(0).cast("bigint")):
        copies = copies.withColumn("part", part)
        rank = F.row_number().over(Window.partitionBy("print", "part").orderBy("id"))
        copies = copies.withColumn("rank", rank).filter(F.col("rank") <= most).select("print", "id")
    return copies
