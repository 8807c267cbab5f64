"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A text is described by a fixed list of statistics (lengths, symbol and case shares, repetition, stop words).
Cosines of random projections of the standardised statistics approximate a Gaussian kernel; the normal equations
of the ridge fit are summed inside each partition, then in two steps over partitions, so that the driver only
ever sees one matrix.  Raw scores are mapped to probabilities by isotonic regression on scores that a fit without
their own fold gives.

The fit reads all labelled rows that it is given; statistics and scores are computed from whole texts.  Labels,
language, source and key are never inputs.

Cases: a null or empty text has zero statistics and scores as such; without labelled rows, or with one class
only, every score is the base rate (0 without labels); rows with equal texts get equal scores; an empty table
gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, written
from .html import STOP_WORDS

#: Random features, ridge strength, kernel width in standard deviations, folds of the calibration, score bins.
FEATURES, RIDGE, WIDTH, FOLDS, BINS = 384, 1e-3, 3.0, 3, 2000

STATISTICS = (
    "log_chars log_words log_lines mean_word mean_line upper_share digit_share letter_share space_share punct_share symbol_share pipe_share "
    "exclaim_share hash_share odd_end_share repeated_words top_word_share repeat_pair_share repeated_lines stop_share capital_word_share long_word_share end_mark_share lost_entropy"
).split()

_letters = re.compile(r"[^\W\d_]")
_upper = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_symbol = re.compile(r"[#$%&*@^~<>{}\[\]\\=+_|/]")
_odd_end = re.compile(r"(?:[#$%&*@^~=+_|]{1,3}|!!)(?=\s|$)")


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` for a whole text, made so that a very short text isn't an extreme one."""
    text = text or ""
    words = text.split()
    n, chars, lines = len(words), len(text), [x for x in text.split("\n") if x.strip()]
    if not n:
        return [float(np.log1p(chars))] + [0.0] * (len(STATISTICS) - 1)
    counts = Counter(words)
    letters, upper = len(_letters.findall(text)), len(_upper.findall(text))
    digits = sum(map(text.count, "0123456789"))
    space = sum(map(text.count, " \n\t"))
    top = counts.most_common(1)[0][1]
    probs = np.fromiter(counts.values(), float, len(counts)) / n
    return [
        float(np.log1p(chars)),
        float(np.log1p(n)),
        float(np.log1p(len(lines))),
        letters / (n + 2),
        float(np.log1p(n / len(lines))),
        upper / (letters + 20),
        digits / chars,
        letters / chars,
        space / chars,
        sum(map(text.count, ".,;:?'\"-")) / chars,
        len(_symbol.findall(text)) / chars,
        text.count("|") / n,
        text.count("!") / n,
        text.count("#") / n,
        len(_odd_end.findall(text)) / n,
        1 - len(counts) / n,
        (top - 1) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        sum(c for w, c in counts.items() if w.strip(".,").lower() in STOP_WORDS) / n,
        sum(c for w, c in counts.items() if w[0].isupper()) / (n + 5),
        sum(c for w, c in counts.items() if len(w) > 20) / n,
        sum(c for w, c in counts.items() if w[-1] in ".?!") / (n + 5),
        float((np.log(n) + (probs * np.log(probs)).sum()) / np.log(n + 1)),
    ]


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, stats`` of every row: one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["key", "stats"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, stats array<double>")


class FourierMap:
    """Standardise, project at random, take cosines; a constant comes last."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(7)
        self.mean, self.deviation = mean, np.where(deviation > 1e-12, deviation, 1.0)
        self.directions = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.shift), np.ones((len(z), 1))])


def _stats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(STATISTICS))


def _normal_equations(rows: DataFrame, spread: FourierMap) -> list[np.ndarray]:
    """For each fold, the sums of x'x and x'y over ``stats, label, fold``, as one matrix of two blocks.

    Each task sums its own rows; sums meet in 32 groups of partitions, then in one sum per fold.  A sum has a fixed
    size, and each row of a fold's matrix is a row of the exchange, so no task takes more than its share.
    """
    size = FEATURES + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            x, y, part = spread(_stats(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for f in range(FOLDS):
                own = x[part == f]
                sums[f] += own.T @ np.hstack([own, y[part == f, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS * size), pa.int32()), pa.array(list(sums.reshape(FOLDS * size, -1)), pa.list_(pa.float64()))], names=["line", "sums"])

    def total(lines: pa.Table) -> pa.Table:
        summed = _matrix(lines["sums"]).sum(axis=0)
        return pa.table({"line": lines["line"].slice(0, 1), "sums": pa.array([summed], pa.list_(pa.float64()))})

    parts = rows.select("stats", F.col("label").cast("double").alias("label"), "fold").mapInArrow(partial, "line int, sums array<double>")
    lines = parts.withColumn("part", F.spark_partition_id() % 32)
    lines = lines.groupBy("line", "part").applyInArrow(total, "line int, sums array<double>").groupBy("line").applyInArrow(total, "line int, sums array<double>")
    got = lines.orderBy("line").toArrow()
    return list(_matrix(got["sums"]).reshape(FOLDS, size, size + 1)) if got.num_rows else []


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy().reshape(len(column), -1)


def _solved(sums: np.ndarray) -> np.ndarray:
    gram, right = sums[:, :-1], sums[:, -1]
    penalty = RIDGE * max(1.0, gram[-1, -1]) * np.eye(len(gram)) / FEATURES
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(gram + penalty, right)


def isotonic(score: np.ndarray, positive: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted score bins: edges and non-decreasing probabilities."""
    pools: list[list[float]] = []
    for s, p, c in zip(score, positive, count):
        pools.append([s, p, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            s2, p2, c2 = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][2] + s2 * c2) / (pools[-1][2] + c2), pools[-1][1] + p2, pools[-1][2] + c2]
    return np.array([x[0] for x in pools]), np.array([x[1] / x[2] for x in pools])


def _scored(rows: DataFrame, spread: FourierMap, weights: list[np.ndarray], carried: str, names: list[str], curve: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Adds ``raw``: the score by the weights of the row's fold, put through the calibration curve if there is one.

    One Python pass does both: a task with two would hold two workers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = spread(_stats(batch.column(0)))
            part = batch.column(1).to_numpy()
            raw = (x * np.stack(weights)[part]).sum(axis=1)
            raw = np.interp(raw, *curve) if curve else raw
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(raw)], names=[*names, "raw"])

    return rows.select("stats", "fold", *names).mapInArrow(run, f"{carried}, raw double")


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Fit on the rows that ``labels`` names and score all: ``key, score, predicted``."""
    stats = written(described(docs, key, text), "stats")
    kind = stats.schema["key"].dataType.simpleString()
    named = labels.select(labels[key].alias("key"), labels[label].alias("label")).dropna().groupBy("key").agg(F.max("label").alias("label"))
    rows = stats.join(named, "key").withColumn("fold", F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int"))
    rows = written(rows, "labelled")
    moments = rows.agg(
        F.count("*").alias("n"), F.sum("label").alias("positive"), *[f(F.col("stats")[i]).alias(f"{a}{i}") for i in range(len(STATISTICS)) for a, f in (("m", F.avg), ("d", F.stddev_pop))]
    ).first()
    n, positive = moments["n"], moments["positive"] or 0
    if positive in (0, n):
        score = F.lit(float(positive / n) if n else 0.0)
        return stats.select(F.col("key").alias(key), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    spread = FourierMap(*(np.array([moments[f"{a}{i}"] for i in range(len(STATISTICS))]) for a in "md"))
    sums = _normal_equations(rows, spread)
    everything = sum(sums)
    without = [_solved(everything - s) for s in sums]
    binned = _scored(rows, spread, without, "label int", ["label"]).groupBy(F.round(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) * BINS / 3).alias("bin"))
    bins = binned.agg(F.avg("raw").alias("raw"), F.sum("label").alias("positive"), F.count("*").alias("n")).orderBy("bin").toArrow()
    curve = isotonic(*(bins[c].to_numpy().astype(float) for c in ("raw", "positive", "n")))
    out = _scored(stats.withColumn("fold", F.lit(0)), spread, [_solved(everything)], f"key {kind}", ["key"], curve)
    return out.select(F.col("key").alias(key), F.col("raw").alias("score"), (F.col("raw") >= threshold).cast("int").alias("predicted"))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the labelled rows outside the held-out fold and score all rows: ``key, held_out, score, predicted``."""
    remainder = fold(F.col(key), folds)
    out = score_quality(spark, docs, labels.filter(remainder != held_out), key, text)
    return out.select(key, F.coalesce(remainder == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
