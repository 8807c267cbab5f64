"""Counterfactual-regularised toxicity classifier.

A logistic model over hashed words and word stems says how likely a text is toxic.  Besides its log loss the fit
penalises, for each labelled sentence that names an identity group, the squared change of the score when the
group is swapped for another one of the same kind.  So weight moves from the group's name to what is said about
it, and neutral mentions stop being false positives.

The fit reads at most ``SAMPLE`` labelled rows, chosen by a hash of their key (a documented bound: the model has
a few thousand parameters); scoring reads every whole text of every row, in one pass without a shuffle.
Labels, language, source and key are never inputs of a score.

Bounds: the model keeps at most ``KEPT`` of the hashed features that differ by ``CLEAR`` standard deviations.

Cases: a null or empty text scores as a text without words does (the base rate); without any labelled row, or
with one class only, every score is the base rate (0 without labels); repeated rows get equal scores; an empty
table gives an empty one; ties don't arise, as each row has its own score.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import trim
from .common import fold, worker_state, written

#: Labelled rows that a fit may read, hashed features, and features that a model keeps.
SAMPLE, SPACE, KEPT = 12_000, 1 << 20, 20_000
#: Strength of the counterfactual penalty and of the quadratic one; standard deviations by which a kept feature's rates differ.
SWAP_PENALTY, RIDGE, CLEAR = 4.0, 1e-5, 3.0
#: Weight of a positive row: missing one is worse than keeping a close call.
POSITIVE = 2.0
#: Words that a worker remembers.
MEMO = 300_000

# Names of groups, by kind; a name is swapped for the others of its list.
IDENTITY_GROUPS = (
    "women men girls boys females males trans nonbinary".split(),
    "woman man girl boy female male transgender".split(),
    "muslims christians jews hindus buddhists atheists catholics".split(),
    "muslim christian jewish hindu buddhist atheist catholic".split(),
    "gay lesbian bisexual straight homosexual heterosexual queer".split(),
    "black white asian latino hispanic arab african indian mexican chinese".split(),
    "immigrants refugees foreigners natives citizens".split(),
    "disabled deaf blind autistic".split(),
    "frauen männer mädchen jungen".split(),
    "muslime christen juden hindus".split(),
    "femmes hommes filles garçons".split(),
    "musulmans chrétiens juifs".split(),
    "mujeres hombres niñas niños".split(),
    "musulmanes cristianos judíos".split(),
)
SWAPS = {w: [x for x in group if x != w] for group in IDENTITY_GROUPS for w in group}
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")


def word_slots(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and its first five and six letters, so that unseen endings count."""
    parts = ["=" + word] + [f"<{word[:n]}" for n in (5, 6) if len(word) >= n]
    return tuple(xxhash.xxh3_64_intdigest(p) % SPACE for p in parts)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature slots of a whole text."""
    words = set(WORD.findall((text or "").lower()))
    known: dict[str, tuple[int, ...]] = worker_state("toxicity words", dict)
    trim(known, MEMO // 3)
    for word in words.difference(known):
        known[word] = word_slots(word)
    return np.sort(np.fromiter(set(chain.from_iterable(map(known.__getitem__, words))), np.int32))


def swapped(text: str | None) -> list[tuple[tuple[int, ...], tuple[int, ...], int]]:
    """What each swap of a group's name changes in its sentence: slots that go, slots that come, and how often.

    Only these slots are worked out: a name's own slots go where no other word of the sentence has them.  Swaps of one
    sentence that change the same are one entry, so a sentence gives no more entries than there are pairs of names.
    """
    found: Counter = Counter()
    for sentence in SENTENCE.findall((text or "").lower()):
        words = Counter(WORD.findall(sentence))
        named = words.keys() & SWAPS.keys()
        if not named:
            continue
        held = Counter(chain.from_iterable(map(word_slots, words)))
        for word in named:
            left = words[word] > 1
            gone = frozenset(s for s in word_slots(word) if held[s] == 1 and not left)
            for other in SWAPS[word]:
                new = frozenset(s for s in word_slots(other) if not held[s] or s in gone)
                if gone != new:
                    found[tuple(sorted(gone - new)), tuple(sorted(new - gone))] += words[word]
    return [(*change, n) for change, n in sorted(found.items())]


class Rows:
    """Sparse 0/1 rows over chosen columns."""

    def __init__(self, slots: list[np.ndarray], column: np.ndarray):
        at = [column[s] for s in slots]
        at = [a[a >= 0] for a in at]
        self.count = len(at)
        self.row = np.repeat(np.arange(len(at)), [len(a) for a in at])
        self.col = np.concatenate(at) if at else np.empty(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.count)

    def back(self, v: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, v[self.row], width)


def chosen_slots(seen: np.ndarray, classes: tuple[int, int], pairs: list[tuple]) -> np.ndarray:
    """Features whose rates in the two classes differ most clearly, and those that a swap touches.

    ``seen`` has the rows of each class with each slot; ``classes`` is the number of rows of each class.
    """
    total, n = seen.sum(axis=0), sum(classes)
    spread = np.sqrt((total + 1) / n * (1 / classes[0] + 1 / classes[1]))
    clear = np.abs(seen[1] / classes[1] - seen[0] / classes[0]) / spread
    clear[(total < 2) | (clear < CLEAR)] = 0
    for gone, new, _ in pairs:
        clear[[*gone, *new]] += 1e3  # what a swap touches must be in the model, or it can't be held back
    chosen = np.argsort(-clear, kind="stable")[:KEPT]
    return chosen[clear[chosen] > 0].astype(np.int64)


def fit(slots: list[np.ndarray], labels: np.ndarray, pairs: list[tuple], chosen: np.ndarray | None = None, rounds: int = 800, swap_penalty: float = SWAP_PENALTY) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, weights and bias over the ``chosen`` slots (those of ``slots`` where they aren't given).

    The loss is the mean log loss, a small ridge, and the mean squared score change over all swaps; its minimum
    is found by full-batch steps with a step size for each weight.
    """
    n, positive = len(labels), int(labels.sum())
    if positive in (0, n):
        rate = positive / n if n else 0.0
        return np.empty(0, np.int64), np.empty(0), float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    if chosen is None:
        seen = np.zeros((2, SPACE))
        for slot, label in zip(slots, labels):
            seen[int(label), slot] += 1
        chosen = chosen_slots(seen, (n - positive, positive), pairs)
    column = np.full(SPACE, -1)
    column[chosen] = np.arange(len(chosen))
    width = len(chosen)
    x, before, after = Rows(slots, column), *(Rows([np.asarray(p[i], np.int64) for p in pairs], column) for i in (0, 1))
    often = np.array([p[2] for p in pairs], float)
    weight = np.where(labels > 0, POSITIVE, 1.0) / n
    w, bias = np.zeros(width), float(np.log(positive / (n - positive)))
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -40, 40))) - labels) * weight
        slope = x.back(error, width) + RIDGE * w
        if pairs:
            change = (before.dot(w) - after.dot(w)) * often
            slope += 2 * swap_penalty / often.sum() * (before.back(change, width) - after.back(change, width))
        slope = np.append(slope, error.sum())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        move = 0.1 * (1 - step / (rounds + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        w -= move[:-1]
        bias -= float(move[-1])
    return chosen, w, bias


class Scorer:
    """Scores texts with the weights of one fit."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray, float]):
        slots, weights, self.bias = model
        self.weights = dict(zip(slots.tolist(), weights.tolist()))
        self.held: dict[str, tuple[int, ...]] = {}  # of each known word, the slots that have a weight

    def score(self, text: str | None) -> float:
        words = set(WORD.findall((text or "").lower()))
        held, weights = self.held, self.weights
        trim(held, MEMO)
        for word in words.difference(held):
            held[word] = tuple(s for s in word_slots(word) if s in weights)
        slots = set(chain.from_iterable(map(held.__getitem__, words)))
        z = self.bias + sum(map(weights.__getitem__, sorted(slots)))
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most ``SAMPLE`` labelled documents, those of the smallest key hashes; of rows that share a key, on one text.

    Features are counted by class in Spark; the driver receives these counts (``SPACE`` rows at most), the distinct
    swaps with their numbers, and of each sampled row only the slots that were chosen.
    """
    named = labels.select(labels[key].alias("key"), labels[label].alias("label")).dropna()
    named = named.groupBy("key").agg(F.max("label").alias("label"))
    present = docs.select(docs[key].alias("key")).dropna().join(named, "key")
    sample = written(present.distinct().orderBy(F.xxhash64("key"), "key").limit(SAMPLE), "sample")
    texts = docs.select(docs[key].alias("key"), docs[text].alias("text")).join(F.broadcast(sample), "key")
    texts = texts.groupBy("key").agg(F.max("label").alias("label"), F.min("text").alias("text"))  # a task passes on one row of a key
    change = pa.struct([("gone", pa.list_(pa.int32())), ("new", pa.list_(pa.int32())), ("n", pa.int64())])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.as_py() for x in batch.column(0)]
            slots = pa.array([features(x) for x in found], pa.list_(pa.int32()))
            changes = pa.array([[dict(zip(("gone", "new", "n"), c)) for c in swapped(x)] for x in found], pa.list_(change))
            yield pa.RecordBatch.from_arrays([slots, batch.column(1), changes], names=["slots", "label", "changes"])

    rows = texts.select("text", (F.col("label") > 0).cast("int").alias("label")).mapInArrow(described, "slots array<int>, label int, changes array<struct<gone:array<int>,new:array<int>,n:bigint>>")
    rows = written(rows, "described")
    classes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        return fit([], np.repeat(list(classes), list(classes.values())), [])
    changes = rows.select(F.explode("changes").alias("c")).groupBy("c.gone", "c.new").agg(F.sum("c.n").alias("n")).orderBy("gone", "new")
    pairs = [(tuple(r["gone"]), tuple(r["new"]), r["n"]) for r in changes.collect()]
    counts = rows.select("label", F.explode("slots").alias("slot")).groupBy("slot").agg(*(F.count_if(F.col("label") == c).alias(f"n{c}") for c in (0, 1))).toArrow()
    seen = np.zeros((2, SPACE))
    for c in (0, 1):
        seen[c, counts["slot"].to_numpy()] = counts[f"n{c}"].to_numpy()
    chosen = chosen_slots(seen, (classes[0], classes[1]), pairs)
    sent = rows.sparkSession.sparkContext.broadcast(np.sort(chosen))

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [np.intersect1d(x.values.to_numpy(), sent.value, assume_unique=True).astype(np.int32) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.list_(pa.int32())), batch.column(1)], names=["slots", "label"])

    got = rows.select("slots", "label").mapInArrow(narrowed, "slots array<int>, label int").toArrow()
    slots = [x.values.to_numpy() for x in got["slots"]]
    truth = got["label"].to_numpy()
    order = sorted(range(len(slots)), key=lambda i: (slots[i].tobytes(), truth[i]))  # so that the order of tasks doesn't matter
    return fit([slots[i] for i in order], truth[order].astype(float), pairs, chosen)


def score_documents(spark, docs: DataFrame, model, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``key, score, predicted`` of every row.  The model is at most ``KEPT`` weights."""
    kind = docs.schema[key].dataType.simpleString()
    sent, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(f"toxicity {name}", lambda: Scorer(sent.value))
        for batch in batches:
            scores = [scorer.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["key", "score"])

    out = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, score double")
    return out.select(F.col("key").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(spark, docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the labelled rows outside the held-out fold and score all rows: ``key, held_out, score, predicted``."""
    remainder = fold(F.col(key), folds)
    model = learn(docs, labels.filter(remainder != held_out), key, text)
    out = score_documents(spark, docs, model, key, text)
    return out.select(key, F.coalesce(remainder == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
