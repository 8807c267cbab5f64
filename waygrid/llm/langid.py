"""Language identification by words first, character n-grams after.

A known word scores the log of its frequency in each language.  An unknown word falls back to its character
4-grams (with word ends); if none of them is known to its 3-grams, and so on down to single letters.  A text
gets the language with the highest sum.

Words and n-grams are counted over all learning rows; counts are summed inside tasks first, so a language or a
word that fills a third of the rows costs each task one row.  A word or n-gram is known if it makes up a share of
``KNOWN`` of all words or n-grams of some language; rarer ones are what the back-off is for.  The share is the same at
every size of input and is taken in each language, however many there are, so none is crowded out by a larger one.
The model holds only the counts that are there, and grows with the languages.

Cases: a null text or one without letters is ``und`` with score 0, as is every text if nothing could be
learned; rows with a null text or language teach nothing; equal sums go to the alphabetically first language;
repeated rows get equal answers; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import gc
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, worker_state, written

#: Least share of a language's words or n-grams that makes one known, and the longest n-gram.
KNOWN, LONGEST = 3e-6, 4
#: Distinct entries that a task counts before it passes them on; rows of a worker's score table (fewer for many languages).
FLUSH, MEMO = 400_000, 800_000
#: Smoothing count.
ALPHA = 0.5

_RUN = re.compile(r"[^\W\d_]+")


def letters(text: str) -> list[str]:
    """Runs of letters; numerals of other forms than digits, which the pattern lets through, are none."""
    found = _RUN.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [x for run in found for x in "".join(c if c.isalpha() else " " for c in run).split()]


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counted(rows: DataFrame, gather, expand) -> DataFrame:
    """``lang, item, n`` of rows ``lang, item, n``, summed in each task, then over all.

    ``gather(counter, item, n)`` adds a row to the counter of its language; when the counters are full, or the task
    ends, ``expand`` makes the items to be passed on of what was gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, Counter] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, counter in by_lang.items():
                items: Counter = Counter()
                for item, n in counter.items():
                    for part in expand(item):
                        items[part] += n
                columns = [pa.array([lang] * len(items), pa.string()), pa.array(list(items), pa.string()), pa.array(list(items.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "item", "n"])
            by_lang.clear()

        for batch in batches:
            for lang, item, n in zip(*(c.to_pylist() for c in batch.columns)):
                gather(by_lang.setdefault(lang, Counter()), item, n)
            if sum(map(len, by_lang.values())) >= FLUSH:
                yield from passed_on()
        yield from passed_on()

    return rows.mapInArrow(run, "lang string, item string, n bigint").groupBy("lang", "item").agg(F.sum("n").alias("n"))


def _add_runs(counter: Counter, text: str, n: int) -> None:
    counter.update(text.lower().split())


def _add(counter: Counter, word: str, n: int) -> None:
    counter[word] += n


def _grams(word: str) -> list[str]:
    return [g for n in range(1, LONGEST + 1) for g in grams(word, n)]


def _known(counts: DataFrame, totals: dict[str, int]) -> dict[str, dict[str, int]]:
    """Counts by language of the items that make up a share of ``KNOWN`` in some language."""
    spark = counts.sparkSession
    least = spark.createDataFrame([(lang, n * KNOWN) for lang, n in totals.items()], "lang string, least double")
    own = counts.join(F.broadcast(least), "lang").filter("n >= least").select("item").distinct()  # one row a language is sent
    top = counts.join(written(own, "known"), "item", "left_semi")
    top = top.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    return {r["item"]: r["by_lang"] for r in top.orderBy("item").toLocalIterator()}


class Model:
    """Log frequencies by language of words and n-grams, one table row each."""

    def __init__(self, languages: dict[str, tuple[int, int]], words: dict[str, dict[str, int]], parts: dict[str, dict[str, int]]):
        """``languages``: for each, the total counts of words and of n-grams."""
        self.languages = sorted(languages)
        totals = np.array([languages[lang] for lang in self.languages], float).reshape(len(self.languages), 2)
        self.words = {w: i for i, w in enumerate(words)}
        self.parts = {g: len(words) + i for i, g in enumerate(parts)}
        # A row has what its counts add to the logs; ``floors`` are the logs of words and of n-grams without a count.
        place = {lang: i for i, lang in enumerate(self.languages)}
        found = [[(place[lang], n) for lang, n in by_lang.items() if lang in place] for items in (words, parts) for by_lang in items.values()]
        self.starts = np.cumsum([0, *map(len, found)])
        self.langs = np.array([lang for row in found for lang, _ in row], np.int32)
        self.gains = np.log(np.array([n for row in found for _, n in row], float) / ALPHA + 1).astype(np.float32)
        self.floors = np.array([np.log(ALPHA / (totals[:, i] + ALPHA * max(1, len(items)))) for i, items in enumerate((words, parts))])

    def sums(self, rows: list[int], weights: list[float], owner: list[int], n: int) -> np.ndarray:
        """Scores by language of ``n`` owners of weighted rows."""
        at, weight, own = np.array(rows, np.int64), np.array(weights, float), np.array(owner, np.int64)
        size = self.starts[at + 1] - self.starts[at]
        each = np.repeat(np.arange(len(at)), size)
        entry = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + self.starts[at][each]
        scores = np.bincount(own[each] * len(self.languages) + self.langs[entry], weight[each] * self.gains[entry], n * len(self.languages)).reshape(n, -1).astype(float)
        for floor, mine in zip(self.floors, (at < len(self.words), at >= len(self.words))):
            scores += np.bincount(own[mine], weight[mine], n)[:, None] * floor
        return scores

    def rows_of(self, word: str) -> tuple[list[int], float]:
        """Table rows that score a word and their weight: its own, or those of its longest known n-grams."""
        known = self.words.get(word)
        if known is not None:
            return [known], 1.0
        for n in range(LONGEST, 0, -1):
            if rows := [at for g in grams(word, n) if (at := self.parts.get(g)) is not None]:
                return rows, 1.0 / n
        return [], 0.0


class Guesser:
    """Guesses with one model, remembering the scores of blank-separated runs."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.rows = max(4, min(MEMO, 16 * MEMO // (len(model.languages) + 1)))
        self.table = np.zeros((self.rows, len(model.languages) + 1), np.float32)  # scores, and the number of words

    def add(self, runs: list[str]) -> None:
        """Score new runs, all in one pass."""
        rows, weights, owner, words = [], [], [], []
        for i, run in enumerate(runs):
            found = letters(run)
            words.append(len(found))
            for word in found:
                own, weight = self.model.rows_of(word)
                rows += own
                weights += [weight] * len(own)
                owner += [i] * len(own)
        start = len(self.place)
        block = self.table[start : start + len(runs)]
        block[:, :-1] = self.model.sums(rows, weights, owner, len(runs))
        block[:, -1] = words
        self.place.update(zip(runs, range(start, start + len(runs))))

    def guess(self, text: str | None) -> tuple[str, float]:
        runs = (text or "").lower().split()
        if not runs or not self.model.languages:
            return "und", 0.0
        sums = np.zeros(self.table.shape[1])
        for start in range(0, len(runs), self.rows // 4):
            part = runs[start : start + self.rows // 4]
            at = np.fromiter(map(self.place.get, part, repeat(-1)), np.int64, len(part))
            new = np.nonzero(at < 0)[0].tolist()
            if new:
                missing = {part[i] for i in new}
                if len(self.place) + len(missing) > self.rows:  # the newer half goes; places are in order of arrival
                    self.place = {k: v for k, v in self.place.items() if v < self.rows // 2}
                    missing, new = set(part).difference(self.place), range(len(part))
                self.add(sorted(missing))
                at[list(new)] = [self.place[part[i]] for i in new]
            sums += self.table[at].sum(axis=0, dtype=float)
        words = sums[-1]
        if not words:
            return "und", 0.0
        sums = sums[:-1]
        best = int(sums.argmax())
        return self.model.languages[best], float(1 / np.exp((sums - sums[best]) / np.sqrt(words)).sum())


def _guesser(name: str, model: Model) -> Guesser:
    """The guesser of this worker, kept from task to task."""

    def made() -> Guesser:
        gc.set_threshold(1_000_000)  # the memo holds no cycles and is large to walk
        return Guesser(model)

    return worker_state(f"language {name}", made)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    rows = docs.select(docs[lang].alias("lang"), docs[text].alias("item")).dropna().withColumn("n", F.lit(1).cast("long"))
    words = written(_counted(rows, _add_runs, letters), "words")
    parts = written(_counted(words, _add, _grams), "grams")
    totals = [df.groupBy("lang").agg(F.sum("n").alias("n")).collect() for df in (words, parts)]
    by_lang = [{r["lang"]: r["n"] for r in rows} for rows in totals]
    languages = {x: (by_lang[0][x], by_lang[1][x]) for x in by_lang[0] if x in by_lang[1]}
    return Model(languages, *(_known(counts, of) for counts, of in zip((words, parts), by_lang)))


def identify(spark: SparkSession, docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` of every row: one pass over whole texts."""
    sent = spark.sparkContext.broadcast(model)
    kind, name = docs.schema[key].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = _guesser(name, sent.value)
        for batch in batches:
            found = [guesser.guess(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["key", "lang_pred", "score"])

    out = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double")
    return out.withColumnRenamed("key", key)


def language(spark: SparkSession, docs: DataFrame, folds: int = 3, held_out: int = 1, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn outside the held-out fold and guess for all rows: ``key, held_out, lang_pred, score``."""
    remainder = fold(F.col(key), folds)
    model = learn(docs.filter(remainder != held_out), text, lang)
    out = identify(spark, docs, model, key, text)
    return out.select(key, F.coalesce(remainder == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
