"""Spelling variants: words one code point apart, grouped without forming pairs.

Words that differ by one replacement share a *wildcard*: position, what stands before and what stands after.  A wildcard's
words are a group of which only its size and its two most frequent words matter: each member is near to all others, and
the most frequent of those is the first word of the group, or the second for the first itself.  Words that differ by one
inserted or deleted code point meet by deletions: what is left of a word without one code point joins the vocabulary.  Both
give rows of a word, a number of near words and the best of them, which are summed by word; no pair of two members of a
group is formed.  A wildcard has as many words at most as there are letters, so no group is large.

Each word points to its near word of largest count if that is frequent enough.  Pointers go from rarer to more frequent words,
so following them ends; it is done by doubling.

Cases: a null or empty text has no words; repeated rows count as they come; rows with a null key count, with the key taken as
empty; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.plans.scratch import discard

from .common import written

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
#: Stands for the code point that may be any; no word holds it.
ANY = "*"
#: Words that a task counts before it passes them on: bounds memory, never the result.
HELD = 400_000


def slips(word: str, prefix: int, every: int) -> str:
    """The word with one code point lost, for one in ``every`` of the (document, word) pairs; a fixed rule of crc32."""
    h = zlib.crc32(word.encode(), prefix)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int | None = None, shortest: int = 6, least: int = 5) -> DataFrame:
    """``word, n`` of the texts' words of ``shortest`` code points or more that occur ``least`` times or more.

    ``slip`` plants misspellings: every so-manieth (document, word) pair loses a code point wherever it stands.  Tasks
    count before the shuffle, so a word that fills the corpus costs a row or two a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for owner, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Counter(LETTERS.findall((said or "").translate(LOWER)))
                prefix = zlib.crc32(f"{'' if owner is None else owner}:".encode())
                for word, n in own.items():
                    if slip:
                        word = slips(word, prefix, slip)
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= HELD:
                    yield passed_on()
        if held:
            yield passed_on()

    counted = docs.select(docs[key], docs[text]).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _better(n, word):
    """Sorts before another where the count is larger, or the same with a word that is smaller in code points."""
    return F.struct((-n).alias("less"), word.alias("word"))


def by_replacement(words: DataFrame) -> DataFrame:
    """``word, n_near, best`` over the wildcards of ``words``: at most one row for each of a word's positions."""
    at = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
    open_ = words.select("word", "n", at).select(
        F.concat(F.expr("substring(word, 1, at - 1)"), F.lit(ANY), F.expr("substring(word, at + 1)")).alias("wildcard"), _better(F.col("n"), F.col("word")).alias("own")
    )
    # No more members than letters: the list of a group is bounded by the alphabet.
    groups = open_.groupBy("wildcard").agg(F.sort_array(F.collect_list("own")).alias("members")).filter(F.size("members") > 1)
    top, second = F.col("members")[0], F.col("members")[1]
    member = groups.select(F.posexplode("members").alias("place", "own"), (F.size("members") - 1).cast("long").alias("n_near"), top.alias("top"), second.alias("second"))
    return member.select("own.word", "n_near", F.when(F.col("place") == 0, F.col("second")).otherwise(F.col("top")).alias("best"))


def by_deletion(words: DataFrame) -> DataFrame:
    """``word, n_near, best`` of words and what is left of them, both ways; equal remains of one word count once."""
    remains = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.col("word").substr(F.lit(1), i - 1), F.col("word").substr(i + 1, F.length("word")))))
    left = words.select(F.col("word").alias("longer"), F.col("n").alias("longer_n"), F.explode(remains).alias("word"))
    met = left.join(words, "word")
    ends = F.array(
        F.struct(F.col("word").alias("word"), _better(F.col("longer_n"), F.col("longer")).alias("best")),
        F.struct(F.col("longer").alias("word"), _better(F.col("n"), F.col("word")).alias("best")),
    )
    return met.select(F.explode(ends).alias("end")).select("end.word", F.lit(1).cast("long").alias("n_near"), "end.best")


def roots(pointers: DataFrame) -> DataFrame:
    """``word, root``: where following ``word -> form`` ends.  Pointers lead upwards, so doubling them ends."""
    reach = written(pointers.select("word", F.col("form").alias("root")), "reach")
    while True:
        onward = reach.select(F.col("word").alias("at"), F.col("root").alias("onward"))
        new = written(reach.join(onward, F.col("root") == F.col("at"), "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "reach")
        moved = new.filter("moved").limit(1).count()
        discard(reach)
        reach = new.drop("moved")
        if not moved:
            return reach


def spelling_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of a vocabulary ``word, n``.

    ``form`` is the near word of largest count (ties: smallest in code points) if that is ``times`` the word's or more.
    """
    words = written(words.select("word", "n"), "words")
    near = by_replacement(words).unionByName(by_deletion(words)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    best_n = -F.col("best.less")
    enough = best_n >= times * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, best_n).alias("form_n")
    )
    found = written(found, "near")
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
