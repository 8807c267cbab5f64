"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by a budget of k edits.  Cut into k + 1 pieces, at least one piece must then
stand in the passage unchanged.  One automaton finds all pieces in one scan of a text; around each hit Myers'
bit-parallel algorithm measures the edit distance between the whole item and the best passage there.  Hits of one
passage overlap and are measured once.

Texts and items are compared in lower case with every run of other characters than letters and digits as one
blank.  Both stand between blanks, so an item is found at the borders of words only (``cat`` isn't in
``concatenate``), and words that run into its ends cost edits of its budget.  The items of one scan are bounded by
``SCAN`` characters; a larger benchmark is scanned in blocks of that size, each with all documents, so nothing that is
broadcast grows with the tables (one item is never divided).

Cases: null or empty texts match nothing; null, empty or letterless items are ignored; an item with a null key is
one like others; equal items all match; an item of few characters has no budget and is found wherever its words stand;
repeated rows get equal answers; an empty table on either side gives no matches; a null key is kept as it is;
texts are scanned whole; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Edits for each character of an item; characters of items in one scan.
RATE, SCAN = 0.08, 4_000_000

_other = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    """Words with a blank around each; empty if there are none."""
    words = _other.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_distance(item: str, window: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """Smallest edit distance between ``item`` and any substring of ``window``, and where that substring ends."""
    m = len(item)
    if masks is None:
        masks = item_masks(item)
    high, ones = 1 << (m - 1), (1 << m) - 1
    plus, minus, score, best, end = ones, 0, m, m, 0
    for at, char in enumerate(window):
        eq = masks.get(char, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        right_plus = minus | ~(diagonal | plus)
        right_minus = plus & diagonal
        if right_plus & high:
            score += 1
        elif right_minus & high:
            score -= 1
        right_plus = (right_plus << 1) & ones
        right_minus = (right_minus << 1) & ones
        plus = right_minus | (~((eq | minus) | right_plus) & ones)
        minus = right_plus & (eq | minus)
        if score < best:
            best, end = score, at + 1
    return best, end


def item_masks(item: str) -> dict[str, int]:
    """For each character, the bits of the places where the item has it."""
    masks: dict[str, int] = defaultdict(int)
    for i, char in enumerate(item):
        masks[char] |= 1 << i
    return dict(masks)


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(key, item, math.floor(rate * (len(item) - 2)), item_masks(item)) for key, item in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, item, budget, _) in enumerate(self.items):
            for offset, piece in pieces(item, budget):
                places[piece].append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """Keys of the items in the text with their distances."""
        text = normalised(text)
        if not text or not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for number, offset in where:
                _, item, budget, _ = self.items[number]
                low = end + 1 - size - offset - budget
                high = low + len(item) + 2 * budget
                spans = windows.setdefault(number, [])
                if spans and low <= spans[-1][1] and high >= spans[-1][0]:
                    spans[-1][0], spans[-1][1] = min(low, spans[-1][0]), max(high, spans[-1][1])
                else:
                    spans.append([low, high])
        found = []
        for number, spans in sorted(windows.items()):
            key, item, budget, masks = self.items[number]
            best = min(best_distance(item, text[max(0, low) : high], masks)[0] for low, high in spans)
            if best <= budget:
                found.append((key, best))
        return found


def find_items(spark: SparkSession, docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = RATE, scan: int = SCAN) -> DataFrame:
    """``key, item_ids, distances`` of each document that holds an item; one row for each block that it matches."""
    kind, item_kind = docs.schema[key].dataType, items.schema[item_key].dataType
    docs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    items = items.select(items[item_key].alias("item"), items[item_text].alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / scan))
    out = None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        sent = spark.sparkContext.broadcast([(r["item"], t) for r in own if (t := normalised(r["text"]))])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                found = [matcher.matches(x.as_py()) for x in batch.column(1)]
                keep = batch.column(0).filter(pa.array([bool(x) for x in found], pa.bool_()))
                found = [x for x in found if x]
                yield pa.RecordBatch.from_pydict({"key": keep, "item_ids": [[k for k, _ in x] for x in found], "distances": [[d for _, d in x] for x in found]}, schema=arrow)

        arrow = pa.schema([("key", _arrow(kind)), ("item_ids", pa.list_(_arrow(item_kind))), ("distances", pa.list_(pa.int32()))])
        part = docs.mapInArrow(run, f"key {kind.simpleString()}, item_ids array<{item_kind.simpleString()}>, distances array<int>")
        if blocks > 1:  # done before the next block is sent
            part = written(part, "matches")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("key", key)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
