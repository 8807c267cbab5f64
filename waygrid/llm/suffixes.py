"""Removal of byte strings that occur more than once, by suffix arrays over what can be repeated.

A byte goes if it lies in a string of ``length`` bytes (a *window*) that also starts anywhere else.  Suffixes of a whole corpus are too
many to be sorted, so what can't be repeated is put aside first, without loss:

1.  Texts that occur repeatedly are one text; all of it goes.
2.  Each window has an *anchor*, the smallest hash among its substrings of ``ANCHOR`` bytes.  Equal windows have equal
    anchors, so only windows whose anchor occurs twice can be repeated.  Neighbouring windows share an anchor and are one *segment*;
    equal segments of an anchor are one, with a count, before anything is sorted.
3.  The segments of an anchor that has different ones are sorted in blocks: a suffix array by two-stage sorting, in
    which only suffixes smaller than their successors are sorted directly, and each of the others is placed when the scan of the
    buckets meets its successor; then the common prefixes of neighbours.  A common prefix of ``length`` bytes is a repeated window.
4.  An anchor with more segments than a block takes is dealt to several blocks.  What is not repeated inside of one block, and one of each
    repeated window, meets the other blocks of that anchor by digests, which any number of tasks share.
5.  Repeated windows go back to the texts by joins and are joined to spans.

Texts move twice, only those with segments to sort or spans to take out.  Digests of 128 bits stand for texts and for segments of one anchor.

Cases: a null text is empty; a text shorter than a window stays; a row with a null key and rows that share a key are documents like others
(rows are known by their texts); an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, keep_ids, written

#: Bytes of an anchor (a power of two), of texts looked at together, and segments in one block.
ANCHOR, LOOK, BLOCK = 64, 1 << 18, 1500
#: Segments of one anchor up to which they stay in one block.
WHOLE = 3000
#: Never part of UTF-8; stands between segments.
GAP = 0xFF

_U = np.uint64
_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=_U)
_STEP = _rng.integers(1, 1 << 63, 16, dtype=_U) * _U(2) + _U(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` neighbours, by doubling."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at most ``LOOK`` bytes: the first window and the number of windows of each segment, and its anchor's hash."""
    h, size = _BYTE[data], 1
    while size < ANCHOR:
        h = h[:-size] * _STEP[size.bit_length()] + h[size:]
        size *= 2
    h = _mixed(h)
    bits = _U(LOOK.bit_length())
    anchor = (_least(h >> bits << bits | np.arange(len(h), dtype=_U), length - ANCHOR + 1) & _U((1 << int(bits)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    return first, np.diff(first, append=len(anchor)), h[anchor[first]].view(np.int64)


def _looks(texts: list[pa.Scalar], length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``text, offset, bytes``: long texts in parts that overlap so that each window is in one of them."""
    for i, value in enumerate(texts):
        data = np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)
        for at in range(0, len(data) - length + 1, LOOK - length + 1):
            yield i, at, data[at : at + LOOK]


def _anchors(texts: DataFrame, length: int, full: bool) -> DataFrame:
    """``id, text`` to ``h`` of every segment, and if ``full`` also ``d, id, p, n``: its digest, text, first window and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[np.ndarray, ...]] = []
            n_held = 0

            def out() -> pa.RecordBatch:
                cols = [np.concatenate(x) for x in zip(*held)]
                held.clear()
                if not full:
                    return pa.RecordBatch.from_arrays([pa.array(cols[0])], names=["h"])
                ids = batch.column(0).take(pa.array(cols[2]))
                return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), ids, pa.array(cols[3].astype(np.int32)), pa.array(cols[4].astype(np.int32))], names=["h", "d", "id", "p", "n"])

            for i, at, data in _looks(list(batch.column(1)), length):
                first, n, h = segments(data, length)
                if full:
                    view = data.tobytes()
                    digest = np.fromiter((xxhash.xxh3_64_intdigest(view[p : p + k + length - 1]) for p, k in zip(first.tolist(), n.tolist())), _U, len(first)).view(np.int64)
                    held.append((h, digest, np.full(len(h), i), first + at, n))
                else:
                    held.append((h,))
                n_held += len(h)
                if n_held > 100_000:
                    yield out()
                    n_held = 0
            if held:
                yield out()

    return texts.select("id", "text").mapInArrow(run, "h bigint, d bigint, id binary, p int, n int" if full else "h bigint")


def two_stage_order(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``wanted`` (a mask) in the order of the first ``depth`` bytes of their suffixes.

    A suffix is smaller than its successor if the first byte that differs from the next one is smaller than it.  Such suffixes are sorted
    directly.  Of the others only those are placed that are wanted or whose successors' places they need.
    """
    n = len(data)
    ahead = np.diff(data.astype(np.int16), append=-1)  # the end is smaller than any byte
    turn = np.minimum.accumulate(np.where(ahead != 0, np.arange(n), n)[::-1])[::-1]
    rises = ahead[turn] > 0
    place = np.arange(n)
    last_rise = np.maximum.accumulate(np.where(rises, place, -1))
    last_wanted = np.maximum.accumulate(np.where(wanted, place, -1))
    needed = wanted | (last_wanted > np.append(-1, last_rise[:-1]))
    needed &= last_wanted >= 0
    # Stage one: the rising ones, by their bytes.
    rising = np.flatnonzero(needed & rises)
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    suffix = np.lib.stride_tricks.as_strided(padded, (n, depth), (1, 1))
    rising = rising[np.argsort(np.ascontiguousarray(suffix[rising]).view(f"S{depth}").ravel(), kind="stable")]
    cuts = np.searchsorted(data[rising], np.arange(257))
    # Stage two: buckets by first byte, from the smallest; each suffix that is met places the one before it.
    falling = needed & ~rises
    before = np.append(falling[-1:] & False, falling[:-1])  # whether the suffix one earlier is a falling one that is needed
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []

    # The end of the data places the last suffix.
    if n and falling[-1]:
        waiting[data[-1]].append(np.array([n - 1]))
    for c in range(256):
        parts = waiting[c]
        front = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        bucket = [front]
        while len(front):
            front = front[before[front]] - 1
            front = front[data[front] == c]
            bucket.append(front)
        bucket.append(rising[cuts[c] : cuts[c + 1]])
        bucket = np.concatenate(bucket)
        if not len(bucket):
            continue
        order.append(bucket)
        previous = bucket[before[bucket]] - 1
        previous = previous[data[previous] > c]
        if len(previous):
            to = data[previous]
            previous, to = previous[by := np.argsort(to, kind="stable")], to[by]
            for x in np.split(previous, np.flatnonzero(np.diff(to)) + 1):
                waiting[data[x[0]]].append(x)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Of each two neighbours of ``order``, the length of the common prefix, or ``most`` where it is no shorter."""
    suffix = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(most, np.uint8)]), (len(data), most), (1, 1))
    out = np.empty(max(0, len(order) - 1), np.int64)
    for at in range(0, len(out), 20_000):
        rows = suffix[order[at : at + 20_001]]
        differ = rows[1:] != rows[:-1]
        out[at : at + 20_000] = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    return out


def repeated_windows(parts: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each segment whether its windows occur elsewhere among the segments, and whether they are the first of their kind."""
    gap = bytes([GAP])
    data = np.frombuffer(gap.join(parts) + gap, np.uint8)
    starts = np.cumsum([0, *(len(x) + 1 for x in parts[:-1])])
    windows = np.array([len(x) - length + 1 for x in parts])
    wanted = np.zeros(len(data), bool)
    wanted[np.repeat(starts - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())] = True
    order = two_stage_order(data, wanted, length)
    same = common_prefixes(data, order, length) == length
    repeated, leading = np.zeros(len(data), bool), np.zeros(len(data), bool)
    repeated[order] = np.append(same, False) | np.append(False, same)
    leading[order] = ~np.append(False, same)
    return ([x[s : s + k] for s, k in zip(starts, windows)] for x in (repeated, leading))


def _sorted_blocks(parts: DataFrame, length: int) -> DataFrame:
    """Blocks of segments ``block, h, d, split, bytes``: ``h, d, s, e`` for ranges of repeated windows.

    Of blocks that are split also ``w, h, d, s`` of windows that stand for themselves in the block (``e`` null), by digest.
    """
    names = ["h", "d", "s", "e", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            for (_, h, d, split, data), repeated, leading in zip(rows, *repeated_windows([r[4] for r in rows], length)):
                edges = np.flatnonzero(np.diff(np.concatenate([[False], repeated, [False]]).astype(np.int8)))
                out += [(h, d, s, e, None) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())]
                if split:
                    out += [(h, d, s, None, xxhash.xxh3_128_digest(data[s : s + length])) for s in np.flatnonzero(leading).tolist()]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    yield work(held)
                    held = []
                held.append(row)
        if held:
            yield work(held)

    rows = parts.select("block", "h", "d", "split", "bytes").repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(run, "h bigint, d bigint, s int, e int, w binary")


def _cut_out(texts: DataFrame, length: int) -> DataFrame:
    """``text, own array<struct<h,d,p,n,...>>`` to one row for each: its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch.column(0), batch.column(1)):
                data, own = memoryview(text.as_buffer()), own.as_py()
                for at in range(0, len(own), 5000):
                    part = own[at : at + 5000]
                    cols = [pa.array([x[c] for x in part], t) for c, t in (("h", pa.int64()), ("d", pa.int64()), ("block", pa.int64()), ("split", pa.bool_()))]
                    cols.append(pa.array([bytes(data[x["p"] : x["p"] + x["n"] + length - 1]) for x in part], pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, names=["h", "d", "block", "split", "bytes"])

    return texts.mapInArrow(run, "h bigint, d bigint, block bigint, split boolean, bytes binary")


def _without(texts: DataFrame, length: int, with_text: bool) -> DataFrame:
    """``id, text, ranges`` of repeated windows to what is left."""
    schema = "id binary, n_removed bigint, n_spans bigint, kept_sha256 string" + (", spans array<struct<start:int,end:int>>, kept binary" if with_text else "")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, ranges in zip(batch.column(1), batch.column(2)):
                data = text.as_buffer()
                values = ranges.values
                s, e = (values.field(c).to_numpy().astype(np.int64) for c in ("s", "e"))
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order] + length - 1)
                new = np.append(True, s[1:] > e[:-1])  # spans that touch are one
                starts, ends = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
                view = memoryview(data)
                kept = b"".join(view[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(view)]))
                rows.append((int((ends - starts).sum()), len(starts), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())] if with_text else None, kept))
            cols = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())]
            if with_text:
                cols += [pa.array([r[3] for r in rows], kind), pa.array([r[4] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(cols)])

    return texts.select("id", "text", "ranges").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` of every row; with ``with_text`` also ``spans`` and ``kept``, the bytes left.

    Spans are ``[start, end)`` in bytes of the text, and no two touch.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"windows have {2 * ANCHOR} bytes or more")
    sha = F.sha2(F.col("text"), 256)
    docs = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).cast("binary").alias("text"))
    rows = written(docs.select("key", F.octet_length("text").cast("long").alias("n_bytes"), sha.alias("sha")), "digests")
    rows = rows.withColumn("id", F.unhex(F.substring("sha", 1, 32)))
    # One row stands for the copies of a text; where rows share key and text several do, which changes nothing.
    copies = rows.filter(F.col("n_bytes") >= length).groupBy("id").agg(F.count("*").alias("copies"), F.min(F.xxhash64("key")).alias("owner"))
    copies = written(copies.filter("copies > 1"), "copies")
    few = copies.select(F.col("id").alias("copied"), "owner")
    few = F.broadcast(few) if copies.count() <= BROADCAST_ROWS else few.hint("merge")
    texts = docs.filter(F.octet_length("text") >= length).withColumn("id", F.unhex(F.substring(sha, 1, 32)))
    texts = texts.join(few, F.col("id") == F.col("copied"), "left").filter("owner IS NULL OR owner = xxhash64(key)").select("id", "text")
    # Anchors that occur again, and their segments.
    again = written(_anchors(texts, length, full=False).groupBy("h").agg(F.count("*").alias("times")).filter("times > 1").select("h"), "anchors")
    found = written(keep_ids(_anchors(texts, length, full=True), again, "h"), "segments")
    kinds = written(found.groupBy("h", "d").agg(F.count("*").alias("times"), F.min(F.struct("id", "p", "n")).alias("one")), "kinds")
    several = written(kinds.groupBy("h").agg(F.count("*").alias("n_kinds")).filter("n_kinds > 1"), "several")
    equal = kinds.filter("times > 1").select("h", "d", F.lit(0).alias("s"), F.col("one.n").alias("e"))
    # The others in blocks: of anchors together, or of one that has many in several.
    total = several.agg(F.coalesce(F.sum("n_kinds"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, total // BLOCK)
    split = F.col("n_kinds") > WHOLE
    block = F.when(split, F.xxhash64("h", F.pmod("d", F.ceil(F.col("n_kinds") / BLOCK)))).otherwise(F.pmod(F.xxhash64("h"), F.lit(blocks)))
    sorting = kinds.join(several, "h").select("one.id", F.struct("h", "d", "one.p", "one.n", block.alias("block"), split.alias("split")).alias("own"))
    sorting = written(sorting.groupBy("id").agg(F.collect_list("own").alias("own")), "sorting")  # at most a text's own segments
    parts = _cut_out(_met(texts, sorting).select("text", "own"), length)
    marked = written(_sorted_blocks(parts, length), "marks")
    alone = marked.filter("w IS NOT NULL")
    shared = alone.groupBy("w").agg(F.count("*").alias("times")).filter("times > 1").select("w")
    across = alone.join(shared, "w").select("h", "d", "s", (F.col("s") + 1).alias("e"))
    marks = marked.filter("w IS NULL").select("h", "d", "s", "e").unionByName(across).unionByName(equal)
    marks = written(marks.groupBy("h", "d").agg(F.collect_list(F.struct("s", "e")).alias("marks")), "marks")  # at most a segment's windows
    # Back to the texts that have no copies; of the others nothing is left.
    shifted = F.transform("marks", lambda x: F.struct((x["s"] + F.col("p")).alias("s"), (x["e"] + F.col("p")).alias("e")))
    spans = found.join(marks, ["h", "d"]).select("id", shifted.alias("ranges")).groupBy("id").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    spans = written(keep_ids(spans, copies, "id", "left_anti"), "spans")
    left = _without(_met(texts, spans), length, with_text)
    gone = copies.join(rows.select("id", "n_bytes").distinct(), "id").select(
        "id", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256")
    )
    if with_text:
        whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_removed").cast("int").alias("end")))
        gone = gone.withColumns({"spans": whole, "kept": F.lit(b"")})
    left = written(left.unionByName(gone), "left")
    none = F.lit(0).cast("long")
    out = rows.join(left, "id", "left")
    columns = [F.col("key").alias(key), "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    if with_text:
        columns += [F.coalesce("spans", F.array().cast(left.schema["spans"].dataType)).alias("spans"), "kept"]
    return out.select(*columns)


def _met(texts: DataFrame, by_id: DataFrame) -> DataFrame:
    """Texts with the row of ``by_id``, a written table; texts that have none stay where they are."""
    return keep_ids(texts, by_id, "id").join(by_id.hint("merge"), "id")
