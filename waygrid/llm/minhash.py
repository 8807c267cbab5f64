"""Near-duplicates by MinHash bands, odd sketches and exact confirmation.

Two documents are linked when the Jaccard similarity of their shingle sets reaches a threshold; a document's
class is its connected component.  The work goes in five moves:

1.  Each text becomes a set of 64-bit shingle hashes, 240 MinHash samples of it, 40 band keys over six samples
    each, and an *odd sketch*: the samples folded into 1024 parity bits.  Texts with one set are one node.
2.  Within each band bucket all members are compared with one centre, the member that meets most others over
    all bands.  So a bucket of m members gives m - 1 candidate pairs, not m squared.
3.  The XOR population count of two odd sketches estimates high similarities closely; pairs clearly below the
    threshold go.  The others are confirmed on their full sets, and confirmed links are closed to components.
4.  Buckets whose members still lie in several components are compared across components in blocks of bounded
    size, on sketches and then on full sets; a block gives only links that join components.  Where a bucket would
    make too many blocks, its members meet by the rarest shingles of their sets, which loses no link.
5.  Components are closed again over all links.

At the threshold 0.8 a pair shares no band with probability (1 - 0.8^6)^40, about 5 in a million, and a true
link's sketch count lies beyond the cut by more than six standard deviations.  Nothing is capped: every pair of a hot
bucket that can reach the threshold is compared.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text shorter
than a shingle is one shingle; a row with a null key can't be named as another's copy and stays alone
(component null, kept); rows that share a key are one node; an empty table gives an empty one; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.plans.components import connected_components

from .bpe import trim
from .common import keep_ids, worker_state, written

BANDS, ROWS, BITS = 40, 6, 1024
SAMPLES = BANDS * ROWS
#: Members of one component side of a block; a block holds two sides.
BLOCK = 128
#: Blocks that an average member of a bucket may come in, and the bits of a counter's number where rare shingles are told.
DEALT, SLOTS = 16, 20
#: Words whose hashes a worker remembers.
MEMO = 500_000

_U = np.uint64
_rng = np.random.default_rng(20240901)
_MUL = _rng.integers(1, 1 << 63, SAMPLES, dtype=_U) * _U(2) + _U(1)
_ADD = _rng.integers(0, 1 << 63, SAMPLES, dtype=_U)
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=_U) * _U(2) + _U(1)
_SALT = _rng.integers(1, 1 << 63, SAMPLES, dtype=_U)
_STEP = _U(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all others."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; ASCII letters are lower-cased and ASCII white space divides."""
    words = (text or "").encode().lower().split()  # on bytes, both touch ASCII alone
    if not words:
        return np.empty(0, _U)
    known: dict[bytes, int] = worker_state("words", dict)
    trim(known, MEMO)
    for word in set(words).difference(known):
        known[word] = xxhash.xxh3_64_intdigest(word)
    hashes = np.fromiter(map(known.__getitem__, words), _U, len(words))
    size = min(size, len(words))
    out = hashes[: len(words) - size + 1].copy()
    for i in range(1, size):
        out = _mixed(out) * _STEP + hashes[i : len(words) - size + 1 + i]
    return np.unique(_mixed(out + _U(size)))


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that isn't empty."""
    low = np.full(SAMPLES, np.iinfo(_U).max, _U)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[at : at + 1024, None] * _MUL + _ADD).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    return _mixed((_mixed(low.reshape(BANDS, ROWS)) * _BAND).sum(axis=1, dtype=_U) + np.arange(BANDS, dtype=_U) * _STEP).view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parities of how often the samples fall on each of the bits, as 64-bit words."""
    parity = np.bincount((_mixed(low ^ _SALT) % _U(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def estimated_similarity(differing_bits: float) -> float:
    """The similarity for which so many bits of two sketches are expected to differ."""
    return 1 + BITS / (4 * SAMPLES) * math.log(max(1e-9, 1 - 2 * differing_bits / BITS))


def most_differing_bits(threshold: float) -> int:
    """Sketch counts above this mean, beyond six standard deviations, a similarity below the threshold."""
    miss = 1 - threshold
    toggles = 2 * (SAMPLES * miss + 6 * math.sqrt(SAMPLES * miss * (1 - miss)))
    share = math.exp(-2 * toggles / BITS)
    return math.ceil(BITS / 2 * (1 - share) + 3 * math.sqrt(BITS * (1 - share * share)) / 2)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """``key, text`` to ``key, n_shingles, digest, sketch, bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, sketches, bands = [], [], [], []
            for value in batch.column(1):
                found = shingle_set(value.as_py(), size)
                counts.append(len(found))
                if len(found):
                    low = samples(found)
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    sketches.append(odd_sketch(low))
                    bands.append(band_keys(low))
                else:
                    digests.append(None)
                    sketches.append(None)
                    bands.append(None)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_shingles", "digest", "sketch", "bands"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, n_shingles bigint, digest binary, sketch array<bigint>, bands array<bigint>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``key, text`` to ``key, shingles``: the full sets as packed 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [shingle_set(x.as_py(), size).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["key", "shingles"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, shingles binary")


def _plausible(pairs: DataFrame, sketches: DataFrame, most: int) -> DataFrame:
    """Pairs ``a, b`` whose sketches don't rule the threshold out."""
    left = sketches.select(F.col("key").alias("a"), F.col("sketch").alias("sketch_a"))
    right = sketches.select(F.col("key").alias("b"), F.col("sketch").alias("sketch_b"))
    differing = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return pairs.join(left, "a").join(right, "b").filter(differing <= most).select("a", "b")


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    total = len(x) + len(y)
    if percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # merges two sorted runs
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (total - common)


def _confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold: 100 * intersection >= percent * union."""
    ids = written(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "candidates")
    sets = written(_sets(keep_ids(docs, ids, "key"), size), "sets")
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                keep.append(reaches(*(np.frombuffer(v.as_buffer(), _U) for v in (a, b)), percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    kind = docs.schema["key"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _plausible_in_block(rows: list[tuple], most: int) -> list[tuple[int, int, int]]:
    """Positions of pairs across components with sketches in reach, and their differing bits; closest first.

    Rows are ``block, side, key, component, sketch, ...``: sides 0 and 1 meet each other, side 2 meets itself.
    """
    labels = {c: i for i, c in enumerate({r[3] for r in rows})}
    component = np.array([labels[r[3]] for r in rows])
    sketch = np.array([r[4] for r in rows], np.int64)
    sides = [np.array([i for i, r in enumerate(rows) if r[1] == s], int) for s in (0, 1, 2)]
    found = []
    for x, y in ((sides[0], sides[1]), (sides[2], sides[2])):
        if len(x) and len(y):
            differing = np.zeros((len(x), len(y)), np.int32)
            for w in range(sketch.shape[1]):
                differing += np.bitwise_count(sketch[x, w, None] ^ sketch[None, y, w]).astype(np.int32)
            at = np.nonzero((differing <= most) & (component[x][:, None] != component[y][None, :]))
            found += zip(differing[at].tolist(), x[at[0]].tolist(), y[at[1]].tolist())
    return [(i, j, n) for n, i, j in sorted(found)]


def _by_block(blocks: DataFrame, columns: list[str], out: list[str], work) -> DataFrame:
    """Run ``work`` on the rows of each block; a task holds one block and one Arrow batch at a time.

    ``work`` gives tuples of ``out``: each name is that of an input column, or ``a`` or ``b``, which are keys.
    """
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = ", ".join(f"{c} {kinds['key' if c in 'ab' else c]}" for c in out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found: list[tuple], like: pa.Schema) -> pa.RecordBatch:
            types = [like.field("key" if c in "ab" else c).type for c in out]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=out)

        held: list[tuple] = []
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    found += work(held)
                    held = []
                held.append(row)
            yield batch_of(found, batch.schema)
        if held:
            yield batch_of(work(held), batch.schema)

    return blocks.select(*columns).repartition("block").sortWithinPartitions("block", "key").mapInArrow(run, schema)


def _crossing_links(docs: DataFrame, blocks: DataFrame, most: int, size: int, percent: int) -> DataFrame:
    """Links across components within blocks ``block, side, key, component, sketch``, confirmed on full sets.

    Rows without a plausible partner in their block go first.  The others are met by their sets; in a block the
    closest pairs are tried first, and a pair whose components are joined by then is not needed: so a block
    gives fewer links than it has rows, though every pair that could join two components is tried.
    """

    def with_partner(rows: list[tuple]) -> list[tuple]:
        found = _plausible_in_block(rows, most)
        return [rows[i] for i in sorted({x for i, j, _ in found for x in (i, j)})]

    def joining(rows: list[tuple]) -> list[tuple]:
        sets = [np.frombuffer(r[5], _U) for r in rows]
        root = {r[3]: r[3] for r in rows}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        links = []
        for i, j, _ in _plausible_in_block(rows, most):
            x, y = top(rows[i][3]), top(rows[j][3])
            if x != y and reaches(sets[i], sets[j], percent):
                root[x] = y
                links.append((min(rows[i][2], rows[j][2]), max(rows[i][2], rows[j][2])))
        return links

    columns = ["block", "side", "key", "component", "sketch"]
    rows = written(_by_block(blocks, columns, columns, with_partner), "leftover")
    sets = written(_sets(keep_ids(docs, written(rows.select("key").distinct(), "candidates"), "key"), size), "sets")
    return _by_block(rows.join(sets, "key"), [*columns, "shingles"], ["a", "b"], joining)


def _sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("band").agg(F.count_if("stray").alias("n_stray"), F.count_if(~F.col("stray")).alias("n_main")).filter("n_stray > 0")


def _dealt(placed: DataFrame, sizes: DataFrame, sketches: DataFrame, among: bool = True) -> DataFrame:
    """Members ``band, key, component, stray`` of buckets dealt out in blocks.

    Members that aren't strays (which may be most of a hot bucket) are never compared with each other: their chunks meet
    those of the strays only, and these meet each other and themselves if ``among``.
    """
    chunks = {n: F.ceil(F.col(n) / BLOCK).cast("int") for n in ("n_stray", "n_main")}
    rows = placed.join(sizes, "band").join(sketches, "key")
    rows = rows.withColumns({"ns": chunks["n_stray"], "nm": chunks["n_main"]})
    own = F.pmod(F.xxhash64("key", "band"), F.when(F.col("stray"), F.col("ns")).otherwise(F.greatest("nm", F.lit(1)))).cast("int")
    rows = rows.withColumn("own", own)
    # Block names: main chunk x stray chunk (sides 0, 1), stray pair i < j (sides 0, 1), stray chunk itself (side 2).
    strays = lambda: F.sequence(F.lit(0), F.col("ns") - 1)
    block = lambda kind, i, j, side: F.struct(F.struct(F.col("band"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j")).alias("block"), side.alias("side"))
    mains = F.when(F.col("nm") > 0, F.sequence(F.lit(0), F.greatest(F.col("nm"), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    as_main = F.transform(strays(), lambda j: block("m", F.col("own"), j, F.lit(0)))
    as_stray = F.transform(mains, lambda i: block("m", i, F.col("own"), F.lit(1)))
    if among:
        met = lambda j: block("s", F.least(F.col("own"), j), F.greatest(F.col("own"), j), F.when(j == F.col("own"), 2).when(F.col("own") < j, 0).otherwise(1))
        as_stray = F.concat(as_stray, F.transform(strays(), met))
    dealt = rows.select("key", "component", "sketch", F.explode(F.when(F.col("stray"), as_stray).otherwise(as_main)).alias("dealt"))
    return dealt.select(F.xxhash64("dealt.block").alias("block"), "dealt.side", "key", "component", "sketch")


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many first shingles, in any one order of all, a set of ``n`` must be looked for by, and looked up by.

    The first common shingle of two sets that reach the threshold is among the longer prefix of the larger set and
    among the shorter one of the smaller set, as all common ones follow it in both.
    """
    return n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1


def _rarest(docs: DataFrame, hot: DataFrame, size: int, percent: int) -> DataFrame:
    """``key, token, indexed``: the prefixes of the sets of ``hot`` in an order that puts rare shingles first.

    Rarity is counted over all of these sets in ``2 ** SLOTS`` counters, so what the tasks are sent has a fixed size.
    Shingles that share a counter only look more frequent; every order gives the same links.
    """
    texts = keep_ids(docs, hot, "key")
    shift = _U(64 - SLOTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SLOTS, np.int64)
        for batch in batches:
            for value in batch.column(1):
                np.add.at(counters, shingle_set(value.as_py(), size) >> shift, 1)
        at = np.nonzero(counters)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counters[at], pa.int64())], names=["slot", "n"])

    summed = texts.mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counters = np.zeros(1 << SLOTS, np.int64)
    counters[summed.column("slot").to_numpy()] = summed.column("n").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(counters)
    kind = docs.schema["key"].dataType.simpleString()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, value in enumerate(batch.column(1)):
                found = shingle_set(value.as_py(), size)
                probed, indexed = prefix_lengths(len(found), percent)
                first = found[np.lexsort((found, sent.value[found >> shift]))[:probed]]
                for start in range(0, len(first), 10_000):
                    part = first[start : start + 10_000]
                    keys = pa.repeat(batch.column(0)[at], len(part))
                    marks = pa.array(np.arange(start, start + len(part)) < indexed)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(part.view(np.int64)), marks], names=["key", "token", "indexed"])

    return texts.select("key", "text").mapInArrow(prefixes, f"key {kind}, token bigint, indexed boolean")


def _rare_blocks(docs: DataFrame, hot: DataFrame, sketches: DataFrame, size: int, percent: int) -> DataFrame:
    """Members ``key, component`` of hot buckets in blocks of those that share a rare shingle, whatever their bucket.

    What makes a bucket hot without joining its members is a passage that they share; it makes up so little of their
    sets that no shingle of it is in a shorter prefix.  Two members meet if a shingle is in the prefixes of both, and in the
    shorter one of at least one of them, and if they are of different components.
    """
    tokens = written(_rarest(docs, hot, size, percent).join(hot, "key"), "rarest")
    parts = tokens.groupBy("token", "component").agg(F.count("*").alias("n"), F.count_if("indexed").alias("n_indexed"))
    groups = parts.groupBy("token").agg(F.max_by("component", "n").alias("main"), F.sum("n_indexed").alias("n_indexed"), F.count("*").alias("n")).filter("n > 1 AND n_indexed > 0")
    met = written(tokens.join(groups.select("token", "main"), "token").withColumn("other", F.col("component") != F.col("main")), "met")
    columns = lambda part, stray: [F.xxhash64("token", F.lit(part)).alias("band"), "key", "component", stray.alias("stray")]
    looked_up = met.select(columns("looked up", F.col("other") & F.col("indexed")))
    of_main = met.filter(F.col("other") != F.col("indexed")).select(columns("of main", F.col("other")))
    dealt = [_dealt(placed, written(_sizes(placed), "sizes"), sketches, among) for placed, among in ((looked_up, True), (of_main, False))]
    return dealt[0].unionByName(dealt[1])


def _leftover_blocks(docs: DataFrame, members: DataFrame, centers: DataFrame, components: DataFrame, sketches: DataFrame, size: int, percent: int) -> DataFrame:
    """Buckets with several components, dealt out in blocks; strays are the members outside the centre's component.

    Of buckets in which a member would come in more than ``DEALT`` blocks, the members meet by rare shingles instead.
    """
    labels = components.select(F.col("node").alias("key"), "component")
    label = F.coalesce("component", "key")
    labelled = written(members.join(labels, "key", "left").select("band", "key", label.alias("component")), "labelled")
    center = centers.join(labels.withColumnRenamed("key", "center"), "center", "left").select("band", F.coalesce("component", "center").alias("main"))
    center = written(center, "centers")
    placed = written(labelled.join(center, "band").withColumn("stray", F.col("component") != F.col("main")), "placed")
    rows = F.col("n_stray") * (F.col("n_stray") + 2 * F.col("n_main")) / BLOCK
    sizes = written(_sizes(placed).withColumn("hot", rows > DEALT * (F.col("n_stray") + F.col("n_main"))), "sizes")
    blocks = _dealt(placed, sizes.filter("NOT hot").drop("hot"), sketches)
    hot = written(placed.join(sizes.filter("hot").select("band"), "band").select("key", "component").distinct(), "hot")
    return blocks.unionByName(_rare_blocks(docs, hot, sketches, size, percent)) if hot.limit(1).count() else blocks


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row; ``kept`` marks the smallest key of each component.

    Shuffled are band keys, sketches of candidates and full sets of candidates; texts stay in place while the
    candidates' keys may be broadcast (see ``keep_ids``).
    """
    docs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    named = docs.filter("key is not null")
    most = most_differing_bits(percent / 100)
    signed = written(_signed(docs, size), "signed")
    alone = (F.col("n_shingles") == 0) | F.col("key").isNull()
    # One node for each distinct set.
    classes = written(signed.filter(~alone).groupBy("digest").agg(F.min("key").alias("node")), "classes")
    nodes = written(signed.filter(~alone).join(classes, (signed["key"] == classes["node"]) & (signed["digest"] == classes["digest"])).select("key", "sketch", "bands"), "nodes")
    sketches = nodes.select("key", "sketch")
    # Buckets of two or more, and their centres.
    banded = nodes.select("key", F.explode("bands").alias("band"))
    sizes = written(banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = written(banded.join(sizes, "band"), "members")
    weights = written(members.groupBy("key").agg(F.sum("n").alias("weight")), "weights")
    best = F.max(F.struct("weight", (-F.xxhash64("key")).alias("tie"), F.col("key").alias("center")))
    centers = written(members.join(weights, "key").groupBy("band").agg(best.alias("best")).select("band", "best.center"), "centers")
    star = members.join(centers, "band").filter("key <> center").select(F.least("key", "center").alias("a"), F.greatest("key", "center").alias("b")).distinct()
    links = written(_confirmed(named, written(_plausible(written(star, "star"), sketches, most), "plausible"), size, percent), "links")
    # What the centres did not join.
    blocks = _leftover_blocks(named, members.select("band", "key"), centers, connected_components(links), sketches, size, percent)
    more = written(_crossing_links(named, blocks, most, size, percent), "links")
    components = connected_components(links.union(more))
    found = components.select("node", F.col("component").alias("found"))
    joined = written(classes.join(found, "node", "left").select("digest", F.coalesce("found", "node").alias("component_id")), "joined")
    out = signed.filter(~alone).select("key", "n_shingles", "digest").join(joined, "digest").select("key", "n_shingles", "component_id")
    out = out.unionByName(signed.filter(alone).select("key", "n_shingles", F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))
