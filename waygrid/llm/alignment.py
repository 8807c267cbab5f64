"""Alignment of two tokenizers' tokens, and how common each alignment is in the whole corpus.

Ends of tokens are cumulative sums of their byte lengths; where an end of one tokenizer is an end of the other
(``intersect1d``) both are cut, and ``searchsorted`` labels each token with its group.  A token's partners are the
tokens whose bytes overlap its own: two more searches give the first and the number of them, and repeating
each token so often gives the links without a loop.

A text is aligned in *units*.  Neither tokenizer joins across a blank that stands between two other characters, so an
ordinary text is cut before its blanks and each distinct unit is encoded and aligned once; any text with other spacing or
unusual characters is one unit.  Documents are gathered in chunks of a bounded number of pairs:

1.  A task writes, for each document, the positions of its distinct pairs in the chunk's sorted list of pairs, and for each
    chunk that list with the number of documents a pair is linked in.
2.  The lists are summed by pair, first under a salt and then without, so that a pair which every chunk has is not one task's
    work; the highest count of each first id is joined to its pairs.
3.  The sums go back to the chunks by a join, each chunk's sums meet its documents, and positions turn into sums.

Cases: a null or empty text, or one whose tokens don't give back its bytes, has no tokens: zeros and an empty digest; a null
key is a key like others; repeated rows are documents of their own; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import worker_state, written

#: Pairs of documents in one chunk, units and links that a worker remembers: these bound memory, never the result.
CHUNK_PAIRS, UNITS, LINKS = 4_000_000, 400_000, 6_000_000
#: Pairs in one row of a chunk's list.
SLICE = 65_536
#: Salts of the first sums.
SALTS = 16

#: Characters on whose classes all engines agree; texts with others are encoded by the vocabulary's own library.
PLAIN = re.compile(r"[\t\n\r -~\xa1-ɏ‐-‧‰-⁞€]*")
#: A blank next to other white space, or at an end.
ODD_SPACE = re.compile(r"\s \s|  | $|^ ")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers: ids of a text, and the bytes of every id."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        special = {i for i, x in self.a.get_added_tokens_decoder().items() if x.special}
        vocabulary = {i: k.encode() if i in special else bytes(letters[c] for c in k) for k, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self.fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks={v: i for i, v in vocabulary.items() if i not in special}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Whether no piece joins what stands before a blank to it.
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_len, self.b_len = (np.array([len(x) for x in entries]) for entries in (self.a_bytes, self.b_bytes))

    def units(self, text: str) -> list[str]:
        """The text in units that start with a blank, which the first of them has been given."""
        if self.cuttable and PLAIN.fullmatch(text) and not ODD_SPACE.search(text):
            return text.split(" ")
        return [text]

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        plain = PLAIN.fullmatch
        a = [self.fast.encode_ordinary(" " + x) if plain(x) else self.a.encode(" " + x, add_special_tokens=False).ids for x in units]
        return a, self.b.encode(units, num_threads=1)

    def whole(self, unit: str, a: list[int], b: list[int]) -> bool:
        """Whether the tokens of both give back the unit's bytes."""
        said = (" " + unit).encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == said == b"".join(map(self.b_bytes.__getitem__, b))


def align(a_ids: np.ndarray, b_ids: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group labels of the tokens of both sides, and the links as positions in both; the bytes of both are the same."""
    a_size, b_size = a_len[a_ids], b_len[b_ids]
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    first = np.searchsorted(b_end, a_end - a_size, "right")
    n = np.searchsorted(b_end - b_size, a_end, "left") - first
    a_link = np.repeat(np.arange(len(a_ids)), n)
    b_link = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    return a_group, b_group, a_link, b_link


class Units:
    """What a worker knows of units: counts, the text of the groups, and the links as ``a << 16 | b``."""

    def __init__(self, pair: Pair):
        self.pair = pair
        most = max(len(pair.a_bytes), len(pair.b_bytes))
        self.words = [f"{i}{end}".encode() for i in range(most) for end in (",", "|", ";", "")]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[bytes | None] = []  # None where the tokens don't give back the unit
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of both, groups, links
        self.starts = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)

    def learn(self, units: list[str]) -> list[int]:
        """Encode and align new units together; their places."""
        pair, base = self.pair, len(self.groups)
        a, b = pair.encode(units)
        good = [i for i, x in enumerate(units) if pair.whole(x, a[i], b[i])]
        sizes, groups = np.zeros((len(units), 4), np.int64), [None] * len(units)
        links = np.zeros(0, np.int64)
        if good:
            na, nb = (np.array([len(x[i]) for i in good]) for x in (a, b))
            a_ids = np.fromiter((t for i in good for t in a[i]), np.int64, na.sum())
            b_ids = np.fromiter((t for i in good for t in b[i]), np.int64, nb.sum())
            a_group, b_group, a_link, b_link = align(a_ids, b_ids, pair.a_len, pair.b_len)
            links = a_ids[a_link] << 16 | b_ids[b_link]
            a_unit, b_unit = np.repeat(np.arange(len(good)), na), np.repeat(np.arange(len(good)), nb)
            a_last, b_last = np.cumsum(na) - 1, np.cumsum(nb) - 1
            n_groups = np.diff(b_group[b_last] + 1, prepend=0)
            sizes[good] = np.stack([na, nb, n_groups, np.bincount(a_unit[a_link], minlength=len(good))], axis=1)
            # Each group's tokens of one side and then of the other, each with the sign that follows it.
            order = np.empty(len(a_ids) + len(b_ids), np.int64)
            a_sign = np.append(a_group[1:] != a_group[:-1], True)
            b_sign = np.append(b_group[1:] != b_group[:-1], True) * 2
            b_sign[b_last] = 3
            order[np.arange(len(a_ids)) + np.searchsorted(b_group, a_group, "left")] = a_ids * 4 + a_sign
            order[np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, "right")] = b_ids * 4 + b_sign
            words, at, codes = self.words, 0, order.tolist()
            for i, n in zip(good, (na + nb).tolist()):
                groups[i] = b"".join([words[c] for c in codes[at : at + n]])
                at += n
        self.groups += groups
        self.sizes = np.concatenate([self.sizes, sizes])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes[:, 3])])
        self.links = np.concatenate([self.links, links])
        return list(range(base, base + len(units)))

    def full(self) -> bool:
        return len(self.groups) > UNITS or len(self.links) > LINKS

    def places(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the places of its units, in order."""
        cut = [self.pair.units(x) if x else [] for x in texts]
        single = [x[0] for x in cut if len(x) == 1]
        index = self.index
        if missing := list({u for x in cut if len(x) > 1 for u in x}.difference(index)):
            for at in range(0, len(missing), 20_000):
                part = missing[at : at + 20_000]
                index.update(zip(part, self.learn(part)))
        alone = iter(self.learn(single) if single else [])
        places = [np.array([next(alone)] if len(x) == 1 else [index[u] for u in x], np.int64) for x in cut]
        # Where a unit is not given back, the whole text decides.
        broken = [i for i, x in enumerate(cut) if len(x) > 1 and any(self.groups[p] is None for p in places[i])]
        for i, p in zip(broken, self.learn([texts[i] for i in broken]) if broken else []):
            places[i] = np.array([p])
        return [p if len(p) and all(self.groups[i] is not None for i in p) else p[:0] for p in places]


def packed(*columns: np.ndarray) -> bytes:
    """Columns of small numbers as bytes: the four bytes of each number lie in four planes, which compress well."""
    flat = np.concatenate(columns).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.split(np.ascontiguousarray(planes.T).view("<u4").ravel(), columns)


def _aligned(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, pattern: str, with_groups: bool) -> DataFrame:
    """``key, text`` to rows of documents (``n_a`` not null) and rows of their chunk's pairs (``pairs`` not null)."""
    kind = docs.schema["key"].dataType.simpleString()
    for path in (a_path, b_path):
        spark.sparkContext.addFile(path)
    names = [path.rsplit("/", 1)[-1] for path in (a_path, b_path)]
    schema = f"chunk bigint, at int, key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, pairs binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = worker_state(f"align {names} {pattern}", lambda: Units(Pair(*map(SparkFiles.get, names), pattern)))
        fields: list[tuple[str, pa.DataType]] = []
        chunk = TaskContext.get().partitionId() << 24
        rows: list[tuple] = []  # key, four sizes, digest, groups
        held: list[tuple[np.ndarray, ...]] = []  # document in the chunk, pair, times

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            doc, pair, times = (np.concatenate(x) if held else np.zeros(0, np.int64) for x in (zip(*held) if held else ((), (), ())))
            known, place, counts = np.unique(pair, return_inverse=True, return_counts=True)
            ends = np.searchsorted(doc, np.arange(len(rows) + 1))
            data = [packed(np.diff(place[s:e], prepend=0), times[s:e]) for s, e in zip(ends[:-1], ends[1:])]
            for at in range(0, len(rows), 2000):
                part = rows[at : at + 2000]
                n = len(part)
                cols = [pa.array([chunk] * n, pa.int64()), pa.nulls(n, pa.int32()), *(pa.array([r[i] for r in part], t) for i, (_, t) in enumerate(fields)), pa.array(data[at : at + 2000], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["chunk", "at", *(f for f, _ in fields), "pairs"])
            for at in range(0, len(known), SLICE):
                said = packed(known[at : at + SLICE], counts[at : at + SLICE])
                cols = [pa.array([chunk], pa.int64()), pa.array([at], pa.int32()), *(pa.nulls(1, t) for _, t in fields), pa.array([said], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["chunk", "at", *(f for f, _ in fields), "pairs"])
            rows.clear()
            held.clear()
            chunk += 1

        for batch in batches:
            fields = [("key", batch.schema.field(0).type), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("groups", pa.string())]
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                places = units.places([x or "" for x in part.column(1).to_pylist()])
                n = np.array([len(p) for p in places])
                of_doc, unit = np.repeat(np.arange(len(places)), n), np.concatenate(places)
                total = np.zeros((len(places), 4), np.int64)
                np.add.at(total, of_doc, units.sizes[unit])
                # Each document's units once, with their times; then their links, repeat-based.
                once, times = np.unique(of_doc << 32 | unit, return_counts=True)
                doc, unit = once >> 32, once & 0xFFFFFFFF
                size = units.sizes[unit, 3]
                link = units.links[np.repeat(units.starts[unit] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                key, inverse = np.unique(np.repeat(doc, size) << 32 | link, return_inverse=True)
                weight = np.bincount(inverse, np.repeat(times, size), minlength=len(key)).astype(np.int64)
                held.append(((key >> 32) + len(rows), key & 0xFFFFFFFF, weight))
                for i, place in enumerate(places):
                    said = b";".join([units.groups[p] for p in place.tolist()])
                    rows.append((part.column(0)[i].as_py(), *total[i].tolist(), hashlib.sha256(said).hexdigest() if len(place) else "", said.decode() if with_groups else None))
                if units.full():
                    units.clear()
                if sum(len(x[0]) for x in held) >= CHUNK_PAIRS:
                    yield from flush()
        if rows:
            yield from flush()

    return docs.mapInArrow(run, schema)


def _listed(lists: DataFrame) -> DataFrame:
    """The pairs of chunks one by one: ``chunk, at, pair, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, at, data in zip(*(c.to_pylist() for c in batch.columns)):
                pair, n = unpacked(data, 2)
                cols = [pa.array(np.full(len(pair), chunk)), pa.array(np.arange(at, at + len(pair), dtype=np.int32)), pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["chunk", "at", "pair", "n"])

    return lists.select("chunk", "at", "pairs").mapInArrow(run, "chunk bigint, at int, pair bigint, n bigint")


def _summed(rows: DataFrame, kind: str) -> DataFrame:
    """Rows in the order chunk, its counts by place, its documents; to the documents with their sums."""
    columns = ["key", "n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, known = None, [], None
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            edges = np.flatnonzero(np.diff(chunks)) + 1
            for s, e in zip([0, *edges], [*edges, len(chunks)]):
                part = batch.slice(s, e - s)
                if chunks[s] != chunk:
                    chunk, parts, known = chunks[s], [], None
                counts = part.filter(pa.compute.is_valid(part.column("n")))
                if counts.num_rows:
                    parts.append(np.stack([counts.column("n").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)]))
                docs = part.filter(pa.compute.is_null(part.column("n")))
                if not docs.num_rows:
                    continue
                if known is None:
                    known = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
                best, total = [], []
                for data in docs.column("pairs"):
                    step, times = unpacked(data.as_py(), 2)
                    n, top = known[:, np.cumsum(step.astype(np.int64))] if len(step) else np.zeros((2, 0), np.int64)
                    best.append(int((times * top).sum()))
                    total.append(int((times * n).sum()))
                cols = [*(docs.column(c) for c in columns), pa.array(best, pa.int64()), pa.array(total, pa.int64()), docs.column("groups_sha256"), docs.column("groups")]
                yield pa.RecordBatch.from_arrays(cols, names=[*columns, "n_best", "count_sum", "groups_sha256", "groups"])

    return rows.mapInArrow(run, f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups string")


def align_tokenizers(
    spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, pattern: str, key: str = "doc_id", text: str = "text", with_groups: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The documents with their alignment, and the corpus's pairs.

    ``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` (and ``groups``) of every row; and ``a, b, n, best`` of
    every pair of ids: in how many documents it is linked, and whether no pair of its first id is linked in more.
    ``a_path`` is a byte-level vocabulary that cuts by ``pattern``, ``b_path`` a piece model that adds a blank in front.
    """
    docs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    found = written(_aligned(spark, docs, a_path, b_path, pattern, with_groups), "aligned")
    listed = _listed(found.filter("at IS NOT NULL"))
    salted = listed.groupBy("pair", (F.col("chunk") % SALTS).alias("salt")).agg(F.sum("n").alias("n"))
    counts = written(salted.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.shiftright("pair", 16)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))
    ranked = counts.withColumn("a", a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))
    ranked = written(ranked, "ranked")
    back = listed.select("chunk", "at", "pair").join(ranked, "pair").select("chunk", "at", "n", "best")
    own = found.filter("at IS NULL").drop("at")
    rows = back.unionByName(own, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.col("at").asc_nulls_last())
    out = _summed(rows, kind).withColumnRenamed("key", key)
    pairs = ranked.select(a.cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFF).cast("int").alias("b"), "n", (F.col("best") == 1).alias("best"))
    return (out if with_groups else out.drop("groups")), pairs
