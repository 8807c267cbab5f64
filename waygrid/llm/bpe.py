"""Byte-level BPE encoding and decoding without a merge loop.

Bytes are mapped to Latin-1 characters so that one automaton (pyahocorasick) finds, for a whole piece, the
longest vocabulary entry at each position.  A token sequence is the BPE encoding exactly when each pair of
neighbours is *compatible*: merging the bytes of the two by rank leaves those two tokens.  So the encoder
places longest matches from left to right, asks a memo whether neighbours are compatible, and where they are
not falls back to the next shorter entry, or takes back the last token.  An end position that has been given
up once is never tried again, and no step looks further ahead than the longest entry, so the walk is linear in the
piece.  Memos hold vocabulary entries and short strings only, so their bytes are bounded by their numbers of entries.

Cases: a null or empty text has no tokens (count 0, the digests of zero bytes); any text is encoded whole;
repeated rows give repeated rows; an empty table gives an empty one; further columns are ignored unless named.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import worker_state

#: Entries that a worker's memos may hold, and characters of one that is kept: bounds its memory, never the result.
RUNS, PIECES, PAIRS, HEADS, KEPT = 450_000, 150_000, 300_000, 100_000, 48
#: Above any rank.
END = 1 << 40


def trim(memo: dict, most: int) -> None:
    """Drop the newer half of a full memo: what was met first is mostly what is met often."""
    if len(memo) >= most:
        kept = list(islice(memo.items(), most // 2))
        memo.clear()
        memo.update(kept)


def load_ranks(lines) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 token, blank, rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class ByteBPE:
    """Encoder and decoder of one vocabulary; the ranks must hold all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.text_of = {v: str(v) for v in ranks.values()}
        automaton = ahocorasick.Automaton()
        # An entry that its own merges do not rebuild can only stand for a whole piece.
        self.halves = {k: tuple(self.merged(k, 2)) for k in self.ranks if len(k) > 1}
        self.whole = {k for k, v in self.halves.items() if len(v) != 2 or v[0] + v[1] != k or max(map(self.ranks.get, v)) >= self.ranks[k]}
        self.parts = self.ranks.keys() - self.whole
        for key in self.parts:
            automaton.add_word(key, key)
        automaton.make_automaton()
        self.automaton = automaton
        self.longest = max(map(len, self.parts))
        self.fits: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, tuple[list[tuple[str, int]], list[tuple[str, int]]]] = {}
        self.prefixes: dict[str, str] = {}
        self.heads: dict[str, str] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.runs: dict[str, tuple[int, ...]] = {}

    def merged(self, key: str, until: int = 1) -> list[str]:
        """The merges by rank, for short strings, until so many parts are left: shows how an entry is made."""
        parts, ranks = list(key), self.ranks
        while len(parts) > until:
            best, at = min((ranks.get(a + b, END), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == END:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spines(self, token: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
        """The parts of ``token`` that are at its left and at its right end while it is being merged.

        Each comes with the rank of the merge that ends its life; the token itself lives on.
        """
        known = self.edges.get(token)
        if known is None:
            left, right = [(token, END)], [(token, END)]
            if (halves := self.halves.get(token)) is not None:
                rank = self.ranks[token]
                left += [(x, min(end, rank)) for x, end in self.spines(halves[0])[0]]
                right += [(x, min(end, rank)) for x, end in self.spines(halves[1])[1]]
            known = self.edges[token] = left, right
        return known

    def compatible(self, a: str, b: str) -> bool:
        """Whether the merges leave ``a`` and ``b`` next to each other.

        They do unless some part at the right end of ``a`` and some part at the left end of ``b`` would merge
        before either is used up.  At equal ranks the leftmost pair merges first.
        """
        known = self.fits.get((a, b))
        if known is None:
            trim(self.fits, PAIRS)
            rank = self.ranks.get
            starts = self.spines(b)[0]
            known = self.fits[a, b] = not any(
                (r := rank(x + y)) is not None and r < x_end and r <= y_end for x, x_end in self.spines(a)[1] for y, y_end in starts
            )
        return known

    def shorter(self, token: str) -> str:
        """The longest entry that is a proper prefix of ``token``; empty if there is none."""
        known = self.prefixes.get(token)
        if known is None:
            known = self.prefixes[token] = next((x for n in range(len(token) - 1, 0, -1) if (x := token[:n]) in self.parts), "")
        return known

    def head(self, ahead: str) -> str:
        """The longest entry that a string no longer than any entry starts with."""
        known = self.heads.get(ahead)
        if known is None:
            trim(self.heads, HEADS)
            size = self.automaton.longest_prefix(ahead)  # of the path, which may go on beyond an entry
            known = self.heads[ahead] = ahead[:size] if ahead[:size] in self.parts else self.shorter(ahead[:size])
        return known

    def placed(self, s: str) -> list[str]:
        """Tokens of a piece, by backtracking from longest matches."""
        out = [key for _, key in self.automaton.iter_long(s)]
        fits, compatible = self.fits, self.compatible
        for i, pair in enumerate(zip(out, out[1:])):
            if not (fits[pair] if pair in fits else compatible(*pair)):
                break
        else:
            return out
        token = out[i + 1]
        del out[i + 1 :]
        at, end = sum(map(len, out)), len(s)
        given_up: set[int] = set()
        prefixes, heads, longest = self.prefixes, self.heads, self.longest
        while at < end:
            before = out[-1] if out else ""
            while token:
                if at + len(token) not in given_up:
                    known = fits.get((before, token)) if before else True
                    if compatible(before, token) if known is None else known:
                        break
                known = prefixes.get(token)
                token = self.shorter(token) if known is None else known
            if token:
                out.append(token)
                at += len(token)
                if at < end:
                    ahead = s[at : at + longest]
                    token = heads.get(ahead) or self.head(ahead)
            else:
                given_up.add(at)
                last = out.pop()
                at -= len(last)
                token = self.shorter(last)
        return out

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        found = self.pieces.get(piece)
        if found is None:
            s = piece.encode().decode("latin-1")
            whole = self.ranks.get(s)
            found = (whole,) if whole is not None else tuple(map(self.ranks.__getitem__, self.placed(s)))
            if len(piece) <= KEPT:
                trim(self.pieces, PIECES)
                self.pieces[piece] = found
        return found

    def encode_run(self, run: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.encode_piece, self.pattern.findall(run))))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text.

        Texts without odd spacing are cut before each blank: no match of the pattern spans such a cut, so
        each run is encoded on its own and remembered.  Others are matched as they stand.
        """
        if not text:
            return []
        if ODD_SPACE.search(text):
            return list(self.encode_run(text))
        first, *rest = text.split(" ")
        runs = self.runs
        trim(runs, RUNS)
        long: dict[str, tuple[int, ...]] = {}  # remembered for this text alone
        for run in set(rest).difference(runs):
            (runs if len(run) <= KEPT else long)[run] = self.encode_run(" " + run)
        out = list(self.encode_run(first))
        if long:
            out.extend(chain.from_iterable(runs[run] if run in runs else long[run] for run in rest))
        else:
            out.extend(chain.from_iterable(map(runs.__getitem__, rest)))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: A blank next to other white space or at the end, or separators on which engines disagree.
ODD_SPACE = re.compile(r"\s \s|  | $|^ |[\x1c-\x1f]")


def _encoder(name: str, pattern: str) -> ByteBPE:
    """The encoder of this worker; the ranks come from the file that Spark has sent along."""

    def made() -> ByteBPE:
        gc.set_threshold(1_000_000)  # the memos hold no cycles and are large to walk
        with open(SparkFiles.get(name), "rb") as file:
            return ByteBPE(load_ranks(file), pattern)

    return worker_state(f"bpe {name} {pattern}", made)


def encode_documents(
    spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode and decode every text: ``key, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, ``decoded``).

    One pass, no shuffle; each task holds one Arrow batch and its memos.
    """
    spark.sparkContext.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]
    kind = docs.schema[key].dataType.simpleString()
    extra = ", ids array<int>, decoded binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(name, pattern)
        for batch in batches:
            counts, ids_digest, text_digest, all_ids, all_decoded = [], [], [], [], []
            for value in batch.column(1):
                ids = coder.encode(value.as_py() or "")
                decoded = coder.decode(ids)
                counts.append(len(ids))
                ids_digest.append(hashlib.sha256(",".join(map(coder.text_of.__getitem__, ids)).encode()).hexdigest())
                text_digest.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    all_decoded.append(decoded)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_decoded, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")
    return out.withColumnRenamed("key", key)
