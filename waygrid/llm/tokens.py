"""Token counts with a digest cache.

Counts are stored under (digest of the tokenizer file, digest of the normalised text).  A run joins the
documents' digests to the stored counts, encodes one text for each digest that is missing, appends those
counts, and reads all counts back from the cache.  Normalised means: runs of ASCII white space are one blank
and the ends are trimmed, which this tokenizer's own normaliser and splitter make of them anyway, so texts with
one digest have one count.

Cases: a null text counts as empty (0 tokens); a null key is a key like others, and one key may have several texts;
copies share one encoding; an empty table gives an empty one;
other columns are ignored.  The cache must be a folder that driver and executors share.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import trim
from .common import BROADCAST_ROWS, worker_state, written

CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokenizer", T.StringType())])

#: Entries of a worker's memo: bounds memory, never the result.
MEMO = 800_000

#: Characters for which lower-casing and cutting at white space are plain; any other text goes to the library whole.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")


class Counter:
    """Counts tokens as the library does, remembering the counts of blank-separated runs.

    The tokenizer's splitter never matches across white space, so a plain text counts as the sum of its runs.
    Texts with unusual characters or with the opening of a special token are encoded whole by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.runs: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, missing: list[str]) -> None:
        """Count new runs, many in one call: a token belongs to the run that its offset falls in."""
        for at in range(0, len(missing), 2000):
            part = missing[at : at + 2000]
            starts = np.cumsum([0, *(len(x) + 1 for x in part[:-1])])
            offsets = [x[0] for x in self.tokenizer.encode(" ".join(part), add_special_tokens=False).offsets]
            counts = np.bincount(np.searchsorted(starts, offsets, "right") - 1, minlength=len(part))
            self.runs.update(zip(part, counts.tolist()))

    def count(self, text: str) -> int:
        if "<|" in text or not PLAIN.fullmatch(text):
            return self.counts([text])[0]
        runs, words = self.runs, text.lower().split()
        trim(runs, MEMO)
        if missing := list(set(words).difference(runs)):
            self.learn(missing)
        return sum(map(runs.__getitem__, words))


def _counter(name: str) -> Counter:
    return worker_state(f"tokens {name}", lambda: Counter(SparkFiles.get(name)))


def content_digest(text):
    """SHA-256 of the normalised text, as a column."""
    return F.unhex(F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f]+", " ")), 256))


def _encoded(spark: SparkSession, texts: DataFrame, path: str) -> DataFrame:
    """``digest, text`` to ``digest, n_tokens``."""
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(name)
        for batch in batches:
            counts = [counter.count(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens bigint")


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, cache_dir: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every document, through the cache in ``cache_dir``.

    Only texts to be encoded move, and once: the representative of each missing digest is
    chosen from digests and hashed keys alone (map-side minima, so a text that fills a third of the rows costs one
    row per task), then met by both, so that neither a null key nor one key with several texts can take another
    text's place.  Up to a million missing digests go to the texts; with a full cache nothing but digests is shuffled.  Beyond
    that the texts meet them in a shuffle.  The last join carries no texts; a hot digest there is split by the adaptive
    skew join.
    """
    with open(tokenizer_path, "rb") as file:
        version = hashlib.sha256(file.read()).hexdigest()[:16]
    docs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    digest = content_digest(F.col("text")).alias("digest")
    digests = written(docs.select("key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest), "digests")
    mine = F.col("tokenizer") == version
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache_dir)  # so that a new folder can be read
    stored = spark.read.schema(CACHE).parquet(cache_dir).filter(mine).select("digest", "n_tokens")
    missing = digests.groupBy("digest").agg(F.min(F.xxhash64("key")).alias("owner")).join(stored, "digest", "left_anti")
    missing = written(missing.select(F.col("digest").alias("missed"), "owner"), "missing")
    few = F.broadcast(missing) if missing.count() <= BROADCAST_ROWS else missing.hint("merge")
    texts = docs.select(F.xxhash64("key").alias("own"), digest, "text").join(few, (F.col("digest") == F.col("missed")) & (F.col("own") == F.col("owner")))
    texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
    _encoded(spark, texts, tokenizer_path).withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_dir)
    stored = spark.read.schema(CACHE).parquet(cache_dir).filter(mine).select("digest", "n_tokens")
    # Two runs that share a cache may both have added a digest: one count is kept.  Written, so that both sides of
    # the last join are plain scans and the adaptive join can split a hot digest.
    stored = written(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    out = digests.join(stored, "digest").select(F.col("key").alias(key), "n_bytes", "n_tokens")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
