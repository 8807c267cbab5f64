"""A corpus from the documents: five stages, each over all that its predecessor kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``.

Cases, for all stages: decisions are made by ``doc_id``, so rows that share one go together when one of them is rejected;
rows without a ``doc_id`` can't be named in a decision and pass through; null and empty texts are scored and compared as
the operators say; an empty table gives an empty one; extra columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygrid.llm import bpe, decontaminate, minhash, quality, toxicity
from waygrid.llm.common import fold, keep_ids, table, written

#: A model's decisions reject or keep at this score.
THRESHOLD = 0.3


def _without(docs: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    return keep_ids(docs, written(rejected.select("doc_id").distinct(), name), "doc_id", "left_anti")


def _single(docs: DataFrame) -> DataFrame:
    """One row for each id.  Only ids that occur repeatedly move with their rows, of which each task passes on one."""
    repeated = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        return docs
    row = F.struct(*docs.columns)
    chosen = keep_ids(docs, repeated, "doc_id").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("row"))
    return keep_ids(docs, repeated, "doc_id", "left_anti").unionByName(chosen.select("row.*"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts; all of them where no label says what is toxic."""
    scored = toxicity.toxicity(spark, docs, table(spark, sf_dir, "labels"), folds=4, held_out=2)
    return _without(docs, scored.filter(F.col("score") >= THRESHOLD), "toxic")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all of them where labels of the documents don't show both kinds."""
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    known = labels.join(docs.select("doc_id"), "doc_id", "left_semi").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).first()
    if known["least"] == known["most"]:
        return docs
    scored = quality.score_quality(spark, docs, labels)
    return _without(docs, scored.filter(F.col("score") < THRESHOLD), "poor")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, a similarity of 0.8.

    Of rows that share the id, one stays.
    """
    return _single(_without(docs, minhash.near_duplicates(docs, size=5, percent=80).filter(~F.col("kept")), "copies"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return _without(docs, decontaminate.find_items(spark, docs, table(spark, sf_dir, "benchmark")), "leaks")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_documents(spark, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("byte_bpe", encode),
]

#: Classifiers and edit distances have no SQL form; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
