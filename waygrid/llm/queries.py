"""The queries over the driver's tables, one per operator and ``pipeline``."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, decontaminate, html, langid, licenses, minhash, oracles, quality, spelling, suffixes, tokens, toxicity
from .common import shared_dir, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by word_bpe_49k through a cache that starts empty, so that every distinct text is encoded."""
    cache = f"{shared_dir(spark)}/waygrid/token-cache-{uuid.uuid4().hex}"
    return tokens.count_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held_out=2)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


#: The documents as files: a source is a tree of folders of fifty, the first of each folder is its licence file.
PATH = "concat(source, '/', doc_id div 50, CASE WHEN doc_id % 50 = 0 THEN '/LICENSE' ELSE concat('/', doc_id, '.txt') END)"


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH).alias("path"), "text")
    return licenses.scan(spark, files)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(spark, table(spark, sf_dir, "documents"), folds=3, held_out=1)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item: ``doc_id, item_id, distance``."""
    found = decontaminate.find_items(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    pairs = found.select("doc_id", F.explode(F.arrays_zip("item_ids", "distances")).alias("hit"))
    return pairs.select("doc_id", F.col("hit.item_ids").alias("item_id"), F.col("hit.distances").alias("distance"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held_out=0)


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur elsewhere too, as counts and a digest."""
    return suffixes.without_repeats(table(spark, sf_dir, "documents"), length=200)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.vocabulary(table(spark, sf_dir, "documents"), slip=199, shortest=6, least=5), times=5)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokenizers(spark, table(spark, sf_dir, "documents"), a, b, public_tokenizers.PATTERN)[0]


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_html_text,
        op3_toxicity,
        op4_byte_bpe,
        op5_minhash,
        op6_licenses,
        op7_neighbours,
        op8_language,
        op9_decontaminate,
        op10_quality,
        op11_suffixes,
        op12_spelling,
        op13_alignment,
    )
}

#: Links and components in SQL; the driver's tables have no white space but blanks, tabs and line ends.
OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), classes AS (
  SELECT min(doc_id) AS node, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)
), items AS (
  SELECT node, n, unnest(s) AS item FROM classes
), pairs AS (
  SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.item = b.item AND a.node < b.node
    AND 80 * greatest(a.n, b.n) <= 100 * least(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS (
  SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), reach AS (
  SELECT node AS root, node FROM classes
  UNION
  SELECT r.root, l.b FROM reach r JOIN links l ON r.node = l.a
), components AS (
  SELECT node, min(root) AS component FROM reach GROUP BY node
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, coalesce(m.component, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN classes c ON c.s = list_sort(d.s) AND len(d.s) > 0 LEFT JOIN components m ON m.node = c.node
"""

ORACLE: dict[str, str] = {"op5_minhash": OP5_SQL, "op6_licenses": oracles.licenses_sql(), "op11_suffixes": oracles.repeats_sql(), "op12_spelling": oracles.SPELLING_SQL}
