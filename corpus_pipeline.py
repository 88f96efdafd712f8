"""The training-data pipeline over ``documents``: stages in order, each on all that the one before kept.

1. ``toxicity``: documents that the pattern grammar scores at 0.3 or more go.
2. ``near_dedup``: of the documents that SimHash fingerprints link (three-word shingles, at
   most three differing bits), the row with the smallest doc_id stays, ties by a hash
   of the row; a row without an id only if no row of its group has one. Rows that repeat
   an id with unlike texts are different documents.
3. ``secrets``: secrets in the text become ``[secret]`` and n_chars follows.
4. ``packing``: token pieces with their sequences.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkgauge.llm import packing, secrets as secret_spans, simhash, toxicity as toxic_grammar
from sparkgauge.llm.common import scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC_FROM = 0.3
SHINGLE_WORDS, MOST_BITS = 3, 3
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic documents; the grammar is learned from the labelled rows of the whole corpus."""
    corpus = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxic_grammar.fit(corpus, table(spark, sf_dir, "labels"))
    scored = toxic_grammar.score(docs.select(*COLUMNS), grammar, name="toxic_score")
    return scored.filter(F.col("toxic_score") < TOXIC_FROM).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first row of each group of near duplicates by doc_id, null last, then by a hash of the row."""
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row_hash"))
    return simhash.first_of_each(rows, ["doc_id", "row_hash"], words=SHINGLE_WORDS, most_bits=MOST_BITS).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    field = secret_spans.fit(docs)
    clean = secret_spans.find_secrets(docs.select(*COLUMNS), field, redact=True)
    changed = F.size("spans") > 0
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts with the sequence and the place that each one has."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", pack_sequences)]

#: Learned scores, connected components and tokenizer ids are beyond SQL; tests compare each stage with a direct version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
