"""A corpus pipeline: each stage reads what the one before kept, and its decisions take effect.

Stages take (spark, docs, sf_dir); all but the last return the columns of `documents`. Empty inputs pass through as empty
outputs, extra columns are carried along, and nulls and repeated rows are treated as each operator states.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from costloom.llm import bpe, mixing, neardup, quality, secretscan
from costloom.session import ensure_checkpoint_dir

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARIES = [public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the base rules and the line CRF keep."""
    chain = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_documents(docs, chain)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (5-word shingles, similarity 0.8)."""
    return neardup.keep_one_of_each(docs, words=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes secrets out of the texts."""
    return secretscan.redact_documents(docs, VOCABULARIES)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops, cuts and repeats documents so that sources come near their target weights."""
    return mixing.mix_documents(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids, their number, and whether decoding gives the text back."""
    trip = bpe.round_trip(spark, F.col("text"), RANKS, public_tokenizers.PATTERN, ids=True)
    done = docs.withColumn("_trip", trip)
    return done.withColumn("ids", F.col("_trip.ids")).withColumn("n_tokens", F.col("_trip.n_tokens")).withColumn("round_trip", F.col("_trip.same")).drop("_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]
# Training, sketches and tokens are beyond SQL; tests compare run() with a plain version on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
