"""From documents to packed training sequences: language, exact and near copies, source mixture, packing.

Every stage takes the rows its predecessor kept and is judged on them alone. All but the last return the columns of
documents. Each is written as Parquet and read again before the next one.
"""

from __future__ import annotations

import os
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tenderloom.llm import exact_dedup, language, mixing, near_copies, packing, simhash
from tenderloom.llm.queries import TOKEN_LIMIT, tokenizer_file
from tenderloom.session import frozen


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: learns from the rows with a language; documents whose language it does not know go."""
    return language.accepted(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal texts one document stays."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of every group of near copies the document with the smallest id stays.

    Its fingerprints and blocks propose pairs, and bands of minima those its 64 bits are too few for; pairs alike in 0.8
    of their five-word shingles are links.
    """
    return simhash.one_of_each(docs, groups_of=partial(near_copies.near_groups, fingerprints=True))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every source weighs the square root of its size; documents are repeated or left out accordingly."""
    return mixing.mixed(docs, tell=False)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the pieces of all documents with their places in sequences."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), TOKEN_LIMIT)


STAGES = [
    ("language", known_language),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", to_target_weights),
    ("packing", into_sequences),
]

# Trained models, a 64-bit hash and a tokenizer are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for _, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
