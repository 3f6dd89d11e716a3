"""Sparse word weights of chunks, as they are stored with the dense vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed


def words(c: Column) -> Column:
    """Word tokens in text order; stands in for a tagger that keeps nouns."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[0-9a-z가-힣]+"), F.lit(0))


def sparse_weights(chunks: DataFrame, key: str, text: str, tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """(key, term, tf, weight): saturated term frequency, lengths related to a fixed average.

    Counting starts inside each task, so a very frequent term costs one row per chunk and no more.
    """
    kept = F.filter(tokenize(F.col(text)), lambda t: F.length(t) <= fixed.BM25_TOKEN_MAX)
    terms = chunks.select(key, kept.alias("__t")).select(key, F.size("__t").alias("n_tokens"), F.explode("__t").alias("term"))
    counted = terms.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("n_tokens").alias("n_tokens"))
    k, b = fixed.BM25_K, fixed.BM25_B
    length = (1 - b) + b * F.col("n_tokens") / fixed.BM25_AVERAGE_LENGTH
    weight = F.col("tf") * (k + 1) / (F.col("tf") + k * length)
    return counted.select(key, "term", "tf", weight.alias("weight"))


def sparse_maps(weights: DataFrame, key: str) -> DataFrame:
    """One map per chunk for the store; a chunk has a bounded number of words."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "weight"))))
    return weights.groupBy(key).agg(pairs.alias("sparse"))
