"""Vector search, scoring and mode choice for a table of questions.

Index: `id`, `vector` (array of floats) and whatever else is kept. Questions: `query_id`, `vector`, `question`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom import fixed_values as fixed
from tenderloom.functions.questions import search_mode
from tenderloom.functions.text import overlap_share, strip, tokens
from tenderloom.operators.ordered import top_per_group
from tenderloom.session import frozen, setting

QUERY_BLOCK = 1_024
CELLS = 1_000_000
INDEX_BLOCK = 50_000
BLOCK_ROWS = 8_192
MERGED = 8


# ---------------------------------------------------------------- scores
def dense_score(distance: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(F.coalesce(distance, F.lit(1.0)), F.lit(0.0)))


def lexical_score(question_tokens: Column, text_tokens: Column, source_tokens: Column) -> Column:
    score = overlap_share(question_tokens, text_tokens) + fixed.SOURCE_OVERLAP_WEIGHT * overlap_share(
        question_tokens, source_tokens
    )
    return F.when(F.size(question_tokens) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


# ---------------------------------------------------------------- nearest vectors
def _unit(batch: pa.ListArray | pa.LargeListArray, size: int) -> np.ndarray:
    values = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    length = np.linalg.norm(values, axis=1, keepdims=True)
    return values / np.where(length == 0, 1.0, length)


def _best(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k smallest distances of every row, ties by id."""
    n = distance.shape[1]
    if n <= k:
        rows, columns = np.indices(distance.shape)
        return rows.ravel(), columns.ravel()
    kth = np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
    rows, columns = np.nonzero(distance <= kth)
    order = np.lexsort((ids[columns], distance[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    start = np.searchsorted(rows, np.arange(distance.shape[0]))
    keep = np.arange(len(rows)) - start[rows] < k
    return rows[keep], columns[keep]


def _nearest_in(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step, found = max(k, CELLS // max(1, len(queries))), []
    for start in range(0, len(vectors), step):
        distance = queries @ vectors[start : start + step].T
        np.subtract(1.0, distance, out=distance)
        np.round(distance, 6, out=distance)
        distance += 0.0  # no negative zeros
        rows, columns = _best(distance, ids[start : start + step], k)
        found.append((query_ids[rows], ids[start + columns], distance[rows, columns]))
        if len(found) == MERGED:
            found = [_keep([np.concatenate(parts) for parts in zip(*found)], k)]
    return _keep([np.concatenate(parts) for parts in zip(*found)], k)


def nearest(index: DataFrame, questions: DataFrame, k: int, index_id: str = "id") -> DataFrame:
    """Exact k nearest vectors by cosine distance (six decimals, ties by id): query_id, id, distance, position.

    Each task multiplies its part of the index with the question vectors and keeps k rows per question. Up to
    QUERY_BLOCK questions travel to every task; beyond that both sides are cut into blocks of bounded size and each
    task gets one block of either.
    """
    spark = index.sparkSession
    limit = setting(spark, "query.block", QUERY_BLOCK)
    # a row without a vector is near nothing
    questions = questions.filter(F.col("vector").isNotNull())
    head = questions.select("query_id", "vector").limit(limit + 1).toArrow()
    schema = T.StructType(
        [
            T.StructField("query_id", questions.schema["query_id"].dataType),
            T.StructField("id", index.schema[index_id].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    rows = index.filter(F.col("vector").isNotNull()).select(F.col(index_id).alias("id"), "vector")
    if head.num_rows <= limit:
        found = _with_all_questions(rows, head, k, schema)
    else:
        found = _by_blocks(rows, questions.select("query_id", "vector"), k, limit, schema)
    return top_per_group(
        found, ["query_id"], [F.asc("distance"), F.asc("id")], k, "position", spread=F.pmod(F.xxhash64("id"), F.lit(16))
    )


def _with_all_questions(index: DataFrame, questions: pa.Table, k: int, schema: T.StructType) -> DataFrame:
    query_ids = questions.column("query_id").to_numpy()
    if len(query_ids) == 0:
        return index.sparkSession.createDataFrame([], schema)
    vectors = questions.column("vector").combine_chunks()
    size = len(vectors[0])
    queries = _unit(vectors, size)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            found = _nearest_in(
                query_ids, queries, batch.column("id").to_numpy(zero_copy_only=False), _unit(batch.column("vector"), size), k
            )
            best = found if best is None else tuple(np.concatenate(pair) for pair in zip(best, found))
            if len(best[0]) > 4 * k * len(query_ids):
                best = _keep(best, k)
        if best is not None:
            q, i, d = _keep(best, k)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(d)], ["query_id", "id", "distance"])

    return index.mapInArrow(search, schema)


def _keep(found: tuple, k: int) -> tuple[np.ndarray, ...]:
    q, i, d = found
    order = np.lexsort((i, d, q))
    q, i, d = q[order], i[order], d[order]
    first = np.r_[True, q[1:] != q[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    keep = np.arange(len(q)) - start < k
    return q[keep], i[keep], d[keep]


def _by_blocks(index: DataFrame, questions: DataFrame, k: int, query_block: int, schema: T.StructType) -> DataFrame:
    index_block = setting(index.sparkSession, "index.block", INDEX_BLOCK)
    n_index = max(1, -(-index.count() // index_block))
    n_query = max(1, -(-questions.count() // query_block))

    def numbers(n: int) -> Column:
        # of the type of a remainder: grouped sides meet only if their keys have one type
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = index.withColumn("ib", F.pmod(F.xxhash64("id"), F.lit(n_index).cast("long"))).withColumn("qb", numbers(n_query))
    right = questions.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_query).cast("long"))).withColumn("ib", numbers(n_index))
    names = ["query_id", "id", "distance"]

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        if block.num_rows == 0 or asked.num_rows == 0:
            return pa.table([pa.array([], type=t) for t in (asked.schema.field("query_id").type, block.schema.field("id").type, pa.float64())], names)
        query_vectors = asked.column("vector").combine_chunks()
        size, query_ids, best = len(query_vectors[0]), asked.column("query_id").to_numpy(), None
        queries = _unit(query_vectors, size)
        # unit vectors of one piece of the block at a time
        for batch in block.to_batches(max_chunksize=BLOCK_ROWS):
            found = _nearest_in(query_ids, queries, batch.column("id").to_numpy(zero_copy_only=False), _unit(batch.column("vector"), size), k)
            best = found if best is None else _keep([np.concatenate(pair) for pair in zip(best, found)], k)
        q, i, d = best
        return pa.table([pa.array(q), pa.array(i), pa.array(d)], names)

    return left.groupBy("ib", "qb").cogroup(right.groupBy("ib", "qb")).applyInArrow(search, schema)


def diverse(index: DataFrame, questions: DataFrame, k: int, fetch_k: int = fixed.DIVERSE_FETCH, weight: float = fixed.DIVERSE_WEIGHT) -> DataFrame:
    """k vectors per question by maximal marginal relevance among its `fetch_k` nearest: query_id, id, distance, position.

    Each pick has the largest weight * similarity to the question - (1 - weight) * largest similarity to a vector picked
    before. Similarities have six decimals, ties go to the nearer vector, then to the smaller id. A group has `fetch_k`
    rows at most.
    """
    near = frozen(nearest(index, questions, fetch_k))
    rows = near.join(index.filter(F.col("vector").isNotNull()).select("id", "vector"), "id")
    schema = T.StructType([*[near.schema[c] for c in ("query_id", "id", "distance")], T.StructField("position", T.IntegerType())])

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["distance", "id"]).drop_duplicates("id").reset_index(drop=True)
        vectors = np.array(group["vector"].tolist(), dtype=np.float64)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        likeness, own = np.round(vectors @ vectors.T, 6), 1 - group["distance"].to_numpy()
        picked: list[int] = []
        while len(picked) < min(k, len(group)):
            penalty = likeness[:, picked].max(axis=1) if picked else np.zeros(len(group))
            gain = np.round(weight * own - (1 - weight) * penalty, 6)
            gain[picked] = -np.inf
            picked.append(int(np.argmax(gain)))
        return group.loc[picked, ["query_id", "id", "distance"]].assign(position=np.arange(1, len(picked) + 1, dtype=np.int32))

    return rows.select("query_id", "id", "distance", "vector").groupBy("query_id").applyInPandas(pick, schema)


# ---------------------------------------------------------------- search
def candidate_count(top_k: int, candidate_k: int | None = None) -> int:
    return max(top_k, candidate_k or max(top_k * 4, 40))


def search(
    index: DataFrame,
    questions: DataFrame,
    top_k: int = fixed.DEFAULT_TOP_K,
    mode: str = "chroma",
    alpha: float = fixed.HYBRID_ALPHA,
    hard_threshold: int = fixed.HARD_THRESHOLD,
    candidate_k: int | None = None,
) -> DataFrame:
    """The top hits of every question with their scores.

    `chroma` ranks by vectors, `hybrid` mixes in word overlap for the vector candidates, `dynamic` chooses per
    question. The index also needs `text` and `source`.
    """
    # Written once: its size decides how it meets the texts, and it is not searched for a second time.
    candidates = frozen(nearest(index, questions, candidate_count(top_k, candidate_k)))
    weight = min(1.0, max(0.0, float(alpha)))
    chosen = search_mode(F.col("question"), hard_threshold) if mode == "dynamic" else F.lit(mode)
    asked = questions.select("query_id", tokens(F.col("question")).alias("__q"), chosen.alias("mode"))
    docs = index.select("id", "text", "source")
    rows = docs.join(candidates, ["id"], "inner")
    rows = rows.join(asked, ["query_id"], "inner")
    scored = rows.withColumn("dense_score", dense_score(F.col("distance"))).withColumn(
        "lexical_score", lexical_score(F.col("__q"), tokens(F.col("text")), tokens(F.col("source")))
    )
    mixed = weight * F.col("dense_score") + (1.0 - weight) * F.col("lexical_score")
    scored = scored.withColumn("score", F.when(F.col("mode") == "chroma", F.col("dense_score")).otherwise(mixed))
    best = top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("position")], top_k)
    return best.select("query_id", "rank", "id", "source", "text", "mode", "score", "dense_score", "lexical_score")


def unique_sources(hits: DataFrame) -> DataFrame:
    named = F.nullif(strip("source"), F.lit(""))
    return hits.groupBy("query_id").agg(F.count_distinct(named).alias("n_sources"))


def retrieval_metrics(hits: DataFrame) -> DataFrame:
    """Per trace: hit count, and mean and maximum of the non-zero scores."""
    score = F.when(F.col("score") != 0, F.col("score"))
    return hits.groupBy("query_id").agg(
        F.count("*").alias("retrieval_count"),
        # Ten decimals first, so that the order of the additions cannot show in the fourth.
        F.round(F.round(F.avg(score), 10), 4).alias("retrieval_avg_score"),
        F.round(F.max(score), 4).alias("retrieval_max_score"),
    )
