"""Approximate nearest vectors with an inverted file: lists of vectors by their nearest centroid, few of them read.

Centroids come from Lloyd steps over a sample of bounded size, each step one pass in which every task sends one sum per
list. All vectors are then written once, in folders by list, so that a search reads the folders it probes and no others.
Inside the probed lists distances are exact. How many lists a question probes is measured when the index is built, on a
few vectors whose exact neighbours are known.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.operators.ordered import top_per_group
from tenderloom.operators.search import CELLS, _keep, _nearest_in, _unit, nearest
from tenderloom.session import frozen, setting, shared_folder

MOST_LISTS = 4_096
SAMPLE_PER_LIST = 64
ROUNDS = 8
BLOCK_BYTES = 64 << 20
PROBE_BYTES = 8 << 20
# Parts of a unit vector as whole numbers, so that sums do not depend on the order of the rows.
SCALE = 1 << 24
PROBE_QUESTIONS = 64
TARGET_RECALL = 0.95


@dataclass(frozen=True)
class VectorIndex:
    """Folders of vectors by list under `path` (id, vector, list), one centroid per list, and how many lists to probe."""

    path: str
    schema: T.StructType
    centroids: np.ndarray
    probes: int

    def rows(self, spark) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def _lists_of(vectors: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest lists of every unit vector, nearest first; ties to the smaller number."""
    found = np.empty((len(vectors), min(n, len(centroids))), dtype=np.int64)
    step = max(1, CELLS // max(1, len(centroids)))
    for start in range(0, len(vectors), step):
        distance = -vectors[start:start + step] @ centroids.T
        np.round(distance, 9, out=distance)
        if found.shape[1] == 1:
            found[start:start + step, 0] = distance.argmin(axis=1)  # the first of equal ones
        else:
            found[start:start + step] = np.argsort(distance, axis=1, kind="stable")[:, :found.shape[1]]
    return found


def _vectors(batch: pa.Array) -> np.ndarray:
    return _unit(batch, len(batch[0]))


def _means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One Lloyd step: the directions of the sums of each list; a list without vectors keeps its centroid."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(centroids.shape, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = _vectors(batch.column(0))
                np.add.at(total, _lists_of(vectors, centroids)[:, 0], np.round(vectors * SCALE).astype(np.int64))
        there = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(list(total[there]), pa.list_(pa.int64()))], names=["list", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[number] = total.get(number, 0) + np.array(part.values)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array(list(total.values()), pa.list_(pa.int64()))], names=["list", "sums"])

    schema = "list long, sums array<long>"
    means = centroids.copy()
    for number, total in rows.mapInArrow(sums, schema).repartition("list").mapInArrow(added, schema).collect():  # one row a list
        length = np.linalg.norm(np.array(total, dtype=np.float64))
        if length:
            means[number] = np.array(total) / length
    return means


def build(index: DataFrame, lists: int | None = None, rounds: int = ROUNDS, k: int = 10, path: str | None = None) -> VectorIndex:
    """Index of the rows (id, vector) that have a vector; by default about sqrt(n) lists, at most `MOST_LISTS`.

    The sample for the centroids are the `SAMPLE_PER_LIST` rows a list with the smallest hash of their id. Equal vectors and
    repeated ids are indexed as they are.
    """
    spark = index.sparkSession
    rows = index.filter(F.col("vector").isNotNull()).select("id", "vector")
    n = rows.count()
    lists = max(1, min(lists or round(n ** 0.5), MOST_LISTS, n))
    chosen = rows.select("id").distinct().orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(SAMPLE_PER_LIST * lists)
    # ids only, at most SAMPLE_PER_LIST * MOST_LISTS of them
    sample = frozen(rows.join(F.broadcast(chosen), "id", "left_semi"))
    first = sample.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(lists).toArrow()
    centroids = _vectors(first.column("vector").combine_chunks()) if first.num_rows else np.zeros((0, 1))
    for _ in range(rounds if first.num_rows else 0):
        means = _means(sample.select("vector"), centroids)
        if np.array_equal(means, centroids):
            break
        centroids = means
    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                numbers = _lists_of(_vectors(batch.column(1)), centroids)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], names=["id", "vector", "list"])

    path = path or f"{shared_folder(spark)}/tenderloom/vectors-{uuid.uuid4().hex}"
    # by range of list and id: a list that holds a large part of the rows is spread over several tasks and files
    rows.mapInArrow(assign, schema).repartitionByRange("list", "id").write.partitionBy("list").parquet(path)
    built = VectorIndex(path, schema, centroids, 1)
    return VectorIndex(path, schema, centroids, _probes_needed(built, sample, k, n))


def _probes_needed(built: VectorIndex, sample: DataFrame, k: int, n: int) -> int:
    """The smallest number of probed lists that reach `TARGET_RECALL` of the k nearest of some sample rows."""
    if not n:
        return 1
    asked = frozen(sample.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(1)), "id").limit(PROBE_QUESTIONS).select(F.col("id").alias("query_id"), "vector"))
    rows = built.rows(sample.sparkSession)
    near = nearest(rows, asked, k).select("query_id", "id").join(rows.select("id", "list"), "id").select("query_id", "list")
    # PROBE_QUESTIONS rows, and k lists for each
    questions, lists = asked.toArrow(), near.collect()
    ranked = _lists_of(_vectors(questions.column("vector").combine_chunks()), built.centroids, len(built.centroids))
    place = {q: np.argsort(r) for q, r in zip(questions.column("query_id").to_pylist(), ranked)}
    needed = np.sort([place[r["query_id"]][r["list"]] + 1 for r in lists])
    return int(needed[min(len(needed) - 1, int(np.ceil(TARGET_RECALL * len(needed))) - 1)])


def probed_lists(index: VectorIndex, questions: DataFrame, probes: int | None = None) -> DataFrame:
    """query_id, vector, list: a row for every list a question with a vector looks into, in batches of bounded size."""
    centroids, n = index.centroids, probes or index.probes
    step = max(1, PROBE_BYTES // (8 * max(1, centroids.shape[1]) * max(1, min(n, len(centroids)))))
    schema = T.StructType([questions.schema["query_id"], questions.schema["vector"], T.StructField("list", T.IntegerType())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # an empty index has no lists
            for start in range(0, batch.num_rows if len(centroids) else 0, step):
                piece = batch.slice(start, step)
                found = _lists_of(_vectors(piece.column(1)), centroids, n)
                again = pa.array(np.repeat(np.arange(piece.num_rows), found.shape[1]))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(again), piece.column(1).take(again), pa.array(found.ravel(), pa.int32())],
                                                 names=["query_id", "vector", "list"])

    return questions.filter(F.col("vector").isNotNull()).select("query_id", "vector").mapInArrow(choose, schema)


def search_lists(index: VectorIndex, questions: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """The k nearest vectors in the probed lists: query_id, id, distance, position, as `search.nearest` has them.

    Vectors and the questions that probe their list meet in one task. A list larger than a block of bytes is dealt to several
    tasks, and questions arrive there in pieces of bounded size.
    """
    spark = questions.sparkSession
    width = index.centroids.shape[1]
    block_rows = max(1, setting(spark, "vector.block.bytes", BLOCK_BYTES) // (8 * width))
    asked = frozen(probed_lists(index, questions, probes))
    wanted = [r[0] for r in asked.select("list").distinct().collect()]  # numbers of lists, at most MOST_LISTS
    rows = index.rows(spark).filter(F.col("list").isin(wanted))  # reads the folders of these lists only
    parts = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("parts"))
    sized = F.broadcast(frozen(parts))  # one row a list, at most MOST_LISTS
    id_type, query_type = index.schema["id"].dataType, questions.schema["query_id"].dataType
    vector = F.col("vector").cast("array<double>").alias("vector")
    there = rows.join(sized, "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.lit(False).alias("asks"), "id",
                                            F.lit(None).cast(query_type).alias("query_id"), vector)
    asking = asked.join(sized, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"),
                                              F.lit(None).cast(id_type).alias("id"), "query_id", vector)
    dealt = there.unionByName(asking).repartition("list", "part").sortWithinPartitions("list", "part", "asks")
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("distance", T.DoubleType())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, vectors, best = None, [], [], None
        for batch in batches:
            lists, parts, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            ends = np.flatnonzero((lists[1:] != lists[:-1]) | (parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, end in zip([0, *ends], [*ends, batch.num_rows]):
                if end == start:
                    continue
                if current != (lists[start], parts[start]):
                    current, ids, vectors = (lists[start], parts[start]), [], []
                piece = batch.slice(start, end - start)
                if not asks[start]:
                    ids.append(piece.column(3).to_numpy(zero_copy_only=False))
                    vectors.append(_vectors(piece.column(5)))
                elif ids:
                    if len(ids) > 1:
                        ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    found = _nearest_in(piece.column(4).to_numpy(zero_copy_only=False), _vectors(piece.column(5)), ids[0], vectors[0], k)
                    best = found if best is None else tuple(np.concatenate(pair) for pair in zip(best, found))
            if best is not None:
                q, i, d = _keep(best, k)
                best = None
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(d)], ["query_id", "id", "distance"])

    return top_per_group(dealt.mapInArrow(meet, schema), ["query_id"], [F.asc("distance"), F.asc("id")], k, "position", spread=F.pmod(F.xxhash64("id"), F.lit(16)))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of the exact neighbours of every question that were found."""
    hit = found.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    return exact.select("query_id", "id").distinct().join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
