"""The inverted file against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.operators import vector_index
from tenderloom.operators.search import nearest

SCHEMA = "id long, vector array<double>"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    made = [(i, [float(x) for x in centres[i % 30] + rng.normal(size=16) * 0.3]) for i in range(1500)]
    made += [(2000 + i, made[7][1]) for i in range(40)] + [(3000, None), (3001, [0.0] * 16), (7, made[8][1])]
    return spark.createDataFrame(made, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def index(rows):
    return vector_index.build(rows)


def questions(rows):
    return rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


def test_recall_and_pruned_lists(spark, rows, index):
    found, exact = vector_index.search_lists(index, questions(rows), 10), nearest(rows, questions(rows), 10)
    assert vector_index.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    distances = {(r["query_id"], r["id"]): r["distance"] for r in exact.collect()}
    assert all(distances.get((r["query_id"], r["id"]), r["distance"]) == r["distance"] for r in found.collect())
    assert 1 <= index.probes < len(index.centroids) / 3
    # one question reads as many folders as it probes
    one = questions(rows).limit(1)
    numbers = [r["list"] for r in vector_index.probed_lists(index, one).collect()]
    read = index.rows(spark).filter(F.col("list").isin(numbers))
    assert len(numbers) == index.probes and "PartitionFilters: [isnotnull(list" in read._jdf.queryExecution().toString()
    assert read.select(F.input_file_name()).distinct().count() < len(index.rows(spark).inputFiles()) / 2


def test_all_lists_give_the_exact_answer(spark, rows, index):
    spark.conf.set("spark.tenderloom.vector.block.bytes", 8 * 16 * 10)
    try:
        found = vector_index.search_lists(index, questions(rows), 10, len(index.centroids)).collect()
    finally:
        spark.conf.unset("spark.tenderloom.vector.block.bytes")
    assert sorted(map(tuple, found)) == sorted(map(tuple, nearest(rows, questions(rows), 10).collect()))


def test_a_question_with_many_lists_is_written_in_pieces(spark, rows, index, monkeypatch):
    lists, calls, of_rows = len(index.centroids), spark.sparkContext.accumulator(0), vector_index._lists_of

    def counted(vectors, *args):
        calls.add(1)
        return of_rows(vectors, *args)

    asked = questions(rows).coalesce(1)
    whole = vector_index.probed_lists(index, asked, lists).select("query_id", "list").collect()
    monkeypatch.setattr(vector_index, "PROBE_BYTES", 8 * 16 * lists * 2, raising=False)
    monkeypatch.setattr(vector_index, "_lists_of", counted)
    found = vector_index.probed_lists(index, asked, lists).select("query_id", "list").collect()
    # no batch holds the vectors of more than two questions for all their lists
    assert calls.value >= len(whole) / lists / 2
    assert found == whole and len(whole) == lists * asked.filter("vector IS NOT NULL").count()


def test_every_row_is_indexed_once(spark, rows, index):
    with_vector = rows.filter("vector IS NOT NULL")
    assert sorted(r["id"] for r in index.rows(spark).collect()) == sorted(r["id"] for r in with_vector.collect())


def test_empty_and_single(spark, rows):
    none = vector_index.build(rows.filter("false"))
    assert vector_index.search_lists(none, questions(rows), 3).count() == 0
    one = vector_index.build(rows.filter("id = 5"))
    assert {r["id"] for r in vector_index.search_lists(one, questions(rows), 3).collect()} == {5}
    assert vector_index.search_lists(one, questions(rows).filter("false"), 3).count() == 0
