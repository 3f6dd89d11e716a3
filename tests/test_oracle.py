"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, connect
from tests.conftest import FOLDER

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    problem = compare(QUERIES[name](spark, FOLDER), con, ORACLES[name])
    assert problem in ("", "both empty")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


@pytest.mark.parametrize("name", ["source_metrics", "history_last5", "follow_up", "run_anomaly_by_user", "run_anomaly", "running_history",
                                  "global_chunk_ids", "bid_table", "incremental_upsert", "items_by_project", "repair_counts", "knn_dense",
                                  "label_scores", "answered_questions", "diversify", "merge_dedupe", "table_short_circuit"])
def test_matches_oracle_with_large_group_paths(small_groups, con, name):
    assert compare(QUERIES[name](small_groups, FOLDER), con, ORACLES[name]) in ("", "both empty")
