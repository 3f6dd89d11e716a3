import pytest

from tenderloom.operators import evaluation as ev
from tenderloom.operators.ordered import row_numbers

HITS = [(1, 1, "Dir/A.pdf", 0.5), (1, 2, "b.hwp", 0.25), (1, 3, None, 0.5), (2, 1, "", 1.0), (2, 2, "é x.pdf", 0.75), (None, 1, "A.pdf", 1.0)]
TRUTH = [(1, ["a.hwp", "B", None]), (1, ["b", "B.hwp"]), (2, ["é X"]), (3, None), (4, []), (None, ["a"])]


@pytest.fixture
def frames(spark):
    return spark.createDataFrame(TRUTH, "query_id int, sources array<string>"), spark.createDataFrame(HITS, "query_id int, rank int, source string, score double")


def test_names_are_read_once_each(frames, capsys):
    """Neither hits nor questions go through Python or the patterns row by row."""
    truth, hits = frames
    ev.matched_hits(ev.truth_sources(truth), hits).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "regexp_replace" not in plan


def test_matches_of_repeated_nulls_and_decomposed_names(frames):
    truth, hits = frames
    rows = ev.truth_sources(truth, distinct=False)
    assert sorted((r["query_id"] or 0, r["n_truth"], r["truth"]) for r in rows.collect()) == [(0, 1, "a"), (1, 2, "a.hwp"), (1, 2, "b"), (1, 2, "b"), (1, 2, "b.hwp"), (2, 1, "é x")]
    found = ev.matched_hits(rows, hits).collect()
    assert sorted((r["query_id"], r["rank"], r["truth"]) for r in found) == [(1, 1, "a.hwp"), (1, 2, "b"), (1, 2, "b"), (1, 2, "b.hwp"), (2, 2, "é x")]


@pytest.mark.parametrize("limit", [1000, 3])
def test_row_numbers_of_small_and_large_groups(spark, limit, capsys):
    df = spark.createDataFrame([(k, n) for k in (1, 2, 3) for n in range(2 * k)] + [(None, 5)], "k int, n int")
    spark.conf.set("spark.tenderloom.ordered.block.rows", str(limit))
    try:
        placed = row_numbers(df, ["k"], ["n"])
    finally:
        spark.conf.unset("spark.tenderloom.ordered.block.rows")
    assert sorted(tuple(r) for r in placed.collect()) == [(k, n, n + 1) for k in (1, 2, 3) for n in range(2 * k)]
    placed.explain()
    assert ("__range" in capsys.readouterr().out) == (limit == 3)
