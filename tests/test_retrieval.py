"""Search, re-ranking and metrics against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.operators import evaluation as ev
from tenderloom.operators import labels, rerank, search


def _vectors(n, seed, dim=8):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=dim).round(1).tolist()) for i in range(n)]


def _brute(index, asked, k):
    out = set()
    for q, v in asked:
        v = np.array(v)
        rows = sorted((round(1 - float(np.dot(v, x) / (np.linalg.norm(v) * np.linalg.norm(x))), 6), i) for i, x in index)
        out |= {(q, i, p) for p, (_, i) in enumerate(rows[:k], 1)}
    return out


def _nearest(spark, k=5):
    index, asked = _vectors(300, 1), _vectors(11, 2)
    frame = spark.createDataFrame(index, "id long, vector array<double>").repartition(5)
    found = search.nearest(frame, spark.createDataFrame(asked, "query_id long, vector array<double>"), k)
    return {(r["query_id"], r["id"], r["position"]) for r in found.collect()}, _brute(index, asked, k)


def test_nearest(spark):
    ours, brute = _nearest(spark)
    assert ours == brute


def test_nearest_in_blocks(small_groups):
    ours, brute = _nearest(small_groups)
    assert ours == brute


def test_nearest_without_questions(spark):
    frame = spark.createDataFrame(_vectors(3, 1), "id long, vector array<double>")
    assert search.nearest(frame, spark.createDataFrame([], "query_id long, vector array<double>"), 3).count() == 0


def test_scores(column_of):
    assert column_of(["0", "1", None, "-0.2"], lambda c: search.dense_score(c.cast("double"))) == [1.0, 0.5, 0.5, 1.0]
    tokens = lambda *w: F.array(*[F.lit(x) for x in w])
    assert column_of([""], lambda c: search.lexical_score(tokens("budget", "plan"), tokens("the", "budget"), tokens("plan", "pdf"))) == [0.65]


def _penalized(items, window):
    """The re-ranking rule in plain Python: items are (score, index, source, chunk)."""
    if len(items) <= 2:
        return [i for _, i, _, _ in items]
    ordered = sorted(items, key=lambda x: (-x[0], x[1]))
    size = min(max(4, window), len(items))
    head, tail, picked = ordered[:size], ordered[size:], []
    while head:
        def value(item):
            total = 0.0
            for other in picked[-6:]:
                if item[2] and item[2] == other[2]:
                    gap = None if item[3] is None or other[3] is None else abs(item[3] - other[3])
                    total += 0.25 if gap is None else 1.6 if gap <= 2 else 0.6 if gap <= 5 else 0.15
            return item[0] - total
        best = max(range(len(head)), key=lambda i: (value(head[i]), -i))
        picked.append(head.pop(best))
    return [i for _, i, _, _ in picked + tail]


@pytest.mark.parametrize("window", [3, 10])
def test_spread_sources(spark, window):
    rng = random.Random(window)
    rows, wanted = [], {}
    for q in range(40):
        items = [(rng.choice([0.25, 0.5, 1.0, 1.75, 2.5]), i, rng.choice(["a", "b", "c", ""]), rng.choice([None, 0, 1, 3, 7, 20])) for i in range(1, rng.randint(1, 15) + 1)]
        rows += [(q, i, s, src, c) for s, i, src, c in items]
        wanted[q] = _penalized(items, window)
    frame = spark.createDataFrame(rows, "query_id int, rank int, score double, source_key string, chunk_index int")
    got = {}
    for r in rerank.spread_sources(frame, window).orderBy("query_id", "new_rank").collect():
        got.setdefault(r["query_id"], []).append(r["rank"])
    assert got == wanted


def test_diversify(spark):
    def order(orgs, window=10):
        rows = [(1, i, o, "s") for i, o in enumerate(orgs, 1)]
        out = rerank.diversify(spark.createDataFrame(rows, "query_id int, rank int, org string, source string"), window).orderBy("new_rank")
        return [f"{r['org']}{r['rank']}" for r in out.collect()]

    assert order("AAABCB") == ["A1", "B4", "A2", "B6", "A3", "C5"]
    assert order("AAAA") == ["A1", "A2", "A3", "A4"]
    assert order("AB") == ["A1", "B2"]
    assert order("AAABBB", 2) == ["A1", "B4", "A2", "A3", "B5", "B6"]


def test_merge(spark):
    frame = lambda keys: spark.createDataFrame([(1, i, k) for i, k in enumerate(keys, 1)], "query_id int, rank int, k string")
    out = rerank.merge(frame(["k1", "k2"]), frame(["k2", "k3"]), ["k"], 3).orderBy("new_rank")
    assert [r["k"] for r in out.collect()] == ["k1", "k2", "k3"]
    passes = rerank.union_passes([frame(["a"]), frame(["b", "a"]), frame(["c"])], ["k"], 3).orderBy("rank")
    assert [r["k"] for r in passes.collect()] == ["a", "b", "c"]


def _metrics(spark, sources, k, distinct):
    hits = spark.createDataFrame([(1, i, s) for i, s in enumerate(["b", "a", "c"], 1)], "query_id int, rank int, source string")
    truth = spark.createDataFrame([(1, sources)], "query_id int, sources array<string>")
    row = ev.source_metrics(truth, hits, k, distinct).first()
    return row["hit_position"], row["recall_at_k"]


def test_source_metrics(spark):
    assert _metrics(spark, ["a"], 5, True) == (2, 1.0)
    assert _metrics(spark, ["a", "b"], 1, True) == (2, 0.0)
    assert _metrics(spark, ["a", "b"], 2, True) == (2, 1.0)
    assert _metrics(spark, ["a", "z"], 5, True) == (None, 0.0)
    assert _metrics(spark, ["a", "a"], 5, False) == (None, 1.0)
    assert _metrics(spark, ["a", "a"], 5, True) == (2, 1.0)
    assert _metrics(spark, [], 5, True) == (None, 0.0)


def test_chunk_recall(spark):
    hits = spark.createDataFrame([(1, 1, "h_1", None), (1, 2, "x_9", None)], "query_id int, rank int, chunk_id string, chunk_index int")

    def recall(uids, orders):
        truth = spark.createDataFrame([(1, uids, orders)], "query_id int, uids array<string>, orders array<string>")
        return ev.chunk_recall(truth, hits, 5).first()["chunk_recall"]

    assert recall(["h_1", "h_2"], []) == 0.5
    assert recall([], ["9"]) == 1.0
    assert recall([], []) is None
    assert recall(["q_1"], ["9", "8"]) == 0.5


def test_label_selection(spark):
    scored = spark.createDataFrame(
        [(1, "s1", "a", 3.0, True), (1, "s1", "b", 2.9, True), (1, "s2", "c", 1.0, True), (1, "s2", "d", 0.9, True), (1, "s3", "e", 5.0, False), (2, "s", "f", 0.5, True)],
        "item_id int, source string, chunk_id string, score double, acceptable boolean")
    targets = spark.createDataFrame([(1, 3), (2, 1)], "item_id int, target_n int")
    out = labels.select_labels(scored, targets).orderBy("pick").collect()
    assert [(r["item_id"], r["chunk_id"]) for r in out] == [(1, "a"), (1, "c"), (1, "b")]


def test_unreadable_judge_reply(column_of):
    good = '{"correctness": {"score": 9, "reason": "r"}, "answer_coverage": {"score": 3}}'
    scores = column_of([good, "{bad"], lambda c: ev.judge_scores(c))
    assert (scores[0]["correctness"]["score"], scores[0]["answer_coverage"]["score"], scores[0]["faithfulness"]["score"]) == (5, 3, 0)


def test_diverse_picks(spark):
    index, asked = _vectors(120, 3), _vectors(6, 4)
    frame = spark.createDataFrame(index, "id long, vector array<double>").repartition(4)
    got = search.diverse(frame, spark.createDataFrame(asked, "query_id long, vector array<double>"), 4, 15).collect()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in index}
    for q, v in asked:
        v = np.array(v) / np.linalg.norm(v)
        left, picked = sorted((round(1 - float(v @ unit[i]), 6), i) for i in unit)[:15], []
        while len(picked) < 4:
            best = max(left, key=lambda x: (round(0.5 * (1 - x[0]) - 0.5 * max([round(float(unit[x[1]] @ unit[j]), 6) for j in picked], default=0.0), 6), -x[0], -x[1]))
            left.remove(best)
            picked.append(best[1])
        assert [r["id"] for r in sorted(got, key=lambda r: r["position"]) if r["query_id"] == q] == picked
