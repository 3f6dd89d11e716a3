import hashlib
import math
from collections import Counter

import pytest

from tenderloom.llm.mixing import mixed, source_rates
from tests.llm.helpers import documents


def draw(rate, key, seed="mixture"):
    parts, count = max(1, math.ceil(rate / 32)), 0
    for j in range(parts):
        u = int(hashlib.md5(f"{seed}|{key}|{j}".encode()).hexdigest()[:13], 16) / 2**52
        r, p, c, k = rate / parts, math.exp(-rate / parts), math.exp(-rate / parts), 0
        while c <= u and k < r + 12 * math.sqrt(r) + 24:
            k += 1
            p *= r / k
            c += p
            count += 1
    return count


ROWS = [(i, f"text {i}", None, "big") for i in range(600)] + [(i, "t", None, "small") for i in range(600, 640)] + [
    (700, None, None, None), (701, "", None, None), (702, "x", None, "unwanted"), (703, "y", None, "tiny"), (None, "no id", None, "big"), (5, "text 5", None, "big")]


@pytest.mark.parametrize("weights", [None, {"big": 1.0, "small": 1.0, None: 0.5, "tiny": 0.25, "absent": 3.0}])
def test_counts_are_inverted_poisson_draws(spark, weights):
    docs = documents(spark, ROWS)
    rates = {r["source"]: r["rate"] for r in source_rates(docs, weights).collect()}
    expected = Counter()
    for doc_id, text, _, source in ROWS:
        expected[doc_id, text] += draw(rates[source], "\\N" if doc_id is None else doc_id) if rates[source] else 0
    got = mixed(docs, weights)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == +expected
    assert set(docs.columns) < set(got.columns)


def test_rates_reach_the_target_weights(spark):
    docs = documents(spark, ROWS)
    rates = {r["source"]: r for r in source_rates(docs, {"big": 1.0, "small": 3.0}).collect()}
    assert rates["small"]["rate"] * 40 == pytest.approx(0.75 * len(ROWS)) and rates["unwanted"]["rate"] == 0
    copies = Counter(r["source"] for r in mixed(docs, {"big": 1.0, "small": 3.0}).collect())
    assert set(copies) == {"big", "small"}
    assert copies["small"] == pytest.approx(0.75 * len(ROWS), rel=0.15)


def test_a_large_rate_is_a_sum_of_draws(spark):
    docs = documents(spark, [(i, "t", None, "a") for i in range(50)])
    copies = Counter(r["doc_id"] for r in mixed(docs, {"a": 1.0}, total=50 * 150).collect())
    assert copies == {i: draw(150.0, i) for i in range(50)}
    assert sum(copies.values()) == pytest.approx(7500, rel=0.05)


def test_rows_are_stored_in_shuffled_order(spark):
    parts = mixed(documents(spark, ROWS)).select("_order").rdd.glom().map(lambda rows: [r[0] for r in rows]).collect()
    assert [x for p in parts for x in p] == sorted(x for p in parts for x in p)


def test_empty_table(spark):
    assert mixed(documents(spark, ROWS).where("false")).count() == 0
