"""Label candidates by postings against the scores of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.operators import labels

ITEMS = "item_id long, source string, question string, answer string, query_type string"


def made():
    rng = random.Random(2)
    pool = ["ab", "cd", "efg", "the", "x", "예산", "사업", "system", "1,200", "30", "plan", "12"] + [f"w{i}" for i in range(40)]

    def text(n):
        return "".join(rng.choice(pool) + rng.choice([" ", " ", ", ", "-", ""]) for _ in range(n)).strip()

    items = [(i, f"s{i % 3}", text(12), text(14), rng.choice(["multi_doc", "single_doc"])) for i in range(40)]
    chunks = [(f"s{rng.randrange(4)}", f"c_{i:03}", text(rng.randrange(0, 30))) for i in range(300)]
    # phrases whose ends are parts of longer words in the text
    items += [(100, "s0", "zz", "abcd efgh", "single_doc"), (101, "s0", "zz", "qq ww rr", "single_doc"), (102, "s1", "", "", ""), (103, "s0", "zz", "a bc de f", "single_doc")]
    chunks += [("s0", "p_1", "xabcd efghy"), ("s0", "p_2", "abcd  efgh"), ("s0", "p_3", "qqq ww rrr"), ("s0", "p_4", "xqq ww rr9"), ("s0", "p_5", "9a bc de f9"), ("s0", "p_6", ""), ("s0", None, "abcd efgh")]
    return items, chunks


@pytest.fixture(scope="module")
def tables(spark):
    items, chunks = made()
    return spark.createDataFrame(items, ITEMS), spark.createDataFrame(chunks, "source string, chunk_id string, text string").repartition(3)


@pytest.fixture(scope="module")
def everything(tables):
    """All pairs of a source, scored by the same expressions: (item, chunk) -> score."""
    items, chunks = tables
    rows = items.select("item_id", "source", labels.label_tokens(F.col("question")).alias("q"), labels.label_tokens(F.col("answer")).alias("e"),
                        labels.label_numbers(F.col("answer")).alias("n"), labels.expected_phrases(F.col("answer")).alias("p")).join(chunks, "source")
    scored = rows.select("item_id", "chunk_id", labels.candidate_score(F.col("text"), labels.label_tokens(F.col("text")), labels.label_numbers(F.col("text")), F.col("q"), F.col("e"),
                                                                     F.col("n"), F.col("p")).alias("s"))
    return {(r["item_id"], r["chunk_id"]): r["s"]["score"] for r in scored.collect() if r["chunk_id"]}


@pytest.mark.parametrize("least", [fixed.LABEL_MIN_SCORE, 2.5])
def test_no_pair_above_the_score_is_lost(tables, everything, least):
    got = {(r["item_id"], r["chunk_id"]): r["score"] for r in labels.score_candidates(*tables, least).collect()}
    assert {k: v for k, v in everything.items() if v >= least} == {k: v for k, v in got.items() if v >= least}
    assert len(got) < len(everything)
    assert {(100, "p_1"), (100, "p_2"), (101, "p_3"), (101, "p_4"), (103, "p_5")} & set(got) >= {k for k in everything if k[0] >= 100 and everything[k] >= least}


def test_the_best_of_every_item_even_without_a_score(tables, everything):
    best = {}
    for r in labels.score_candidates(*tables).collect():
        best.setdefault(r["item_id"], []).append((-r["score"], r["chunk_id"]))
    for item in {k[0] for k in everything}:
        assert sorted(best[item])[:20] == sorted((-v, k[1]) for k, v in everything.items() if k[0] == item)[:20]


def test_parts_of_names_without_substrings(spark):
    rng = random.Random(6)
    stored = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(200)] + ["z" * 10_000 + "q"]
    wanted = ["a", "ab", "abc", "cabca", "z" * 9_999, "zq", "bbbbbbbbb", "y"] + ["".join(rng.choice("abc") for _ in range(4)) for _ in range(20)]
    found = labels.contained_in(spark.createDataFrame([(w, w) for w in set(wanted)], "label string, key string"), spark.createDataFrame([(s, s) for s in set(stored)], "raw string, key string"))
    assert sorted(map(tuple, found.collect())) == sorted((w, s) for w in set(wanted) for s in set(stored) if w in s)
