import hashlib
import re

import pytest

from tenderloom.llm.common import parted
from tenderloom.llm.exact_dedup import deduplicated, exact_groups
from tests.llm.helpers import AWKWARD, documents


def brute(rows):
    """(doc_id, normalised text) -> (keep_id, group_size)."""
    def normal(t):
        return re.sub("[\x20\x09-\x0D]", "", t or "")

    unique = {}
    for doc_id, text in rows:
        key = (doc_id, normal(text))
        unique[key] = max(unique.get(key, 0), len(text or ""))
    found = {}
    for key in unique:
        group = [k for k in unique if k[1] == key[1]]
        best = min(group, key=lambda k: (-unique[k], k[0] is None, k[0] or 0))
        found[key[0], hashlib.sha256(key[1].encode()).hexdigest()] = (best[0], len(group))
    return found


ROWS = [(i, t) for i, t in enumerate(AWKWARD)] + [
    (20, "a b c"), (21, "abc"), (22, "a  b c "), (23, "a b  c "), (24, "ab c" * 200), (25, "abc" * 200), (26, "abc" * 199 + "abd"),
    (27, None), (28, "  "), (20, "a b c"), (20, "another"), (None, "abc"), (None, "lonely"), (29, "x" * 70000 + "y"), (30, "x" * 70000 + "z"), (31, "x" * 70000 + " y"),
]


@pytest.mark.parametrize("all_rows", [True, False])
def test_against_brute_force(spark, all_rows):
    expected = brute(ROWS)
    got = exact_groups(documents(spark, ROWS), all_rows=all_rows).collect()
    found = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in got}
    assert len(found) == len(got)
    repeats = {(20, hashlib.sha256(b"abc").hexdigest())}
    assert found == {k: v for k, v in expected.items() if all_rows or v[1] > 1 or k in repeats}
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert {(r["doc_id"], r["text_sha256"]) for r in got if r["copies"] > 1} == repeats


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark, ROWS)
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    expected = sorted((str(k[0]), k[1]) for k, v in brute(ROWS).items() if k[0] == v[0])
    got = sorted((str(r["doc_id"]), hashlib.sha256(re.sub("[\x20\x09-\x0D]", "", r["text"] or "").encode()).hexdigest()) for r in kept.collect())
    assert got == expected


def test_empty_table(spark):
    docs = documents(spark, ROWS).where("false")
    assert exact_groups(docs, all_rows=True).count() == 0
    assert deduplicated(docs).count() == 0


def test_parting_by_marks(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(3000)] + [(None, "y"), (5, "again")], "doc_id long, _place string").repartition(3)
    marked = spark.createDataFrame([(i,) for i in range(0, 3000, 3)] + [(None,), (9_999,)], "k long")
    clear, touched = parted(rows, "doc_id", marked)
    assert clear.columns == touched.columns == rows.columns
    assert sorted(map(str, clear.collect() + touched.collect())) == sorted(map(str, rows.collect()))
    ids = {r["doc_id"] for r in touched.collect()}
    assert ids >= {None, *range(0, 3000, 3)} and len(ids) < 1010
    assert parted(rows, "doc_id", marked.where("false"))[1].count() == 0
