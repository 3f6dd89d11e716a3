import hashlib
import itertools
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tenderloom.llm import near_copies
from tenderloom.llm.queries import QUERIES
from tenderloom.session import frozen
from tests.conftest import FOLDER
from tests.llm.helpers import AWKWARD, documents, words
from tests.llm.test_near_copies import brute_groups
from tests.llm.test_simhash import brute_print


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage returns over the smallest documents, beginning with the documents."""
    found = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        found.append(frozen(stage(spark, found[-1], FOLDER)))
    return found


def test_all_but_the_last_return_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_keeps_clean_documents(stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    assert all(r["doc_id"] in kept for r in stages[0].collect() if len(r["text"]) >= 20)


def test_one_of_equal_texts(stages):
    groups = {}
    for r in stages[1].collect():
        digest = hashlib.sha256(re.sub("[\x20\x09-\x0D]", "", r["text"]).encode()).hexdigest()
        groups.setdefault(digest, []).append((-len(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(min(g)[1] for g in groups.values())


def test_one_of_near_copies(stages):
    """Jaccard 0.8 or more of five-word shingles, links followed to their end."""
    rows = sorted((r["doc_id"], r["text"]) for r in stages[2].collect())
    group = brute_groups([t for _, t in rows])
    assert sorted(r["doc_id"] for r in stages[3].collect()) == [rows[g][0] for g in sorted(set(group))]


def test_mixture_and_sequences(stages):
    copies, before = Counter(r["doc_id"] for r in stages[4].collect()), {r["doc_id"] for r in stages[3].collect()}
    assert set(copies) <= before and 0.7 < sum(copies.values()) / len(before) < 1.3
    heads = Counter(r["doc_id"] for r in stages[5].collect() if r["start"] == 0)
    assert heads == copies


def test_run_gives_the_same_rows(spark, stages):
    first, again = ([r[:5] for r in map(tuple, df.collect())] for df in (stages[-1], corpus_pipeline.run(spark, FOLDER)))
    assert sorted(first) == sorted(again)


def test_stages_take_awkward_and_empty_tables(spark):
    rows = [(i, t, "en") for i, t in enumerate(AWKWARD * 2)] + [(None, "some words without an id", "en"), (3, "a repeated id", "de"), (3, "a repeated id", "de")]
    for docs in (documents(spark, rows), documents(spark, rows).where("false")):
        for _, stage in corpus_pipeline.STAGES:
            before = docs.count()
            docs = frozen(stage(spark, docs, FOLDER))
            assert docs.count() >= 0 if before else docs.count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_near_dedup_takes_pairs_from_operator_7(spark):
    rng = random.Random(5)
    texts = [words(rng, 250) for _ in range(6)]
    made = [(k, t) for k, t in enumerate(texts)] + [(10 + k, f"{t} end") for k, t in enumerate(texts)] + [(20, texts[0].upper()), (21, None)]
    prints = near_copies._sketches(documents(spark, made), near_copies.SHINGLE_WORDS, True)
    sets = {r["doc_id"]: (r["set_id"], r["fp"] % 2 ** 64) for r in prints.collect()}
    assert {k: fp for k, (_, fp) in sets.items()} == {k: brute_print(t) for k, t in made}
    close = {tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations(sets.values(), 2) if a != b and (x ^ y).bit_count() <= 3}
    assert close and {tuple(r) for r in near_copies._pairs_by_print(prints).collect()} == close
    assert sorted(r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, documents(spark, made), FOLDER).collect()) == [*range(6), 21]
