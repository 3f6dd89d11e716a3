import itertools
import random
import re

import pytest

import corpus_pipeline
from tenderloom.llm import near_copies
from tests.conftest import FOLDER
from tests.llm.helpers import AWKWARD, documents, words


def brute_set(text):
    found = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i:i + 5]) for i in range(max(len(found) - 4, 1))} if found else set()


def brute_groups(texts):
    """place -> smallest place reachable by Jaccard >= 0.8."""
    sets, group = [brute_set(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if group[i] != group[j] and (not all_ or 5 * both >= 4 * all_):
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
    return group


def changed(rng, text, times):
    found = text.split()
    for at in rng.sample(range(len(found)), times):
        found[at] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(found)


def rows():
    """Chains in which every text is alike to the one before only, clouds round one text, and texts with a common passage."""
    rng, texts = random.Random(3), [t for t in AWKWARD if t is None or len(t) < 9000]
    for _ in range(6):
        text = words(rng, 200, 5000)
        for _ in range(8):
            texts.append(text)
            text = changed(rng, text, 4)
    for _ in range(3):
        text = words(rng, 300, 5000)
        texts += [text] + [changed(rng, text, rng.randrange(1, 14)) for _ in range(20)]
    passage = words(rng, 100, 5000)
    texts += [passage + " " + words(rng, rng.choice([20, 40, 80]), 5000) for _ in range(30)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block_rows", [near_copies.BLOCK_ROWS, 2])
def test_against_brute_force(spark, block_rows):
    made = rows() + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    expected = {made[k][0]: made[g][0] for k, g in enumerate(brute_groups([t for _, t in made]))}
    got = near_copies.near_groups(documents(spark, made), block_rows=block_rows).collect()
    assert len(got) == len(made) and {r["doc_id"]: r["component_id"] for r in got} == expected


def test_stage_drops_near_copies_beyond_three_bits(spark):
    made = rows()
    stayed = corpus_pipeline.without_near_copies(spark, documents(spark, made), FOLDER).collect()
    assert sorted(r["doc_id"] for r in stayed) == sorted({made[g][0] for g in brute_groups([t for _, t in made])})
