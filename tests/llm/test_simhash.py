import random
import re

import numpy as np
import pytest
import xxhash

from tenderloom.llm import simhash
from tenderloom.llm.components import components
from tests.conftest import FOLDER
from tests.llm.helpers import AWKWARD, documents, words


def brute_print(text):
    found = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i:i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """place -> smallest place reachable."""
    group = list(range(len(prints)))
    for _ in range(len(prints)):
        before = list(group)
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    group[i] = min(group[i], group[j])
        if group == before:
            return group
    return group


def rows():
    rng = random.Random(9)
    made = [(i, t) for i, t in enumerate(AWKWARD)]
    for i in range(100, 160, 3):
        text = words(rng, 250)
        near = text.split()
        near[7] = "changed"
        made += [(i, text), (i + 1, " ".join(near)), (i + 2, text.upper())]
    return [*made, (100, made[20][1]), (None, made[21][1]), (None, "no id and no copy anywhere")]


@pytest.mark.parametrize("bucket_rows", [4096, 2])
def test_against_brute_force(spark, bucket_rows):
    made = rows() + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    prints = [brute_print(t) for _, t in made]
    group = brute_groups(prints)
    ids = {}
    for g, (doc_id, _) in zip(group, made):
        ids[g] = doc_id if ids.get(g) is None else ids[g] if doc_id is None else min(ids[g], doc_id)
    expected = sorted((str(d), f"{p:016x}", str(ids[g])) for (d, _), p, g in zip(made, prints, group))
    got = simhash.near_groups(documents(spark, made), bucket_rows=bucket_rows).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == expected


def test_chains_and_dense_clouds_lose_no_link(spark):
    """Fingerprints made to order: long chains of close steps, and clouds that share most of their blocks."""
    rng = random.Random(2)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(40):
            prints.add(p)
            for _ in range(rng.choice([1, 2, 3, 3, 4])):
                p ^= 1 << rng.randrange(64)
    base = rng.getrandbits(64)
    prints |= {base ^ rng.getrandbits(10) << 30 for _ in range(700)} | {base ^ rng.getrandbits(12) << 50 for _ in range(100)} | {0, 7, 2**64 - 1}
    prints = sorted(prints)
    group = brute_groups_fast(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    for bucket_rows in (4096, 8):
        found = {int(np.int64(r["node"]).astype(np.uint64)): r["component"] for r in components(simhash.links(frame, bucket_rows)).collect()}
        named = {}
        for p, g in zip(prints, group):
            named.setdefault(found.get(p, f"alone {p}"), set()).add(g)
        assert all(len(g) == 1 for g in named.values()) and len(named) == len(set(group))


def brute_groups_fast(prints):
    all_prints = np.array(prints, dtype=np.uint64)
    group = np.arange(len(prints))
    while True:
        new = np.array([group[np.bitwise_count(all_prints ^ p) <= 3].min() for p in all_prints])
        if (new == group).all():
            return group.tolist()
        group = new


@pytest.mark.parametrize("way", [0, 7, 19, 20 + 7, 20 * 20 + 19])
def test_links_in_a_key_by_flips_and_by_pairs(way):
    rng, free = random.Random(way), simhash._free_bits(way)
    fps = np.array(sorted({simhash._mask(sorted({rng.choice(free) for _ in range(rng.randrange(6))})) for _ in range(2500)}), dtype=np.uint64)
    whole = simhash.close_links(fps[:simhash.PAIRWISE_ROWS], way)
    kept, simhash.PAIRWISE_ROWS = simhash.PAIRWISE_ROWS, 0
    try:
        flipped = simhash.close_links(fps[:kept], way)
    finally:
        simhash.PAIRWISE_ROWS = kept
    assert len(whole) == len(flipped) and all((a ^ b).bit_count() <= 3 for a, b in whole + flipped)


def test_components_of_a_path_a_star_and_a_ring(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    ring = [(i, i + 1) for i in range(-20, -1)] + [(-1, -20)]
    edges = spark.createDataFrame(path + star + ring + [(7, 7)], "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 560)}, **{i: -20 for i in range(-20, 0)}}


def test_one_of_each_group_stays(spark):
    docs = documents(spark, rows())
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = simhash.near_groups(docs).collect()
    ids = sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect())
    # the repeated id 100 has two different texts, each in a group that it names
    assert ids == sorted([100, *{r["component_id"] for r in groups if r["component_id"] is not None}])


def test_empty_table(spark):
    docs = documents(spark, rows()).where("false")
    assert simhash.near_groups(docs).count() == 0
    assert simhash.one_of_each(docs).count() == 0
