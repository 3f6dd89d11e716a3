import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tenderloom.llm import spelling
from tests.llm.helpers import AWKWARD, documents


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, least=6, times=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= times}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    found = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        found[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return found


def misspelt(rng):
    letters = "abcdeéèñßÿÀ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(60)] + ["straße", "strasse", "stresse", "abcabc", "abcbac", "abcabd"]
    rows = []
    for i in range(150):
        said = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.08)), len(base) - 1)]
            if rng.random() < 0.3:
                at, what = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + ("" if what == 0 else rng.choice("abé")) + w[at + (what != 1):]
            said.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "1", "-", "\n"]).join(said)))
    return rows


@pytest.mark.parametrize("node_words", [60, spelling.NODE_WORDS])
def test_against_brute_force(spark, node_words):
    long = "x" * 300
    rows = misspelt(random.Random(3)) + [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "nobody nobody"), (None, "nobody"), (None, "nobody nobody nobodi ")]
    rows += [(2000 + i, f"{long}a {long}b {long}xa {'y' * 70} {'y' * 71} {'y' * 35}z{'y' * 35}") for i in range(6)] + [(5, "again another")] * 6
    rows += [(3000, "chainxaa " * 5), (3001, "chainxab " * 25), (3002, "chainxbb " * 125)]
    got = spelling.variants(documents(spark, rows), node_words=node_words).collect()
    found = {r["word"]: tuple(r)[1:] for r in got}
    expected = brute(rows)
    assert len(found) == len(got) and found == expected
    assert sum(v[0] is not None for v in expected.values()) > 20 and any(v[1] != v[0] and v[0] for v in expected.values())


def test_walk_finds_all_pairs_within_bounded_blocks(monkeypatch):
    monkeypatch.setattr(spelling, "PAIRS_AT_ONCE", 50)
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(400)})
    trie = spelling.Trie([w.encode("latin-1") for w in words], np.ones(len(words), dtype=np.int64))
    found = set()
    for left, right, spent in spelling.walked(trie, trie):
        assert len(left) <= 400
        for i in np.flatnonzero(spelling.verified(trie, trie, left, right)):
            pair = frozenset((trie.words[left[i]].decode("latin-1"), trie.words[right[i]].decode("latin-1")))
            assert spent[i] == 0 or pair not in found
            found.add(pair)
    assert found == {frozenset((a, b)) for a in words for b in words if one_apart(a, b)}


def test_no_words(spark):
    assert spelling.variants(documents(spark, [(1, None), (2, "")])).count() == 0
    assert spelling.variants(documents(spark, [(1, "a")]).where("false")).count() == 0


def test_roots_of_long_paths(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)], "word string, form string")
    assert {r["root"] for r in spelling.roots(links).collect()} == {"w20"}
