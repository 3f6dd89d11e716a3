import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import language, toxicity
from tenderloom.llm.common import bucket_of
from tests.llm.helpers import AWKWARD, documents

LARGER = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    got = language.identified(docs).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    told = [r for r in got if r["held_out"] and r["n"] >= 20]
    assert sum(r["lang"] == r["lang_pred"] for r in told) > 0.97 * len(told)


def test_languages_of_awkward_texts(spark):
    base = [(i, "the and of was this that from " * 3, "en") for i in range(40)] + [(i, "der die und nicht zwischen für " * 3, "de") for i in range(40, 80)]
    rows = base + [(200 + i, t, "en" if i % 2 else None) for i, t in enumerate(AWKWARD)] + [(None, "und der die nicht", "de"), (3, None, "en"), (500, "123 !?", "en")]
    got = language.identified(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows if r[0] != 3}
    for r in got:
        if r["doc_id"] == 3:
            assert r["lang_pred"] in ("en", "und")
        else:
            text = texts[r["doc_id"]]
            assert (r["lang_pred"] == "und") == (text is None or not any(c.isalpha() for c in text))
    assert {r["lang_pred"] for r in got if r["doc_id"] is None} == {"de"}
    assert next(r for r in got if r["doc_id"] is None)["held_out"] is False


def test_language_of_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "some text", None)])
    assert [(r["lang_pred"], r["score"]) for r in language.identified(docs).collect()] == [("und", 0.0)]
    assert language.identified(docs.where("false")).count() == 0
    assert language.accepted(docs).count() == 0


def test_five_languages_of_equal_size(spark):
    """Every language is trained on, whatever the number of languages."""
    rng, langs = random.Random(6), ["aa", "bb", "cc", "dd", "ee"]
    pools = {lang: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(60)] for lang, letters in zip(langs, ["abcde", "fghij", "klmno", "pqrst", "uvwxy"])}
    made = [(5 * i + k, " ".join(rng.choices(pools[lang], k=20)), lang) for i in range(40) for k, lang in enumerate(langs)]
    docs = documents(spark, made)
    model = language.fit(docs)
    assert model.temperature < 19
    got = docs.select("lang", model.predict(F.col("text")).alias("p")).select("lang", "p.*").collect()
    assert all(r[0] == r[1] and r["score"] >= 0.4 for r in got)
    assert language.accepted(docs).count() == len(made)


def test_long_texts_are_counted_in_pieces():
    text = "".join(chr(97 + i % 7) for i in range(2_500_000))
    found, counts = language.sparse_counts(text)
    assert counts.sum() == 3 * len(text) - 3 and len(found) <= 21


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    classes = np.array([rng.choice(3, p=language.softmax(z)) for z in logits])
    assert 0.85 < language.fitted_temperature(logits, classes) < 1.18
    assert 3.4 < language.fitted_temperature(logits * 4, classes) < 4.7


def test_penalties_make_the_model_sparse():
    rng = np.random.default_rng(2)
    rows = [(np.array([k, *rng.integers(10, 3000, 20)]), np.ones(21) / 5, k) for k in (0, 1) for _ in range(100)]
    weights = language.follow_the_leader(rows, 2, l1=1.0)
    assert weights[0, 0] > 0 > weights[0, 1] and (weights == 0).mean() > 0.95


def test_index_finds_what_a_full_scan_finds():
    rng = random.Random(4)

    def vector():
        found = np.array(sorted(rng.sample(range(40), rng.randrange(1, 6))))
        x = np.array([rng.choice([1.0, 1.7, 2.1]) for _ in found])
        return found, x / np.sqrt(x @ x)

    rows = [vector() for _ in range(700)]
    dense = np.zeros((700, 40))
    for k, (t, x) in enumerate(rows):
        dense[k, t] = x
    index = toxicity.BlockMaxIndex(rows, 40, block=16)
    for _ in range(150):
        t, x = vector()
        scores = np.round(dense[:, t] @ x, 10)
        expected = sorted(((-s, k) for k, s in enumerate(scores) if s > 0))[:15]
        got = [(-round(s, 10), k) for s, k in index.nearest(t, x, 15)]
        assert [s for s, _ in got] == [s for s, _ in expected]
        assert {k for s, k in got if s < got[-1][0]} == {k for s, k in expected if s < expected[-1][0]}


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 6000"), spark.read.parquet(f"{folder}/labels.parquet")
    held_out = bucket_of("doc_id", 5) == 0
    got = toxicity.scored(docs, labels, held_out).withColumn("held", held_out).join(labels, "doc_id").where("held").collect()
    toxic, clean = ([r["predicted"] for r in got if r["toxic"] == y] for y in (1, 0))
    assert sum(toxic) > 0.8 * len(toxic) and sum(clean) < 0.02 * len(clean)
    assert all(0 <= r["score"] <= 1 and len(r["evidence"]) <= 3 for r in got)
    assert all(int(e["example_id"]) % 1 == 0 and zlib.crc32(e["example_id"].encode()) % 5 for r in got for e in r["evidence"])


def test_toxicity_of_awkward_tables(spark):
    rng = random.Random(8)
    filler = [f"plain{i}" for i in range(50)]
    rows = [(i, " ".join(rng.sample(filler, 8) + (["horrid", "horrid"] if i % 4 == 0 else []))) for i in range(200)]
    rows += [(300 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "horrid horrid"), (4, "a second text with this id"), (400, "horrid " * 4), (401, "nothing of the kind")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(4, 0), (9999, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    held_out = bucket_of("doc_id", 5) == 0
    got = toxicity.scored(docs, labels, held_out).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] != 4}
    assert by_id[400]["predicted"] == 1 and by_id[None]["predicted"] == 1 and by_id[401]["predicted"] == 0
    assert by_id[300]["score"] == by_id[301]["score"] < 0.5
    nothing = toxicity.scored(docs, labels.where("false"), held_out).collect()
    assert {(r["score"], r["predicted"]) for r in nothing} == {(0.0, 0)}
    assert toxicity.scored(docs.where("false"), labels, held_out).count() == 0
    one_label = toxicity.scored(docs, labels.where("toxic = 0"), held_out).collect()
    assert {r["predicted"] for r in one_label} == {0}


def test_examples_that_share_a_passage_are_no_copies(spark):
    rng = random.Random(12)
    passage = " ".join(f"same{k}" for k in range(30))
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(9000)}" for _ in range(40))) for i in range(60)]
    rows += [(100 + i, rows[i][1].upper()) for i in range(20)] + [(200 + i, rows[i][1] + " end") for i in range(10)]
    docs = documents(spark, rows).select("doc_id", "text")
    known = spark.createDataFrame([(i, int(i % 100 % 2 == 0)) for i, _ in rows], "doc_id long, toxic int").withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    kept = toxicity._unlike(docs, known).collect()
    assert sorted(r["doc_id"] % 100 for r in kept) == list(range(60))


def test_terms_counted_for_many_texts_are_those_of_each():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 80))) for _ in range(60)] + [None, "", "12 !", "ABCDE abcdef Abcdx äöüßé " * 3]
    vocabulary = sorted({t for text in texts[::2] for t in toxicity.terms(text)})
    counter = toxicity.TermCounter(vocabulary)
    for part in (texts, texts[::-1], []):
        starts, found, counts = counter.counted(part)
        got = [dict(zip((vocabulary[t] for t in found[a:b]), counts[a:b].tolist())) for a, b in zip(starts, starts[1:])]
        assert got == [{t: n for t, n in toxicity.terms(text).items() if t in counter.places} for text in part]


def test_word_cache_may_overflow(monkeypatch):
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 8)
    texts = [f"word{chr(97 + i)} wordy other{chr(97 + i)}" for i in range(20)]
    vocabulary = sorted({t for text in texts for t in toxicity.terms(text)})
    starts, found, counts = toxicity.TermCounter(vocabulary).counted(texts)
    got = [dict(zip((vocabulary[t] for t in found[a:b]), counts[a:b].tolist())) for a, b in zip(starts, starts[1:])]
    assert got == [toxicity.terms(text) for text in texts]


def _made_for_toxicity():
    rng = random.Random(31)
    plain = [f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = [(i, " ".join(rng.choices(plain, k=25) + (["horrid", "awful"] if i % 4 == 0 else []))) for i in range(160)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 160, 7)] + [(2000, None), (2001, ""), (2002, "unmet words only")]
    return rows, [(i, int(i % 4 == 0)) for i in range(160)]


def test_whole_toxicity_query_against_brute_force(spark):
    rows, labelled = _made_for_toxicity()
    docs, labels = documents(spark, rows), spark.createDataFrame(labelled, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, labels, bucket_of("doc_id", 5) == 0).collect()}
    text, y = dict(rows), dict(labelled)
    known = [i for i in y if zlib.crc32(str(i).encode()) % 5]
    rank = [r["i"] for r in spark.createDataFrame([(i,) for i in known], "i long").orderBy(F.xxhash64(F.col("i").cast("string")), "i").collect()]
    counts = {i: toxicity.terms(t) for i, t in text.items()}
    n = {v: sum(y[i] == v for i in known) for v in (0, 1)}
    weight = {}
    for t in {t for i in known for t in counts[i]}:
        a, b = (sum(t in counts[i] for i in known if y[i] == v) for v in (1, 0))
        c, d = n[1] - a, n[0] - b
        chi2 = (a * d - b * c) ** 2 * len(known) / (max(a + b, 1) * max(c + d, 1) * n[0] * n[1])
        idf = np.log((1 + len(rows)) / (1 + sum(t in c for c in counts.values()))) + 1
        weight[t] = idf * (1 if a + b >= toxicity.MIN_ROWS and chi2 >= toxicity.MIN_CHI2 else toxicity.OTHERS)
    assert {w for w in weight.values() if w >= 0.1} and {w for w in weight.values() if w < 0.1}

    def unit(i):
        x = {t: (1 + np.log(k)) * weight[t] for t, k in counts[i].items() if t in weight}
        length = sum(v * v for v in x.values()) ** 0.5
        return {t: v / length for t, v in x.items()}

    units = {i: unit(i) for i in text}
    base = (n[1] + 1) / (len(known) + 2)

    def near(i, among):
        cosines = [(round(sum(v * units[j].get(t, 0.0) for t, v in units[i].items()), 12), j) for j in among]
        return sorted(((s, j) for s, j in cosines if s > 0), key=lambda x: (-x[0], x[1]))[:toxicity.NEIGHBOURS]

    def vote(found):
        return (sum(s for s, j in found if y[j]) + toxicity.PRIOR_VOTES * base) / (sum(s for s, _ in found) + toxicity.PRIOR_VOTES)

    asked, inside = rank[::5], [i for k, i in enumerate(rank) if k % 5]
    slope, offset = toxicity.fitted_curve(np.array([vote(near(i, inside)) for i in asked]), np.array([y[i] for i in asked]), np.ones(len(asked)))
    for i, r in got.items():
        found = near(i, known)
        expected = 1 / (1 + np.exp(-(slope * vote(found) + offset))) if found else base
        assert abs(r["score"] - expected) < 1e-6 and r["predicted"] == int(r["score"] >= 0.5)
        assert [round(e["cosine"], 9) for e in r["evidence"]] == [round(s, 9) for s, _ in found[:toxicity.EVIDENCE]]


def test_a_copy_of_any_example_finds_it(spark):
    rows, labelled = _made_for_toxicity()
    rows += [(3000 + i, text) for i, text in rows[:160]]
    docs, labels = documents(spark, rows), spark.createDataFrame(labelled, "doc_id long, toxic int")
    got = {r["doc_id"]: r["evidence"] for r in toxicity.scored(docs, labels, bucket_of("doc_id", 5) == 0).collect()}
    for i, _ in labelled:
        if zlib.crc32(str(i).encode()) % 5:
            assert got[3000 + i][0]["example_id"] == str(i) and abs(got[3000 + i][0]["cosine"] - 1) < 1e-9


def test_index_grows_with_its_postings_not_with_terms_times_blocks():
    def room(x):
        return x.nbytes if isinstance(x, np.ndarray) else sum(map(room, x)) if isinstance(x, (list, tuple)) else 0

    rows = [(np.array([0, *range(1 + 9 * k, 10 + 9 * k)], np.int32), np.full(10, 10 ** -0.5)) for k in range(2000)]
    index = toxicity.BlockMaxIndex(rows, 18_001, block=16)
    # one frequent term, 18,000 others of one row each; 125 blocks
    assert sum(map(room, index.__dict__.values())) < 64 * 20_000
    assert index.nearest(np.arange(1, 10), np.full(9, 1 / 3), 3) == [(pytest.approx(0.9 ** 0.5), 0)]


def test_judge_travels_with_its_examples():
    import pickle

    rows = [(np.array([0, 2], np.int32), np.array([0.6, 0.8])), (np.array([1], np.int32), np.array([1.0]))]
    judge = toxicity.Judge(["=a", "=b", "=c"], np.ones(3), rows, [7, 8], np.array([1, 0]))
    first = pickle.loads(pickle.dumps(judge))
    assert [[x.tolist() for x in row] for row in first.examples] == [[x.tolist() for x in row] for row in rows]
    # two long arrays, no matter how many examples
    assert first.examples[0][0].base is first.examples[1][0].base
    scores, _, near = first.judged(["a c", "b", ""])
    assert near[:, 0].tolist() == [0, 1, -1] and scores[0] > scores[1] and scores[2] == 0
    assert pickle.loads(pickle.dumps(toxicity.Judge())).examples == []


def test_driver_holds_neither_index_nor_words_of_examples(spark, monkeypatch):
    import os

    driver, index, counter, travelling = os.getpid(), toxicity.BlockMaxIndex, toxicity.TermCounter, []

    def elsewhere(kind):
        def made(*args):
            assert os.getpid() != driver, "made on the driver"
            return kind(*args)
        return made

    def broadcast(context, value, send=type(spark.sparkContext).broadcast):
        travelling.append((value.counted.nbytes if value.counted is not None else 0, len(value.examples), len(value.vocabulary), type(value.vocabulary)))
        return send(context, value)

    rows, labelled = _made_for_toxicity()
    docs, labels = documents(spark, rows), spark.createDataFrame(labelled, "doc_id long, toxic int")
    expected = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, labels, bucket_of("doc_id", 5) == 0).collect()}
    monkeypatch.setattr(toxicity, "BlockMaxIndex", elsewhere(index))
    monkeypatch.setattr(toxicity, "TermCounter", elsewhere(counter))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, labels, bucket_of("doc_id", 5) == 0).collect()}
    assert got == pytest.approx(expected, abs=1e-9)
    # the vocabulary once and never as string objects, the examples once as packed bytes
    assert [bool(n) for _, _, n, _ in travelling] == [True, False] and not any(n for _, n, _, _ in travelling)
    known = [text for (i, text) in rows[:160] if zlib.crc32(str(i).encode()) % 5]
    assert not isinstance(travelling[0][3], list) and 0 < travelling[1][0] < 8 * sum(len(toxicity.terms(t)) for t in known)


def test_examples_passed_over_are_as_if_not_in_the_index():
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(300):
        x = rng.choice([1.0, 1.5, 2.0], 6)
        rows.append((np.sort(rng.choice(50, 6, replace=False)).astype(np.int32), x / np.sqrt(x @ x)))
    without = np.arange(300) % 5 == 0
    kept = np.flatnonzero(~without)
    whole, part = toxicity.BlockMaxIndex(rows, 50, block=16), toxicity.BlockMaxIndex([rows[k] for k in kept], 50, block=16)
    starts = np.concatenate(([0], np.cumsum([6] * 60)))
    asked = tuple(np.concatenate([rows[k][c] for k in range(0, 300, 5)]) for c in (0, 1))
    cosines, near = whole.nearest_of(starts, *asked, 15, without)
    expected, of_part = part.nearest_of(starts, *asked, 15)
    assert np.allclose(cosines, expected, atol=1e-11) and not without[near].any()
    assert (near[:, 0] == kept[of_part[:, 0]]).mean() > 0.9


@pytest.mark.parametrize("most", [0, 1, 255, 256, 70_000, 5_000_000_000])
def test_packed_occurrences_come_back(most):
    terms, counts = np.array([3, 9, 400_000][:3 if most else 0]), np.array([1, most, 2][:3 if most else 0], np.int64)
    found, n = toxicity._told(*toxicity._packed(terms, counts))
    assert found.tolist() == terms.tolist() and n.tolist() == counts.tolist()


def test_packed_examples_are_unpacked_into_two_long_arrays():
    import pyarrow as pa

    rng = np.random.default_rng(11)
    rows = [(np.sort(rng.choice(900, n, replace=False)), rng.integers(1, 400 if n > 20 else 4, n)) for n in rng.integers(1, 40, 600)]
    packed = [toxicity._packed(*r) for r in rows]
    judge = toxicity.Judge(weights=rng.random(900) + 0.1)
    found = judge._unpacked(pa.table({c: pa.array([p[k] for p in packed], pa.binary()) for k, c in enumerate(("terms", "counts"))}))
    for (t, n), (told, units) in zip(rows, found, strict=True):
        x = (1 + np.log(n)) * judge.weights[t]
        assert told.tolist() == t.tolist() and np.allclose(units, x / np.sqrt(x @ x), atol=1e-14)
    assert len({id(x.base) for x, _ in found}) == len({id(x.base) for _, x in found}) == 1
