import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tenderloom.llm import quality
from tests.llm.helpers import AWKWARD, documents, words


def brute(text):
    text = text or ""
    found = re.findall("[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    windows = [tuple(found[i:i + 5]) for i in range(len(found) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def rows():
    rng = random.Random(3)
    made = [(i, t) for i, t in enumerate(AWKWARD)]
    for i in range(100, 160):
        text = words(rng, rng.randrange(1, 80), pool=rng.choice([3, 20, 400]))
        if rng.random() < 0.4:
            text = "\n".join(rng.choice([text, words(rng, 7), "# | $", " ", "- a b"]) for _ in range(rng.randrange(1, 9)))
        made.append((i, text))
    return [*made, (100, made[20][1]), (None, "null id, still a text of more than ten words in all, is it not?")]


def test_measures_against_brute_force(spark):
    made = rows()
    got = quality.judged(documents(spark, made)).collect()
    assert len(got) == len(made)
    texts = {}
    for doc_id, text in made:
        texts.setdefault(doc_id, []).append(text)
    for r in got:
        expected = [brute(t) for t in texts[r["doc_id"]]]
        measures = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert measures in expected
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_verdict_is_the_same_in_any_order(spark):
    docs, rules = documents(spark, rows()), quality.standard_rules()
    order = quality.measured_order(docs, rules)
    assert [x["rank"] for x in order] == sorted((x["rank"] for x in order), reverse=True)
    assert {x["rule"] for x in order} == set(rules)
    text = F.coalesce("text", F.lit(""))
    one, other = (docs.select("doc_id", quality.first_failure(text, rules, o).isNull().alias("ok")) for o in (order, order[::-1]))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_rules_reject_what_they_name(spark):
    junk = {
        "symbols": "one# two$ three% four& five six seven eight nine ten", "duplicate_lines": "\n".join(["the same line again"] * 5),
        "word_length": "a b c d e f g h i j k l", "letters": "12 34 56 78 90 12 34 word 56 78 90", "stutters": "of of the the word word again again and on",
        "bullets": "- one thing\n- two things\n* three things", "ellipses": "to be continued...\nand so on…\nthe end",
    }
    rules = quality.standard_rules()
    docs = documents(spark, [(k, t) for k, t in enumerate(junk.values())])
    for k, name in enumerate(junk):
        assert [r["doc_id"] for r in docs.where(rules[name](F.col("text"))).collect() if r["doc_id"] == k] == [k]
    clean = documents(spark, [(0, "A plain sentence of ordinary words stays in, whatever the rules say.")])
    assert quality.judged(clean).first()["kept"]


def test_empty_table(spark):
    assert quality.judged(documents(spark, rows()).where("false")).count() == 0
