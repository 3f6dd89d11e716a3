"""Stateful operators against their batch forms and against plain Python."""

import random
from datetime import timedelta

import pytest

from tenderloom import fixed_values as fixed
from tenderloom.operators.conversation import exchanges, with_follow_up, with_history, with_intent
from tenderloom.sources.tables import table
from tenderloom.streaming.conversations import followed
from tenderloom.streaming.intent_cache import with_cached_intent
from tests.conftest import FOLDER


def drained(spark, operator, frames, schema, folder, name):
    """The output of a stream that meets one micro-batch after the other."""
    landing = str(folder / "in")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(landing)
        stream = operator(spark.readStream.schema(schema).parquet(landing))
        query = stream.writeStream.format("parquet").option("path", str(folder / "out")).outputMode("append").trigger(availableNow=True)
        query.option("checkpointLocation", str(folder / "checkpoint")).queryName(name).start().awaitTermination()
    return spark.read.parquet(str(folder / "out")).collect()


def test_conversations_in_two_batches_and_through_the_store(spark, tmp_path):
    source = exchanges(table(spark, FOLDER, "conversations"))
    parts = [source.where("turn < 3"), source.where("turn >= 3")]
    # two rows are held in memory, all others wait in the state store
    rows = drained(spark, lambda s: followed(s, held_rows=2), parts, source.schema, tmp_path, "two")
    key = lambda r: (r["conv_id"], r["turn"])
    live = {key(r): (r["n_history"], r["summary"], r["last_org"], r["has_previous"], r["is_follow_up"]) for r in rows}
    batch = with_follow_up(with_intent(with_history(source))).collect()
    assert live == {key(r): (len(r["history"]), r["summary"], r["last_org"], r["has_previous"], r["is_follow_up"]) for r in batch}


def test_conversation_edges(spark, tmp_path):
    schema = "conv_id long, turn long, query string, answer string, extra int"
    rows = [(1, 2, None, None, 0), (1, 1, "가", "x" * 500, 0), (None, 1, "나", "", 0), (2, None, "다", "", 0), (1, 3, "그거", "", 0)]
    frame = spark.createDataFrame(rows, schema)
    # with an expiry a stream otherwise runs batches without data for ever, as entries may expire in any of them
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        found = drained(spark, lambda s: followed(s, expires=timedelta(hours=1)), [frame, frame.limit(0)], frame.schema, tmp_path, "edges")
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert [(r["turn"], r["n_history"], r["is_follow_up"]) for r in sorted(found, key=lambda r: r["turn"])] == [(1, 0, False), (2, 1, False), (3, 2, True)]
    last = max(found, key=lambda r: r["turn"])["summary"]
    assert last == "Q: 가\nA: " + "x" * fixed.ANSWER_EXCERPT + "...\nQ: \nA: ..."


def brute_cache(asked, size):
    """Dictionaries in order of insertion, the oldest entry goes first."""
    exact, alike, found = {}, {}, []
    for name in asked:
        key = " ".join(name.lower().split())
        signed = "|".join(sorted(set(key.split())))
        by = "exact" if key in exact else "signature" if signed in alike else None
        found.append(by)
        if by is None:
            exact[key] = alike[signed] = name
            for cache in (exact, alike):
                while len(cache) > size:
                    cache.pop(next(iter(cache)))
    return found


@pytest.mark.parametrize("size", [3, fixed.INTENT_CACHE_SIZE])
def test_intent_cache(spark, tmp_path, size):
    draw = random.Random(size)
    names = [f"word{k:03d} budget" for k in range(8 if size == 3 else 300)]
    asked = [draw.choice([n, " ".join(reversed(n.split())), n.upper() + " "]) for n in draw.choices(names, k=60 if size == 3 else 900)]
    frame = spark.createDataFrame(list(enumerate(asked)), "arrival long, query string")
    parts = [frame.where(f"arrival < {len(asked) // 2}"), frame.where(f"arrival >= {len(asked) // 2}")]
    rows = drained(spark, lambda s: with_cached_intent(s, size=size, held_rows=50), parts, frame.schema, tmp_path, f"cache{size}")
    assert [r["found_by"] for r in sorted(rows, key=lambda r: r["arrival"])] == brute_cache(asked, size)


def test_intent_cache_edges(spark, tmp_path):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "가"), (5, "가"), (None, "나")], "arrival long, query string")
    rows = drained(spark, lambda s: with_cached_intent(s, shards=4), [frame], frame.schema, tmp_path, "nothing")
    assert [(r["arrival"], r["found_by"]) for r in sorted(rows, key=lambda r: r["arrival"])] == [(1, None), (2, None), (3, None), (4, None), (5, "exact")]
