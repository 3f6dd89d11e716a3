"""Versions of an index: all tables or none, repeated and killed batches, conflicts, compaction."""

import pytest
from pyspark.sql import functions as F

from tenderloom.plans.ingest import Index
from tenderloom.sources import versions
from tenderloom.sources.versions import VersionConflict, VersionedIndex
from tenderloom.streaming import indexing

NAMES = ["chunks", "hierarchy", "sparse"]


def tables(rows):
    return {n: rows.select("doc_id", F.concat(F.lit(n), F.lit(" "), "text").alias("text")) for n in NAMES}


def docs(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def live(spark, index, version=None):
    return {n: sorted(map(tuple, index.table(spark, n, version).collect())) for n in NAMES}


def expected(*rows):
    return {n: sorted((i, f"{n} {t}") for i, t in rows) for n in NAMES}


def test_versions_and_repeated_batches(spark, tmp_path):
    index = VersionedIndex(str(tmp_path / "index"))
    assert index.version(spark).number == 0
    first = docs(spark, (1, "a"), (2, "b"), (2, "b2"), (3, "c"))
    assert index.commit(tables(first), first, "s", 0) == 1
    second = docs(spark, (2, "new"), (9, "x"))
    assert index.commit(tables(second.filter("doc_id = 2")), second.union(docs(spark, (3, ""))), "s", 1) == 2
    now = expected((1, "a"), (2, "new"))
    assert live(spark, index) == now and index.commit(tables(first), first, "s", 1) == 2 and live(spark, index) == now
    assert live(spark, index, index.version(spark, 1)) == expected((1, "a"), (2, "b"), (2, "b2"), (3, "c"))
    # another stream has its own numbers
    assert index.commit(tables(docs(spark, (4, "d"))), docs(spark, (4, "")), "other", 0) == 3
    assert index.compacted(spark) == 4 and len(index.version(spark).batches) == 1 and index.version(spark).streams == {"s": 1, "other": 0}
    assert live(spark, index) == expected((1, "a"), (2, "new"), (4, "d"))
    assert index.commit(tables(docs(spark, (1, "z"))), docs(spark, (1, "")), "s", 2) == 5
    assert live(spark, index) == expected((1, "z"), (2, "new"), (4, "d"))
    with pytest.raises(ValueError, match="has the tables"):
        index.commit({"chunks": first}, first)


@pytest.mark.parametrize("dies", ["while a table is written", "before the manifest"])
def test_a_killed_batch_leaves_the_old_version(spark, tmp_path, monkeypatch, dies):
    index = VersionedIndex(str(tmp_path / "index"))
    first = docs(spark, (1, "a"), (2, "b"))
    index.commit(tables(first), first, "s", 0)
    second = docs(spark, (2, "new"), (3, "c"))
    made = tables(second)
    if dies == "while a table is written":
        made["sparse"] = made["sparse"].withColumn("text", F.raise_error(F.lit("killed")).cast("string"))
        with pytest.raises(Exception, match="killed"):
            index.commit(made, second, "s", 1)
    else:
        with monkeypatch.context() as patched:
            patched.setattr(versions._Files, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError, match="killed"):
                index.commit(made, second, "s", 1)
    assert live(spark, index) == expected((1, "a"), (2, "b")) and index.version(spark).number == 1
    assert index.commit(tables(second), second, "s", 1) == 2
    assert live(spark, index) == expected((1, "a"), (2, "new"), (3, "c"))


def test_two_writers(spark, tmp_path, monkeypatch):
    index = VersionedIndex(str(tmp_path / "index"))
    first = docs(spark, (1, "a"))
    index.commit(tables(first), first)
    stale = index.version(spark)
    index.commit(tables(docs(spark, (2, "b"))), docs(spark, (2, "")))
    with monkeypatch.context() as patched:
        patched.setattr(VersionedIndex, "version", lambda self, spark, number=None: stale)
        with pytest.raises(VersionConflict):
            index.commit(tables(docs(spark, (3, "c"))), docs(spark, (3, "")))
    assert live(spark, index) == expected((1, "a"), (2, "b"))


def test_stream_of_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexing, "COMPACT_AFTER", 2)
    source, folder = tmp_path / "in", str(tmp_path / "index")
    index = VersionedIndex(folder)

    def run(*rows):
        docs(spark, *rows).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(source))
        indexing.versioned_stream(stream, lambda b: Index(**tables(b)), folder, str(tmp_path / "checkpoint")).awaitTermination()

    run((1, "a"), (2, "b"))
    run((2, "new"))
    run((3, "c"))
    assert live(spark, index) == expected((1, "a"), (2, "new"), (3, "c"))
    assert index.version(spark).streams == {"documents": 2} and len(index.version(spark).batches) == 1
