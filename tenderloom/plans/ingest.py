"""From parsed documents to the stored index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.markdown import front_matter
from tenderloom.operators import audit, chunking, hierarchy, sparse, store, tables
from tenderloom.operators.lines import by_document, parts_of
from tenderloom.session import frozen
from tenderloom.sources import stores


@dataclass
class Index:
    """The tables of an index, all keyed by `doc_id`."""

    chunks: DataFrame
    hierarchy: DataFrame
    sparse: DataFrame


def chunk_table(parsed: DataFrame, title: Column, created_at: Column) -> DataFrame:
    """Audited, flattened and cut documents as full chunk rows. `parsed`: doc_id, text.

    The audited texts are written once: the flattening reads documents with and without tables apart. Their length gives
    the number of parts for it and for the chunks.
    """
    audited = frozen(audit.audit(parsed))
    parts = parts_of(audited)
    body = audited.select("doc_id", front_matter(F.col("text"))["body"].alias("text"))
    chunks = chunking.chunk_documents(tables.flatten_tables(body, parts=parts), parts=parts)
    titles = parsed.select("doc_id", title.alias("title"))
    joined = chunks.join(titles, "doc_id")
    return chunking.with_chunk_metadata(joined, F.col("title"), created_at).drop("title")


def build_index(parsed: DataFrame, title: Column, created_at: Column) -> Index:
    """Chunks with uids and section links, the section hierarchy and the sparse weights.

    The chunks are written once to the checkpoint folder: three tables are made of them. For the weights they are dealt by
    key before their terms are counted, so that texts are shuffled and not a row per term.
    """
    chunks = frozen(chunk_table(parsed, title, created_at))
    entries = hierarchy.section_entries(chunks)
    keyed = by_document(chunks.select(F.concat_ws("/", "doc_id", "uid").alias("key"), "text"), key="key")
    return Index(
        chunks=hierarchy.with_section_uid(chunks, entries),
        hierarchy=hierarchy.hierarchy(chunks),
        sparse=sparse.sparse_weights(keyed, "key", "text"),
    )


def update_index(stored: DataFrame, fresh: DataFrame, folder: str) -> int:
    """Replace the documents of `fresh` in a stored table of the folder; only buckets they fall into are rewritten.

    The result is frozen before it is written, because it reads the folder it replaces.
    """
    buckets = stores.index_buckets(stored.sparkSession, stored)
    touched = fresh.select(stores.bucket_of("doc_id", buckets).alias("bucket")).distinct()
    nearby = stored.join(touched, "bucket", "left_semi").drop("bucket", "buckets")
    merged = frozen(store.upserted(nearby, fresh))
    stores.write_index(merged, folder, buckets=buckets)
    return merged.count()


def run_rows(parsed: DataFrame, index: Index, failures: DataFrame | None = None) -> DataFrame:
    """One summary row per document; a document without chunks has failed.

    Every count is of its own table: chunks with terms (sparse), chunks with a vector (dense, none without that column) and
    sections. `parsed` may carry duration_sec, the time its parser took; it is null where nothing was measured.
    `failures` (source, error, seconds) are files that could not be parsed.
    """
    vectors = F.count_if(F.col("vector").isNotNull()) if "vector" in index.chunks.columns else F.lit(0).cast("long")
    chunks = index.chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), vectors.alias("dense_count"))
    # a key is doc_id/uid with one row per term
    weighted = index.sparse.select("key").distinct().select(F.regexp_replace("key", "/[^/]*$", "").alias("__doc"))
    weighted = weighted.groupBy("__doc").agg(F.count("*").alias("sparse_count"))
    sections = index.hierarchy.groupBy("doc_id").agg(F.count("*").alias("hierarchy_count"))
    taken = F.col("duration_sec") if "duration_sec" in parsed.columns else F.lit(None).cast("double")
    rows = parsed.select("doc_id", F.col("doc_id").cast("string").alias("__doc"), F.col("source").alias("file"), taken.alias("duration_sec"))
    rows = rows.join(chunks, "doc_id", "left").join(sections, "doc_id", "left").join(weighted, "__doc", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("chunk_count", "sparse_count", "dense_count", "hierarchy_count")}
    failed = counts["chunk_count"] == 0
    found = rows.select(
        "file",
        F.when(failed, "failed").otherwise("ok").alias("status"),
        "duration_sec",
        *[count.alias(name) for name, count in counts.items()],
        (~failed).alias("reindexed"),
        F.when(failed, "zero chunks produced").alias("error"),
    )
    if failures is None:
        return found
    none = [F.lit(0).cast("long").alias(name) for name in counts]
    lost = failures.where("error is not null").select(
        F.col("source").alias("file"), F.lit("failed").alias("status"), F.col("seconds").alias("duration_sec"), *none,
        F.lit(False).alias("reindexed"), "error",
    )
    return found.unionByName(lost)
