"""Re-indexing from a stream of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tenderloom.plans.ingest import Index, update_index
from tenderloom.sources.notices_csv import exists
from tenderloom.sources.stores import write_index
from tenderloom.sources.versions import COMPACT_AFTER, VersionedIndex


def index_stream(documents: DataFrame, to_chunks: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Keep an index folder up to date: each micro-batch replaces the chunks of its documents.

    Replacing by document makes a repeated batch harmless, so every document counts once.
    """

    def replace(batch: DataFrame, _: int) -> None:
        fresh = to_chunks(batch)
        spark = batch.sparkSession
        if exists(spark, folder + "/bucket=*"):
            update_index(spark.read.parquet(folder), fresh, folder)
        else:
            write_index(fresh, folder)

    return (
        documents.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def versioned_stream(documents: DataFrame, to_index: Callable[[DataFrame], Index], folder: str, checkpoint: str, name: str = "documents") -> StreamingQuery:
    """Keeps chunks, hierarchy and sparse weights in step: each micro-batch is one version of all three.

    A batch that is repeated after a failure is known by its number, so every document counts once.
    """
    index = VersionedIndex(folder)

    def commit(batch: DataFrame, number: int) -> None:
        made = to_index(batch)
        tables = {"chunks": made.chunks, "hierarchy": made.hierarchy, "sparse": made.sparse}
        index.commit(tables, batch.select("doc_id"), name, number)
        if len(index.version(batch.sparkSession).batches) > COMPACT_AFTER:
            index.compacted(batch.sparkSession)

    return documents.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
