"""Documents as ordered lines and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.session import setting


CHARS_PER_TASK = 16 << 20


def parts_of(docs: DataFrame, text: str = "text") -> int:
    """So many parts that a task's share of the texts does not grow with the table; the session's number at least."""
    spark = docs.sparkSession
    chars = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    parts = -(-chars // setting(spark, "chars.per.task", CHARS_PER_TASK))
    return max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_document(docs: DataFrame, text: str = "text", parts: int | None = None, key: str = "doc_id") -> DataFrame:
    """The documents partitioned by `doc_id` (or another key), in `parts_of` parts unless their number is known."""
    return docs.repartition(parts_of(docs, text) if parts is None else parts, key)


def explode_lines(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), parts: int | None = None) -> DataFrame:
    """One row per line; documents are partitioned by `doc_id` before, so that windows over it need no other shuffle."""
    placed = by_document(docs.select(*keys, text), text, parts)
    return placed.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def join_lines(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",), order: tuple[str, ...] = ("line_no",), line: str = "line", text: str = "text") -> DataFrame:
    """The lines of every group in order as one text. A group is a document or a part of one, so it was one value before."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, line)))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r[line]), "\n").alias(text))


def in_document(keys: tuple[str, ...] = ("doc_id",)):
    return Window.partitionBy(*keys).orderBy("line_no")
