"""Expressions and helpers that several operators share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.session import frozen

# The six ASCII blanks: what separates words and what exact dedup ignores.
BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"


def text_of(column: str) -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def bucket_of(id_column: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo `buckets`; null for a null id."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(buckets))


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII blanks, in order; no words give an empty array."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+"))


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so that tasks of one worker share what they computed."""
    module = sys.modules.setdefault("_tenderloom_worker_store", types.ModuleType("_tenderloom_worker_store"))
    return module.__dict__.setdefault(name, {})


MARKS = 1 << 26


def parted(rows: DataFrame, key: str, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is certainly not in the one column of `marked`, and all others; both with the columns of `rows`.

    The marked keys become a bitmap of `MARKS` hashed places, at most 8 MB whatever their number, which every task
    gets. So the first part needs no shuffle, and only the second has to be joined with the keys themselves. The more
    keys, the more rows end up in the second part; nothing but its size depends on that.
    """
    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit("\\N"))), F.lit(MARKS)) + 1

    at = place(F.col(marked.columns[0]))
    marks = frozen(marked.select(F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit"))
                   .groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap")))
    # the row travels as one struct, so that no column of it can clash with those added here
    placed = rows.select(F.struct(*rows.columns).alias("_row"), place(F.col(key)).alias("_place"))
    met = placed.join(F.broadcast(marks), F.bitmap_bucket_number(F.col("_place")) == F.col("_bucket"), "left")
    byte = "CAST(conv(hex(substring(_bitmap, CAST(bitmap_bit_position(_place) DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    found = F.coalesce(F.expr(f"shiftright({byte}, CAST(bitmap_bit_position(_place) % 8 AS INT)) % 2 = 1"), F.lit(False))
    return met.where(~found).select("_row.*"), met.where(found).select("_row.*")


BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to what a Python worker should hold of long texts, unless they are smaller."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("bB")
        # a size with a unit, or none at all, was not made for a worker with long texts
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
