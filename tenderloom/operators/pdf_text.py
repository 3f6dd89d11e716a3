"""Repair of text extracted from PDF pages, from tables of text spans.

Spans: doc_id, page, line_id, x, y0, y1, size, text, span_no. Pages: doc_id, page, text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.functions import markdown as md
from tenderloom.functions.text import pattern, strip

_PAGE = ["doc_id", "page"]
SAME_LINE = 3.0
HEADER_ABOVE_BODY = 2.0


def header_lines(spans: DataFrame) -> DataFrame:
    """Lines with a span clearly larger than the most frequent font size of their page."""
    filled = spans.filter(strip("text") != "").withColumn("__size", F.bround("size", 1))
    # The body size is the most frequent one; of equally frequent ones the first on the page.
    counts = filled.groupBy(*_PAGE, "__size").agg(F.count("*").alias("n"), F.min("span_no").alias("first"))
    body = counts.groupBy(*_PAGE).agg(F.max_by("__size", F.struct("n", -F.col("first"))).alias("body"))
    lines = filled.groupBy(*_PAGE, "line_id").agg(
        F.max("size").alias("size"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), "").alias("text"),
        F.min("x").alias("x"),
        ((F.min("y0") + F.max("y1")) / 2).alias("y"),
    )
    large = lines.join(body, _PAGE).filter(F.col("size") >= F.col("body") + HEADER_ABOVE_BODY)
    return large.select(*_PAGE, "line_id", "x", "y", strip("text").alias("text")).filter("text <> ''")


def _same_height(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the visual lines of pages: a line belongs to the group whose first member is less than 3 points away.

    The rows come page by page and by y (third column), those without one last; these stay in the group before them.
    """
    current, anchor, number = None, None, 0
    for batch in batches:
        numbers = []
        for *page, y in zip(*(batch.column(c).to_pylist() for c in range(3))):
            y = math.nan if y is None else y
            if page != current:
                current, anchor, number = page, y, 0
            elif abs(y - anchor) >= SAME_LINE:
                anchor, number = y, number + 1
            numbers.append(number)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], names=[*batch.schema.names, "group_no"])


def visual_lines(large: DataFrame) -> DataFrame:
    """Lines at one height joined from left to right. The grouping follows its own first member, so it is sequential.

    The pages of a task pass as one stream, so that neither a call nor memory is spent on each.
    """
    rows = large.select(*_PAGE, "y", "line_id", "x", "text").dropna(subset=_PAGE)
    together = rows.repartition(*_PAGE).sortWithinPartitions(*_PAGE, F.asc_nulls_last("y"))
    schema = T.StructType([*together.schema.fields, T.StructField("group_no", T.IntegerType())])
    numbered = together.mapInArrow(_same_height, schema).filter("line_id IS NOT NULL")
    grouped = numbered.groupBy(*_PAGE, "group_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "line_id", "text"))), lambda s: s["text"]), " ").alias("text")
    )
    return grouped.select(*_PAGE, "group_no", strip("text").alias("text"))


def recovered_headers(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Large-font lines that the page text lacks, as section headers; page numbers are left out."""
    lines = visual_lines(header_lines(spans)).filter(~F.col("text").rlike(pattern(r"\A-?\s*\d{1,4}\s*-?\z")))
    plain = F.replace(md.without_bold(F.col("page_text")), F.lit(" "), F.lit(""))
    joined = lines.join(pages.select(*_PAGE, F.col("text").alias("page_text")), _PAGE)
    missing = joined.filter(~F.contains(plain, F.replace(F.col("text"), F.lit(" "), F.lit(""))))
    return missing.select(*_PAGE, "group_no", md.roman_with_dot(F.col("text")).alias("header"))


def with_headers(pages: DataFrame, headers: DataFrame) -> DataFrame:
    block = headers.groupBy(*_PAGE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "header"))), lambda h: h["header"]), "\n\n").alias("__h")
    )
    joined = pages.join(block, _PAGE, "left")
    text = F.when(F.col("__h").isNull(), F.col("text")).when(F.col("text") == "", F.col("__h")).otherwise(
        F.concat_ws("\n\n", "__h", "text")
    )
    return joined.withColumn("text", text).drop("__h")


def with_table_rows(pages: DataFrame, table_rows: DataFrame) -> DataFrame:
    """Append rows of tables (doc_id, page, row_no, cells) that the page text lacks under a label."""
    filled = F.filter(F.transform("cells", lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
    rows = table_rows.select(*_PAGE, "row_no", F.array_join(filled, " ").alias("row")).filter(F.length("row") > 5)
    missing = rows.join(pages.select(*_PAGE, F.col("text").alias("__t")), _PAGE).filter(~F.contains(F.col("__t"), F.col("row")))
    block = missing.groupBy(*_PAGE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "row"))), lambda r: r["row"]), "\n").alias("__rows")
    )
    joined = pages.join(block, _PAGE, "left")
    added = F.concat(F.col("text"), F.lit("\n\n[테이블에서 추출]\n"), F.col("__rows"))
    return joined.withColumn("text", F.coalesce(added, F.col("text"))).drop("__rows")


def tidy_page(text):
    """Stray replacement characters, split bold, repeated blank lines and page numbers of one page text."""
    lines = F.transform(F.split(md.replacement_char_to_space(strip(text)), "\n", -1), md.join_bold)
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(joined, pattern(r"^\s*-?\s*\d{1,3}\s*-?\s*$", True), ""))
