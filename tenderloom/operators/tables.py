"""Markdown tables in documents, worked on as rows of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions.text import blank, pattern, strip, strip_chars
from tenderloom.operators.lines import explode_lines, in_document, join_lines


def is_table_row(line: Column) -> Column:
    return strip(line).rlike(r"(?s)\A\|.+\|\z")


def is_separator(line: Column) -> Column:
    return strip(line).rlike(pattern(r"\A\|[-:\s|]+\|\z"))


def cells(line: Column) -> Column:
    """Cell values; outer bars are stripped, so empty cells at the edges vanish."""
    inner = F.split(strip_chars(strip(line), "|"), r"\|", -1)
    return F.transform(inner, lambda c: strip(F.regexp_replace(c, r"(?i)<br\s*/?>", " ")))


def is_placeholder(headers: Column) -> Column:
    named = F.filter(headers, lambda h: h != "")
    return F.forall(named, lambda h: h.rlike(pattern(fixed.PLACEHOLDER_HEADER_PATTERN)))


def row_text(headers: Column, values: Column) -> Column:
    """A data row as text: `key: value` for two columns, values for placeholder headers, else `header: value` pairs."""
    filled = F.filter(values, lambda v: v != "")
    first, second = F.coalesce(F.get(values, F.lit(0)), F.lit("")), F.coalesce(F.get(values, F.lit(1)), F.lit(""))
    pair = F.when((first != "") & (second != ""), F.concat(first, F.lit(": "), second)).otherwise(F.concat(first, second))
    named = F.transform(
        values,
        lambda v, i: F.when(v == "", F.lit(None).cast("string"))
        .when(F.coalesce(F.get(headers, i), F.lit("")) != "", F.concat(F.get(headers, i), F.lit(": "), v))
        .otherwise(v),
    )
    return (
        F.when(is_placeholder(headers), F.array_join(filled, ", "))
        .when(F.size(headers) == 2, pair)
        .otherwise(F.array_join(F.filter(named, lambda v: v.isNotNull()), ", "))
    )


def classified_lines(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add `block` (number of the table a line belongs to or directly precedes), `in_table` and `row_no`."""
    window = in_document(keys)
    up_to = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = lines.withColumn("in_table", is_table_row(F.col("line")))
    starts = F.col("in_table") & ~F.coalesce(F.lag("in_table").over(window), F.lit(False))
    numbered = flagged.withColumn("__start", starts)
    numbered = numbered.withColumn("block", F.sum(F.col("__start").cast("int")).over(up_to))
    row = F.row_number().over(Window.partitionBy(*keys, "block", "in_table").orderBy("line_no"))
    return numbered.withColumn("row_no", F.when(F.col("in_table"), row)).drop("__start")


def flatten_lines(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Lines with every table row turned into plain text.

    Short lines directly before a table count as its title: the first is stripped on the left and the last on the
    right. Tables without data rows stay as they are.
    """
    table = Window.partitionBy(*keys, "block", "in_table")
    rows = classified_lines(lines, keys).select(
        "*",
        F.when(F.col("in_table"), cells(F.col("line"))).alias("values"),
        (F.col("in_table") & is_separator(F.col("line"))).alias("separator"),
    )
    first_row = F.col("row_no") == 1
    rows = rows.withColumn("data", F.col("in_table") & ~F.col("separator") & ~first_row)
    head = F.when(first_row & ~F.col("separator"), F.col("values")).when(first_row, F.array().cast("array<string>"))
    rows = rows.select("*", F.max(head).over(table).alias("headers"), F.count_if("data").over(table).alias("n_data"))

    flat = F.col("in_table") & (F.col("n_data") > 0)
    generic = F.forall(
        F.filter("headers", lambda h: h != ""), lambda h: h.isin(fixed.GENERIC_TABLE_HEADERS)
    )
    head_counts = (F.size("headers") == 2) & ~is_placeholder(F.col("headers")) & ~generic
    as_data = F.col("data") | (first_row & ~F.col("separator") & head_counts)
    text = F.when(as_data, row_text(F.col("headers"), F.col("values"))).otherwise(F.lit(""))
    rows = rows.withColumn("out", F.when(flat, F.nullif(text, F.lit(""))).otherwise(F.col("line"))).withColumn("flat", flat)
    rows = rows.withColumn("__empty", F.col("flat") & (F.count("out").over(table) == 0) & first_row)

    window = in_document(keys)
    after_table = F.coalesce(F.lag("in_table").over(window), F.lit(False))
    short = ~F.col("in_table") & ~blank(F.col("line")) & (F.length(strip("line")) < fixed.TABLE_PREFIX_MAX) & ~after_table
    return _with_titles(rows.withColumn("__short", short), keys)


def _with_titles(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Cut the run of short lines right before a flattened table, its title; every window sorts the lines of a document anew
    only if it reads them backwards."""
    window = in_document(keys)
    no = F.lit(False)
    rows = rows.select(
        "*",
        F.coalesce(F.lag("__short").over(window), no).alias("__after_short"),
        F.coalesce(F.lead("__short").over(window), no).alias("__before_short"),
    )
    below = Window.partitionBy(*keys).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    # The line that ends a run of short lines: only it can open a table.
    next_flat = F.last(F.when(~F.col("__short"), F.col("flat")), ignorenulls=True).over(below)
    title = F.col("__short") & F.coalesce(next_flat, no)
    rows = rows.withColumn("__title", title)
    cut = F.when(F.col("__title") & ~F.col("__after_short"), F.regexp_replace("out", r"\A\s+", "")).otherwise(F.col("out"))
    cut = F.when(F.col("__title") & ~F.col("__before_short"), F.regexp_replace(cut, r"\s+\z", "")).otherwise(cut)
    # A table of empty cells without a title leaves one empty line.
    rows = rows.withColumn("out", F.when(F.col("__empty") & ~F.col("__after_short"), F.lit("")).otherwise(cut))
    return rows.filter(F.col("out").isNotNull()).select(*keys, "line_no", F.col("out").alias("line"))


def flatten_tables(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Documents with all their Markdown tables flattened. Documents without a table row pass untouched."""
    has_table = F.col(text).rlike(r"(?md)^\s*\|.+\|\s*$")
    plain = docs.filter(~has_table).select("doc_id", *keep, text)
    with_tables = docs.filter(has_table)
    keys = ("doc_id", *keep)
    flat = join_lines(flatten_lines(explode_lines(with_tables, text, keys, parts), keys), keys, text=text)
    return plain.unionByName(flat)


def join_cell_lines(lines: DataFrame, is_page_marker: Column, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Lines that continue the last cell of a table row are appended to it. All windows read the lines in one order."""
    window = in_document(keys)
    text = strip("line")
    row = F.startswith(text, F.lit("|")) & F.endswith(text, F.lit("|"))
    before_open = F.coalesce(F.endswith(F.lag(text).over(window), F.lit("|")), F.lit(False))
    may_follow = (text != "") & ~F.startswith(text, F.lit("|")) & ~F.startswith(text, F.lit("#")) & ~is_page_marker
    flagged = lines.select("*", row.alias("__row"), (may_follow & before_open).alias("__follows"))
    up_to = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The last line that follows none leads those after it; the first line follows none.
    leader = F.last(F.when(~F.col("__follows"), F.col("__row")), ignorenulls=True).over(up_to)
    joined = flagged.withColumn("__joins", F.col("__follows") & leader)
    joined = joined.select(
        "*", F.count_if(~F.col("__joins")).over(up_to).alias("__target"), F.lead("__joins").over(window).alias("__goes_on")
    )
    shown = F.when(F.col("__joins"), strip("line")).otherwise(F.col("line"))
    shown = F.when(F.coalesce("__goes_on", F.lit(False)), F.regexp_replace(shown, r"\s+\z", "")).otherwise(shown)
    pieces = joined.withColumn("__shown", shown)
    return pieces.groupBy(*keys, "__target").agg(
        F.min("line_no").alias("line_no"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("line_no", "__shown"))), lambda r: r["__shown"]), " "
        ).alias("line"),
    ).drop("__target")
