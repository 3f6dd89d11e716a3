"""From Markdown documents to chunks with sections and pages.

Everything up to the pieces is row-local. The pieces of a document are then ordered by windows over `doc_id`, for
which they are dealt once more: Python, which cuts long texts, does not keep the partitioning.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom import fixed_values as fixed
from tenderloom.functions import markdown as md
from tenderloom.functions.text import strip
from tenderloom.operators.lines import by_document, parts_of

_SEPARATORS = ("\n\n", "\n", " ")
_ORDER = ["section_no", "part_no", "piece_no"]


# ---------------------------------------------------------------- cutting one text by size
def _units(text: str, separators: tuple[str, ...]) -> tuple[list[str], tuple[str, ...] | None]:
    """The text cut before the coarsest separator in it, and the finer separators; without one, its characters."""
    usable = next((i for i, s in enumerate(separators) if s in text), None)
    if usable is None:
        return list(text), None
    separator = separators[usable]
    head, *rest = text.split(separator)
    return [u for u in [head, *[separator + r for r in rest]] if u], separators[usable + 1 :]


def split_by_size(text: str, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> list[str]:
    """Pieces of at most `size` characters; a piece repeats whole units from the end of the one before it."""
    pieces: list[str] = []

    def pack(units: list[str]) -> None:
        window: list[str] = []
        length = 0
        for unit in units:
            if window and length + len(unit) > size:
                pieces.append("".join(window).strip())
                while window and (length > overlap or length + len(unit) > size):
                    length -= len(window.pop(0))
            window.append(unit)
            length += len(unit)
        pieces.append("".join(window).strip())

    def cut(part: str, separators: tuple[str, ...]) -> None:
        units, finer = _units(part, separators)
        small: list[str] = []
        for unit in units:
            if len(unit) < size or finer is None:
                small.append(unit)
                continue
            if small:
                pack(small)
                small = []
            cut(unit, finer)
        if small:
            pack(small)

    cut(text, _SEPARATORS)
    return [p for p in pieces if p]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut_long(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else split_by_size(t))


def sized_pieces(c: Column) -> Column:
    """Short texts pass in the JVM; only long ones go through Python."""
    is_long = F.length(c) > fixed.CHUNK_SIZE
    return F.coalesce(F.when(~is_long, F.array(c)), _cut_long(F.when(is_long, c)))


# ---------------------------------------------------------------- stages
def insert_headings(docs: DataFrame, text: str = "text") -> DataFrame:
    """Find the section hierarchy of every document and write `# ` and `## ` before its first two levels."""
    marked = docs.withColumn("__marked", md.mark_headings(F.col(text)))
    marked = marked.withColumn("__types", md.heading_types(F.col("__marked")))
    kept = marked.withColumn("__marked", md.drop_early_brackets(F.col("__marked"), F.col("__types")))
    prefixes = md.heading_prefixes(F.col(text), F.col("__types"))
    return kept.withColumn(text, md.replace_marks(F.col("__marked"), prefixes)).drop("__marked", "__types")


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """Cut documents at first-level headings, and at second-level headings from the second one under each.

    A section is labelled by the heading it starts with, so the text of the first second-level heading belongs to the
    section of its first-level heading.
    """
    first = r"(?md)^(?=# .)"
    second = r"(?md)^(?=## .)"
    others = [c for c in docs.columns if c != text]
    tops = docs.select(*others, F.posexplode(F.split(F.col(text), first, -1)).alias("section_no", "__top"))
    cut = F.split(F.col("__top"), second, -1)
    opens_second = F.col("__top").rlike(r"\A## .")
    joined = F.concat(
        F.array(F.concat(F.get("__cut", F.lit(0)), F.coalesce(F.get("__cut", F.lit(1)), F.lit("")))),
        F.slice("__cut", 3, F.greatest(F.size("__cut"), F.lit(1))),
    )
    parts = tops.withColumn("__cut", cut).withColumn("__parts", F.when(opens_second, F.col("__cut")).otherwise(joined))
    level1 = F.regexp_extract("__top", r"(?d)\A# (.+)", 1)
    rows = parts.select(
        *others,
        "section_no",
        F.when(F.col("__top").rlike(r"\A# ."), strip(level1)).otherwise(F.lit("N/A")).alias("section_level1"),
        F.posexplode("__parts").alias("part_no", text),
    )
    level2 = strip(F.regexp_extract(text, r"(?d)\A## (.+)", 1))
    return rows.withColumn(
        "section_level2", F.when(F.col(text).rlike(r"\A## ."), level2).otherwise(F.lit("N/A"))
    ).withColumn(text, strip(F.col(text)))


def pieces(section_rows: DataFrame, text: str = "text") -> DataFrame:
    """Sections cut to size, in order, each still carrying its page markers."""
    others = [c for c in section_rows.columns if c != text]
    filled = section_rows.filter(F.col(text) != "")
    cut = filled.select(*others, F.posexplode(sized_pieces(F.col(text))).alias("piece_no", text))
    return cut.filter(strip(F.col(text)) != "")


def with_pages(rows: DataFrame, text: str = "text") -> DataFrame:
    """A piece ends on the last page marked so far and starts where the piece before it ended; then drop the marks."""
    in_order = Window.partitionBy("doc_id").orderBy(*_ORDER)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.coalesce(F.last(md.last_page(F.col(text)), ignorenulls=True).over(so_far), F.lit(1))
    paged = rows.withColumn("page_end", end)
    paged = paged.withColumn("page_start", F.coalesce(F.lag("page_end").over(in_order), F.lit(1)))
    return paged.withColumn(text, md.without_page_markers(F.col(text))).filter(F.col(text) != "")


def join_heading_pieces(rows: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of headings only join the next piece with content, those at the end the last one."""
    in_order = Window.partitionBy("doc_id").orderBy(*_ORDER)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc_id")
    flagged = rows.withColumn("__content", ~md.only_headings(F.col(text)))
    counted = flagged.select(
        "*",
        F.count_if("__content").over(before).alias("__seen"),
        F.count_if("__content").over(whole).alias("__total"),
        F.row_number().over(in_order).alias("__no"),
    )
    at_end = (F.col("__total") > 0) & (F.col("__seen") == F.col("__total"))
    group = F.when(F.col("__total") == 0, F.col("__no")).when(at_end, F.col("__total") - 1).otherwise(F.col("__seen"))
    grouped = counted.withColumn("__at_end", at_end).withColumn("__group", group)
    leading = F.when(~F.col("__content") & ~F.col("__at_end"), F.col("__no"))
    own = F.when(F.col("__content") | (F.col("__total") == 0), F.col("__no"))
    joined = grouped.groupBy("doc_id", *keep, "__group").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("__no", text))), lambda r: r[text]), "\n\n"
        ).alias(text),
        F.min_by("section_level1", own).alias("__own1"),
        F.max_by("section_level1", leading).alias("__lead1"),
        F.min_by("section_level2", own).alias("section_level2"),
        F.min_by("page_start", "__no").alias("page_start"),
        F.max_by("page_end", "__no").alias("page_end"),
    )
    level1 = F.when(F.col("__own1") == "N/A", F.coalesce("__lead1", "__own1")).otherwise(F.col("__own1"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("__group")) - 1
    return joined.select(
        "doc_id", *keep, order.alias("chunk_order"), F.col(text), level1.alias("section_level1"), "section_level2",
        "page_start", "page_end",
    )


def chunk_documents(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Cleaned Markdown documents (`doc_id`, text, and columns to keep) to chunks in document order.

    Tables should be flat before (`tables.flatten_tables`). `parts` spares a pass over the texts, see `lines.by_document`.
    """
    parts = parts_of(docs, text) if parts is None else parts
    placed = by_document(docs.select("doc_id", *keep, text), text, parts)
    cleaned = placed.withColumn(text, md.clean_for_chunks(F.col(text)))
    rows = by_document(pieces(sections(insert_headings(cleaned, text), text), text), text, parts)
    return join_heading_pieces(with_pages(rows, text), text, keep)


def fixed_stride_pieces(docs: DataFrame, text: str = "text", size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """Pieces of a fixed size that start every `size - overlap` characters."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - overlap - 1) / step), F.lit(0)).cast("int"))
    rows = docs.select("doc_id", text, F.explode(starts).alias("piece_no"))
    return rows.select(
        "doc_id", "piece_no", F.substring(F.col(text), F.col("piece_no") * step + 1, F.lit(size)).alias("piece")
    )


# ---------------------------------------------------------------- identifiers and statistics
def with_chunk_metadata(chunks: DataFrame, title: Column, created_at: Column, text: str = "text") -> DataFrame:
    """The full chunk row: title, organisation and project of the file name, size, uid."""
    stem = F.when(title.contains("."), F.regexp_replace(title, r"\.[^.]*$", "")).otherwise(title)
    split = stem.contains("_")
    return chunks.select(
        "*",
        F.concat_ws("_", "doc_id", "chunk_order").alias("uid"),
        title.alias("document_title"),
        title.alias("source"),
        F.when(split, F.split_part(stem, F.lit("_"), F.lit(1))).otherwise(F.lit("N/A")).alias("org"),
        F.when(split, F.regexp_replace(stem, r"\A[^_]*_", "")).otherwise(F.lit("N/A")).alias("project_name"),
        F.length(text).alias("chunk_size"),
        created_at.alias("created_at"),
        F.lit("chunk").alias("type"),
    )


def chunk_statistics(chunks: DataFrame, text: str = "text") -> DataFrame:
    size = F.length(text)
    return chunks.agg(
        F.count("*").alias("total"),
        F.sum(size).alias("total_size"),
        F.avg(size).alias("avg_size"),
        F.min(size).alias("min_size"),
        F.max(size).alias("max_size"),
    )
