"""Audit of parsed Markdown: normalise pages, find the heading types, write headings, clear tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions import markdown as md
from tenderloom.functions.text import blank, pattern, strip
from tenderloom.operators.lines import by_document, join_lines, parts_of
from tenderloom.operators.tables import join_cell_lines

_PAGE = ("doc_id", "page_no", "page")


def _is_marker(line: Column) -> Column:
    return strip(line).rlike(pattern(r"\A<<PAGE:\s*\d+>>"))


def page_rows(docs: DataFrame, text: str = "text", parts: int | None = None) -> DataFrame:
    """One row per page of every document: `page_no` counts them, `page` is the marked number."""
    placed = by_document(docs.select("doc_id", F.col(text).alias("text")), parts=parts)
    rows = placed.select("doc_id", F.posexplode(md.pages(F.col("text"))).alias("page_no", "p"))
    return rows.select("doc_id", "page_no", F.col("p.page").alias("page"), F.col("p.content").alias("text"))


def normalized_lines(pages: DataFrame) -> DataFrame:
    """Page texts as normalised lines: spacing, bullets, cell line breaks, headings of the parser, bold, numerals."""
    text = md.star_bullets(md.join_spaced_letters(F.col("text")))
    lines = pages.withColumn("text", text).select(*_PAGE, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = join_cell_lines(lines, _is_marker(F.col("line")), _PAGE)
    lines = lines.withColumn("line", F.regexp_replace("line", " {2,}", " "))
    window = Window.partitionBy(*_PAGE).orderBy("line_no")
    repeated_gap = (F.col("line") == "") & (F.coalesce(F.lag("line").over(window), F.lit("x")) == "")
    lines = lines.withColumn("__gap", repeated_gap).filter(~F.col("__gap")).drop("__gap")
    lines = lines.withColumn("line", md.join_bold(md.without_parser_heading(F.col("line"))))
    opens = F.coalesce(blank(F.lag("line").over(window)), F.lit(True))
    lines = lines.withColumn("__opens", opens)
    lines = lines.withColumn("line", md.roman_paragraph(F.col("line"), F.col("__opens"))).drop("__opens")
    return lines.withColumn("line", md.without_bold(F.col("line")))


def heading_candidates(lines: DataFrame) -> DataFrame:
    """Lines with their heading type, invalid letter headings left out."""
    typed = lines.withColumn("heading_type", md.line_heading_type(F.col("line")))
    return typed.filter(
        F.col("heading_type").isNotNull() & md.valid_letter_heading(F.col("line"), F.col("heading_type"))
    )


def heading_levels(candidates: DataFrame) -> DataFrame:
    """Per document the first heading type (level 1) and the first other one (level 2)."""
    first_seen = candidates.groupBy("doc_id", "heading_type").agg(
        F.min(F.struct("page_no", "line_no")).alias("first_seen")
    )
    level = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_seen"))
    return first_seen.withColumn("level", level).filter("level <= 2").drop("first_seen")


def with_headings(lines: DataFrame) -> DataFrame:
    """Write `# ` or `## ` before every line of a level-1 or level-2 type; the levels come from windows, not a join."""
    typed = lines.withColumn("heading_type", md.line_heading_type(F.col("line")))
    counts = F.col("heading_type").isNotNull() & md.valid_letter_heading(F.col("line"), F.col("heading_type"))
    typed = typed.withColumn("__place", F.when(counts, F.struct("page_no", "line_no")))
    whole = Window.partitionBy("doc_id")
    typed = typed.withColumn("__l1", F.min_by("heading_type", "__place").over(whole))
    other = F.when(F.col("heading_type") != F.col("__l1"), F.col("__place"))
    typed = typed.withColumn("__other", other).withColumn("__l2", F.min_by("heading_type", "__other").over(whole))
    prefix = (
        F.when(F.col("heading_type") == F.col("__l1"), F.lit("# "))
        .when(F.col("heading_type") == F.col("__l2"), F.lit("## "))
        .otherwise(F.lit(""))
    )
    return typed.withColumn("line", F.concat(prefix, "line")).drop("heading_type", "__place", "__l1", "__other", "__l2")


def contents_share(lines: DataFrame) -> DataFrame:
    """Per page the share of non-empty lines with a dot leader; above one half the page is a table of contents."""
    filled = lines.filter(~blank(F.col("line")))
    leader = F.col("line").rlike(fixed.TOC_SEPARATOR_PATTERN)
    shares = filled.groupBy("doc_id", "page").agg(F.count_if(leader).alias("n_leader"), F.count("*").alias("n_lines"))
    return shares.withColumn("is_contents", F.col("n_leader") / F.col("n_lines") > 0.5)


def without_contents_headings(lines: DataFrame) -> DataFrame:
    """On table-of-contents pages drop the heading mark of every title that is also a heading in the body."""
    page = Window.partitionBy("doc_id", "page_no")
    filled = ~blank(F.col("line"))
    leader = filled & F.col("line").rlike(fixed.TOC_SEPARATOR_PATTERN)
    of_page = F.count_if(leader).over(page) / F.count_if(filled).over(page)
    rows = lines.withColumn("__page_contents", F.coalesce(of_page > 0.5, F.lit(False)))
    # Pages are told apart by their number, so one contents page makes all pages of that number contents pages.
    number = Window.partitionBy("doc_id", "page")
    rows = rows.withColumn("__contents", F.bool_or("__page_contents").over(number))
    mark = F.regexp_extract("line", pattern(r"\A#+\s"), 0)
    title = F.when(mark != "", md.heading_title_key(F.substring("line", F.length(mark) + 1, F.length("line"))))
    rows = rows.withColumn("__title", F.nullif(title, F.lit("")))
    same = Window.partitionBy("doc_id", "__title")
    both = F.bool_or("__contents").over(same) & F.bool_or(~F.col("__contents")).over(same)
    rows = rows.withColumn("__both", F.col("__title").isNotNull() & both)
    plain = F.when(F.col("__contents") & F.col("__both"), md.without_parser_heading(F.col("line"))).otherwise(F.col("line"))
    changed = F.bool_or(F.col("__contents") & F.col("__both")).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("line", plain).withColumn("contents_cleared", changed)
    return rows.drop("__page_contents", "__contents", "__title", "__both")


def document_text(lines: DataFrame) -> DataFrame:
    """Audited lines back to documents, a page marker before every page.

    Documents whose contents pages were cleared have one more empty line after and before each marker.
    """
    pages = join_lines(lines, (*_PAGE, "contents_cleared"))
    last = F.max("page_no").over(Window.partitionBy("doc_id"))
    pages = pages.withColumn("__more", F.col("contents_cleared") & (F.col("page_no") < last))
    newline, nothing = F.lit("\n"), F.lit("")
    marked = F.concat(
        F.lit("<<PAGE: "), F.col("page").cast("string"), F.lit(">>\n\n"),
        F.when(F.col("contents_cleared"), newline).otherwise(nothing),
        F.when(F.col("text") == "", nothing).otherwise(F.concat(F.col("text"), newline)),
        F.when(F.col("__more"), newline).otherwise(nothing),
    )
    return join_lines(pages.withColumn("line", marked), ("doc_id",), ("page_no",))


def table_lines(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?md)^\|"))


def table_line_count(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", table_lines(F.col(text)).alias("table_lines"))


def audit(docs: DataFrame, text: str = "text") -> DataFrame:
    """Parsed Markdown with page markers to audited Markdown; front matter is passed through.

    The number of parts follows from the texts as they come, which spares another pass over the bodies.
    """
    parts = docs.withColumn("__fm", md.split_front_matter(F.col(text)))
    body = parts.select("doc_id", F.col("__fm.body").alias("text"))
    lines = without_contents_headings(with_headings(normalized_lines(page_rows(body, parts=parts_of(docs, text)))))
    front = parts.filter("__fm.front is not null").select("doc_id", F.col("__fm.front").alias("front"))
    whole = document_text(lines).join(front, "doc_id", "left")
    fronted = F.concat(F.lit("---"), F.col("front"), F.lit("---"), F.col("text"))
    return whole.select("doc_id", F.coalesce(fronted, F.col("text")).alias("text"))
