"""Section hierarchy over chunks, section summaries and the link from chunks to sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions.text import sentences
from tenderloom.operators.ordered import top_per_group


def with_uids(chunks: DataFrame, order: str) -> DataFrame:
    """Dense 0-based `chunk_order` per document in the given order, and the uid made of it."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1
    return chunks.withColumn("chunk_order", number).withColumn("uid", F.concat_ws("_", "doc_id", "chunk_order"))


def section_entries(chunks: DataFrame) -> DataFrame:
    """One row per section of level 1 and 2: first and last chunk, uid in order of appearance, uid of the parent."""
    labelled = chunks.filter((F.coalesce("section_level1", F.lit("")) != "") & (F.col("section_level1") != "N/A"))
    by_level = labelled.groupingSets(
        [["doc_id", "section_level1"], ["doc_id", "section_level1", "section_level2"]],
        "doc_id", "section_level1", "section_level2",
    ).agg(
        F.min("chunk_order").alias("start_order"),
        F.max("chunk_order").alias("end_order"),
        (2 - F.grouping("section_level2").cast("int")).alias("level"),
    )
    kept = by_level.filter(
        (F.col("level") == 1) | ((F.coalesce("section_level2", F.lit("")) != "") & (F.col("section_level2") != "N/A"))
    )
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("level", "start_order"))
    numbered = kept.withColumn("uid", F.concat(F.col("doc_id").cast("string"), F.lit("_h_"), number.cast("string")))
    parent = F.max(F.when(F.col("level") == 1, F.col("uid"))).over(Window.partitionBy("doc_id", "section_level1"))
    return numbered.select(
        "doc_id", "uid", "level",
        F.when(F.col("level") == 1, F.col("section_level1")).otherwise(F.col("section_level2")).alias("title"),
        F.when(F.col("level") == 2, parent).alias("parent_uid"),
        "start_order", "end_order", "section_level1", "section_level2",
    )


def section_summaries(chunks: DataFrame, text: str = "text", split: callable = sentences) -> DataFrame:
    """First sentences of the first chunks of every section, cut to the limit.

    Only the first chunks of a section are ever gathered, so a section may have any number of chunks.
    """
    snippet = F.array_join(F.slice(split(F.col(text)), 1, fixed.SUMMARY_SENTENCES), " ")
    short = chunks.filter((F.coalesce("section_level1", F.lit("")) != "") & (F.col("section_level1") != "N/A"))
    levels = F.array(
        F.struct(F.lit(1).alias("level"), F.lit(None).cast("string").alias("l2")),
        F.struct(F.lit(2).alias("level"), F.col("section_level2").alias("l2")),
    )
    rows = short.select("doc_id", "section_level1", "chunk_order", F.explode(levels).alias("lv"), snippet.alias("snippet"))
    rows = rows.select("doc_id", "section_level1", "chunk_order", "snippet", "lv.level", "lv.l2").filter(
        (F.col("level") == 1) | ((F.coalesce("l2", F.lit("")) != "") & (F.col("l2") != "N/A"))
    )
    keys = ["doc_id", "section_level1", "level", "l2"]
    first = top_per_group(rows, keys, [F.asc("chunk_order")], fixed.SUMMARY_CHUNKS)
    joined = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk_order", "snippet"))).alias("s"))
    filled = F.filter(F.transform("s", lambda r: r["snippet"]), lambda x: x != "")
    text_out = F.array_join(filled, " ")
    cut = F.when(
        F.length(text_out) > fixed.SUMMARY_LIMIT, F.concat(F.substring(text_out, 1, fixed.SUMMARY_LIMIT), F.lit("..."))
    ).otherwise(text_out)
    title = F.when(F.col("level") == 1, F.col("section_level1")).otherwise(
        F.concat_ws(" > ", "section_level1", "l2")
    )
    head = F.concat(F.lit("[Level "), F.col("level").cast("string"), F.lit("] "), title, F.lit("\n"))
    return joined.select("doc_id", "section_level1", F.col("l2").alias("section_level2"), "level", F.concat(head, cut).alias("summary"))


def hierarchy(chunks: DataFrame, text: str = "text", split: callable = sentences) -> DataFrame:
    """Section entries with their summary."""
    entries, texts = section_entries(chunks), section_summaries(chunks, text, split)
    same = (
        (entries["doc_id"] == texts["doc_id"])
        & (entries["level"] == texts["level"])
        & (entries["section_level1"] == texts["section_level1"])
        & entries["section_level2"].eqNullSafe(texts["section_level2"])
    )
    return entries.join(texts, same).select(entries["*"], texts["summary"])


def with_section_uid(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """Link every chunk to its most specific section: level 2, else level 1, else the word None."""
    second = entries.filter("level = 2").select("doc_id", "section_level1", "section_level2", F.col("uid").alias("__u2"))
    first = entries.filter("level = 1").select("doc_id", "section_level1", F.col("uid").alias("__u1"))
    linked = chunks.join(second, ["doc_id", "section_level1", "section_level2"], "left")
    linked = linked.join(first, ["doc_id", "section_level1"], "left")
    return linked.withColumn("section_uid", F.coalesce("__u2", "__u1", F.lit("None"))).drop("__u1", "__u2")


def section_at(positions: DataFrame, headings: DataFrame) -> DataFrame:
    """As-of lookup: for every character position the last heading at or before it in the document.

    Both sides become one stream per document; second-level headings end with the next first-level one.
    """
    marks = headings.select(
        "doc_id", "pos", F.lit(0).alias("kind"),
        F.when(F.col("level") == 1, F.col("heading")).alias("l1"),
        F.when(F.col("level") == 2, F.col("heading")).when(F.col("level") == 1, F.lit("N/A")).alias("l2"),
    )
    asked = positions.select(
        "doc_id", "pos", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("l1"), F.lit(None).cast("string").alias("l2")
    )
    window = Window.partitionBy("doc_id").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)

    def latest(c: str) -> Column:
        return F.coalesce(F.last(c, ignorenulls=True).over(window), F.lit("N/A"))

    both = marks.unionByName(asked).select("doc_id", "pos", "kind", latest("l1").alias("section_level1"), latest("l2").alias("section_level2"))
    return both.filter("kind = 1").drop("kind")


def _aligned_blocks(start: Column, end: Column) -> Column:
    """The range start..end as few aligned blocks of power-of-two size: array of (size: its exponent, block: its number).

    Going up the sizes, what is left of the range begins at the next block and ends before the last; of either side a block
    with an odd number (or before one) is not part of a larger one and is taken.
    """
    def shifted(value: Column, bits: Column) -> Column:
        return F.call_function("shiftright", value, bits)

    def of_size(k: Column) -> Column:
        low = shifted(start + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
        high = shifted(end + 1, k)
        at = lambda block: F.struct(k.alias("size"), block.alias("block"))
        taken = F.array(F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), at(low)), F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), at(high - 1)))
        return F.array_compact(taken)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.log2(end - start + 1)).cast("int")), of_size))


def chunks_of_sections(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every section with the chunks in its range: an interval join on equal keys alone.

    A range is cut into aligned blocks, a chunk lies in one block of every size; the two meet on (document, size, block) once
    for every pair of the result and never otherwise. A range without a start or an end has no chunks.
    """
    start, end = F.col("start_order").cast("long"), F.col("end_order").cast("long")
    cut = entries.select("doc_id", "uid", "level", "start_order", "end_order").filter(start <= end).select(
        "*", F.inline(_aligned_blocks(start, end)))
    # at most one number for every power of two
    sizes = sorted(r[0] for r in cut.select("size").distinct().collect())
    order = F.col("chunk_order").cast("long")
    own = chunks.select("doc_id", "chunk_order", F.col("uid").alias("chunk_uid"), F.explode(F.array(*[F.lit(n) for n in sizes]).cast("array<int>")).alias("size"))
    own = own.withColumn("block", F.call_function("shiftright", order, F.col("size")))
    return cut.join(own, ["doc_id", "size", "block"]).select("doc_id", "uid", "level", "start_order", "end_order", "chunk_order", "chunk_uid")
