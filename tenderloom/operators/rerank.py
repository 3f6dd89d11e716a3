"""Re-ranking, merging and checks of result lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions.questions import budget_evidence, needs_original, owner_evidence
from tenderloom.functions.text import let, strip
from tenderloom.operators.ordered import row_numbers, top_per_group


def diversify(hits: DataFrame, top_window: int = fixed.DEFAULT_TOP_K) -> DataFrame:
    """Interleave the two largest organisations at the top of each list; the rest keeps its order.

    Needs query_id, rank (1..n), org, source; adds `new_rank`. Lists of two hits or with one organisation stay as they
    are. Only the picked hits of a list, at most `top_window`, are ever ordered together; where the others land
    follows from their rank and the picked ranks behind it.
    """
    window = max(2, top_window)
    key = F.coalesce(F.nullif(strip(F.coalesce("org", F.lit(""))), F.lit("")), strip(F.coalesce("source", F.lit(""))))
    rows = hits.select("query_id", "rank", key.alias("__key"))
    sizes = rows.groupBy("query_id", "__key").agg(F.count("*").alias("__size"), F.min("rank").alias("__first"))
    lists = sizes.groupBy("query_id").agg(F.sum("__size").alias("__n"), F.count("*").alias("__keys"))
    largest = top_per_group(sizes, ["query_id"], [F.desc("__size"), F.asc("__first")], 2, "__place")
    pools = largest.join(lists.filter((F.col("__n") > 2) & (F.col("__keys") >= 2)), "query_id").select(
        "query_id", "__key", "__place", F.least(F.lit(window), F.col("__n")).alias("__limit")
    )
    in_pool = rows.join(pools, ["query_id", "__key"], "inner")
    turns = top_per_group(in_pool, ["query_id", "__key"], [F.asc("rank")], window, "__turn")
    picked = top_per_group(turns, ["query_id"], [F.asc("__turn"), F.asc("__place")], window, "__pick")
    picks = picked.filter(F.col("__pick") <= F.col("__limit")).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__pick", "rank"))), lambda p: p["rank"]).alias("__picks")
    )
    placed = hits.join(picks, ["query_id"], "left")
    at = F.array_position("__picks", F.col("rank"))
    behind = F.size(F.filter("__picks", lambda p: p > F.col("rank")))
    new_rank = F.when(F.col("__picks").isNull(), F.col("rank")).when(at > 0, at).otherwise(F.col("rank") + behind)
    return placed.withColumn("new_rank", new_rank.cast("int")).drop("__picks")


def _penalty(item: Column, other: Column) -> Column:
    gap = F.abs(item["chunk_index"] - other["chunk_index"])
    by_gap = F.when(gap <= 2, 1.6).when(gap <= 5, 0.6).when(gap.isNotNull(), 0.15).otherwise(0.25)
    same = (item["source_key"] != "") & (item["source_key"] == other["source_key"])
    return F.when(same, by_gap).otherwise(0.0)


def _picks(window: Column, size: int) -> Column:
    """Order of a sorted window: each pick takes the best score after penalties against the last six picks."""

    def pick(state: Column, _: Column) -> Column:
        recent = F.slice(state["picked"], F.greatest(F.size(state["picked"]) - 5, F.lit(1)), 6)

        def adjusted(item: Column) -> Column:
            return item["score"] - F.aggregate(recent, F.lit(0.0), lambda total, other: total + _penalty(item, other))

        ranked = F.transform(state["waiting"], lambda item, i: F.struct(adjusted(item).alias("s"), (-i).alias("i")))
        return F.when(F.size(state["waiting"]) == 0, state).otherwise(
            let(
                -F.array_max(ranked)["i"],
                lambda best: F.struct(
                    F.array_append(state["picked"], F.get(state["waiting"], best)).alias("picked"),
                    F.filter(state["waiting"], lambda _, i: i != best).alias("waiting"),
                ),
            )
        )

    start = F.struct(F.slice(window, 1, 0).alias("picked"), window.alias("waiting"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(size)), start, pick)["picked"]


def spread_sources(hits: DataFrame, top_window: int = fixed.DEFAULT_TOP_K) -> DataFrame:
    """Re-rank the top window so that neighbouring chunks of one source do not crowd it.

    Needs query_id, rank, score, source_key, chunk_index; adds `new_rank`. The picks depend on each other, so the
    window of a list, whose size is fixed, is folded as one array; what is behind it keeps the score order.
    """
    window = max(4, top_window)
    minus = hits.withColumn("__minus", -F.col("score").cast("double"))
    placed = row_numbers(minus, ["query_id"], ["__minus", "rank"], "__place").drop("__minus")
    # Lists of at most two hits come back in the order they had.
    longer = placed.filter("__place = 3").select("query_id", F.lit(True).alias("__long"))
    ordered = placed.join(longer, ["query_id"], "left").withColumn("__long", F.col("__long").isNotNull())
    ordered = ordered.withColumn("__place", F.when(F.col("__long"), F.col("__place")).otherwise(F.col("rank")))
    item = F.struct(
        "__place", F.col("score").cast("double").alias("score"), F.coalesce("source_key", F.lit("")).alias("source_key"),
        F.col("chunk_index").cast("bigint").alias("chunk_index"), "rank",
    )
    head = ordered.filter(F.col("__long") & (F.col("__place") <= window))
    picked = head.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("w"))
    # Without a repeated source there is no penalty and the score order stands.
    keys = F.filter(F.transform("w", lambda h: h["source_key"]), lambda k: k != "")
    picked = picked.filter(F.size(F.array_distinct(keys)) < F.size(keys))
    moved = picked.select("query_id", F.posexplode(_picks(F.col("w"), window)).alias("p", "h"))
    places = moved.select("query_id", F.col("h.rank").alias("rank"), (F.col("p") + 1).alias("new_rank"))
    joined = ordered.join(places, ["query_id", "rank"], "left")
    return joined.withColumn("new_rank", F.coalesce("new_rank", "__place").cast("int")).drop("__place", "__long")


def merge(base: DataFrame, incoming: DataFrame, key: Sequence[str], top_k: int) -> DataFrame:
    """Two lists per question as one: base first, the first hit of every key, at most top_k. Needs query_id, rank."""
    both = base.withColumn("__pass", F.lit(0)).unionByName(incoming.withColumn("__pass", F.lit(1)))
    first = top_per_group(both, ["query_id", *key], [F.asc("__pass"), F.asc("rank")], 1, "__copy").drop("__copy")
    merged = top_per_group(first, ["query_id"], [F.asc("__pass"), F.asc("rank")], top_k, "new_rank")
    return merged.drop("__pass")


def union_passes(passes: Sequence[DataFrame], key: Sequence[str], top_k: int) -> DataFrame:
    """Several search passes merged in their order."""
    merged = passes[0]
    for incoming in passes[1:]:
        merged = merge(merged, incoming, key, top_k).drop("rank").withColumnRenamed("new_rank", "rank")
    return merged


def evidence_flags(hits: DataFrame, top_n: int = fixed.EVIDENCE_WINDOW) -> DataFrame:
    """Per question whether its top hits carry evidence for an owner and for a budget."""
    near = F.col("rank") <= max(1, top_n)
    return hits.groupBy("query_id").agg(
        F.coalesce(F.bool_or(near & owner_evidence(F.col("text"))), F.lit(False)).alias("has_owner"),
        F.coalesce(F.bool_or(near & budget_evidence(F.col("text"))), F.lit(False)).alias("has_budget"),
    )


def original_fallback(questions: DataFrame, hits: DataFrame, doc_type: Column, normalized: Column) -> DataFrame:
    """Questions that should be searched again in the original documents.

    True without any hit, or when the question needs originals and none of its first hits is one.
    """
    original = doc_type.isin(fixed.ORIGINAL_TYPES) & (F.col("rank") <= fixed.ORIGINAL_WINDOW)
    seen = hits.groupBy("query_id").agg(F.coalesce(F.bool_or(original), F.lit(False)).alias("__original"))
    joined = questions.join(seen, "query_id", "left")
    again = F.when(F.col("__original").isNull(), F.lit(True)).otherwise(needs_original(normalized) & ~F.col("__original"))
    return joined.withColumn("fallback", again).drop("__original")
