"""Samples of chunks for evaluation sets. The order is a salted SHA-256, so a sample can be drawn again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions.text import strip
from tenderloom.operators.ordered import top_per_group


def lot(key: Column, seed: int = 42) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}-"), key.cast("string")), 256)


def eligible(chunks: DataFrame, text: str = "text", min_length: int = 200) -> DataFrame:
    """Chunks that are no contents page and no form and are long enough."""
    no_toc = ~F.coalesce("is_toc", F.lit(False)) if "is_toc" in chunks.columns else F.lit(True)
    no_form = ~F.coalesce("is_form", F.lit(False)) if "is_form" in chunks.columns else F.lit(True)
    return chunks.filter(no_toc & no_form & (F.length(strip(text)) >= min_length))


def balanced(chunks: DataFrame, key: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, an equal share from every group first, then from all that is left.

    A group contributes at most n rows to any shuffle: the window keeps the first ones of each task.
    """
    named = chunks.withColumn("__group", F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.lit("unknown")))
    drawn = named.withColumn("__lot", lot(F.col(key), seed))
    groups = max(1, drawn.select("__group").distinct().count())
    share = max(1, n // groups)
    placed = top_per_group(drawn, ["__group"], [F.asc("__lot"), F.asc(key)], n, "__place")
    tier = F.when(F.col("__place") <= share, 0).otherwise(1)
    chosen = placed.withColumn("__tier", tier).orderBy("__tier", "__lot", key).limit(n)
    return chosen.drop("__group", "__lot", "__place", "__tier")


def type_counts(n: int) -> dict[str, int]:
    """Number of questions per type; rounding differences go to the single-document type."""
    counts = {kind: max(1, round(n * weight)) for kind, weight in fixed.EVAL_TYPE_WEIGHTS.items()}
    counts["single_doc"] += n - sum(counts.values())
    return counts


def paired(samples: DataFrame, n_single: int, n_pairs: int) -> DataFrame:
    """Numbered samples (`place` from 1, `source`) as single items and pairs of neighbours.

    If both of a pair come from one source the second is replaced by the next sample, which moves all later pairs;
    the state is one offset over at most a few hundred samples, so it is folded over one array.
    """
    ordered = F.array_sort(F.collect_list(F.struct("place", "source")))
    gathered = samples.filter(F.col("place") <= n_single + 3 * n_pairs).agg(ordered.alias("s"))
    start = F.struct(F.lit(n_single).alias("next"), F.array().cast("array<struct<first:int,second:int>>").alias("pairs"))

    def step(state: Column, _: Column) -> Column:
        first, second = state["next"] + 1, state["next"] + 2
        source = lambda i: F.get("s", i - 1)["source"]
        swap = source(first).eqNullSafe(source(second)) & (F.size("s") >= second + 1)
        pair = F.struct(first.cast("int").alias("first"), F.when(swap, second + 1).otherwise(second).cast("int").alias("second"))
        grown = F.struct(
            (state["next"] + F.when(swap, 3).otherwise(2)).cast("int").alias("next"),
            F.concat(state["pairs"], F.array(pair)).alias("pairs"),
        )
        return F.when(F.size("s") >= second, grown).otherwise(state)

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(n_pairs)), start, step)
    return gathered.select(F.posexplode(folded["pairs"]).alias("pair_no", "p")).select("pair_no", "p.first", "p.second")
