"""An evaluation run: items and hits to per-question results and their summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.operators import evaluation as ev
from tenderloom.sources.models import Model, judge_prompt, with_replies


def truth_of(items: DataFrame) -> DataFrame:
    """Ground truth of evaluation items in the form the metrics read."""
    gt = F.col("ground_truth")
    none = F.array().cast("array<string>")
    uids = F.transform(F.coalesce(gt["chunk_uids"], none), ev.chunk_label)
    # Numbers listed as orders may be written as uids, so these are told apart once more.
    mixed = ev.split_chunk_labels(F.coalesce(gt["chunk_orders"].cast("array<string>"), none))
    return items.select(
        F.col("id").alias("query_id"),
        F.coalesce(gt["sources"], none).alias("sources"),
        F.array_distinct(F.concat(F.filter(uids, lambda u: u != ""), mixed["uids"])).alias("uids"),
        mixed["orders"].alias("orders"),
    )


def judged(items: DataFrame, produced: DataFrame, judge: Callable[[], Model]) -> DataFrame:
    """Judge scores and reasons per question; an unreadable or failed reply gives zeros. `produced`: query_id, answer, context."""
    rows = items.select(F.col("id").alias("query_id"), "question", "expected_answer").join(produced, "query_id")
    prompt = judge_prompt(F.col("question"), F.col("expected_answer"), F.col("answer"), F.col("context"))
    scored = with_replies(rows.select("query_id", prompt.alias("__p")), F.col("__p"), judge).withColumn("j", ev.judge_scores(F.col("reply")))
    told = [F.coalesce(F.col("j")[c]["score"], F.lit(0)).alias(c) for c in fixed.JUDGE_CRITERIA]
    reasons = [F.coalesce(F.col("j")[c]["reason"], F.lit("")).alias(f"{c}_reason") for c in fixed.JUDGE_CRITERIA]
    return scored.select("query_id", *told, *reasons)


def results(items: DataFrame, hits: DataFrame, scores: DataFrame, runs: DataFrame, top_k: int) -> DataFrame:
    """One row per item. `runs`: query_id, from_table, error, latencies."""
    truth = truth_of(items)
    with_table = ev.with_table_hit(hits, truth.join(runs.select("query_id", "from_table"), "query_id"))
    return (
        items.select(F.col("id").alias("query_id"), "query_type")
        .join(ev.source_metrics(truth, with_table, top_k, distinct=False), "query_id", "left")
        .join(ev.chunk_recall(truth, with_table, top_k), "query_id", "left")
        .join(scores, "query_id", "left")
        .join(runs, "query_id", "left")
    )


def run_summary(result_rows: DataFrame, top_k: int) -> DataFrame:
    return ev.summary(result_rows, top_k)
