"""Aggregates behind the evaluation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed


def type_averages(results: DataFrame) -> DataFrame:
    """Mean of the four judge scores per question type; a missing score counts as 0."""
    return results.groupBy("query_type").agg(
        *[F.avg(F.coalesce(c, F.lit(0))).alias(f"avg_{c}") for c in fixed.JUDGE_CRITERIA]
    )


def _stage_means(total: Column) -> list[Column]:
    return [(F.coalesce(F.sum(F.col("latencies")[s]), F.lit(0.0)) / total).alias(s) for s in fixed.LATENCY_STAGES]


def latency_by_type(results: DataFrame) -> DataFrame:
    """Mean seconds per stage over all questions and per type, only questions with latencies; `query_type` is null for all."""
    timed = results.filter(F.size("latencies") > 0)
    rolled = timed.rollup("query_type").agg(*_stage_means(F.count("*")), F.count("*").alias("n"))
    total = sum((F.col(s) for s in fixed.LATENCY_STAGES), F.lit(0.0))
    return rolled.withColumn("total", total)


def latency_shares(results: DataFrame) -> DataFrame:
    """Mean seconds per stage and its share of their sum."""
    timed = results.filter(F.size("latencies") > 0).agg(*_stage_means(F.count("*")))
    rows = timed.unpivot([], list(fixed.LATENCY_STAGES), "stage", "avg_seconds")
    # Three rows.
    everything = Window.partitionBy(F.lit(1))
    return rows.withColumn("share", F.col("avg_seconds") / F.sum("avg_seconds").over(everything))


def score_histogram(results: DataFrame, score: str = "correctness") -> DataFrame:
    """Number of questions for every score 0..5, also those that do not occur."""
    bins = results.sparkSession.range(6).select(F.col("id").cast("int").alias("score"))
    counted = results.groupBy(F.coalesce(score, F.lit(0)).cast("int").alias("score")).agg(F.count("*").alias("n"))
    return bins.join(counted, "score", "left").select("score", F.coalesce("n", F.lit(0)).alias("n"))


def insight_counts(results: DataFrame) -> DataFrame:
    score = F.coalesce("correctness", F.lit(0))
    return results.agg(
        F.count_if(score == 5).alias("perfect"), F.count_if(score <= 2).alias("weak"), F.count("*").alias("asked")
    )


def longest_total(results: DataFrame) -> DataFrame:
    """The largest sum of stage times of a question, at least 1."""
    total = sum((F.coalesce(F.col("latencies")[s], F.lit(0.0)) for s in fixed.LATENCY_STAGES), F.lit(0.0))
    return results.agg(F.greatest(F.max(F.when(F.size("latencies") > 0, total)), F.lit(1.0)).alias("max_total"))


def run_totals(runs: DataFrame) -> DataFrame:
    """Succeeded and failed files of an ingest run with their durations."""
    ok = F.col("status") != "failed"
    seconds = F.when(ok, F.col("duration_sec"))
    return runs.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"),
        F.avg(seconds).alias("avg_seconds"), F.sum(seconds).alias("total_seconds"),
    )
