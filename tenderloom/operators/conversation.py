"""Conversations as rows (conv_id, turn, …): history, carried organisation, follow-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions.questions import follows_up, intent, signature
from tenderloom.operators.ordered import carried, look_back


def exchanges(turns: DataFrame) -> DataFrame:
    """Pair every user turn with the assistant turn right after it; the answer is empty if there is none.

    The partner is found by its turn number, so nothing has to be ordered.
    """
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    said = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    joined = asked.join(said, ["conv_id", "turn"], "left")
    return joined.withColumn("answer", F.coalesce("answer", F.lit("")))


def with_intent(rows: DataFrame) -> DataFrame:
    found = intent(F.col("query"))
    return rows.withColumn("__i", found).select(
        "*", F.col("__i.query_type").alias("query_type"), F.col("__i.org_name").alias("org_name")
    ).drop("__i")


def with_history(rows: DataFrame, size: int = fixed.HISTORY_LENGTH) -> DataFrame:
    """The last exchanges known before each question, and the context summary made of the last three of them."""
    one = F.struct("turn", "query", "answer")
    known = look_back(rows, ["conv_id"], ["turn"], {"__seen": one}, size)
    earlier = F.slice("__seen", 1, F.greatest(F.size("__seen") - 1, F.lit(0)))
    latest = F.slice("history", F.greatest(F.size("history") - fixed.SUMMARY_EXCHANGES + 1, F.lit(1)), fixed.SUMMARY_EXCHANGES)
    lines = F.transform(
        latest,
        lambda e: F.concat(
            F.lit("Q: "), e["query"], F.lit("\nA: "), F.substring(e["answer"], 1, fixed.ANSWER_EXCERPT), F.lit("...")
        ),
    )
    return known.withColumn("history", earlier).withColumn("summary", F.array_join(lines, "\n")).drop("__seen")


def with_follow_up(rows: DataFrame) -> DataFrame:
    """Organisation and kind of the exchange before, and whether a question follows up on it.

    Needs query, query_type, org_name. Every exchange has an intent, so the state is the row before.
    """
    state = carried(
        rows, ["conv_id"], ["turn"], {"last_org": F.col("org_name"), "last_query_type": F.col("query_type")}, before=True
    )
    has_previous = F.col("last_query_type").isNotNull()
    return state.select(
        "*", has_previous.alias("has_previous"), (has_previous & follows_up(F.col("query"))).alias("is_follow_up")
    )


def resolved_org(rows: DataFrame) -> DataFrame:
    """The organisation a question is about: its own, else for a follow-up the one before."""
    own = F.nullif(F.col("org_name"), F.lit(""))
    return rows.withColumn("target_org", F.coalesce(own, F.when(F.col("is_follow_up"), F.col("last_org")), F.lit("")))


def distinct_questions(rows: DataFrame, normalized: str = "query") -> DataFrame:
    """One row per question signature with its count: equal signatures may share one intent and one model call."""
    return rows.groupBy(signature(F.lower(F.col(normalized))).alias("signature")).agg(
        F.count("*").alias("n"), F.min(normalized).alias("query")
    )
