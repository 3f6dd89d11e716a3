"""Retrieval metrics for a table of questions, their ground truth and their hits.

`hits`: query_id, rank (1-based), source, and where needed page, score, chunk_id, chunk_index.
`truth`: query_id, sources (array of strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions import names
from tenderloom.functions.text import json_object, nfc_all, nfkc, strip
from tenderloom.session import frozen


# ---------------------------------------------------------------- matches
def truth_sources(truth: DataFrame, distinct: bool = True) -> DataFrame:
    """One row per ground-truth source with the keys it is matched by; `n_truth` counts the labels of the question.

    With `distinct=False` a source listed twice counts twice, so such a question can never be complete.
    """
    # The same lists stand in many questions: their keys are taken once and stored, so that Spark knows how small they are.
    # Names are compared in one Unicode form: a file system may give them decomposed.
    composed = nfc_all(F.transform(F.array_compact("sources"), lambda s: s))
    cleaned = F.filter(F.transform(composed, names.eval_name), lambda s: s != "")
    sources = F.array_distinct(cleaned)
    listed = truth.select("sources").distinct().select(
        "sources", (F.size(sources) if distinct else F.size(cleaned)).alias("n_truth"), F.explode(sources).alias("truth")
    )
    named = frozen(listed.select(
        "*", names.eval_stem_key(nfkc(F.col("truth"))).alias("stem"), names.eval_extension(F.col("truth")).alias("truth_ext")
    ))
    return truth.select("query_id", "sources").join(named, "sources").drop("sources")


def matched_hits(truth_rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Ground-truth sources with the hits that name the same document.

    Equal names have equal stems, so the match is an equality join on question and stem with a check of the
    extensions behind it.
    """
    kept = [c for c in hits.columns if c not in ("query_id", "source")]
    # a source stands in many hits: its keys are taken once and stored, so that Spark knows how small they are
    composed = F.get(nfc_all(F.array("source")), F.lit(0))
    different = hits.select("source").where("source IS NOT NULL").distinct()
    named = frozen(different.select("source", composed.alias("__composed")).select(
        "source",
        names.eval_name(F.col("__composed")).alias("hit_name"),
        names.eval_stem_key(nfkc(F.col("__composed"))).alias("stem"),
        names.eval_extension(F.col("__composed")).alias("hit_ext"),
    )).filter("hit_name <> ''")
    keyed = hits.join(named, "source").select("query_id", *kept, "hit_name", "stem", "hit_ext")
    joined = keyed.join(truth_rows, ["query_id", "stem"], "inner")
    same = (F.col("hit_name") == F.col("truth")) | names.extensions_agree(F.col("truth_ext"), F.col("hit_ext"))
    return joined.filter(same)


# ---------------------------------------------------------------- per question
def source_metrics(truth: DataFrame, hits: DataFrame, k: int, distinct: bool = True, page: str | None = None) -> DataFrame:
    """hit_position and recall_at_k per question.

    One source: its first rank. Several: the rank by which all were found, or null. `page` names a truth column with
    a page that must agree when there is only one source.
    """
    rows = truth_sources(truth, distinct)
    found = matched_hits(rows, hits)
    if page is not None:
        wanted = truth.select("query_id", F.col(page).alias("__page"))
        found = found.join(wanted, "query_id").filter(
            (F.col("n_truth") > 1) | F.col("__page").isNull() | F.coalesce(F.col("page") == F.col("__page"), F.lit(False))
        )
    # A source matched by very many hits is reduced to its first rank inside each task.
    first = found.groupBy("query_id", "n_truth", "truth").agg(F.min("rank").alias("first_rank"))
    per_query = first.groupBy("query_id").agg(
        F.max("first_rank").alias("last"), F.count("*").alias("n_found"), F.max("n_truth").alias("n_truth"),
        F.count_if(F.col("first_rank") <= k).alias("n_in_k"),
    )
    needed = F.size(F.array_distinct(F.filter(F.transform("sources", names.eval_name), lambda s: s != "")))
    joined = truth.select("query_id", needed.alias("n_needed")).join(per_query, "query_id", "left")
    return joined.select(
        "query_id",
        F.when(F.col("n_found") == F.col("n_truth"), F.col("last")).alias("hit_position"),
        F.when(F.col("n_in_k") == F.col("n_needed"), 1.0).otherwise(0.0).alias("recall_at_k"),
    )


def average_hit_score(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """Mean score of the hits from a ground-truth document; null without one."""
    found = matched_hits(truth_sources(truth), hits).select("query_id", "rank", "score").distinct()
    mean = found.groupBy("query_id").agg(F.avg("score").alias("avg_score"))
    return truth.select("query_id").join(mean, "query_id", "left")


def chunk_label(normalized: Column) -> Column:
    return F.lower(strip(normalized.cast("string")))


def split_chunk_labels(labels: Column) -> Column:
    """Mixed chunk labels as struct of uids and orders: an underscore or a letter makes a uid."""
    cleaned = F.filter(F.transform(labels, chunk_label), lambda x: x.isNotNull() & (x != ""))
    is_uid = r"_|\p{L}"
    return F.struct(
        F.array_distinct(F.filter(cleaned, lambda x: x.rlike(is_uid))).alias("uids"),
        F.array_distinct(F.filter(cleaned, lambda x: ~x.rlike(is_uid))).alias("orders"),
    )


def chunk_recall(truth: DataFrame, hits: DataFrame, k: int, same_source: bool = False) -> DataFrame:
    """Share of the labelled chunks among the first k hits, by uid or by order, whichever is higher; null without labels.

    `truth`: query_id, uids, orders. Orders match whatever document they come from; with `same_source` a hit's order
    counts only if its document is one of the `sources` of the question.
    """
    near = hits.filter(F.col("rank") <= k)
    uid = chunk_label(F.col("chunk_id"))
    order_keys = F.array_compact(
        F.array(
            F.nullif(F.regexp_extract(uid, r"_\s*(\d+)$", 1), F.lit("")), F.nullif(chunk_label(F.col("chunk_index")), F.lit(""))
        )
    )
    if same_source:
        rows = truth_sources(truth)
        ours = matched_hits(rows, near).select("query_id", "rank").distinct().withColumn("__ours", F.lit(True))
        near = near.join(ours, ["query_id", "rank"], "left")
        order_keys = F.when(F.col("__ours"), order_keys).otherwise(F.array().cast("array<string>"))
    keys = near.select("query_id", F.nullif(uid, F.lit("")).alias("u"), order_keys.alias("o"))
    # At most k hits per question are gathered.
    seen = keys.groupBy("query_id").agg(
        F.collect_set("u").alias("seen_uids"), F.array_distinct(F.flatten(F.collect_list("o"))).alias("seen_orders")
    )
    none = F.array().cast("array<string>")
    joined = truth.select("query_id", "uids", "orders").join(seen, "query_id", "left")
    by_uid = F.when(F.size("uids") > 0, F.size(F.array_intersect("uids", F.coalesce("seen_uids", none))) / F.size("uids"))
    by_order = F.when(
        F.size("orders") > 0, F.size(F.array_intersect("orders", F.coalesce("seen_orders", none))) / F.size("orders")
    )
    return joined.select("query_id", F.greatest(by_uid, by_order).alias("chunk_recall"))


def empty_rate(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Share of the questions without any hit; 0 for no questions."""
    any_hit = hits.select("query_id").distinct().withColumn("__hit", F.lit(True))
    joined = questions.select("query_id").join(any_hit, "query_id", "left")
    return joined.agg(F.coalesce(F.avg(F.col("__hit").isNull().cast("int")), F.lit(0.0)).alias("empty_rate"))


def with_table_hit(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Put `data_list.csv` in front of the hits of questions answered from the notice table.

    `questions`: query_id, sources, from_table. Lists that already contain the table stay as they are.
    """
    labels = F.transform("sources", names.hit_label)
    asks_table = F.exists(labels, names.is_notice_table)
    wanted = questions.filter(F.col("from_table") & asks_table).select("query_id")
    present = hits.filter(names.hit_label(F.col("source")) == "data_list").select("query_id")
    added = wanted.join(present, "query_id", "left_anti")
    moved = hits.join(added.withColumn("__shift", F.lit(1)), ["query_id"], "left")
    shifted = moved.withColumn("rank", F.col("rank") + F.coalesce("__shift", F.lit(0))).drop("__shift")
    columns = {f.name: F.lit(None).cast(f.dataType) for f in hits.schema.fields}
    columns["query_id"] = F.col("query_id")
    columns["rank"] = F.lit(1).cast(hits.schema["rank"].dataType)
    columns["source"] = F.lit("data_list.csv")
    if "score" in columns:
        columns["score"] = F.lit(1.0).cast(hits.schema["score"].dataType)
    return shifted.select(*hits.columns).unionByName(added.select(*[c.alias(n) for n, c in columns.items()]))


# ---------------------------------------------------------------- summaries
def _share(condition: Column) -> Column:
    return F.coalesce(F.avg(condition.cast("int")), F.lit(0.0))


def mean_reciprocal_rank(position: Column) -> Column:
    return F.coalesce(F.avg(F.coalesce(1.0 / position, F.lit(0.0))), F.lit(0.0))


def summary(results: DataFrame, top_k: int) -> DataFrame:
    """One row over all questions; rows with an `error` count as asked but are left out of every mean."""
    ok = F.col("error").isNull()

    def mean(c: str) -> Column:
        return F.coalesce(F.round(F.avg(F.when(ok, F.col(c))), 2), F.lit(0.0))

    return results.agg(
        F.count("*").alias("num_queries"),
        F.count_if(ok).alias("num_evaluated"),
        F.lit(top_k).alias("top_k"),
        mean("correctness").alias("avg_correctness"),
        mean("answer_coverage").alias("avg_answer_coverage"),
        mean("faithfulness").alias("avg_faithfulness"),
        mean("context_relevance").alias("avg_context_relevance"),
        F.round(_share(F.when(ok, F.col("recall_at_k") > 0)), 4).alias("recall_at_k_source"),
        F.round(F.avg(F.when(ok, F.col("chunk_recall"))), 4).alias("recall_at_k_chunk"),
        F.count_if(ok & F.col("chunk_recall").isNotNull()).alias("num_chunk_labeled_queries"),
        F.round(
            F.coalesce(F.avg(F.when(ok, F.coalesce(1.0 / F.col("hit_position"), F.lit(0.0)))), F.lit(0.0)), 4
        ).alias("mrr_source"),
    )


def judge_scores(reply: Column) -> Column:
    """The four scores of a judge's JSON reply, each brought into 0..5, with their reasons; null if unreadable."""
    entry = "struct<score: int, reason: string>"
    parsed = F.from_json(json_object(reply), ", ".join(f"{c} {entry}" for c in fixed.JUDGE_CRITERIA))
    scored = [
        F.struct(
            F.least(F.greatest(F.coalesce(parsed[c]["score"], F.lit(0)), F.lit(0)), F.lit(5)).alias("score"),
            F.coalesce(parsed[c]["reason"], F.lit("")).alias("reason"),
        ).alias(c)
        for c in fixed.JUDGE_CRITERIA
    ]
    return F.when(parsed.isNotNull(), F.struct(*scored))
