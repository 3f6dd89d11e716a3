"""Queries that run whole plans: ingest, answering, evaluation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.operators import notices as notice_ops
from tenderloom.plans import answering, evaluating, ingest
from tenderloom.session import frozen
from tenderloom.sources.tables import table
from tenderloom.workload.derived import SQL, hits, markdown_documents, notices, questions, truth
from tenderloom.workload.evaluation import K, results
from tenderloom.workload.notices import _MERGED, _REGISTRY, registry_rows
from tenderloom.workload.retrieval import _evidence_hits
from tenderloom.workload.text import _BUDGET, _CATEGORY, _NO_CURRICULUM, _ORG_SQL, _RANKING, _any


def _answered(spark, sf):
    asked = frozen(answering.understood(questions(spark, sf)))
    rows = notices(spark, sf)
    stages = [
        answering.blank_questions,
        answering.ranking_answers(notice_ops.merge_registry(registry_rows(spark, sf))),
        answering.category_answers(rows),
        answering.notice_answers(rows),
        answering.org_overviews(rows),
        answering.not_found,
    ]
    return answering.first_answers(asked, stages, stored=True), asked


def answered_questions(spark, sf):
    return _answered(spark, sf)[0]


_CTES = ", ".join(f"{n} AS ({SQL[n]})" for n in ("notices", "questions"))
_LINE = """name || ': ' || CASE WHEN amount_numeric >= 100000000 THEN '약 ' || format('{:.1f}', amount_numeric / 100000000) || '억 원 (' || format('{:,}', amount_numeric::BIGINT) || '원)'
    WHEN amount_numeric >= 10000 THEN '약 ' || format('{:,}', round_even(amount_numeric / 10000, 0)::BIGINT) || '만 원 (' || format('{:,}', amount_numeric::BIGINT) || '원)'
    ELSE format('{:,}', amount_numeric::BIGINT) || '원' END"""
ANSWERED_SQL = f"""WITH {_CTES}, reg AS ({_REGISTRY}), merged AS ({_MERGED}),
    tops AS (SELECT 'desc' AS way, string_agg({_LINE}, chr(10) ORDER BY amount_numeric DESC) AS a FROM (SELECT * FROM merged WHERE amount_numeric > 0 ORDER BY amount_numeric DESC, name LIMIT 5)
             UNION ALL SELECT 'asc', string_agg({_LINE}, chr(10) ORDER BY amount_numeric) FROM (SELECT * FROM merged WHERE amount_numeric > 0 ORDER BY amount_numeric, name LIMIT 5)),
    cats AS (SELECT 'IT' AS category, string_agg('- ' || project || ' (' || org || ')', chr(10) ORDER BY row_num) AS a
             FROM (SELECT * FROM notices WHERE {_any(fixed.CATEGORY_WORDS['IT'], 'lower(project)')} ORDER BY row_num LIMIT 5)),
    fb AS (SELECT org, arg_min(project, row_num) AS p, arg_min(amount, row_num) AS amount FROM notices WHERE try_cast(amount AS DOUBLE) IS NOT NULL GROUP BY org),
    fd AS (SELECT org, arg_min(project, row_num) AS p, arg_min(bid_end, row_num) AS bid_end FROM notices WHERE bid_end <> '' GROUP BY org),
    t AS (SELECT query_id, question, lower(question) AS q, {_ORG_SQL} AS org FROM questions),
    k AS (SELECT *, org IS NULL AND {_RANKING} AS ranking, {_CATEGORY} AS category,
                 regexp_matches(question, '{fixed.RANGE_PATTERNS[0]}') OR regexp_matches(question, '{fixed.RANGE_PATTERNS[1]}') OR {_any(fixed.RANGE_WORDS, 'question')} AS ranged,
                 contains({_NO_CURRICULUM}, '비교') OR {_any(fixed.PLAN_COMPARE_WORDS)} OR (contains(q, '각각') AND {_any(fixed.PLAN_COMPARE_EACH_WORDS)}) AS comparison,
                 {_BUDGET} AS budget, {_any(fixed.PLAN_DEADLINE_WORDS)} AND NOT {_any(fixed.PLAN_OWNER_WORDS)} AS deadline,
                 CASE WHEN {_any(fixed.RANK_ASC_WORDS)} AND NOT {_any(fixed.RANK_DESC_WORDS)} THEN 'asc' ELSE 'desc' END AS way FROM t),
    j AS (SELECT k.*, tops.a AS top, CASE WHEN k.org IS NULL AND NOT ranking AND NOT ranged THEN cats.a END AS cat,
                 CASE WHEN k.org IS NOT NULL AND NOT comparison AND budget THEN fb.p || '의 사업 금액은 ' || format('{{:,}}', trunc(try_cast(fb.amount AS DOUBLE))::BIGINT) || '원입니다.' END AS bud,
                 CASE WHEN k.org IS NOT NULL AND NOT comparison AND NOT budget AND deadline THEN fd.p || '의 마감일은 ' || fd.bid_end || '입니다.' END AS dead
          FROM k LEFT JOIN tops ON k.ranking AND tops.way = k.way LEFT JOIN cats ON cats.category = k.category LEFT JOIN fb ON fb.org = k.org LEFT JOIN fd ON fd.org = k.org)
    SELECT query_id, coalesce(top, cat, bud, dead, CASE WHEN org IS NOT NULL THEN '''' || org || ''' 관련 정보를 찾을 수 없습니다.' ELSE '관련 정보를 찾을 수 없습니다.' END) AS answer,
           CASE WHEN coalesce(top, cat, bud, dead) IS NULL THEN 'none' ELSE 'csv' END AS source_type,
           CASE WHEN coalesce(top, cat, bud, dead) IS NULL THEN 'fixed' ELSE 'extractive' END AS answer_mode FROM j"""


def finished_answers(spark, sf):
    """The answers in their final form with slot filling and confidence."""
    found, asked = _answered(spark, sf)
    return answering.finished(found, asked)


def question_contexts(spark, sf):
    """Contexts of the first hits of every order, a text per line item."""
    rows = hits(spark, sf).withColumn("text", F.concat_ws(" ", "source", "chunk_id", F.repeat("chunk_id", 200)))
    return answering.contexts(rows).select("query_id", F.md5("context").alias("context_md5"))


CONTEXT_SQL = f"""WITH hits AS ({SQL['hits']}) SELECT query_id,
    md5(string_agg(substring(source || ' ' || chunk_id || ' ' || repeat(chunk_id, 200), 1, 700), chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM hits WHERE rank <= 6 GROUP BY query_id"""


def expanded_questions(spark, sf):
    asked = answering.understood(questions(spark, sf))
    terms = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.col("org"), F.lit(" 사업 "), i.cast("string")))
    return answering.expanded(asked, terms).groupBy("pass_no").agg(F.count("*").alias("n"), F.countDistinct("search_text").alias("n_texts"))


EXPANDED_SQL = f"""WITH questions AS ({SQL['questions']}), t AS (SELECT query_id, question, coalesce({_ORG_SQL}, '') AS org FROM questions),
    u AS (SELECT unnest(generate_series(0, 3)) AS pass_no, question, org FROM t)
    SELECT pass_no::INTEGER AS pass_no, count(*) AS n, count(DISTINCT CASE WHEN pass_no = 0 THEN question ELSE org || ' 사업 ' || pass_no::VARCHAR END) AS n_texts FROM u GROUP BY 1"""


def search_again(spark, sf):
    """Questions that need another search pass after the hits of their order."""
    asked = answering.understood(questions(spark, sf))
    return answering.to_search_again(asked, _evidence_hits(spark, sf), 3).select("query_id", "query_kind")


_KIND = f"""CASE WHEN contains({_NO_CURRICULUM}, '비교') OR {_any(fixed.PLAN_COMPARE_WORDS)} OR (contains(q, '각각') AND {_any(fixed.PLAN_COMPARE_EACH_WORDS)}) THEN 'comparison'
    WHEN {_any(fixed.PLAN_OWNER_WORDS)} THEN 'owner' WHEN {_any(fixed.PLAN_DEADLINE_WORDS)} THEN 'deadline' WHEN {_any(fixed.PLAN_NUMERIC_WORDS)} THEN 'fact_numeric'
    WHEN {_any(fixed.PLAN_MULTI_WORDS)} OR regexp_matches(q, '{fixed.PLAN_MULTI_PATTERNS[0]}') OR regexp_matches(q, '{fixed.PLAN_MULTI_PATTERNS[1]}') THEN 'multi_doc' ELSE 'single_doc' END"""
SEARCH_AGAIN_SQL = f"""WITH hits AS ({SQL['hits']}), questions AS ({SQL['questions']}),
    h AS (SELECT query_id, count(*) AS n, bool_or(rank <= 12 AND chunk_index % 3 = 0) AS o, bool_or(rank <= 12 AND chunk_index % 3 = 1) AS b FROM hits GROUP BY query_id),
    t AS (SELECT query_id, lower(question) AS q FROM questions), k AS (SELECT query_id, q, {_KIND} AS query_kind, {_BUDGET} AS budget FROM t)
    SELECT k.query_id, query_kind FROM k LEFT JOIN h USING (query_id)
    WHERE coalesce(n, 0) < 3 OR (query_kind = 'owner' AND NOT coalesce(o, false)) OR (budget AND NOT coalesce(b, false))"""


def scoped_search(spark, sf):
    """Hits of one organisation first, filled up from all hits."""
    h = hits(spark, sf).withColumnRenamed("chunk_id", "id").select("query_id", "rank", "id", "source")
    merged = answering.scoped_or_global(h.filter("source like '%pdf'"), h, 5)
    return merged.select("query_id", "new_rank", "id", "source")


SCOPED_SQL = f"""WITH hits AS ({SQL['hits']}), u AS (SELECT 0 AS p, query_id, rank, chunk_id AS id, source FROM hits WHERE source LIKE '%pdf' UNION ALL SELECT 1, query_id, rank, chunk_id, source FROM hits),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY p, rank) AS c FROM u),
    m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, rank) AS new_rank FROM f WHERE c = 1)
    SELECT query_id, new_rank, id, source FROM m WHERE new_rank <= 5"""


def ingested_index(spark, sf):
    """All documents through audit, chunking, hierarchy and sparse weights; counts per document."""
    parsed = markdown_documents(spark, sf)
    index = ingest.build_index(parsed, F.concat(F.col("source"), F.lit("_문서"), F.col("doc_id").cast("string"), F.lit(".pdf")), F.lit("2024-01-01T00:00:00"))
    # Both counts need only the keys of the weights: the terms are counted once and the keys stored.
    index = replace(index, sparse=frozen(index.sparse.select("key")))
    runs = ingest.run_rows(parsed.withColumn("source", F.col("doc_id").cast("string")), index)
    of_chunk = index.sparse.groupBy("key").agg(F.count("*").alias("n"))
    weights = of_chunk.groupBy(F.split_part("key", F.lit("/"), F.lit(1)).alias("file")).agg(F.sum("n").alias("n_terms"))
    return runs.join(weights, "file", "left").select("file", "status", "chunk_count", "hierarchy_count", "n_terms")


def evaluated_run(spark, sf):
    """Orders as evaluation items with their hits; table answers injected, scores from the labels."""
    t = truth(spark, sf)
    items = t.select(
        F.col("query_id").alias("id"), F.when(F.size("sources") > 1, "multi_doc").otherwise("single_doc").alias("query_type"),
        F.struct("sources", F.col("orders").cast("array<int>").alias("chunk_orders"), F.col("uids").alias("chunk_uids")).alias("ground_truth"),
    )
    runs = t.select("query_id", (F.col("query_id") % 6 == 0).alias("from_table"), F.when(F.col("query_id") % 31 == 0, "timeout").alias("error"))
    scores = results(spark, sf).select("query_id", *fixed.JUDGE_CRITERIA)
    rows = evaluating.results(items, hits(spark, sf), scores, runs, K)
    return evaluating.run_summary(rows, K)


QUERIES = {
    "answered_questions": (answered_questions, ANSWERED_SQL),
    "finished_answers": (finished_answers, None),
    "question_contexts": (question_contexts, CONTEXT_SQL),
    "expanded_questions": (expanded_questions, EXPANDED_SQL),
    "search_again": (search_again, SEARCH_AGAIN_SQL),
    "scoped_search": (scoped_search, SCOPED_SQL),
    "ingested_index": (ingested_index, None),
    "evaluated_run": (evaluated_run, None),
}
