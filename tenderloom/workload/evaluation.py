"""Queries on retrieval metrics, judge summaries, reports and label synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions import answers, names
from tenderloom.functions.text import nfkc
from tenderloom.operators import evaluation as ev
from tenderloom.operators import labels, report
from tenderloom.operators.lines import explode_lines
from tenderloom.operators.ordered import top_per_group
from tenderloom.sources.tables import table
from tenderloom.workload.derived import hits, truth, with_sql

K = 5


# ---------------------------------------------------------------- metrics
def source_metrics(spark, sf):
    return ev.source_metrics(truth(spark, sf), hits(spark, sf), K)


_KEYS = r"""
    , hk AS (SELECT *, lower(replace(source, 'Dir/', '')) AS nm, regexp_replace(regexp_replace(lower(replace(source, 'Dir/', '')), '\.[a-z]+$', ''), '[^\p{L}\p{N}]+', '', 'g') AS stem,
                   regexp_extract(lower(source), '\.([a-z]+)$', 1) AS ext FROM hits),
    tu AS (SELECT query_id, page AS tpage, len(list_distinct(sources)) AS nd, len(sources) AS na, unnest(list_distinct(list_transform(sources, lambda s: lower(s)))) AS t FROM truth),
    tk AS (SELECT *, regexp_replace(regexp_replace(t, '\.[a-z]+$', ''), '[^\p{L}\p{N}]+', '', 'g') AS stem, regexp_extract(t, '\.([a-z]+)$', 1) AS ext FROM tu),
    mt AS (SELECT tk.query_id, tk.t, tk.nd, tk.na, tk.tpage, hk.rank, hk.page, hk.score FROM tk JOIN hk ON hk.query_id = tk.query_id AND hk.stem = tk.stem
           WHERE hk.nm = tk.t OR hk.ext = '' OR tk.ext = '' OR (hk.ext IN ('hwp', 'hwpx', 'pdf') AND tk.ext IN ('hwp', 'hwpx', 'pdf')))"""


def _metrics_sql(count: str, where: str = "true") -> str:
    return with_sql(["hits", "truth"], f"""{_KEYS},
    fr AS (SELECT query_id, t, any_value(nd) AS nd, any_value({count}) AS need, min(rank) AS r FROM mt WHERE {where} GROUP BY query_id, t),
    pq AS (SELECT query_id, count(*) AS found, max(need) AS need, max(nd) AS nd, max(r) AS last, count(*) FILTER (r <= {K}) AS ink FROM fr GROUP BY query_id)
    SELECT o.query_id, CASE WHEN found = need THEN last END AS hit_position, CASE WHEN ink = nd THEN 1.0 ELSE 0.0 END AS recall_at_k
    FROM truth o LEFT JOIN pq USING (query_id)""")


def source_metrics_with_repeats(spark, sf):
    """The strict form: a source labelled twice can never be complete, its recall can."""
    return ev.source_metrics(truth(spark, sf), hits(spark, sf), K, distinct=False)


def source_metrics_with_page(spark, sf):
    return ev.source_metrics(truth(spark, sf), hits(spark, sf), K, page="page")


def mrr(spark, sf):
    rows = ev.source_metrics(truth(spark, sf), hits(spark, sf), K)
    return rows.agg(
        F.round(ev.mean_reciprocal_rank(F.col("hit_position")), 6).alias("mrr"),
        F.round(F.avg((F.col("recall_at_k") > 0).cast("int")), 6).alias("recall"), F.count("*").alias("n"),
    )


MRR_SQL = "WITH m AS (" + _metrics_sql("nd") + """) SELECT round(avg(coalesce(1.0 / hit_position, 0)), 6) AS mrr,
    round(avg((recall_at_k > 0)::INTEGER), 6) AS recall, count(*) AS n FROM m"""


def avg_hit_score(spark, sf):
    rows = ev.average_hit_score(truth(spark, sf), hits(spark, sf))
    return rows.select("query_id", F.round("avg_score", 6).alias("avg_score"))


AVG_SCORE_SQL = with_sql(["hits", "truth"], f"""{_KEYS},
    d AS (SELECT DISTINCT query_id, rank, score FROM mt), a AS (SELECT query_id, round(avg(score), 6) AS avg_score FROM d GROUP BY query_id)
    SELECT query_id, avg_score FROM truth LEFT JOIN a USING (query_id)""")


def chunk_recall(spark, sf):
    rows = ev.chunk_recall(_label_truth(spark, sf), hits(spark, sf), K)
    return rows.select("query_id", F.round("chunk_recall", 6).alias("chunk_recall"))


CHUNK_RECALL_SQL = with_sql(["hits", "truth"], f"""
    , s AS (SELECT query_id, list_distinct(list(lower(chunk_id))) AS u, list_distinct(list(chunk_index::VARCHAR)) AS o FROM hits WHERE rank <= {K} GROUP BY query_id),
    r AS (SELECT t.query_id, CASE WHEN len(t.uids) > 0 THEN len(list_filter(list_distinct(t.uids), lambda x: list_contains(coalesce(s.u, []), x))) / len(list_distinct(t.uids)) END AS a,
                 CASE WHEN len(t.orders) > 0 THEN len(list_filter(list_distinct(t.orders), lambda x: list_contains(coalesce(s.o, []), x))) / len(list_distinct(t.orders)) END AS b
          FROM (SELECT query_id, list_transform(uids, lambda x: lower(x)) AS uids, orders FROM truth) t LEFT JOIN s USING (query_id))
    SELECT query_id, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE greatest(a, b) END, 6) AS chunk_recall FROM r""")


def _label_truth(spark, sf):
    t = truth(spark, sf)
    return t.select(
        "query_id", "sources", F.transform("uids", ev.chunk_label).alias("uids"), F.array_distinct("orders").alias("orders")
    )


def chunk_recall_labels(spark, sf):
    """Mixed labels split into uids and orders."""
    t = truth(spark, sf)
    rows = t.select("query_id", ev.split_chunk_labels(F.concat("uids", "orders", F.array(F.lit(" "), F.lit("Ab")))).alias("s"))
    return rows.select("query_id", F.array_join("s.uids", ",").alias("uids"), F.array_join("s.orders", ",").alias("orders"))


LABEL_SPLIT_SQL = with_sql(["truth"], """
    SELECT query_id, array_to_string(list_concat(list_transform(uids, lambda x: lower(x)), ['ab']), ',') AS uids,
           CASE WHEN len(orders) = 2 AND orders[1] = orders[2] THEN orders[1] ELSE array_to_string(orders, ',') END AS orders FROM truth""")


def chunk_recall_same_source(spark, sf):
    rows = ev.chunk_recall(_label_truth(spark, sf), hits(spark, sf), K, same_source=True)
    return rows.select("query_id", F.round("chunk_recall", 6).alias("chunk_recall"))


SAME_SOURCE_SQL = with_sql(["hits", "truth"], f"""{_KEYS},
    ours AS (SELECT DISTINCT query_id, rank FROM mt),
    s AS (SELECT h.query_id, list_distinct(list(lower(chunk_id))) AS u, list_distinct(list(chunk_index::VARCHAR) FILTER (o.rank IS NOT NULL)) AS o
          FROM hits h LEFT JOIN ours o ON o.query_id = h.query_id AND o.rank = h.rank WHERE h.rank <= {K} GROUP BY h.query_id),
    r AS (SELECT t.query_id, CASE WHEN len(t.uids) > 0 THEN len(list_filter(t.uids, lambda x: list_contains(coalesce(s.u, []), x))) / len(t.uids) END AS a,
                 CASE WHEN len(t.orders) > 0 THEN len(list_filter(list_distinct(t.orders), lambda x: list_contains(coalesce(s.o, []), x))) / len(list_distinct(t.orders)) END AS b
          FROM (SELECT query_id, list_transform(uids, lambda x: lower(x)) AS uids, orders FROM truth) t LEFT JOIN s USING (query_id))
    SELECT query_id, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE greatest(a, b) END, 6) AS chunk_recall FROM r""")


def empty_rate(spark, sf):
    kept = hits(spark, sf).filter("chunk_index = 3")
    rate = ev.empty_rate(truth(spark, sf), kept)
    return rate.select(F.round("empty_rate", 6).alias("empty_rate"))


EMPTY_SQL = with_sql(["hits"], """
    SELECT round(avg((h.query_id IS NULL)::INTEGER), 6) AS empty_rate FROM orders LEFT JOIN (SELECT DISTINCT query_id FROM hits WHERE chunk_index = 3) h ON h.query_id = o_orderkey""")


def table_short_circuit(spark, sf):
    q = truth(spark, sf).select(
        "query_id", F.when(F.col("query_id") % 2 == 0, F.array(F.lit("data_list.csv"))).otherwise(F.col("sources")).alias("sources"),
        (F.col("query_id") % 6 == 0).alias("from_table"),
    )
    h = hits(spark, sf).withColumn("source", F.when((F.col("query_id") % 12 == 0) & (F.col("rank") == 2), F.lit("X/Data_List.csv")).otherwise(F.col("source")))
    return ev.with_table_hit(h, q).select("query_id", "rank", "source", "score", "page")


SHORT_CIRCUIT_SQL = with_sql(["hits"], """
    , h AS (SELECT query_id, rank, CASE WHEN query_id % 12 = 0 AND rank = 2 THEN 'X/Data_List.csv' ELSE source END AS source, score, page FROM hits),
    a AS (SELECT o_orderkey AS query_id FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey NOT IN (SELECT query_id FROM h WHERE source = 'X/Data_List.csv'))
    SELECT h.query_id, h.rank + CASE WHEN a.query_id IS NULL THEN 0 ELSE 1 END AS rank, source, score, page FROM h LEFT JOIN a USING (query_id)
    UNION ALL SELECT query_id, 1, 'data_list.csv', 1.0, NULL FROM a""")


def answer_in_context(spark, sf):
    """Assistant turns judged against the turn before: shares of their sentences found there."""
    c = table(spark, sf, "conversations")
    context = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.concat(F.col("text"), F.lit(" "), F.col("text")).alias("context"))
    answer = c.select("conv_id", "turn", F.col("text").alias("answer")).join(context, ["conv_id", "turn"])
    echoed = F.concat(F.substring_index("context", ".", 1), F.lit(". "), "answer")
    rate = answers.in_context_rate(echoed, F.col("context"))
    return answer.select(
        "conv_id", "turn", F.round(rate, 6).alias("aicr"), F.round(answers.hallucination_rate(echoed, F.col("context")), 6).alias("hallucination")
    )


AICR_SQL = f"""WITH p AS (SELECT a.conv_id, a.turn, split_part(b.text, '.', 1) || '. ' || a.text AS answer, b.text || ' ' || b.text AS context
           FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
    s AS (SELECT *, list_filter(list_transform(string_split(answer, '.'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS ss FROM p),
    r AS (SELECT conv_id, turn, CASE WHEN len(ss) = 0 THEN 1.0 ELSE len(list_filter(ss, lambda x: contains(lower(context), lower(x)))) / len(ss) END AS v FROM s)
    SELECT conv_id, turn, round(v, 6) AS aicr, round(1 - v, 6) AS hallucination FROM r"""


# ---------------------------------------------------------------- judged results
def results(spark: SparkSession, sf: str) -> DataFrame:
    """Judged questions: one per labelled document, scores from its labels, stage times from the events."""
    l, d = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    e = table(spark, sf, "events")
    stage = F.when(F.col("event_type").isin("view", "click"), "analyze_query").when(F.col("event_type") == "error", "retrieve").otherwise("generate")
    size = d.agg(F.count("*")).scalar()
    times = e.select((F.col("event_id") % size).alias("doc_id"), stage.alias("stage"), "value").groupBy("doc_id").pivot("stage", fixed.LATENCY_STAGES).agg(F.sum("value"))
    rows = l.join(d, "doc_id").join(times, "doc_id", "left")
    entries = F.filter(F.array(*[F.struct(F.lit(s).alias("k"), F.col(s).alias("v")) for s in fixed.LATENCY_STAGES]), lambda x: x["v"].isNotNull())
    n = F.col("n_chars")
    return rows.select(
        F.col("doc_id").alias("query_id"),
        F.when(F.col("lang") == "en", "single_doc").when(F.col("lang") == "fr", "multi_doc").otherwise("csv_match").alias("query_type"),
        F.least(F.lit(5), F.col("quality") * 3 + n % 3).cast("int").alias("correctness"),
        F.least(F.lit(5), F.col("quality") * 2 + n % 4).cast("int").alias("answer_coverage"),
        (F.lit(5) - F.col("toxic") * 3 - n % 2).cast("int").alias("faithfulness"),
        (n % 6).cast("int").alias("context_relevance"),
        F.when(n % 5 < 4, n % 5 + 1).cast("int").alias("hit_position"),
        F.when(n % 5 < 4, 1.0).otherwise(0.0).alias("recall_at_k"),
        F.when(n % 3 > 0, n % 3 / 2).alias("chunk_recall"),
        F.when(n % 29 == 0, "timeout").alias("error"),
        F.map_from_entries(entries).alias("latencies"),
    )


_RESULTS = """WITH tm AS (SELECT event_id % (SELECT count(*) FROM documents) AS doc_id, sum(value) FILTER (event_type IN ('view', 'click')) AS analyze_query, sum(value) FILTER (event_type = 'error') AS retrieve,
                  sum(value) FILTER (event_type NOT IN ('view', 'click', 'error')) AS generate FROM events GROUP BY 1),
    res AS (SELECT l.doc_id AS query_id, CASE lang WHEN 'en' THEN 'single_doc' WHEN 'fr' THEN 'multi_doc' ELSE 'csv_match' END AS query_type,
                   least(5, quality * 3 + n_chars % 3) AS correctness, least(5, quality * 2 + n_chars % 4) AS answer_coverage, 5 - toxic * 3 - n_chars % 2 AS faithfulness,
                   n_chars % 6 AS context_relevance, CASE WHEN n_chars % 5 < 4 THEN n_chars % 5 + 1 END AS hit_position, CASE WHEN n_chars % 5 < 4 THEN 1.0 ELSE 0.0 END AS recall_at_k,
                   CASE WHEN n_chars % 3 > 0 THEN n_chars % 3 / 2 END AS chunk_recall, CASE WHEN n_chars % 29 = 0 THEN 'timeout' END AS error, analyze_query, retrieve, generate,
                   coalesce(analyze_query, retrieve, generate) IS NOT NULL AS timed
            FROM labels l JOIN documents d USING (doc_id) LEFT JOIN tm USING (doc_id))"""


def eval_summary(spark, sf):
    return ev.summary(results(spark, sf), K)


SUMMARY_SQL = f"""{_RESULTS} SELECT count(*) AS num_queries, count(*) FILTER (error IS NULL) AS num_evaluated, {K} AS top_k,
    round(avg(correctness) FILTER (error IS NULL), 2) AS avg_correctness, round(avg(answer_coverage) FILTER (error IS NULL), 2) AS avg_answer_coverage,
    round(avg(faithfulness) FILTER (error IS NULL), 2) AS avg_faithfulness, round(avg(context_relevance) FILTER (error IS NULL), 2) AS avg_context_relevance,
    round(avg((recall_at_k > 0)::INTEGER) FILTER (error IS NULL), 4) AS recall_at_k_source, round(avg(chunk_recall) FILTER (error IS NULL), 4) AS recall_at_k_chunk,
    count(*) FILTER (error IS NULL AND chunk_recall IS NOT NULL) AS num_chunk_labeled_queries, round(avg(coalesce(1.0 / hit_position, 0)) FILTER (error IS NULL), 4) AS mrr_source FROM res"""


def type_averages(spark, sf):
    rows = report.type_averages(results(spark, sf))
    return rows.select("query_type", *[F.round(f"avg_{c}", 6).alias(f"avg_{c}") for c in fixed.JUDGE_CRITERIA])


TYPES_SQL = f"""{_RESULTS} SELECT query_type, {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in fixed.JUDGE_CRITERIA)} FROM res GROUP BY query_type"""


def latency_rollup(spark, sf):
    rows = report.latency_by_type(results(spark, sf))
    return rows.select(F.coalesce("query_type", F.lit("all")).alias("query_type"), *[F.round(s, 4).alias(s) for s in fixed.LATENCY_STAGES], F.round("total", 4).alias("total"), "n")


LATENCY_SQL = f"""{_RESULTS} SELECT coalesce(query_type, 'all') AS query_type, {', '.join(f'round(sum(coalesce({s}, 0)) / count(*), 4) AS {s}' for s in fixed.LATENCY_STAGES)},
    round(sum(coalesce(analyze_query, 0) + coalesce(retrieve, 0) + coalesce(generate, 0)) / count(*), 4) AS total, count(*) AS n
    FROM res WHERE timed GROUP BY ROLLUP (query_type)"""


def latency_shares(spark, sf):
    rows = report.latency_shares(results(spark, sf))
    return rows.select("stage", F.round("avg_seconds", 4).alias("avg_seconds"), F.round("share", 6).alias("share"))


SHARES_SQL = f"""{_RESULTS}, s AS (SELECT unnest(['analyze_query', 'retrieve', 'generate']) AS stage,
    unnest([sum(coalesce(analyze_query, 0)), sum(coalesce(retrieve, 0)), sum(coalesce(generate, 0))]) / any_value(n) AS a FROM res, (SELECT count(*) AS n FROM res WHERE timed) WHERE timed)
    SELECT stage, round(a, 4) AS avg_seconds, round(a / sum(a) OVER (), 6) AS share FROM s"""


def score_histogram(spark, sf):
    return report.score_histogram(results(spark, sf))


HISTOGRAM_SQL = f"""{_RESULTS} SELECT b::INTEGER AS score, count(query_id) AS n FROM generate_series(0, 5) g(b) LEFT JOIN res ON correctness = b GROUP BY b"""


def insight_counts(spark, sf):
    return report.insight_counts(results(spark, sf))


INSIGHT_SQL = f"{_RESULTS} SELECT count(*) FILTER (correctness = 5) AS perfect, count(*) FILTER (correctness <= 2) AS weak, count(*) AS asked FROM res"


def longest_total(spark, sf):
    return report.longest_total(results(spark, sf)).select(F.round("max_total", 4).alias("max_total"))


LONGEST_SQL = f"""{_RESULTS} SELECT round(greatest(max(coalesce(analyze_query, 0) + coalesce(retrieve, 0) + coalesce(generate, 0)) FILTER (timed), 1), 4) AS max_total FROM res"""


def judge_scores(spark, sf):
    """Scores read from judge replies made of the labels; the last digit of some is out of range."""
    l = table(spark, sf, "labels")
    entry = lambda name, value: F.concat(F.lit(f'"{name}": {{"score": '), value.cast("string"), F.lit(', "reason": "r"}'))
    body = F.concat(
        F.lit("```json\n{"), entry("correctness", F.col("quality") * 7), F.lit(", "), entry("answer_coverage", F.col("toxic") * 4), F.lit(", "),
        entry("faithfulness", F.col("doc_id") % 6), F.lit(", "), entry("context_relevance", F.lit(-2)), F.lit("}\n```"),
    )
    reply = F.when(F.col("doc_id") % 10 == 0, F.lit("no json")).otherwise(body)
    rows = l.select("doc_id", ev.judge_scores(reply).alias("j"))
    return rows.select("doc_id", *[F.coalesce(F.col("j")[c]["score"], F.lit(0)).alias(c) for c in fixed.JUDGE_CRITERIA])


JUDGE_SQL = """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE least(quality * 7, 5) END AS correctness, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE least(toxic * 4, 5) END AS answer_coverage,
    CASE WHEN doc_id % 10 = 0 THEN 0 ELSE least(doc_id % 6, 5)::INTEGER END AS faithfulness, 0 AS context_relevance FROM labels"""


# ---------------------------------------------------------------- label synchronisation
def _label_chunks(spark, sf):
    lines = explode_lines(table(spark, sf, "documents").select("doc_id", "text", "source"), keys=("doc_id", "source"))
    return lines.select("source", F.concat_ws("_", "doc_id", "line_no").alias("chunk_id"), labels.label_text(nfkc(F.col("line"))).alias("text"))


def _label_items(spark, sf):
    """Evaluation items: every benchmark passage, with the source it should come from."""
    b = table(spark, sf, "benchmark")
    text = labels.label_text(nfkc(F.col("text")))
    answer = F.concat(F.substring_index(text, ".", 1), F.lit(" 12, 2024"))
    return b.select(
        F.col("item_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"),
        F.when(F.col("item_id") % 3 == 0, "multi_doc").otherwise("single_doc").alias("query_type"), text.alias("question"), answer.alias("answer"),
    )


def label_scores(spark, sf):
    """The twenty best chunks of the source of every item."""
    scored = labels.score_candidates(_label_items(spark, sf), _label_chunks(spark, sf))
    rounded = scored.withColumn("score", F.round("score", 6))
    best = top_per_group(rounded, ["item_id", "source"], [F.desc("score"), F.asc("chunk_id")], 20, "place")
    return best.select("item_id", "place", "chunk_id", "score", "num_hit", "phrase_hit", "acceptable")


_STOP = "[" + ", ".join(f"'{w}'" for w in fixed.LABEL_STOPWORDS) + "]"


def _label_tokens(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all({c}, '[0-9A-Za-z가-힣]+'), lambda x: length(x) >= 2 AND NOT list_contains({_STOP}, x)))"


_LABEL_BASE = rf"""WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
    ch AS (SELECT source, doc_id::VARCHAR || '_' || i::VARCHAR AS chunk_id, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS text
           FROM (SELECT source, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM d)),
    b AS (SELECT item_id, 'src' || (item_id % 20)::VARCHAR AS source, CASE WHEN item_id % 3 = 0 THEN 'multi_doc' ELSE 'single_doc' END AS query_type,
                 trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS question FROM benchmark),
    it AS (SELECT *, split_part(question, '.', 1) || ' 12, 2024' AS answer FROM b),
    ix AS (SELECT *, {_label_tokens('question')} AS q, {_label_tokens('answer')} AS e,
                  list_distinct(list_transform(regexp_extract_all(answer, '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', ''))) AS nums,
                  list_filter(list_transform(regexp_split_to_array(answer, '[,\n;:()]+'), lambda p: trim(p, ' -•' || chr(9))), lambda p: length(p) >= 8 AND len({_label_tokens('p')}) >= 2)[1:6] AS ph FROM it),
    ct AS (SELECT *, {_label_tokens('text')} AS t, list_distinct(list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', ''))) AS tn FROM ch),
    sc AS (SELECT ix.item_id, ix.source, ct.chunk_id, ix.query_type, ct.text AS t, ix.question, ix.nums, len(list_intersect(q, ct.t)) / greatest(len(q), 1) AS oq, len(list_intersect(e, ct.t)) / greatest(len(e), 1) AS oe,
                  len(list_intersect(nums, tn)) AS num_hit, len(list_filter(list_distinct(ph), lambda p: contains(ct.text, p))) AS phrase_hit FROM ix JOIN ct ON ct.source = ix.source),
    sr AS (SELECT item_id, source, chunk_id, CASE WHEN t = '' THEN 0 ELSE num_hit END AS num_hit, CASE WHEN t = '' THEN 0 ELSE phrase_hit END AS phrase_hit,
                  CASE WHEN t = '' THEN 0 ELSE round(1.8 * oq + 3.2 * oe + 1.4 * num_hit + 1.6 * least(phrase_hit, 2), 6) END AS score,
                  ((CASE WHEN t = '' THEN 0 ELSE round(oq, 4) + round(oe, 4) END >= CASE WHEN query_type = 'multi_doc' THEN 0.02 ELSE 0.05 END) OR (t <> '' AND phrase_hit > 0))
                  AND (NOT regexp_matches(question, 'guide|economic analysis|cost-benefit') OR regexp_matches(t, 'guideline|guide to|adb|european commission'))
                  AND (NOT contains(question, 'mm') OR (num_hit >= 2 AND (contains(t, 'mm') OR regexp_matches(t, '\d[\d,]*\s*/\s*\d[\d,]*\s*/\s*\d[\d,]*')))) AS acceptable FROM sc),
    pl AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, chunk_id) AS place FROM sr)"""
LABEL_SCORES_SQL = f"{_LABEL_BASE} SELECT item_id, place, chunk_id, score, num_hit, phrase_hit, acceptable FROM pl WHERE place <= 20"


def _selected(spark, sf):
    scored = labels.score_candidates(_label_items(spark, sf), _label_chunks(spark, sf), fixed.LABEL_MIN_SCORE - 1e-6).withColumn("score", F.round("score", 6))
    return labels.select_labels(scored, _targets(spark, sf))


def _targets(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 3 + 1).cast("int").alias("target_n"))


def label_sync(spark, sf):
    return _selected(spark, sf).select("item_id", "pick", "chunk_id", "score")


LABEL_SYNC_SQL = f"""{_LABEL_BASE},
    us AS (SELECT *, CASE WHEN place = 1 THEN 0 ELSE 1 END AS tier FROM pl WHERE place <= 20 AND acceptable AND score >= 0.85),
    pk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY tier, score DESC, chunk_id) AS pick FROM us)
    SELECT item_id, pick, chunk_id, score FROM pk WHERE tier = 0 OR pick <= item_id % 3 + 1"""


def label_sync_by_name(spark, sf):
    """The same labels for items whose sources are named otherwise than they are stored: found by label, key or part of a key."""
    number = F.regexp_extract("source", "[0-9]+", 0)
    items = _label_items(spark, sf).withColumn("label", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("src"), number)).otherwise(F.concat(F.lit("src_"), number))).drop("source")
    return labels.synchronised(items, _label_chunks(spark, sf), _targets(spark, sf)).select("item_id", "pick", "chunk_id", "score")


def label_changes(spark, sf):
    b = table(spark, sf, "benchmark")
    items = b.select("item_id", F.array(F.lit("0_0")).alias("chunk_uids"), F.array(F.lit(0).cast("bigint")).alias("chunk_orders"))
    rows = labels.label_changes(items, _selected(spark, sf))
    return rows.agg(F.count_if("changed").alias("changed"), F.count_if("unresolved").alias("unresolved"), F.count("*").alias("n"), F.sum(F.size("chunk_uids")).alias("n_labels"))


LABEL_CHANGES_SQL = "WITH sel AS (" + LABEL_SYNC_SQL + """), g AS (SELECT item_id, list(chunk_id ORDER BY pick) AS u FROM sel GROUP BY item_id)
    SELECT count(*) FILTER (u IS NOT NULL AND u <> ['0_0']) AS changed, count(*) FILTER (u IS NULL) AS unresolved, count(*) AS n, sum(coalesce(len(u), 1)) AS n_labels
    FROM benchmark LEFT JOIN g USING (item_id)"""


def label_lookup_cascade(spark, sf):
    """Customer names looked up among supplier-like source names: by label, by key, by part of the key."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    stored = s.select(F.concat(F.lit("Docs/"), "s_name", F.when(F.col("s_suppkey") % 2 == 0, F.lit(".pdf")).otherwise(F.lit(" 과업 .hwp"))).alias("source"))
    k = F.col("c_custkey")
    asked = F.when(k % 3 == 0, F.concat(F.lit("supplier#"), F.lpad(k.cast("string"), 9, "0"))).when(
        k % 3 == 1, F.concat(F.lit("Supplier-"), F.lpad(k.cast("string"), 9, "0"))
    ).otherwise(F.lpad(k.cast("string"), 6, "0"))
    wanted = c.select(names.source_label(nfkc(asked)).alias("label")).filter("label <> ''").distinct()
    return labels.match_sources(wanted, labels.source_index(stored, F.col("source")))


LOOKUP_SQL = r"""WITH st AS (SELECT DISTINCT 'Docs/' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN '.pdf' ELSE ' 과업 .hwp' END AS raw FROM supplier),
    ix AS (SELECT raw, trim(regexp_replace(replace(lower(raw), 'docs/', ''), '\.(pdf|hwp)$', '')) AS label FROM st),
    iy AS (SELECT raw, label, regexp_replace(label, '[^0-9A-Za-z가-힣]+', '', 'g') AS key FROM ix),
    w AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'supplier#' || lpad(c_custkey::VARCHAR, 9, '0') WHEN c_custkey % 3 = 1 THEN 'supplier-' || lpad(c_custkey::VARCHAR, 9, '0')
                 ELSE lpad(c_custkey::VARCHAR, 6, '0') END AS label FROM customer),
    wk AS (SELECT label, regexp_replace(label, '[^0-9A-Za-z가-힣]+', '', 'g') AS key FROM w),
    a AS (SELECT wk.label, raw, 1 AS level FROM wk JOIN iy ON iy.label = wk.label),
    b AS (SELECT wk.label, raw, 2 AS level FROM wk JOIN iy ON iy.key = wk.key WHERE wk.label NOT IN (SELECT label FROM a)),
    c AS (SELECT wk.label, raw, 3 AS level, row_number() OVER (PARTITION BY wk.label ORDER BY raw) AS rn FROM wk JOIN iy ON contains(iy.key, wk.key)
          WHERE wk.label NOT IN (SELECT label FROM a) AND wk.label NOT IN (SELECT label FROM b))
    SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT label, raw, level FROM c WHERE rn <= 3"""

QUERIES = {
    "source_metrics": (source_metrics, _metrics_sql("nd")),
    "source_metrics_with_repeats": (source_metrics_with_repeats, _metrics_sql("na")),
    "source_metrics_with_page": (source_metrics_with_page, _metrics_sql("nd", "nd > 1 OR page = tpage")),
    "mrr": (mrr, MRR_SQL),
    "avg_hit_score": (avg_hit_score, AVG_SCORE_SQL),
    "chunk_recall": (chunk_recall, CHUNK_RECALL_SQL),
    "chunk_recall_labels": (chunk_recall_labels, LABEL_SPLIT_SQL),
    "chunk_recall_same_source": (chunk_recall_same_source, SAME_SOURCE_SQL),
    "empty_rate": (empty_rate, EMPTY_SQL),
    "table_short_circuit": (table_short_circuit, SHORT_CIRCUIT_SQL),
    "answer_in_context": (answer_in_context, AICR_SQL),
    "eval_summary": (eval_summary, SUMMARY_SQL),
    "type_averages": (type_averages, TYPES_SQL),
    "latency_rollup": (latency_rollup, LATENCY_SQL),
    "latency_shares": (latency_shares, SHARES_SQL),
    "score_histogram": (score_histogram, HISTOGRAM_SQL),
    "insight_counts": (insight_counts, INSIGHT_SQL),
    "longest_total": (longest_total, LONGEST_SQL),
    "judge_scores": (judge_scores, JUDGE_SQL),
    "label_scores": (label_scores, LABEL_SCORES_SQL),
    "label_sync": (label_sync, LABEL_SYNC_SQL),
    "label_sync_by_name": (label_sync_by_name, LABEL_SYNC_SQL),
    "label_changes": (label_changes, LABEL_CHANGES_SQL),
    "label_lookup_cascade": (label_lookup_cascade, LOOKUP_SQL),
}
