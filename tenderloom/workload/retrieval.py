"""Queries on vector search, hybrid scoring, re-ranking and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions.text import nfkc, overlap_coefficient, tokens
from tenderloom.operators import rerank, search, vector_index
from tenderloom.plans.answering import adapted_hits, with_institution
from tenderloom.sources.tables import table
from tenderloom.workload.derived import hits, notices, questions, with_sql


def label_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question vector per relevance class: the mean of its vectors."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = e.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One value per dimension and class: 64 rows per group.
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return vectors.select(F.col("label").cast("bigint").alias("query_id"), F.transform("v", lambda r: r["x"]).alias("vector"))


def vector_index_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


_QUERY_VECTORS = """WITH qd AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
    q AS (SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS v FROM qd GROUP BY label),
    d AS (SELECT q.query_id, e.vec_id AS id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS distance, e.label FROM embeddings e, q),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS position FROM d)"""


def knn_dense(spark, sf):
    found = search.nearest(vector_index_rows(spark, sf), label_questions(spark, sf), fixed.DEFAULT_TOP_K)
    return found.select("query_id", "id", "distance", "position", F.round(search.dense_score(F.col("distance")), 6).alias("score"))


KNN_SQL = f"{_QUERY_VECTORS} SELECT query_id, id, distance, position, round(1 / (1 + distance), 6) AS score FROM n WHERE position <= 10"


def knn_class_share(spark, sf):
    """Share of the nearest vectors that belong to the class of the question."""
    index = vector_index_rows(spark, sf)
    found = search.nearest(index, label_questions(spark, sf), fixed.DEFAULT_TOP_K)
    joined = index.select("id", "label").join(found, ["id"], "inner")
    return joined.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("query_id")).cast("int")), 6).alias("share"))


CLASS_SHARE_SQL = f"{_QUERY_VECTORS} SELECT query_id, round(avg((label = query_id)::INTEGER), 6) AS share FROM n WHERE position <= 10 GROUP BY query_id"


def vector_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 100, as a question."""
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))


def knn_vectors(spark, sf):
    """Exact neighbours of every hundredth vector among all."""
    return search.nearest(vector_index_rows(spark, sf), vector_questions(spark, sf), fixed.DEFAULT_TOP_K).select("query_id", "id", "distance", "position")


KNN_VECTORS_SQL = """WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance
           FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)
    SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS position FROM d QUALIFY position <= 10"""


def knn_lists(spark, sf):
    """The same neighbours from an inverted file: only the lists nearest to a question are read."""
    index = vector_index.build(vector_index_rows(spark, sf), k=fixed.DEFAULT_TOP_K)
    return vector_index.search_lists(index, vector_questions(spark, sf), fixed.DEFAULT_TOP_K).select("query_id", "id", "distance", "position")


def knn_lists_recall(spark, sf):
    """Whether the inverted file finds nine tenths of the exact neighbours, and that what it finds has exact distances."""
    found, exact = knn_lists(spark, sf), knn_vectors(spark, sf)
    same = exact.select("query_id", "id", F.col("distance").alias("exact"))
    wrong = found.join(same, ["query_id", "id"]).agg(F.count_if(F.col("distance") != F.col("exact")).alias("wrong_distances"))
    return vector_index.recall(found, exact).agg(F.count("*").alias("questions"), (F.avg("recall") >= 0.9).alias("recall_reached")).crossJoin(wrong)


LISTS_RECALL_SQL = "SELECT count(*) AS questions, true AS recall_reached, 0 AS wrong_distances FROM embeddings WHERE vec_id % 100 = 0"


def _text_index(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return vector_index_rows(spark, sf).join(d, "id")


def _text_questions(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return label_questions(spark, sf).join(b, "query_id")


def _search_sql(mode: str, limit: int = 10) -> str:
    return f"""{_QUERY_VECTORS.replace("FROM embeddings e, q)", "FROM embeddings e JOIN documents ON doc_id = vec_id, q JOIN benchmark b ON b.item_id = q.query_id)")},
    c AS (SELECT n.query_id, n.id, n.position, n.distance, x.text, x.source, b.text AS question FROM n JOIN documents x ON x.doc_id = n.id
          JOIN benchmark b ON b.item_id = n.query_id WHERE n.position <= 40),
    tk AS (SELECT *, list_distinct(regexp_extract_all(lower(question), '[0-9a-z가-힣]{{2,}}')) AS qt, list_distinct(regexp_extract_all(lower(text), '[0-9a-z가-힣]{{2,}}')) AS tt,
                  list_distinct(regexp_extract_all(lower(source), '[0-9a-z가-힣]{{2,}}')) AS st FROM c),
    sc AS (SELECT query_id, id, source, position, 1 / (1 + greatest(distance, 0)) AS dense_score,
                  least(1.0, len(list_intersect(qt, tt)) / greatest(len(qt), 1) + 0.3 * (len(list_intersect(qt, st)) / greatest(len(qt), 1)))::DOUBLE AS lexical_score,
                  {mode} AS mode FROM tk),
    r AS (SELECT *, CASE WHEN mode = 'chroma' THEN dense_score ELSE 0.6 * dense_score + 0.4 * lexical_score END AS score FROM sc),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank FROM r)
    SELECT query_id, rank, id, source, mode, round(score, 6) AS score, round(dense_score, 6) AS dense_score, round(lexical_score, 6) AS lexical_score FROM o WHERE rank <= {limit}"""


def _search(spark, sf, mode):
    found = search.search(_text_index(spark, sf), _text_questions(spark, sf), mode=mode)
    return found.select("query_id", "rank", "id", "source", "mode", *[F.round(c, 6).alias(c) for c in ("score", "dense_score", "lexical_score")])


def hybrid_search(spark, sf):
    return _search(spark, sf, "hybrid")


def dynamic_search(spark, sf):
    return _search(spark, sf, "dynamic")


_DYNAMIC = """CASE WHEN CASE WHEN length(question) >= 80 THEN 2 WHEN length(question) >= 45 THEN 1 ELSE 0 END
    + CASE WHEN len(regexp_extract_all(question, '[0-9A-Za-z가-힣]+')) >= 16 THEN 2 WHEN len(regexp_extract_all(question, '[0-9A-Za-z가-힣]+')) >= 10 THEN 1 ELSE 0 END >= 2
    THEN 'chroma' ELSE 'hybrid' END"""


def lexical_overlap(spark, sf):
    """Word overlap of every conversation turn with the turn before it, as text score and as overlap coefficient."""
    c = table(spark, sf, "conversations")
    earlier = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"), F.col("role").alias("source"))
    rows = c.select("conv_id", "turn", "text").join(earlier, ["conv_id", "turn"])
    q, t, s = (tokens(nfkc(F.col(x))) for x in ("text", "before", "source"))
    made = rows.select("conv_id", "turn", q.alias("q"), t.alias("t"), s.alias("s"))
    return made.select(
        "conv_id", "turn", F.round(search.lexical_score(F.col("q"), F.col("t"), F.col("s")), 6).alias("lexical"),
        F.round(overlap_coefficient(F.col("q"), F.col("t")), 6).alias("coefficient"),
    )


LEXICAL_SQL = """WITH p AS (SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(lower(a.text), '[0-9a-z가-힣]{2,}')) AS q,
                  list_distinct(regexp_extract_all(lower(b.text), '[0-9a-z가-힣]{2,}')) AS t, list_distinct(regexp_extract_all(lower(b.role), '[0-9a-z가-힣]{2,}')) AS s
           FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
    SELECT conv_id, turn, CASE WHEN len(q) = 0 THEN 0 ELSE round(least(1.0, len(list_intersect(q, t)) / len(q) + 0.3 * len(list_intersect(q, s)) / len(q)), 6) END AS lexical,
           CASE WHEN least(len(q), len(t)) = 0 THEN 0 ELSE round(len(list_intersect(q, t)) / least(len(q), len(t)), 6) END AS coefficient FROM p"""


# ---------------------------------------------------------------- lists
def _org_hits(spark, sf):
    h = hits(spark, sf)
    return h.select(
        "query_id", "rank", "score", "source", F.when(F.col("chunk_index") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("org"), (F.col("chunk_index") % 3).cast("string"))).alias("org"),
        "chunk_index", F.regexp_replace(F.lower("source"), "[^0-9a-z]+", "").alias("source_key"),
    )


def diversify(spark, sf):
    return rerank.diversify(_org_hits(spark, sf)).select("query_id", "rank", "new_rank")


DIVERSIFY_SQL = with_sql(["hits"], """
    , o AS (SELECT query_id, rank, CASE WHEN chunk_index % 4 = 0 THEN source ELSE 'org' || (chunk_index % 3)::VARCHAR END AS k FROM hits),
    a AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, count(*) OVER (PARTITION BY query_id, k) AS sz, min(rank) OVER (PARTITION BY query_id, k) AS f,
                 row_number() OVER (PARTITION BY query_id, k ORDER BY rank) AS turn FROM o),
    b AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY sz DESC, f) AS place FROM a),
    c AS (SELECT *, max(place) OVER (PARTITION BY query_id) AS keys, CASE WHEN place <= 2 THEN row_number() OVER (PARTITION BY query_id, place <= 2 ORDER BY turn, place) END AS pool FROM b),
    d AS (SELECT *, coalesce(n > 2 AND keys >= 2 AND pool <= least(10, n), false) AS picked FROM c)
    SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY picked DESC, CASE WHEN picked THEN pool END, rank) AS new_rank FROM d""")


def cluster_penalty(spark, sf):
    return rerank.spread_sources(_org_hits(spark, sf), 5).select("query_id", "rank", "new_rank")


def merge_dedupe(spark, sf):
    h = hits(spark, sf).select("query_id", "rank", "source", "chunk_id")
    base, incoming = h.filter("rank % 2 = 1"), h.filter("rank % 3 <> 1")
    return rerank.merge(base, incoming, ["source"], 4).select("query_id", "new_rank", "source", "chunk_id")


MERGE_SQL = with_sql(["hits"], """
    , u AS (SELECT 0 AS p, * FROM hits WHERE rank % 2 = 1 UNION ALL SELECT 1, * FROM hits WHERE rank % 3 <> 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY p, rank) AS c FROM u),
    m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, rank) AS new_rank FROM f WHERE c = 1)
    SELECT query_id, new_rank, source, chunk_id FROM m WHERE new_rank <= 4""")


def _evidence_hits(spark, sf):
    h = hits(spark, sf)
    text = F.element_at(
        F.array(F.lit("저작권은 발주기관에 귀속된다"), F.concat(F.lit("총사업비 "), F.col("page").cast("string"), F.lit("50,000천원")), F.lit("일반 내용")),
        (F.col("chunk_index") % 3 + 1).cast("int"),
    )
    return h.withColumn("text", text)


def evidence_flags(spark, sf):
    return rerank.evidence_flags(_evidence_hits(spark, sf).filter("rank % 2 = 1"), 3)


EVIDENCE_SQL = with_sql(["hits"], """
    SELECT query_id, bool_or(rank <= 3 AND chunk_index % 3 = 0) AS has_owner, bool_or(rank <= 3 AND chunk_index % 3 = 1) AS has_budget
    FROM hits WHERE rank % 2 = 1 GROUP BY query_id""")


def original_fallback(spark, sf):
    kind = F.lower(F.regexp_extract("source", r"\.([a-z]+)$", 1))
    h = hits(spark, sf).filter("chunk_index > 2")
    rows = rerank.original_fallback(questions(spark, sf), h, kind, F.lower(F.col("question")))
    return rows.select("query_id", "fallback")


FALLBACK_SQL = with_sql(["hits", "questions"], f"""
    , s AS (SELECT query_id, bool_or(regexp_matches(source, '\\.(pdf|hwp)$') AND rank <= 8) AS o FROM hits WHERE chunk_index > 2 GROUP BY query_id)
    SELECT q.query_id, CASE WHEN s.query_id IS NULL THEN true
           ELSE ({' OR '.join(f"contains(lower(question), '{w}')" for w in fixed.ORIGINAL_PRIORITY_WORDS)}) AND NOT o END AS fallback
    FROM questions q LEFT JOIN s USING (query_id)""")


def unique_sources(spark, sf):
    return search.unique_sources(hits(spark, sf))


UNIQUE_SQL = with_sql(["hits"], "SELECT query_id, count(DISTINCT source) AS n_sources FROM hits GROUP BY query_id")


def retrieval_metrics(spark, sf):
    return search.retrieval_metrics(hits(spark, sf))


METRICS_SQL = with_sql(["hits"], """
    SELECT query_id, count(*) AS retrieval_count, round(round(avg(score) FILTER (score <> 0), 10), 4) AS retrieval_avg_score, round(max(score) FILTER (score <> 0), 4) AS retrieval_max_score
    FROM hits GROUP BY query_id""")


def diverse_search(spark, sf):
    """Five diverse vectors for every relevance class."""
    return search.diverse(vector_index_rows(spark, sf), label_questions(spark, sf), 5).select("query_id", "id", "position")


def asked_with_institution(spark, sf):
    rows = notices(spark, sf)
    question = F.concat(F.col("project"), F.when(F.col("row_num") % 3 == 0, F.concat(F.lit(" "), F.col("org"))).otherwise(F.lit("")))
    return rows.select("row_num", with_institution(question, F.col("org")).alias("question"))


INSTITUTION_SQL = with_sql(["notices"], """
    SELECT row_num, CASE WHEN trim(coalesce(org, '')) = '' OR contains(project || CASE WHEN row_num % 3 = 0 THEN ' ' || org ELSE '' END, trim(org))
           THEN project || CASE WHEN row_num % 3 = 0 THEN ' ' || org ELSE '' END ELSE trim(org) || ' ' || project END AS question FROM notices""")


def hits_of_any_form(spark, sf):
    """The hits as three kinds of retrievers give them, brought into one form."""
    h = hits(spark, sf)
    kind = F.col("query_id") % 3
    text = F.col("chunk_id")
    raw = h.select(
        "query_id", "rank", F.when(kind == 0, F.col("source")).alias("source"), "score",
        F.when(kind == 1, text).when(kind == 0, F.lit(" ")).alias("uid"), F.when(kind == 0, F.col("chunk_index").cast("string")).alias("chunk_order"),
        F.when(kind == 2, F.create_map(F.lit("source_file"), F.col("source"), F.lit("chunk_id"), text, F.lit("page"), F.col("page").cast("string"))).alias("metadata"),
    )
    return adapted_hits(raw).drop("content")


ADAPTED_SQL = with_sql(["hits"], """
    SELECT query_id, rank, CASE WHEN query_id % 3 = 1 THEN 'unknown' ELSE source END AS source, CASE WHEN query_id % 3 = 2 THEN page END AS page, score,
           CASE WHEN query_id % 3 <> 0 THEN chunk_id END AS chunk_id, chunk_index FROM hits""")


QUERIES = {
    "knn_dense": (knn_dense, KNN_SQL),
    "knn_vectors": (knn_vectors, KNN_VECTORS_SQL),
    "knn_lists": (knn_lists, None),
    "knn_lists_recall": (knn_lists_recall, LISTS_RECALL_SQL),
    "knn_class_share": (knn_class_share, CLASS_SHARE_SQL),
    "hybrid_search": (hybrid_search, _search_sql("'hybrid'")),
    "dynamic_search": (dynamic_search, _search_sql(_DYNAMIC)),
    "lexical_overlap": (lexical_overlap, LEXICAL_SQL),
    "diversify": (diversify, DIVERSIFY_SQL),
    "cluster_penalty": (cluster_penalty, None),
    "merge_dedupe": (merge_dedupe, MERGE_SQL),
    "evidence_flags": (evidence_flags, EVIDENCE_SQL),
    "original_fallback": (original_fallback, FALLBACK_SQL),
    "unique_sources": (unique_sources, UNIQUE_SQL),
    "diverse_search": (diverse_search, None),
    "asked_with_institution": (asked_with_institution, INSTITUTION_SQL),
    "hits_of_any_form": (hits_of_any_form, ADAPTED_SQL),
    "retrieval_metrics": (retrieval_metrics, METRICS_SQL),
}
