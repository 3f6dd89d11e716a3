"""Queries on keeping tables up to date, run history and samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tenderloom.operators import report, sampling, store
from tenderloom.operators.ordered import row_numbers, running_before
from tenderloom.session import shared_folder
from tenderloom.sources.tables import table
from tenderloom.sources.versions import VersionedIndex
from tenderloom.workload.derived import hits, notices, with_sql


# ---------------------------------------------------------------- re-indexing and repair
def incremental_upsert(spark, sf):
    """Result rows as the stored index; the documents of even numbers under 4 in each ten come anew with other rows."""
    h = hits(spark, sf).select(F.col("query_id").alias("doc_id"), "rank", "source")
    fresh = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("rank"), F.concat(F.lit("new-"), "o_orderpriority").alias("source")
    )
    return store.upserted(h, fresh).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("source").alias("last_source"))


UPSERT_SQL = with_sql(["hits"], """
    , u AS (SELECT query_id AS doc_id, rank, source FROM hits WHERE query_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
            UNION ALL SELECT o_orderkey, 1, 'new-' || o_orderpriority FROM orders WHERE o_orderstatus = 'P')
    SELECT doc_id, count(*) AS n, max(source) AS last_source FROM u GROUP BY doc_id""")


def versioned_upsert(spark, sf):
    """Three tables of all documents in two batches, the second twice: some documents come anew, some are removed."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    again = d.filter("doc_id % 10 = 0").withColumn("text", F.concat(F.lit("v2 "), "text"))

    def tables(rows):
        lines = F.split("text", "\n", -1)
        return {
            "chunks": rows.select("doc_id", F.posexplode(lines).alias("line_no", "line")),
            "hierarchy": rows.select("doc_id", F.size(lines).alias("n_lines")),
            "sparse": rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars")),
        }

    index = VersionedIndex(f"{shared_folder(spark)}/tenderloom/index-{uuid.uuid4().hex}")
    index.commit(tables(d), d, "documents", 0)
    for _ in range(2):
        index.commit(tables(again), d.filter("doc_id % 5 = 0"), "documents", 1)
    version = index.version(spark)
    chunks = index.table(spark, "chunks", version).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min("line").alias("least_line"))
    return (chunks.join(index.table(spark, "hierarchy", version), "doc_id", "full").join(index.table(spark, "sparse", version), "doc_id", "full")
            .withColumn("version", F.lit(version.number)))


VERSIONED_SQL = """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'v2 ' ELSE '' END || coalesce(text, '') AS text FROM documents WHERE doc_id % 10 <> 5),
    c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    SELECT doc_id, count(*) AS n_chunks, min(line) AS least_line, count(*) AS n_lines, any_value(n_chars) AS n_chars, 2 AS version
    FROM c JOIN (SELECT doc_id, length(text) AS n_chars FROM d) USING (doc_id) GROUP BY doc_id"""


def _metadata(spark, sf):
    k = F.col("l_orderkey") + F.col("l_partkey")
    name = F.concat(F.lit("Supplier "), (F.col("l_suppkey") % 60).cast("string"))
    source = F.when(k % 3 == 0, F.concat(F.lit("a/"), name, F.lit(".hwpx"))).when(k % 3 == 1, name).otherwise(F.concat(F.lit("supplier-"), (F.col("l_suppkey") % 60).cast("string")))
    return table(spark, sf, "lineitem").select(
        F.concat_ws("_", "l_orderkey", "l_partkey", "l_linenumber").alias("id"), source.alias("source"),
        F.when(k % 5 == 0, F.lit("pdf")).otherwise(F.lit("")).alias("source_ext"), F.when(k % 7 == 0, F.lit("PDF")).otherwise(F.lit("chunk")).alias("type"),
    )


def _files(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    index = store.extension_index(
        s, F.concat(F.lit("Supplier "), (k % 60).cast("string"), F.element_at(F.array(F.lit(".pdf"), F.lit(".hwp"), F.lit("")), (k % 3 + 1).cast("int"))),
        F.when(k % 2 == 0, F.lit("HWP")).otherwise(F.lit("pdf")), k,
    )
    return index.filter("line_no % 60 < 40")


_REPAIR = r"""WITH m AS (SELECT l_orderkey + l_partkey AS k, (l_suppkey % 60)::VARCHAR AS s FROM lineitem),
    md AS (SELECT CASE k % 3 WHEN 0 THEN 'a/Supplier ' || s || '.hwpx' WHEN 1 THEN 'Supplier ' || s ELSE 'supplier-' || s END AS source,
                  CASE WHEN k % 5 = 0 THEN 'pdf' ELSE '' END AS source_ext, CASE WHEN k % 7 = 0 THEN 'PDF' ELSE 'chunk' END AS type, k FROM m),
    f0 AS (SELECT s_suppkey AS line_no, lower('Supplier ' || (s_suppkey % 60)::VARCHAR) AS stem,
                  CASE s_suppkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'hwp' ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'hwp' ELSE 'pdf' END END AS ext FROM supplier WHERE s_suppkey % 60 < 40),
    f AS (SELECT stem, arg_min(ext, line_no) AS ext FROM f0 GROUP BY stem),
    fk AS (SELECT regexp_replace(stem, '[^0-9a-z]+', '', 'g') AS key, arg_min(ext, line_no) AS ext FROM f0 GROUP BY 1),
    n AS (SELECT md.*, CASE k % 3 WHEN 0 THEN regexp_replace(replace(source, 'a/', ''), '\.hwpx$', '') ELSE source END AS norm FROM md),
    i AS (SELECT n.*, coalesce(CASE WHEN k % 3 = 0 THEN 'hwp' END, f.ext, fk.ext, '') AS inferred FROM n LEFT JOIN f ON f.stem = lower(norm)
          LEFT JOIN fk ON fk.key = regexp_replace(lower(norm), '[^0-9A-Za-z가-힣]+', '', 'g')),
    r AS (SELECT norm AS source, CASE WHEN inferred <> '' AND source_ext = '' THEN inferred ELSE source_ext END AS source_ext, CASE WHEN inferred <> '' AND lower(type) <> inferred THEN inferred ELSE type END AS type,
                 norm <> source AS source_normalized, inferred <> '' AND source_ext = '' AS ext_filled, inferred <> '' AND lower(type) <> inferred AS type_materialized FROM i)"""


def repair_counts(spark, sf):
    return store.repair_counts(store.repaired(_metadata(spark, sf), _files(spark, sf), materialize_type=True))


REPAIR_COUNTS_SQL = f"""{_REPAIR} SELECT count(*) AS scanned, count(*) FILTER (source_normalized OR ext_filled OR type_materialized) AS changed,
    count(*) FILTER (source_normalized) AS source_normalized, count(*) FILTER (ext_filled) AS ext_filled, count(*) FILTER (type_materialized) AS type_materialized FROM r"""


def repair_diff(spark, sf):
    rows = store.repaired(_metadata(spark, sf), _files(spark, sf), materialize_type=True)
    return rows.groupBy("source", "source_ext", "type").agg(F.count("*").alias("n"))


REPAIR_DIFF_SQL = f"{_REPAIR} SELECT source, source_ext, type, count(*) AS n FROM r GROUP BY source, source_ext, type"


def stored_metadata(spark, sf):
    rows = notices(spark, sf).select(
        "row_num",
        F.struct(
            F.concat(F.lit("files/"), "file_name").alias("source"), F.col("row_num").alias("chunk_order"), F.array("notice_no", "org").alias("refs"),
            F.when(F.col("row_num") % 2 == 0, F.col("project")).alias("section"),
        ).alias("metadata"),
    )
    m = F.col("metadata")
    return store.stored_metadata(rows).select(
        "row_num", F.size(m).alias("n_keys"), m["source"].alias("source"), m["source_ext"].alias("source_ext"), m["refs"].alias("refs"), m["section"].alias("section")
    )


STORED_SQL = with_sql(["notices"], r"""
    SELECT row_num, CASE WHEN row_num % 2 = 0 THEN 5 ELSE 4 END AS n_keys, regexp_replace(file_name, '\.[a-z]+$', '') AS source, regexp_extract(file_name, '\.([a-z]+)$', 1) AS source_ext,
           '["' || notice_no || '","' || org || '"]' AS refs, CASE WHEN row_num % 2 = 0 THEN project END AS section FROM notices""")


# ---------------------------------------------------------------- run history
def run_anomaly(spark, sf):
    """Events as runs of one history in time order; errors are failed runs."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("value").alias("seconds"))
    rows = store.run_anomalies(e, [], ["event_id"], "seconds", F.col("event_type") != "error")
    return rows.select("event_id", "n_before", "is_anomaly")


ANOMALY_SQL = """WITH w AS (SELECT event_id, event_type, value, count(*) FILTER (event_type <> 'error') OVER f AS n, sum(value) FILTER (event_type <> 'error') OVER f AS s
        FROM events WINDOW f AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, n AS n_before, event_type <> 'error' AND CASE WHEN n < 10 THEN value > 60 ELSE value > s / n * 3 END AS is_anomaly FROM w"""


def run_anomaly_by_user(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("value").alias("seconds"))
    rows = store.run_anomalies(e, ["user_id"], ["event_id"], "seconds", F.col("event_type") != "error")
    return rows.groupBy("user_id").agg(F.count_if("is_anomaly").alias("n_anomalies"), F.max("n_before").alias("n_runs"))


ANOMALY_USER_SQL = """WITH w AS (SELECT event_id, user_id, event_type, value, count(*) FILTER (event_type <> 'error') OVER f AS n, sum(value) FILTER (event_type <> 'error') OVER f AS s
        FROM events WINDOW f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT user_id, count(*) FILTER (event_type <> 'error' AND CASE WHEN n < 10 THEN value > 60 ELSE value > s / n * 3 END) AS n_anomalies, max(n) AS n_runs FROM w GROUP BY user_id"""


def run_totals(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("value").alias("duration_sec"))
    return report.run_totals(e).select("total", "ok", "failed", F.round("avg_seconds", 4).alias("avg_seconds"), F.round("total_seconds", 2).alias("total_seconds"))


TOTALS_SQL = """SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed,
    round(avg(value) FILTER (event_type <> 'error'), 4) AS avg_seconds, round(sum(value) FILTER (event_type <> 'error'), 2) AS total_seconds FROM events"""


def running_history(spark, sf):
    """Number and sum of the earlier purchases of every user, event by event."""
    e = table(spark, sf, "events")
    cents = F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("bigint"))
    rows = running_before(e, ["user_id"], ["event_id"], cents.cast("double"), "n_before", "sum_before")
    return rows.select("event_id", "n_before", F.col("sum_before").cast("bigint").alias("cents_before"))


RUNNING_SQL = """SELECT event_id, count(*) FILTER (event_type = 'purchase') OVER f AS n_before, coalesce(sum(round(value * 100)::BIGINT) FILTER (event_type = 'purchase') OVER f, 0)::BIGINT AS cents_before
    FROM events WINDOW f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def global_chunk_ids(spark, sf):
    """One running chunk number over all documents in document order."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = row_numbers(lines.select("doc_id", "pos"), [], ["doc_id", "pos"], "n")
    return rows.select("doc_id", "pos", (F.col("n") - 1).alias("chunk_id"))


GLOBAL_IDS_SQL = """WITH l AS (SELECT doc_id, (unnest(generate_series(1, len(string_split(text, chr(10))))) - 1)::INTEGER AS pos FROM documents)
    SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id FROM l"""


# ---------------------------------------------------------------- samples
def stratified_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    rows = sampling.balanced(sampling.eligible(d), "doc_id", "source", 40)
    return rows.select("doc_id", "source")


SAMPLE_SQL = r"""WITH e AS (SELECT doc_id, source, sha256('42-' || doc_id::VARCHAR) AS lot FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 200),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lot, doc_id) AS place FROM e),
    t AS (SELECT *, CASE WHEN place <= greatest(1, 40 // (SELECT count(DISTINCT source) FROM e)) THEN 0 ELSE 1 END AS tier FROM p WHERE place <= 40)
    SELECT doc_id, source FROM t ORDER BY tier, lot, doc_id LIMIT 40"""


def eval_set_pairs(spark, sf):
    """A drawn sample in order, its first items for single questions, the rest in pairs of different sources."""
    counts = sampling.type_counts(20)
    pairs = counts["multi_doc"] + counts["comparison"]
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    drawn = sampling.balanced(sampling.eligible(d), "doc_id", "source", counts["single_doc"] + 3 * pairs)
    placed = row_numbers(drawn.withColumn("lot", sampling.lot(F.col("doc_id"))), [], ["lot", "doc_id"], "place")
    return sampling.paired(placed.select("place", "source"), counts["single_doc"], pairs)


QUERIES = {
    "incremental_upsert": (incremental_upsert, UPSERT_SQL),
    "versioned_upsert": (versioned_upsert, VERSIONED_SQL),
    "repair_counts": (repair_counts, REPAIR_COUNTS_SQL),
    "repair_diff": (repair_diff, REPAIR_DIFF_SQL),
    "stored_metadata": (stored_metadata, STORED_SQL),
    "run_anomaly": (run_anomaly, ANOMALY_SQL),
    "run_anomaly_by_user": (run_anomaly_by_user, ANOMALY_USER_SQL),
    "run_totals": (run_totals, TOTALS_SQL),
    "running_history": (running_history, RUNNING_SQL),
    "global_chunk_ids": (global_chunk_ids, GLOBAL_IDS_SQL),
    "stratified_sample": (stratified_sample, SAMPLE_SQL),
    "eval_set_pairs": (eval_set_pairs, None),
}
