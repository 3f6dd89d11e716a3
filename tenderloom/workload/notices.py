"""Queries on notices: filters, rankings, registry, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.functions import amounts, names
from tenderloom.functions.text import nfkc
from tenderloom.operators import notices as ops
from tenderloom.operators import store
from tenderloom.operators.ordered import row_numbers
from tenderloom.sources.tables import table
from tenderloom.workload.derived import TODAY, bids, notices, org_name, sql_org_name, with_sql


def _today():
    return F.lit(TODAY).cast("date")


# ---------------------------------------------------------------- flagship and top lists
def top_budget(spark: SparkSession, sf: str) -> DataFrame:
    days = ops.with_days_left(bids(spark, sf), _today())
    return ops.top_budgets(days).select(
        "rank", "notice_no", "project", "org", "budget", F.col("deadline").cast("string").alias("deadline"), "d_day",
        "urgency", amounts.format_amount(F.col("budget")).alias("amount_text"),
    )


_DAYS = f"date_diff('day', DATE '{TODAY}', deadline)"
_URGENCY = f"""CASE WHEN deadline IS NULL THEN '⚪ 미확인' WHEN {_DAYS} < 0 THEN '⛔ 마감' WHEN {_DAYS} <= 3 THEN '🔴 긴급'
               WHEN {_DAYS} <= 7 THEN '🟡 임박' ELSE '🟢 여유' END"""
_AMOUNT_TEXT = """CASE WHEN budget >= 100000000 THEN '약 ' || format('{:.1f}', budget / 100000000.0) || '억 원 (' || format('{:,}', budget) || '원)'
               WHEN budget >= 10000 THEN '약 ' || format('{:,}', round_even(budget / 10000.0, 0)::BIGINT) || '만 원 (' || format('{:,}', budget) || '원)'
               ELSE format('{:,}', budget) || '원' END"""

TOP_BUDGET_SQL = with_sql(["bids"], f"""
    SELECT row_number() OVER (ORDER BY budget DESC, notice_no) AS rank, notice_no, project, org, budget,
           strftime(deadline, '%Y-%m-%d') AS deadline, {_DAYS} AS d_day, {_URGENCY} AS urgency, {_AMOUNT_TEXT} AS amount_text
    FROM bids WHERE budget IS NOT NULL ORDER BY budget DESC, notice_no LIMIT 3""")


def top_budget_lines(spark, sf):
    return ops.top_budget_lines(ops.top_budgets(bids(spark, sf)))


TOP_BUDGET_LINES_SQL = with_sql(["bids"], """
    , t AS (SELECT row_number() OVER (ORDER BY budget DESC, notice_no) AS rank, * FROM bids WHERE budget IS NOT NULL
            ORDER BY budget DESC, notice_no LIMIT 3)
    SELECT rank, rank::VARCHAR || '. ' || project || ' (' || org || ')' || chr(10) || '   - 공고번호: ' || notice_no || ' | 사업비: '
           || format('{:,}', budget) || '원 | 마감일: ' || coalesce(strftime(deadline, '%Y-%m-%d'), '미확인') AS line,
           rank::VARCHAR || '. ' || project || ' | ' || org || ' | ' || format('{:,}', budget) || '원' AS evidence
    FROM t""")


def nearest_deadline(spark, sf):
    return ops.nearest_deadline_answer(ops.nearest_deadline(bids(spark, sf), _today()), _today())


NEAREST_DEADLINE_SQL = with_sql(["bids"], f"""
    SELECT notice_no, '**가장 마감이 임박한 공고**' || chr(10) || chr(10) || '- 공고번호: ' || notice_no || chr(10) || '- 사업명: ' || project
           || chr(10) || '- 기관: ' || org || chr(10) || '- 사업비: ' || coalesce(format('{{:,}}', budget) || '원', '미확인') || chr(10)
           || '- 마감일: ' || strftime(deadline, '%Y-%m-%d') || ' (D-' || ({_DAYS})::VARCHAR || ')' AS answer
    FROM bids WHERE deadline >= DATE '{TODAY}' ORDER BY deadline, notice_no LIMIT 1""")


# ---------------------------------------------------------------- filters
def budget_range_unknown_pass(spark, sf):
    return ops.within_budget(bids(spark, sf), F.col("budget"), 2_000_000, 3_500_000).select("notice_no", "budget")


BUDGET_RANGE_SQL = with_sql(["bids"], """
    SELECT notice_no, budget FROM bids
    WHERE budget IS NULL OR budget < 1000000 OR budget BETWEEN 2000000 AND 3500000""")


def urgent_only(spark, sf):
    days = ops.with_days_left(bids(spark, sf), _today())
    return ops.urgent(days, F.col("d_day")).select("notice_no", "d_day", "d_day_label", "budget_label", "deadline_label")


URGENT_SQL = with_sql(["bids"], f"""
    SELECT notice_no, {_DAYS} AS d_day, 'D-' || ({_DAYS})::VARCHAR AS d_day_label,
           CASE WHEN budget >= 1000000 THEN format('{{:,}}', budget) || '원' ELSE '미확인' END AS budget_label,
           strftime(deadline, '%Y-%m-%d') AS deadline_label
    FROM bids WHERE {_DAYS} BETWEEN 0 AND 7""")


def keyword_or(spark, sf):
    return ops.with_keyword(bids(spark, sf), F.col("project"), F.col("org"), "Urgent|#0000000[12]", regex=True).select("notice_no", "project", "org")


KEYWORD_SQL = with_sql(["bids"], """
    SELECT notice_no, project, org FROM bids
    WHERE regexp_matches(lower(project), 'urgent|#0000000[12]') OR regexp_matches(lower(org), 'urgent|#0000000[12]')""")


def institution_and_keyword(spark, sf):
    return ops.matching(notices(spark, sf), F.col("org"), F.col("project"), "대학교", "building").select("notice_no", "org", "project")


INSTITUTION_SQL = with_sql(["notices"], """
    SELECT notice_no, org, project FROM notices WHERE org LIKE '%대학교%' AND lower(project) LIKE '%building%'""")


def relaxed_retry(spark, sf):
    found = ops.relaxed_matching(notices(spark, sf), F.col("org"), F.col("project"), "나공사|가.*재단", "no such project")
    return found.select("row_num", "org", "match_level")


RELAXED_SQL = with_sql(["notices"], """
    , m AS (SELECT row_num, org, CASE WHEN lower(project) LIKE '%no such project%' THEN 0 ELSE 1 END AS match_level
            FROM notices WHERE regexp_matches(org, '나공사|가.*재단'))
    SELECT row_num, org, match_level FROM m WHERE match_level = (SELECT min(match_level) FROM m)""")


def sort_nulls_last(spark, sf):
    """The order of the deadline list as a column, so that the comparison sees it."""
    days = ops.with_days_left(bids(spark, sf), _today())
    keyed = days.withColumn("no_deadline", F.col("d_day").isNull()).withColumn("d", F.coalesce("d_day", F.lit(0)))
    return row_numbers(keyed, [], ["no_deadline", "d", "notice_no"], "place").select("place", "notice_no", "d_day")


SORT_SQL = with_sql(["bids"], f"""
    SELECT row_number() OVER (ORDER BY {_DAYS} ASC NULLS LAST, notice_no) AS place, notice_no, {_DAYS} AS d_day FROM bids""")


def sorted_by_budget(spark, sf):
    days = ops.with_days_left(bids(spark, sf), _today())
    return ops.sorted_notices(days, "budget").select("notice_no", "budget")


SORTED_BUDGET_SQL = with_sql(["bids"], "SELECT notice_no, budget FROM bids ORDER BY budget DESC NULLS LAST, notice_no")


def urgency_class(spark, sf):
    days = ops.with_days_left(bids(spark, sf), _today())
    return days.groupBy("urgency").agg(F.count("*").alias("n"), F.min("d_day_label").alias("first_label"))


URGENCY_SQL = with_sql(["bids"], f"""
    SELECT {_URGENCY} AS urgency, count(*) AS n,
           min(CASE WHEN deadline IS NULL THEN '-' WHEN {_DAYS} < 0 THEN 'D+' || (-({_DAYS}))::VARCHAR ELSE 'D-' || ({_DAYS})::VARCHAR END) AS first_label
    FROM bids GROUP BY 1""")


def bid_metrics(spark, sf):
    return ops.bid_metrics(ops.with_days_left(bids(spark, sf), _today()))


BID_METRICS_SQL = with_sql(["bids"], f"""
    SELECT count(*) AS total, count(*) FILTER ({_DAYS} BETWEEN 0 AND 7) AS urgent,
           min(budget) FILTER (budget >= 1000000) AS budget_min, max(budget) FILTER (budget >= 1000000) AS budget_max FROM bids""")


# ---------------------------------------------------------------- shapes
def bid_table(spark, sf):
    return ops.bid_table(notices(spark, sf)).withColumn("deadline", F.col("deadline").cast("string"))


BID_TABLE_SQL = with_sql(["notices"], """
    SELECT CASE WHEN notice_no = '' THEN 'RFP-' || CASE WHEN rn < 100 THEN lpad(rn::VARCHAR, 3, '0') ELSE rn::VARCHAR END ELSE notice_no END AS notice_no,
           project, org, trunc(try_cast(amount AS DOUBLE))::BIGINT AS budget, nullif(substring(bid_end, 1, 10), '') AS deadline
    FROM (SELECT *, row_number() OVER (ORDER BY row_num) AS rn FROM notices)""")


def registry_rows(spark, sf):
    """Registrations of organisations from two registries; a name arrives many times."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")

    def rows(df, key, nation, balance, project, offset):
        k = F.col(key)
        return df.select(
            F.concat(F.lit("NATION_"), F.col(nation).cast("string")).alias("name"),
            F.when(F.col(balance) > 0, F.round(F.col(balance) * 100).cast("bigint")).otherwise(F.lit(0)).cast("double").alias("amount_numeric"),
            F.when(F.col(balance) > 0, F.round(F.col(balance) * 100).cast("bigint").cast("string")).otherwise(F.lit("")).alias("amount"),
            F.when(k % 3 == 0, F.lit("")).otherwise(project).alias("project_name"),
            F.when(k % 4 == 1, F.concat(F.lit("s"), k.cast("string"))).otherwise(F.lit("")).alias("summary"),
            F.when(k % 5 == 2, F.lit("1998.3.15")).otherwise(F.lit("")).alias("open_date"),
            F.when(k % 6 == 3, F.lit("hwp")).otherwise(F.lit("")).alias("file_format"),
            (k % 50 == 7).alias("has_pdf"),
            (k % 50 == 9).alias("has_hwp"),
            (k + offset).alias("seq"),
        )

    first = rows(c, "c_custkey", "c_nationkey", "c_acctbal", F.col("c_name"), 0)
    second = rows(s, "s_suppkey", "s_nationkey", "s_acctbal", F.col("s_name"), 1_000_000_000_000)
    return first.unionByName(second)


_REGISTRY = """
    SELECT 'NATION_' || c_nationkey::VARCHAR AS name, CASE WHEN c_acctbal > 0 THEN round(c_acctbal * 100)::BIGINT ELSE 0 END::DOUBLE AS amount_numeric,
           CASE WHEN c_acctbal > 0 THEN (round(c_acctbal * 100)::BIGINT)::VARCHAR ELSE '' END AS amount,
           CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS project_name,
           CASE WHEN c_custkey % 4 = 1 THEN 's' || c_custkey::VARCHAR ELSE '' END AS summary,
           CASE WHEN c_custkey % 5 = 2 THEN '1998.3.15' ELSE '' END AS open_date,
           CASE WHEN c_custkey % 6 = 3 THEN 'hwp' ELSE '' END AS file_format,
           c_custkey % 50 = 7 AS has_pdf, c_custkey % 50 = 9 AS has_hwp, c_custkey AS seq FROM customer
    UNION ALL
    SELECT 'NATION_' || s_nationkey::VARCHAR, CASE WHEN s_acctbal > 0 THEN round(s_acctbal * 100)::BIGINT ELSE 0 END::DOUBLE,
           CASE WHEN s_acctbal > 0 THEN (round(s_acctbal * 100)::BIGINT)::VARCHAR ELSE '' END,
           CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END, CASE WHEN s_suppkey % 4 = 1 THEN 's' || s_suppkey::VARCHAR ELSE '' END,
           CASE WHEN s_suppkey % 5 = 2 THEN '1998.3.15' ELSE '' END, CASE WHEN s_suppkey % 6 = 3 THEN 'hwp' ELSE '' END,
           s_suppkey % 50 = 7, s_suppkey % 50 = 9, s_suppkey + 1000000000000 FROM supplier"""
_MERGED = """
    SELECT name, arg_max(amount, struct_pack(a := amount_numeric, b := -seq)) AS amount, max(amount_numeric) AS amount_numeric,
           coalesce(arg_min(project_name, seq) FILTER (project_name <> ''), '') AS project_name,
           coalesce(arg_min(summary, seq) FILTER (summary <> ''), '') AS summary,
           coalesce(arg_min(open_date, seq) FILTER (open_date <> ''), '') AS open_date,
           coalesce(arg_min(file_format, seq) FILTER (file_format <> ''), '') AS file_format,
           bool_or(has_pdf) AS has_pdf, bool_or(has_hwp) AS has_hwp
    FROM reg GROUP BY name"""


def org_registry_merge(spark, sf):
    return ops.merge_registry(registry_rows(spark, sf))


ORG_REGISTRY_SQL = f"WITH reg AS ({_REGISTRY}) {_MERGED}"


def org_ranking_desc(spark, sf):
    return ops.org_ranking(ops.merge_registry(registry_rows(spark, sf))).select("name", "amount", "amount_numeric")


def org_ranking_asc(spark, sf):
    return ops.org_ranking(ops.merge_registry(registry_rows(spark, sf)), descending=False).select("name", "amount", "amount_numeric")


def _ranking_sql(way: str) -> str:
    return f"""WITH reg AS ({_REGISTRY}), merged AS ({_MERGED}) SELECT name, amount, amount_numeric FROM merged
               WHERE amount_numeric > 0 ORDER BY amount_numeric {way}, name LIMIT 5"""


def registry_bid_table(spark, sf):
    return ops.registry_bid_table(ops.merge_registry(registry_rows(spark, sf))).withColumn("deadline", F.col("deadline").cast("string"))


REGISTRY_BIDS_SQL = f"""WITH reg AS ({_REGISTRY}), merged AS ({_MERGED})
    SELECT 'RFP-' || lpad((row_number() OVER (ORDER BY name))::VARCHAR, 3, '0') AS notice_no,
           CASE WHEN project_name = '' THEN name ELSE project_name END AS project, name AS org,
           CASE WHEN amount_numeric > 0 THEN amount_numeric::BIGINT END AS budget,
           CASE WHEN open_date <> '' THEN '1998-04-14' END AS deadline FROM merged"""


def file_bid_table(spark, sf):
    files = notices(spark, sf).select(F.concat("row_num", F.lit("-"), "file_name").alias("file_name"))
    return ops.file_bid_table(files).select("notice_no", "project", "org")


FILE_BIDS_SQL = with_sql(["notices"], """
    , f AS (SELECT row_num::VARCHAR || '-' || file_name AS file_name FROM notices),
    n AS (SELECT file_name, row_number() OVER (ORDER BY CASE WHEN file_name LIKE '%.hwp' THEN 0 WHEN file_name LIKE '%.hwpx' THEN 1 ELSE 2 END, file_name) AS rn,
                 regexp_replace(file_name, '\\.(hwpx?|pdf)$', '') AS stem FROM f)
    SELECT 'RFP-' || CASE WHEN rn < 100 THEN lpad(rn::VARCHAR, 3, '0') ELSE rn::VARCHAR END AS notice_no,
           split_part(stem, '_', 2) AS project, split_part(stem, '_', 1) AS org FROM n""")


def index_stats(spark, sf):
    chunks = table(spark, sf, "documents").select(F.lit("").alias("org"), "source")
    return ops.index_stats(chunks)


INDEX_STATS_SQL = "SELECT count(DISTINCT source) AS orgs, count(*) AS chunks FROM documents"


def project_list(spark, sf):
    return ops.project_list(notices(spark, sf))


PROJECT_LIST_SQL = with_sql(["notices"], """
    SELECT org, 0 AS line_kind, '' AS notice_no, '**' || org || '** 진행 사업 — 총 ' || count(*)::VARCHAR || '개' AS line FROM notices GROUP BY org
    UNION ALL SELECT org, 1, notice_no, '- ' || project FROM notices""")


def notice_answers(spark, sf):
    rows = notices(spark, sf)
    vat = amounts.vat_note(F.lower(F.col("summary")))
    return ops.notice_answers(rows.withColumn("notice_no", F.col("row_num")), F.lit(""), vat)


_FMT_AMOUNT = "CASE WHEN try_cast(amount AS DOUBLE) IS NULL THEN amount ELSE format('{:,}', trunc(try_cast(amount AS DOUBLE))::BIGINT) || '원' END"
_VAT_SQL = """CASE WHEN regexp_matches(lower(summary), '(부가가치세|부가세|vat).{0,12}(포함)') OR regexp_matches(lower(summary), '(포함).{0,12}(부가가치세|부가세|vat)') THEN '부가가치세 포함'
              WHEN regexp_matches(lower(summary), '(부가가치세|부가세|vat).{0,12}(별도|제외|미포함)') THEN '부가가치세 별도'
              WHEN contains(summary, '면세') AND regexp_matches(lower(summary), '(부가가치세|부가세|vat)') THEN '부가가치세 면세' ELSE '' END"""
NOTICE_ANSWERS_SQL = with_sql(["notices"], f"""
    , a AS (SELECT row_num, project, org, bid_start, bid_end, {_FMT_AMOUNT} AS amt, {_VAT_SQL} AS vat FROM notices)
    SELECT row_num AS notice_no,
           '**' || project || '** (' || org || ')' || chr(10) || chr(10) || '사업 금액: **' || amt || '** (' || CASE WHEN vat = '' THEN 'VAT 미확인' ELSE vat END || ')' AS budget,
           '**' || project || '**' || chr(10) || chr(10) || '- 입찰 참여 시작일: **' || bid_start || '**' || chr(10) || '- 입찰 참여 마감일: **'
               || CASE WHEN bid_end = '' THEN '정보 없음' ELSE bid_end END || '**' AS schedule,
           '**' || project || '** (' || org || ')' || chr(10) || chr(10) || '- 사업 금액: **' || amt || '**' || chr(10) || '- 입찰 참여 시작일: ' || bid_start
               || CASE WHEN bid_end = '' THEN '' ELSE chr(10) || '- 입찰 참여 마감일: ' || bid_end END AS summary_answer
    FROM a""")


def evidence_rows(spark, sf):
    return ops.evidence_rows(ops.matching(notices(spark, sf), F.col("org"), F.col("project"), "재단", ""))


EVIDENCE_SQL = with_sql(["notices"], """
    SELECT file_name AS source, NULL::INTEGER AS page, project || ' | ' || org AS text FROM notices WHERE contains(org, '재단')
    ORDER BY row_num LIMIT 5""")


def notice_markdown(spark, sf):
    rows = notices(spark, sf)
    made = ops.notice_markdown(rows, amounts.vat_note(F.lower(nfkc(F.concat_ws(" ", "amount", "summary", "body")))))
    return made.select("row_num", "org_name", "markdown", F.col("metadata.vat_note").alias("vat_note"), F.col("metadata.vat_included").alias("vat_included"))


_JOSA = "CASE WHEN length(org) > 2 AND regexp_matches(org, '(의|은|는|이|가|께서|에서|에게)$') THEN left(org, length(org) - 1) ELSE org END"
_OPEN = """CASE row_num % 4 WHEN 3 THEN open_date ELSE replace(replace(substring(open_date, 1, 10), '.', '-'), '/', '-') END"""
NOTICE_MARKDOWN_SQL = with_sql(["notices"], f"""
    , a AS (SELECT *, {_JOSA} AS org_name, {_VAT_SQL} AS vat_note,
                   CASE WHEN try_cast(amount AS DOUBLE) IS NULL THEN amount
                        WHEN try_cast(amount AS DOUBLE) >= 100000000 THEN format('{{:,}}', trunc(try_cast(amount AS DOUBLE))::BIGINT) || '원 (' || format('{{:.2f}}', try_cast(amount AS DOUBLE) / 100000000) || '억원)'
                        ELSE format('{{:,}}', trunc(try_cast(amount AS DOUBLE))::BIGINT) || '원' END AS amt,
                   ltrim(replace(summary, '- ', chr(10) || '- '), chr(10)) AS s FROM notices)
    SELECT row_num, org_name, vat_note, contains(vat_note, '포함') AS vat_included,
           '# ' || org_name || ' ' || project || chr(10) || chr(10) || '## 기본 정보' || chr(10) || '- **공고 번호**: ' || CASE WHEN notice_no = '' THEN '정보 없음' ELSE notice_no END
           || chr(10) || '- **공고 차수**: ' || notice_round || chr(10) || '- **사업명**: ' || project || chr(10) || '- **발주 기관**: ' || org_name
           || chr(10) || '- **사업 금액**: ' || amt || chr(10) || '- **공개 일자**: ' || {_OPEN} || chr(10) || '- **입찰 시작일**: ' || bid_start
           || chr(10) || '- **입찰 마감일**: ' || CASE WHEN bid_end = '' THEN '정보 없음' ELSE bid_end END || chr(10) || chr(10) || '## 사업 요약' || chr(10) || s
           || chr(10) || chr(10) || '## 파일 정보' || chr(10) || '- **파일 형식**: ' || CASE WHEN file_format = '' THEN 'HWP' ELSE upper(file_format) END
           || chr(10) || '- **파일명**: ' || file_name || chr(10) || chr(10) || '## 원본 문서 내용' || chr(10) || chr(10) AS markdown
    FROM a""")


def markdown_sections(spark, sf):
    rows = notices(spark, sf)
    made = ops.notice_markdown(rows, F.lit(""))
    cut = ops.markdown_sections(made)
    return cut.groupBy("section_no").agg(F.count("*").alias("n"), F.sum(F.length("section")).alias("chars"))


def payload_pairs(spark, sf):
    rows = notices(spark, sf).select(
        "row_num",
        F.create_map(F.lit("공고번호"), "notice_no", F.lit("기관"), "org", F.lit("마감일"), "bid_end", F.lit("파일"), "file_format").alias("payload"),
    )
    return ops.payload_pairs(rows, "row_num", "payload")


PAYLOAD_SQL = with_sql(["notices"], """
    SELECT row_num, item, content FROM (
        SELECT row_num, '공고번호' AS item, notice_no AS content FROM notices UNION ALL SELECT row_num, '기관', org FROM notices
        UNION ALL SELECT row_num, '마감일', bid_end FROM notices UNION ALL SELECT row_num, '파일', file_format FROM notices)
    WHERE content <> ''""")


def saved_selection(spark, sf):
    rows = notices(spark, sf)
    selected = table(spark, sf, "labels").filter("quality = 1").select(F.concat(F.lit("2024"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("notice_no"))
    return ops.saved_selection(selected, rows.select("notice_no", "project", "org", "row_num"))


SAVED_SQL = with_sql(["notices"], """
    SELECT n.notice_no, n.project, n.org, n.row_num FROM labels l
    JOIN (SELECT notice_no, arg_min(project, row_num) AS project, arg_min(org, row_num) AS org, min(row_num) AS row_num FROM notices GROUP BY notice_no) n
      ON n.notice_no = '2024' || lpad(l.doc_id::VARCHAR, 8, '0') WHERE l.quality = 1""")


def cascade_delete(spark, sf):
    """Line items as saved items, orders as projects: cancelled projects take their items with them."""
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project_id"), "l_quantity")
    gone = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("project_id"))
    return store.cascade_delete(items, gone).groupBy("project_id").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


CASCADE_SQL = """SELECT l_orderkey AS project_id, count(*) AS n, sum(l_quantity) AS qty FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"""


def items_by_project(spark, sf):
    """Saved items with their project, joined so that a project with very many items is spread over tasks."""
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project_id"), "l_quantity")
    projects = table(spark, sf, "orders").select(F.col("o_orderkey").alias("project_id"), "o_orderpriority")
    joined = items.join(projects, ["project_id"], "inner")
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


ITEMS_SQL = """SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""


def alias_normalize(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.element_at(
        F.array(F.lit("서울시 "), F.lit("고려대 "), F.lit("서울시립대 "), F.lit("")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("head"), org_name(F.col("c_custkey")).alias("tail"))
    full = F.concat("head", "tail")
    return rows.select("c_custkey", names.standard_org(full).alias("org"))


ALIAS_SQL = f"""WITH t AS (SELECT c_custkey, ['서울시 ', '고려대 ', '서울시립대 ', ''][c_custkey % 4 + 1] || {sql_org_name('c_custkey')} AS n FROM customer)
    SELECT c_custkey, CASE WHEN contains(n, '서울시') THEN '서울특별시' WHEN contains(n, '고려대') THEN '고려대학교' WHEN contains(n, '서울시립대') THEN '서울시립대학교' ELSE n END AS org FROM t"""


QUERIES = {
    "top_budget": (top_budget, TOP_BUDGET_SQL),
    "top_budget_lines": (top_budget_lines, TOP_BUDGET_LINES_SQL),
    "nearest_deadline": (nearest_deadline, NEAREST_DEADLINE_SQL),
    "budget_range_unknown_pass": (budget_range_unknown_pass, BUDGET_RANGE_SQL),
    "urgent_only": (urgent_only, URGENT_SQL),
    "keyword_or": (keyword_or, KEYWORD_SQL),
    "institution_and_keyword": (institution_and_keyword, INSTITUTION_SQL),
    "relaxed_retry": (relaxed_retry, RELAXED_SQL),
    "sort_nulls_last": (sort_nulls_last, SORT_SQL),
    "sorted_by_budget": (sorted_by_budget, SORTED_BUDGET_SQL),
    "urgency_class": (urgency_class, URGENCY_SQL),
    "bid_metrics": (bid_metrics, BID_METRICS_SQL),
    "bid_table": (bid_table, BID_TABLE_SQL),
    "registry_bid_table": (registry_bid_table, REGISTRY_BIDS_SQL),
    "file_bid_table": (file_bid_table, FILE_BIDS_SQL),
    "org_registry_merge": (org_registry_merge, ORG_REGISTRY_SQL),
    "org_ranking_desc": (org_ranking_desc, _ranking_sql("DESC")),
    "org_ranking_asc": (org_ranking_asc, _ranking_sql("ASC")),
    "index_stats": (index_stats, INDEX_STATS_SQL),
    "project_list": (project_list, PROJECT_LIST_SQL),
    "notice_answers": (notice_answers, NOTICE_ANSWERS_SQL),
    "evidence_rows": (evidence_rows, EVIDENCE_SQL),
    "notice_markdown": (notice_markdown, NOTICE_MARKDOWN_SQL),
    "markdown_sections": (markdown_sections, None),
    "payload_pairs": (payload_pairs, PAYLOAD_SQL),
    "saved_selection": (saved_selection, SAVED_SQL),
    "cascade_delete": (cascade_delete, CASCADE_SQL),
    "items_by_project": (items_by_project, ITEMS_SQL),
    "alias_normalize": (alias_normalize, ALIAS_SQL),
}
