"""Notices, questions, result lists and Markdown documents that Spark derives from the given tables.

Each frame has as many rows as the table behind it. `SQL` says the same for the oracle, as CTE bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.operators.ordered import row_numbers
from tenderloom.sources.tables import table

TODAY = "1998-06-15"
_DIGITS, _SYLLABLES = "0123456789", "가나다라마바사아자차"
_ORG_ENDINGS = ["공사", "대학교", "연구원", "재단", "진흥원", "센터"]


def _pick(number: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _sql_pick(number: str, values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{number} % {len(values)} + 1]"


def org_name(key: Column) -> Column:
    return F.concat(F.translate(key.cast("string"), _DIGITS, _SYLLABLES), _pick(key, _ORG_ENDINGS))


def sql_org_name(key: str) -> str:
    return f"translate({key}::VARCHAR, '{_DIGITS}', '{_SYLLABLES}') || {_sql_pick(key, _ORG_ENDINGS)}"


_VAT = ["부가가치세 포함", "부가세 별도", "VAT 면세", "", "세금 포함"]


def notices(spark: SparkSession, sf: str) -> DataFrame:
    """Notices with the text columns of the notice CSV: one per order, its institution from the customer."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    key = F.col("o_orderkey")
    won = F.round(F.col("o_totalprice") * 1000).cast("bigint")
    project = F.concat("c_mktsegment", F.lit(" 정보시스템 구축 "), "o_orderpriority")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        key.alias("row_num"),
        F.when(key % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("2024"), F.lpad(key.cast("string"), 8, "0"))).alias("notice_no"),
        (key % 3).cast("string").alias("notice_round"),
        project.alias("project"),
        won.alias("won"),
        F.when(key % 4 == 0, won.cast("string"))
        .when(key % 4 == 1, F.concat(won.cast("string"), F.lit(".0")))
        .when(key % 4 == 2, F.format_string("%d", (won / 1000).cast("bigint")))
        .otherwise(F.lit("약 3억 5천"))
        .alias("amount"),
        org_name(F.col("c_custkey")).alias("org"),
        F.when(key % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .when(key % 4 == 1, F.date_format("o_orderdate", "yyyy.MM.dd"))
        .when(key % 4 == 2, F.date_format("o_orderdate", "yyyy/MM/dd HH:mm"))
        .otherwise(F.date_format("o_orderdate", "yyyy년"))
        .alias("open_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("bid_start"),
        F.when(key % 7 == 0, F.lit("")).otherwise(
            F.concat(F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (key % 30 + 1).cast("int")), "yyyy-MM-dd"), F.lit(" 14:30"))
        ).alias("bid_end"),
        F.concat(F.lit("- 사업비: "), F.format_number(won, 0), F.lit("원 ("), _pick(key, _VAT), F.lit(") - "), project).alias("summary"),
        _pick(key, ["hwp", "pdf", ""]).alias("file_format"),
        F.concat(org_name(F.col("c_custkey")), F.lit("_"), "c_mktsegment", F.lit("."), _pick(key, ["hwp", "pdf", "hwpx"])).alias("file_name"),
        F.lit("").alias("body"),
        F.col("c_nationkey"),
        F.col("o_custkey"),
    )


def bids(spark: SparkSession, sf: str) -> DataFrame:
    """The typed bid table: number, project, institution, budget, deadline; some budgets are low or missing."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    key = F.col("o_orderkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("N"), F.lpad(key.cast("string"), 9, "0")).alias("notice_no"),
        F.concat("c_mktsegment", F.lit(" "), "o_orderpriority").alias("project"),
        F.col("c_name").alias("org"),
        F.when(key % 11 == 0, F.lit(None)).otherwise(F.round(F.col("o_totalprice") * 10).cast("bigint")).alias("budget"),
        F.when(key % 13 == 0, F.lit(None)).otherwise(F.col("o_orderdate").cast("date")).alias("deadline"),
    )


_QUESTIONS = [
    "{org} 사업비는 얼마야?",
    "사업비가 가장 많은 기관 3곳은?",
    "5억에서 10억 사이 사업 알려줘",
    "데이터 플랫폼 관련 사업 추천해줘",
    "마감일은 언제야?",
    "{org} 와 한국전력공사 의 요구사항을 비교해줘. 그리고 차이 및 영향을 각각 설명해줘",
    "저작권 책임은 누가 부담하나요?",
    "비교과시스템 용량은 몇 GB 인가요?",
    "{seg} 시스템 구축 요약 정리",
    "A 문서와 B 문서의 공통 조건은?",
    "예산은 3억 이상 이하 목록",
    "그것 말고 다른 {seg} 사업은?",
]


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per order, its organisation from the customer."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    text = _pick(F.col("o_orderkey"), _QUESTIONS)
    text = F.replace(text, F.lit("{org}"), org_name(F.col("c_custkey")))
    text = F.replace(text, F.lit("{seg}"), F.col("c_mktsegment"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("query_id"), text.alias("question"))


_EXTS = [".pdf", ".hwp", "", ".csv"]


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """A result list per order: its line items, whose supplier is the source."""
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"
    )
    ranked = row_numbers(items, ["query_id"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"], "rank")
    return ranked.select(
        "query_id",
        F.col("rank").cast("int").alias("rank"),
        F.concat(F.lit("Dir/Supplier "), (F.col("l_suppkey") % 40).cast("string"), _pick(F.col("l_suppkey"), _EXTS)).alias("source"),
        F.round(1 - F.col("l_discount"), 2).alias("score"),
        F.concat(F.lit("d"), (F.col("l_suppkey") % 40).cast("string"), F.lit("_"), (F.col("l_partkey") % 9).cast("string")).alias("chunk_id"),
        (F.col("l_partkey") % 9).alias("chunk_index"),
        (F.col("l_quantity").cast("int") % 5 + 1).alias("page"),
    )


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Ground truth per order: one source, or two for some, and chunk labels for some."""
    o = table(spark, sf, "orders")
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    first = F.concat(F.lit("supplier"), (other % 40).cast("string"), F.lit(".hwp"))
    second = F.concat(F.lit("Supplier_"), (key % 40).cast("string"))
    none = F.array().cast("array<string>")
    return o.select(
        key.alias("query_id"),
        F.when(key % 3 == 0, F.array(first, second)).when(key % 17 == 0, F.array(second, second)).otherwise(F.array(first)).alias("sources"),
        F.when(key % 4 == 0, F.array(F.concat(F.lit("D"), (other % 40).cast("string"), F.lit("_"), (key % 9).cast("string")))).otherwise(none).alias("uids"),
        F.when(key % 4 <= 1, F.array((key % 9).cast("string"), (other % 9).cast("string"))).otherwise(none).alias("orders"),
        (key % 5 + 1).cast("int").alias("page"),
    )


def markdown_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as parsed Markdown: page markers, numbered headings and a small table every few lines."""
    d = table(spark, sf, "documents")
    short = lambda x: F.substring(x, 1, 20)
    number = lambda i: (F.floor(i / 6) + 1).cast("string")

    def line(x: Column, i: Column) -> Column:
        return (
            F.when(i % 6 == 0, F.concat(F.lit("<<PAGE: "), number(i), F.lit(">>\n"), x))
            .when(i % 6 == 1, F.concat(F.lit("제"), number(i), F.lit("장 "), short(x)))
            .when(i % 6 == 2, F.concat(number(i), F.lit(".1 "), short(x)))
            .when(i % 6 == 4, F.concat(F.lit("|항목|내용|\n|---|---|\n|기간|"), F.length(x).cast("string"), F.lit("|\n")))
            .when(i % 6 == 5, F.concat(number(i), F.lit(".2 "), short(x)))
            .otherwise(x)
        )

    lines = F.transform(F.split("text", "\n", -1), line)
    return d.select("doc_id", F.array_join(lines, "\n").alias("text"), "source", "lang")


SQL = {
    "notices": f"""
        SELECT o_orderkey AS row_num,
               CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE '2024' || lpad(o_orderkey::VARCHAR, 8, '0') END AS notice_no,
               (o_orderkey % 3)::VARCHAR AS notice_round,
               c_mktsegment || ' 정보시스템 구축 ' || o_orderpriority AS project,
               round(o_totalprice * 1000)::BIGINT AS won,
               CASE o_orderkey % 4 WHEN 0 THEN (round(o_totalprice * 1000)::BIGINT)::VARCHAR
                    WHEN 1 THEN (round(o_totalprice * 1000)::BIGINT)::VARCHAR || '.0'
                    WHEN 2 THEN (trunc(round(o_totalprice * 1000) / 1000)::BIGINT)::VARCHAR
                    ELSE '약 3억 5천' END AS amount,
               {sql_org_name('c_custkey')} AS org,
               CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
                    WHEN 1 THEN strftime(o_orderdate, '%Y.%m.%d')
                    WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M')
                    ELSE strftime(o_orderdate, '%Y') || '년' END AS open_date,
               strftime(o_orderdate, '%Y-%m-%d') AS bid_start,
               CASE WHEN o_orderkey % 7 = 0 THEN ''
                    ELSE strftime(o_orderdate::DATE + (o_orderkey % 30 + 1)::INTEGER, '%Y-%m-%d') || ' 14:30' END AS bid_end,
               '- 사업비: ' || format('{{:,}}', round(o_totalprice * 1000)::BIGINT) || '원 (' || {_sql_pick('o_orderkey', _VAT)}
                   || ') - ' || c_mktsegment || ' 정보시스템 구축 ' || o_orderpriority AS summary,
               {_sql_pick('o_orderkey', ['hwp', 'pdf', ''])} AS file_format,
               {sql_org_name('c_custkey')} || '_' || c_mktsegment || '.' || {_sql_pick('o_orderkey', ['hwp', 'pdf', 'hwpx'])} AS file_name,
               c_nationkey, o_custkey
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "bids": """
        SELECT 'N' || lpad(o_orderkey::VARCHAR, 9, '0') AS notice_no, c_mktsegment || ' ' || o_orderpriority AS project,
               c_name AS org,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE round(o_totalprice * 10)::BIGINT END AS budget,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate::DATE END AS deadline
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "questions": f"""
        SELECT o_orderkey AS query_id,
               replace(replace({_sql_pick('o_orderkey', _QUESTIONS)}, '{{org}}', {sql_org_name('c_custkey')}), '{{seg}}', c_mktsegment) AS question
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "hits": f"""
        SELECT l_orderkey AS query_id,
               (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate))::INTEGER AS rank,
               'Dir/Supplier ' || (l_suppkey % 40)::VARCHAR || {_sql_pick('l_suppkey', _EXTS)} AS source,
               round(1 - l_discount, 2) AS score,
               'd' || (l_suppkey % 40)::VARCHAR || '_' || (l_partkey % 9)::VARCHAR AS chunk_id,
               l_partkey % 9 AS chunk_index, trunc(l_quantity)::INTEGER % 5 + 1 AS page
        FROM lineitem""",
    "truth": """
        SELECT o_orderkey AS query_id,
               CASE WHEN o_orderkey % 3 = 0 THEN ['supplier' || (o_custkey % 40)::VARCHAR || '.hwp', 'Supplier_' || (o_orderkey % 40)::VARCHAR]
                    WHEN o_orderkey % 17 = 0 THEN ['Supplier_' || (o_orderkey % 40)::VARCHAR, 'Supplier_' || (o_orderkey % 40)::VARCHAR]
                    ELSE ['supplier' || (o_custkey % 40)::VARCHAR || '.hwp'] END AS sources,
               CASE WHEN o_orderkey % 4 = 0 THEN ['D' || (o_custkey % 40)::VARCHAR || '_' || (o_orderkey % 9)::VARCHAR] ELSE []::VARCHAR[] END AS uids,
               CASE WHEN o_orderkey % 4 <= 1 THEN [(o_orderkey % 9)::VARCHAR, (o_custkey % 9)::VARCHAR] ELSE []::VARCHAR[] END AS orders,
               (o_orderkey % 5 + 1)::INTEGER AS page
        FROM orders""",
    "markdown": """
        SELECT doc_id, source, lang, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
               CASE (i - 1) % 6
                    WHEN 0 THEN '<<PAGE: ' || ((i - 1) // 6 + 1)::VARCHAR || '>>' || chr(10) || x
                    WHEN 1 THEN '제' || ((i - 1) // 6 + 1)::VARCHAR || '장 ' || substring(x, 1, 20)
                    WHEN 2 THEN ((i - 1) // 6 + 1)::VARCHAR || '.1 ' || substring(x, 1, 20)
                    WHEN 4 THEN '|항목|내용|' || chr(10) || '|---|---|' || chr(10) || '|기간|' || length(x)::VARCHAR || '|' || chr(10)
                    WHEN 5 THEN ((i - 1) // 6 + 1)::VARCHAR || '.2 ' || substring(x, 1, 20)
                    ELSE x END), chr(10)) AS text
        FROM documents""",
}


def with_sql(names: list[str], query: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + query
