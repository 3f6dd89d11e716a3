"""Queries for the column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions import amounts, dates, names, questions, summaries, text
from tenderloom.operators.lines import explode_lines
from tenderloom.sources.tables import table
from tenderloom.workload.derived import bids, hits, notices, questions as question_rows, with_sql
from tenderloom.workload.notices import _VAT_SQL


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "source")


def tokens_distinct(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", F.size(text.tokens(F.col("text"))).alias("n_distinct"), text.token_count(F.col("text")).alias("n_tokens")
    )


TOKENS_SQL = """SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[0-9a-z가-힣]{2,}'))) AS n_distinct,
    len(regexp_extract_all(text, '[0-9A-Za-z가-힣]+')) AS n_tokens FROM documents"""


def match_key(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(text.match_key(text.nfkc(F.col("text")))).alias("key_md5"))


MATCH_KEY_SQL = "SELECT doc_id, md5(regexp_replace(lower(text), '[^0-9A-Za-z가-힣]+', '', 'g')) AS key_md5 FROM documents"


def compare_form(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(text.compare_form(text.nfkc(F.col("text")))).alias("form_md5"))


COMPARE_SQL = r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS form_md5 FROM documents"


def parse_amount(spark, sf):
    rows = notices(spark, sf)
    messy = F.concat(F.lit("금 "), F.format_number("won", 0), F.lit("원정"))
    return rows.select(
        "row_num", amounts.parse_amount(F.col("amount")).alias("parsed"), amounts.parse_amount(messy).alias("parsed_text"),
        amounts.parse_budget_input(F.format_number("won", 0), 7).alias("input"),
        amounts.parse_budget_input(F.col("amount"), 7).alias("input_or_default"),
    )


PARSE_AMOUNT_SQL = with_sql(["notices"], r"""
    SELECT row_num, coalesce(trunc(try_cast(amount AS DOUBLE))::BIGINT, try_cast(regexp_replace(amount, '\D', '', 'g') AS BIGINT), 0) AS parsed,
           won AS parsed_text, won AS input, coalesce(trunc(try_cast(amount AS DOUBLE))::BIGINT, 7) AS input_or_default FROM notices""")


def format_amount(spark, sf):
    return bids(spark, sf).filter("budget is not null").select(
        "notice_no", amounts.format_amount(F.col("budget") * 100).alias("large"), amounts.format_amount(F.col("budget")).alias("middle"),
        amounts.won(F.col("budget")).alias("won"), amounts.budget_label(F.col("budget").cast("string")).alias("label"),
    )


FORMAT_AMOUNT_SQL = with_sql(["bids"], """
    SELECT notice_no,
           CASE WHEN budget * 100 >= 100000000 THEN '약 ' || format('{:.1f}', budget * 100 / 100000000.0::DOUBLE) || '억 원 (' || format('{:,}', budget * 100) || '원)'
                WHEN budget * 100 >= 10000 THEN '약 ' || format('{:,}', round_even(budget * 100 / 10000.0, 0)::BIGINT) || '만 원 (' || format('{:,}', budget * 100) || '원)'
                ELSE format('{:,}', budget * 100) || '원' END AS large,
           CASE WHEN budget >= 10000 THEN '약 ' || format('{:,}', round_even(budget / 10000.0, 0)::BIGINT) || '만 원 (' || format('{:,}', budget) || '원)'
                ELSE format('{:,}', budget) || '원' END AS middle,
           format('{:,}', budget) || '원' AS won, format('{:,}', budget) || '원' AS label
    FROM bids WHERE budget IS NOT NULL""")


def amount_in_text(spark, sf):
    found = amounts.amount_in_text(F.col("summary"))
    return notices(spark, sf).select("row_num", found.alias("a")).select("row_num", "a.label", "a.value")


AMOUNT_IN_TEXT_SQL = with_sql(["notices"], "SELECT row_num, format('{:,}', won) || '원' AS label, won AS value FROM notices")


def date_multi_format(spark, sf):
    return notices(spark, sf).select(
        "row_num", dates.notice_datetime(F.col("open_date")).alias("opened"), dates.notice_date_label(F.col("bid_end")).alias("ends"),
        dates.date_in_text(F.col("open_date")).cast("string").alias("open_day"),
    )


_OPENED = "CASE row_num % 4 WHEN 3 THEN open_date ELSE replace(replace(substring(open_date, 1, 10), '.', '-'), '/', '-') END"
DATE_SQL = with_sql(["notices"], f"""
    SELECT row_num, {_OPENED} AS opened, CASE WHEN bid_end = '' THEN '정보 없음' ELSE bid_end END AS ends,
           CASE row_num % 4 WHEN 3 THEN NULL ELSE {_OPENED} END AS open_day FROM notices""")


def datetime_answer(spark, sf):
    rows = notices(spark, sf)
    question = F.when(F.col("row_num") % 2 == 0, F.lit("마감 시간은 언제야?")).otherwise(F.lit("마감일은 언제야?"))
    return rows.select(
        "row_num", dates.datetime_answer(F.col("bid_end"), question).alias("answer"), dates.asks_for_vat(F.lower("summary")).alias("asks_vat")
    )


DATETIME_ANSWER_SQL = with_sql(["notices"], """
    SELECT row_num, CASE WHEN bid_end <> '' AND row_num % 2 = 0 THEN substring(bid_end, 1, 10) || ' 오후 2시 30분' ELSE bid_end END AS answer,
           regexp_matches(lower(summary), '부가가치세|부가세|vat|세금 포함|세 포함') AS asks_vat FROM notices""")


def vat_note(spark, sf):
    return notices(spark, sf).select("row_num", amounts.vat_note(F.lower(text.nfkc(F.col("summary")))).alias("vat"))


VAT_SQL = with_sql(["notices"], f"SELECT row_num, {_VAT_SQL} AS vat FROM notices")


def source_parts(spark, sf):
    s = F.col("source")
    rows = hits(spark, sf).groupBy("source").agg(F.count("*").alias("n"))
    return rows.select(
        "source", "n", names.source_stem(s).alias("stem"), names.source_extension(s).alias("ext"), names.eval_name(s).alias("name"),
        names.eval_stem_key(s).alias("stem_key"), names.source_key(s).alias("label_key"), names.hit_label(s).alias("hit_label"),
    )


SOURCE_PARTS_SQL = with_sql(["hits"], r"""
    , s AS (SELECT source, count(*) AS n, replace(source, 'Dir/', '') AS base FROM hits GROUP BY source)
    SELECT source, n, regexp_replace(base, '\.[a-z]+$', '') AS stem, regexp_extract(base, '\.([a-z]+)$', 1) AS ext, lower(base) AS name,
           replace(lower(regexp_replace(base, '\.[a-z]+$', '')), ' ', '') AS stem_key, replace(lower(regexp_replace(base, '\.[a-z]+$', '')), ' ', '') AS label_key,
           lower(regexp_replace(base, '\.[a-z]+$', '')) AS hit_label FROM s""")


def file_names(spark, sf):
    f = F.col("file_name")
    parts = names.org_and_project(f)
    return notices(spark, sf).select(
        "row_num", names.org_of_file(f).alias("org_of_file"), parts["org"].alias("org"), parts["project"].alias("project"),
        names.notice_number(F.concat(F.lit("제 "), "notice_no", F.lit("호"))).alias("number"),
        names.notice_number_in_question(F.concat(F.lit("공고 "), "notice_no", F.lit(" 알려줘"))).alias("number_asked"),
    )


FILE_NAMES_SQL = with_sql(["notices"], r"""
    , a AS (SELECT row_num, notice_no, split_part(file_name, '_', 1) AS org, regexp_replace(split_part(file_name, '_', 2), '\.[a-z]+$', '') AS project FROM notices)
    SELECT row_num, CASE WHEN length(org) > 2 AND regexp_matches(org, '(의|은|는|이|가|께서|에서|에게)$') THEN left(org, length(org) - 1) ELSE org END AS org_of_file,
           org, project, notice_no AS number, notice_no AS number_asked FROM a""")


def metadata_fields(spark, sf):
    """Keys of different shapes resolved to one source, page and chunk."""
    rows = hits(spark, sf)
    key = F.col("query_id") + F.col("rank")
    meta = F.when(key % 3 == 0, F.create_map(F.lit("source"), "source", F.lit("page"), F.col("page").cast("string"))).when(
        key % 3 == 1, F.create_map(F.lit("source_file"), "source", F.lit("page"), F.lit("0"), F.lit("page_no"), F.col("page").cast("string"))
    ).otherwise(F.create_map(F.lit("파일명"), F.concat(F.lit(" "), "source"), F.lit("page"), F.lit("x")))
    m = rows.select("query_id", "rank", "chunk_id", meta.alias("m"), F.array(F.lit("0"), F.col("page").cast("string")).alias("refs"))
    cid = names.chunk_id(F.lit(None).cast("string"), F.col("chunk_id"), F.lit("row_1"))
    return m.select(
        "query_id", "rank", names.from_metadata(F.col("m"), fixed.SOURCE_KEYS).alias("source"),
        names.first_page(*[F.col("m")[k] for k in fixed.PAGE_KEYS], refs=F.col("refs")).alias("page"),
        cid.alias("chunk_id"), names.chunk_index(F.lit(None), F.lit(None), cid, F.lit("row_1")).alias("chunk_index"),
    )


METADATA_SQL = with_sql(["hits"], "SELECT query_id, rank, source, page, chunk_id, chunk_index FROM hits")


def json_props(spark, sf):
    """Model-like replies around the JSON of an event: bare, fenced or with talk around it."""
    e = table(spark, sf, "events")
    reply = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    ).otherwise(F.concat(F.lit("결과: "), "props", F.lit(" 입니다")))
    parsed = F.from_json(text.json_object(reply), "k bigint")
    score = F.least(F.greatest(parsed["k"] - 40, F.lit(0)), F.lit(5))
    return e.select("event_id", parsed["k"].alias("k"), score.alias("score"), F.to_json(F.struct("event_type")).alias("encoded"))


JSON_SQL = """SELECT event_id, (props->>'$.k')::BIGINT AS k, least(greatest((props->>'$.k')::BIGINT - 40, 0), 5) AS score,
    '{"event_type":"' || event_type || '"}' AS encoded FROM events"""


def sentence_split(spark, sf):
    s = text.sentences(F.col("text"))
    rows = _docs(spark, sf).select("doc_id", s.alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join(F.slice("s", 1, 2), " ")).alias("first_md5"))


SENTENCE_SQL = r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    s AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda x: x <> '') AS s FROM f)
    SELECT doc_id, len(s) AS n, md5(array_to_string(s[1:2], ' ')) AS first_md5 FROM s"""


def clipped_text(spark, sf):
    rows = _docs(spark, sf).select("doc_id", text.nfkc(F.col("text")).alias("t"))
    return rows.select("doc_id", text.clip_at_sentence(F.col("t")).alias("clipped"))


CLIP_SQL = r"""WITH t AS (SELECT doc_id, trim(text, ' ' || chr(10) || chr(9)) AS t FROM documents),
    c AS (SELECT doc_id, t, regexp_extract(substring(t, 1, 361), '(?s)^(.{216,359}[.!?;:)\]}"''”’])', 1) AS m FROM t)
    SELECT doc_id, CASE WHEN length(t) <= 360 THEN t WHEN m <> '' THEN m ELSE rtrim(substring(t, 1, 359), ' ' || chr(10)) || '…' END AS clipped FROM c"""


def short_summary(spark, sf):
    return _docs(spark, sf).select("doc_id", summaries.within_limit(F.col("text"), 400).alias("short"))


def headline_and_points(spark, sf):
    rows = _docs(spark, sf).select("doc_id", summaries.headline_and_points(F.col("text")).alias("h"))
    return rows.select("doc_id", F.md5("h.summary").alias("summary_md5"), F.size("h.points").alias("n_points"))


HEADLINE_SQL = r"""WITH f AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    s AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda x: x <> '') AS s FROM f)
    SELECT doc_id, md5(array_to_string(s[1:2], ' ')) AS summary_md5,
           least(5, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
                lambda x: regexp_matches(x, '^[-*]') OR (length(x) > 8 AND NOT regexp_matches(x, '^[|#]')) OR (regexp_matches(x, '^#') AND length(regexp_replace(x, '^#+ +', '')) > 2)))) AS n_points
    FROM s"""


def noise_lines(spark, sf):
    """Per document its lines of content and the noise among them."""
    lines = explode_lines(_docs(spark, sf)).withColumn("clean", text.clean_line(text.nfkc(F.col("line"))))
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(text.is_noise(F.col("clean"))).alias("n_noise"),
        F.sum(F.length("clean")).alias("clean_chars"),
        F.count_if(text.looks_incomplete(F.col("clean"))).alias("n_incomplete"),
    )


def signature_key(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", questions.signature(F.lower(text.nfkc(F.col("text")))).alias("signature"))


SIGNATURE_SQL = """SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[0-9a-zA-Z가-힣]{2,}')))[1:12], '|') AS signature
    FROM conversations"""


def content_ids(spark, sf):
    return _docs(spark, sf).select("doc_id", names.content_id(F.col("text")).alias("content_id"))


CONTENT_ID_SQL = "SELECT doc_id, substring(sha256(text), 1, 16) AS content_id FROM documents"


def question_heuristics(spark, sf):
    """All single-question rules over the question table, counted per rule."""
    q = F.lower(text.nfkc(F.col("question")))
    rows = question_rows(spark, sf).select("query_id", q.alias("q"), "question")
    q = F.col("q")
    rules = {
        "needs_original": questions.needs_original(q), "about_budget": questions.about_budget(q), "precise_fact": questions.precise_fact(q),
        "compares": questions.compares(q), "single_document": questions.single_document(q), "implicit_follow_up": questions.implicit_follow_up(q),
        "project_phrase": questions.project_phrase(q), "asks_for_time": dates.asks_for_time(q), "conflict": questions.intents_conflict(q),
    }
    return rows.select("query_id", *[r.cast("int").alias(n) for n, r in rules.items()])


def _any(words, column="q"):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_NO_CURRICULUM = "replace(q, '비교과', '')"
_COMPARES = f"""(contains({_NO_CURRICULUM}, '비교') OR {_any(fixed.COMPARE_STRONG_WORDS)}
    OR (regexp_matches(q, '(^|[^a-z0-9])a\\s*문서') AND regexp_matches(q, '(^|[^a-z0-9])b\\s*문서'))
    OR (contains(q, '각각') AND ({_any(fixed.COMPARE_EACH_WORDS)} OR regexp_matches(q, '(^|[^a-z0-9])[ab]\\s*문서'))))"""
_BUDGET = f"""({_any(fixed.BUDGET_HARD_WORDS)} OR (contains(q, '금액') AND {_any(fixed.BUDGET_AMOUNT_WORDS)})
    OR (contains(q, '예산') AND (regexp_matches(q, '예산\\s*(은|는|이|가|규모|금액|얼마)') OR (contains(q, '얼마') AND NOT contains(q, '예산회계')))))"""
_MARKS = {
    "m1": f"regexp_matches(q, '{fixed.CONFLICT_RANK_PATTERN}')",
    "m2": f"regexp_matches(q, '{fixed.CONFLICT_RANGE_PATTERN}')",
    "m3": _any(fixed.CONFLICT_CATEGORY_WORDS),
    "m4": f"regexp_matches(q, '{fixed.CONFLICT_ORG_PATTERN}')",
    "m5": _any(fixed.CONFLICT_FACT_WORDS),
}
HEURISTICS_SQL = with_sql(["questions"], f"""
    , t AS (SELECT query_id, lower(question) AS q FROM questions),
    m AS (SELECT *, {', '.join(f'({v})::INTEGER AS {k}' for k, v in _MARKS.items())} FROM t)
    SELECT query_id, {_any(fixed.ORIGINAL_PRIORITY_WORDS)}::INTEGER AS needs_original, {_BUDGET}::INTEGER AS about_budget,
           (regexp_matches(q, '[a-z]{{2,5}}\\s*[-_ ]?\\s*\\d{{2,3}}') OR {_any(fixed.PRECISION_WORDS)})::INTEGER AS precise_fact,
           {_COMPARES}::INTEGER AS compares, (q <> '' AND NOT {_COMPARES} AND NOT {_any(fixed.MULTI_DOC_WORDS)})::INTEGER AS single_document,
           (NOT {_any(fixed.FRESH_QUERY_WORDS)} AND ({_any(fixed.FOLLOW_UP_SLOTS)} OR (length(q) <= 12 AND regexp_matches(q, '(\\?|요|줘|봐|가요|인가요)$'))))::INTEGER AS implicit_follow_up,
           {_any(fixed.PROJECT_WORDS)}::INTEGER AS project_phrase, {_any(fixed.TIME_QUERY_WORDS)}::INTEGER AS asks_for_time,
           (m1 + m2 + m3 + m4 + m5 > 1 AND NOT (m4 = 1 AND m5 = 1 AND m1 + m2 + m3 + m4 + m5 = 2))::INTEGER AS conflict
    FROM m""")


def intent_cascade(spark, sf):
    rows = question_rows(spark, sf)
    rows = rows.withColumn("i", questions.intent(F.col("question")))
    return rows.select(
        "query_id", "i.query_type", "i.org_name", "i.rank_order", F.array_join("i.categories", ",").alias("categories"), "i.confidence"
    )


_ORG_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(question, '([가-힣]+{e})', 1), '')" for e in fixed.ORG_NAME_ENDINGS) + ")"
_RANKING = f"""(regexp_matches(q, '{fixed.RANK_NUMBER_PATTERN}') OR {_any(fixed.RANK_STRONG_WORDS)}
    OR ({_any(fixed.RANK_EXTREME_WORDS)} AND {_any(fixed.RANK_CONTEXT_WORDS)}) OR {_any(fixed.RANK_WORDS)}) AND NOT {_any(fixed.RANK_BLOCKERS)}"""
_CATEGORY = f"""CASE WHEN {_any(fixed.DISCOVERY_WORDS)} THEN CASE WHEN {_any(fixed.CATEGORY_WORDS['IT'])} THEN 'IT' WHEN {_any(fixed.CATEGORY_WORDS['교육'])} THEN '교육' END END"""
INTENT_SQL = with_sql(["questions"], f"""
    , t AS (SELECT query_id, question, trim(lower(question)) AS q,
                   CASE WHEN contains(question, '서울시') THEN '서울특별시' WHEN contains(question, '고려대') THEN '고려대학교'
                        WHEN contains(question, '서울시립대') THEN '서울시립대학교' ELSE {_ORG_SQL} END AS org FROM questions),
    k AS (SELECT *, {_RANKING} AS ranking, {_CATEGORY} AS category,
                 regexp_matches(question, '{fixed.RANGE_PATTERNS[0]}') OR regexp_matches(question, '{fixed.RANGE_PATTERNS[1]}') AS in_range,
                 {_any(fixed.RANGE_WORDS, 'question')} AS bounded, {_any(fixed.SEARCH_SLOT_WORDS)} AS slot FROM t)
    SELECT query_id,
           CASE WHEN org IS NOT NULL THEN 'org' WHEN ranking THEN 'ranking' WHEN in_range OR bounded THEN 'filter' WHEN category IS NOT NULL THEN 'category' ELSE 'search' END AS query_type,
           coalesce(org, '') AS org_name,
           CASE WHEN org IS NULL AND ranking THEN CASE WHEN {_any(fixed.RANK_DESC_WORDS)} THEN 'desc' WHEN {_any(fixed.RANK_ASC_WORDS)} THEN 'asc' ELSE '' END ELSE '' END AS rank_order,
           CASE WHEN org IS NULL AND NOT ranking AND NOT in_range AND NOT bounded THEN coalesce(category, '') ELSE '' END AS categories,
           CASE WHEN org IS NOT NULL THEN 0.82::DOUBLE WHEN ranking THEN 0.95 WHEN in_range THEN 0.8 WHEN bounded THEN 0.7 WHEN category IS NOT NULL THEN 0.82
                WHEN slot THEN 0.82 ELSE 0.6 END AS confidence
    FROM k""")


def question_plan(spark, sf):
    rows = question_rows(spark, sf).withColumn("p", questions.plan(F.col("question")))
    return rows.select(
        "query_id", "p.query_kind", F.array_join("p.required_slots", ",").alias("slots"), "p.is_comparison",
        questions.answer_style(F.col("question")).alias("style"),
    )


PLAN_SQL = with_sql(["questions"], f"""
    , t AS (SELECT query_id, lower(question) AS q FROM questions),
    k AS (SELECT query_id, q, CASE
            WHEN contains({_NO_CURRICULUM}, '비교') OR {_any(fixed.PLAN_COMPARE_WORDS)} OR (contains(q, '각각') AND {_any(fixed.PLAN_COMPARE_EACH_WORDS)}) THEN 'comparison'
            WHEN {_any(fixed.PLAN_OWNER_WORDS)} THEN 'owner' WHEN {_any(fixed.PLAN_DEADLINE_WORDS)} THEN 'deadline'
            WHEN {_any(fixed.PLAN_NUMERIC_WORDS)} THEN 'fact_numeric'
            WHEN {_any(fixed.PLAN_MULTI_WORDS)} OR regexp_matches(q, '{fixed.PLAN_MULTI_PATTERNS[0]}') OR regexp_matches(q, '{fixed.PLAN_MULTI_PATTERNS[1]}') THEN 'multi_doc'
            ELSE 'single_doc' END AS kind FROM t)
    SELECT query_id, kind AS query_kind, CASE kind {' '.join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in fixed.PLAN_SLOTS.items())} END AS slots,
           kind = 'comparison' AS is_comparison, CASE WHEN {_any(fixed.DESCRIPTIVE_WORDS)} THEN 'guide' ELSE 'concise' END AS style FROM k""")


def dynamic_route(spark, sf):
    q = F.col("question")
    return question_rows(spark, sf).select(
        "query_id", questions.hardness(q).alias("hardness"), questions.search_mode(q).alias("mode"), questions.org_like_count(q).alias("orgs")
    )


_ORGS = f"""len(list_filter(list_transform(regexp_split_to_array(split_part(question, '에서', 1), '\\s+(과|와|및)\\s+'),
    lambda p: trim(regexp_replace(p, '["''“”‘’\\[\\]{{}}()]', '', 'g'))),
    lambda p: length(p) >= 3 AND (regexp_matches(p, '{fixed.ORG_SUFFIX_PATTERN}') OR regexp_matches(p, '^(한국|국립|국가|재단법인|사단법인|\\(재\\)|\\(사\\))'))))"""
ROUTE_SQL = with_sql(["questions"], f"""
    , t AS (SELECT query_id, question, length(question) AS n, len(regexp_extract_all(question, '[0-9A-Za-z가-힣]+')) AS tk,
                   regexp_matches(question, '{fixed.COMPLEX_QUERY_PATTERN}') AS cx, regexp_matches(question, '{fixed.FACTOID_QUERY_PATTERN}') AS fa,
                   len(regexp_extract_all(question, '{fixed.CONNECTOR_PATTERN}')) AS cn, {_ORGS} AS orgs FROM questions),
    h AS (SELECT query_id, orgs, CASE WHEN n >= 80 THEN 2 WHEN n >= 45 THEN 1 ELSE 0 END + CASE WHEN tk >= 16 THEN 2 WHEN tk >= 10 THEN 1 ELSE 0 END
                 + CASE WHEN cx THEN 2 ELSE 0 END + CASE WHEN cn >= 2 THEN 1 ELSE 0 END + CASE WHEN orgs >= 2 THEN 2 ELSE 0 END
                 - CASE WHEN fa AND tk <= 12 AND NOT cx THEN 2 ELSE 0 END AS hardness FROM t)
    SELECT query_id, hardness, CASE WHEN hardness >= 2 THEN 'chroma' ELSE 'hybrid' END AS mode, orgs FROM h""")


QUERIES = {
    "tokens_distinct": (tokens_distinct, TOKENS_SQL),
    "match_key": (match_key, MATCH_KEY_SQL),
    "compare_form": (compare_form, COMPARE_SQL),
    "parse_amount": (parse_amount, PARSE_AMOUNT_SQL),
    "format_amount": (format_amount, FORMAT_AMOUNT_SQL),
    "amount_in_text": (amount_in_text, AMOUNT_IN_TEXT_SQL),
    "date_multi_format": (date_multi_format, DATE_SQL),
    "datetime_answer": (datetime_answer, DATETIME_ANSWER_SQL),
    "vat_note": (vat_note, VAT_SQL),
    "source_parts": (source_parts, SOURCE_PARTS_SQL),
    "file_names": (file_names, FILE_NAMES_SQL),
    "metadata_fields": (metadata_fields, METADATA_SQL),
    "json_props": (json_props, JSON_SQL),
    "sentence_split": (sentence_split, SENTENCE_SQL),
    "clipped_text": (clipped_text, CLIP_SQL),
    "short_summary": (short_summary, None),
    "headline_and_points": (headline_and_points, HEADLINE_SQL),
    "noise_lines": (noise_lines, None),
    "signature_key": (signature_key, SIGNATURE_SQL),
    "content_ids": (content_ids, CONTENT_ID_SQL),
    "question_heuristics": (question_heuristics, HEURISTICS_SQL),
    "intent_cascade": (intent_cascade, INTENT_SQL),
    "question_plan": (question_plan, PLAN_SQL),
    "dynamic_route": (dynamic_route, ROUTE_SQL),
}
