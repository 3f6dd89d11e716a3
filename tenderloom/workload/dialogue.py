"""Queries on conversations and answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions import answer_format, answers, questions
from tenderloom.functions.text import nfkc
from tenderloom.operators import conversation
from tenderloom.session import shared_folder
from tenderloom.sources.tables import table
from tenderloom.streaming.conversations import followed
from tenderloom.workload.derived import notices, questions as question_rows, with_sql


def _exchanges(spark: SparkSession, sf: str) -> DataFrame:
    return conversation.exchanges(table(spark, sf, "conversations"))


_EXCHANGES = """WITH x AS (SELECT a.conv_id, a.turn, a.text AS query, coalesce(b.text, '') AS answer FROM conversations a
    LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user')"""


def history_last5(spark, sf):
    rows = conversation.with_history(_exchanges(spark, sf))
    return rows.select(
        "conv_id", "turn", F.size("history").alias("n_history"), F.array_join(F.transform("history", lambda e: e["turn"].cast("string")), ",").alias("turns"),
        F.md5("summary").alias("summary_md5"),
    )


HISTORY_SQL = f"""{_EXCHANGES}, h AS (SELECT conv_id, turn,
        list(struct_pack(t := turn, q := query, a := answer)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM x),
    k AS (SELECT conv_id, turn, coalesce(h, []) AS h FROM h)
    SELECT conv_id, turn, len(h) AS n_history, array_to_string(list_transform(h, lambda e: e.t::VARCHAR), ',') AS turns,
           md5(array_to_string(list_transform(h[-3:], lambda e: 'Q: ' || e.q || chr(10) || 'A: ' || substring(e.a, 1, 100) || '...'), chr(10))) AS summary_md5 FROM k"""


def _asked(spark, sf):
    """Exchanges whose question is one of the derived questions, so that organisations and kinds vary."""
    x = _exchanges(spark, sf).select("conv_id", "turn", "answer", (F.col("conv_id") * 7 + F.col("turn")).alias("query_id"))
    q = question_rows(spark, sf).select("query_id", F.col("question").alias("query"))
    return conversation.with_intent(x.join(q, "query_id"))


_ORG_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(query, '([가-힣]+{e})', 1), '')" for e in fixed.ORG_NAME_ENDINGS) + ", '')"
_FOLLOWS = " OR ".join(f"contains(lower(query), '{w}')" for w in fixed.FOLLOW_UP_WORDS)


def follow_up(spark, sf):
    rows = conversation.resolved_org(conversation.with_follow_up(_asked(spark, sf)))
    return rows.select("conv_id", "turn", "org_name", "last_org", "has_previous", "is_follow_up", "target_org")


FOLLOW_UP_SQL = with_sql(["questions"], f"""
    , x AS (SELECT conv_id, turn, conv_id * 7 + turn AS query_id FROM conversations WHERE role = 'user'),
    q AS (SELECT x.conv_id, x.turn, question AS query FROM x JOIN questions USING (query_id)),
    o AS (SELECT *, {_ORG_SQL} AS org_name FROM q),
    w AS (SELECT *, lag(org_name) OVER (PARTITION BY conv_id ORDER BY turn) AS last_org FROM o),
    f AS (SELECT *, last_org IS NOT NULL AS has_previous, last_org IS NOT NULL AND ({_FOLLOWS}) AS is_follow_up FROM w)
    SELECT conv_id, turn, org_name, last_org, has_previous, is_follow_up,
           CASE WHEN org_name <> '' THEN org_name WHEN is_follow_up THEN last_org ELSE '' END AS target_org FROM f""")


def streamed_history(spark, sf):
    """All conversations as a stream through the state store: what was known before every exchange."""
    folder = f"{shared_folder(spark)}/tenderloom/{uuid.uuid4().hex}"
    source = _exchanges(spark, sf)
    source.write.parquet(f"{folder}/in")
    stream = followed(spark.readStream.schema(source.schema).parquet(f"{folder}/in"))
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("conv_id", "turn", "n_history", F.md5("summary").alias("summary_md5"), "has_previous", "is_follow_up")


STREAMED_SQL = f"""{_EXCHANGES}, h AS (SELECT conv_id, turn, query,
        list(struct_pack(q := query, a := answer)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM x),
    k AS (SELECT conv_id, turn, query, coalesce(h, []) AS h FROM h)
    SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, len(h)::INTEGER AS n_history,
           md5(array_to_string(list_transform(h[-3:], lambda e: 'Q: ' || e.q || chr(10) || 'A: ' || substring(e.a, 1, 100) || '...'), chr(10))) AS summary_md5,
           len(h) > 0 AS has_previous, len(h) > 0 AND ({_FOLLOWS}) AS is_follow_up FROM k"""


def distinct_questions(spark, sf):
    return conversation.distinct_questions(question_rows(spark, sf).withColumnRenamed("question", "query"))


DISTINCT_SQL = with_sql(["questions"], f"""
    , t AS (SELECT question AS query, regexp_extract_all(lower(question), '[0-9a-zA-Z가-힣]{{2,}}') AS ts FROM questions),
    k AS (SELECT query, list_filter(ts, lambda x: NOT list_contains([{', '.join(f"'{w}'" for w in fixed.SIGNATURE_STOPWORDS)}], x)) AS kept, ts FROM t)
    SELECT array_to_string(list_sort(list_distinct(CASE WHEN len(kept) > 0 THEN kept ELSE ts END))[1:12], '|') AS signature, count(*) AS n, min(query) AS query FROM k GROUP BY 1""")


# ---------------------------------------------------------------- answers
_ANSWERS = [
    "A 문서는 3개월, B 문서는 5개월로 차이가 있습니다.",
    "사업비는 {won}원이며 제안사가 부담합니다.",
    "문서에서 확인되지 않습니다.",
    "",
    "핵심 내용은 시스템 구축과 데이터 연계 그리고 보안 강화입니다.",
]


def _drafts(spark, sf):
    n = notices(spark, sf)
    q = question_rows(spark, sf)
    text = F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), (F.col("row_num") % len(_ANSWERS) + 1).cast("int"))
    rows = n.select(F.col("row_num").alias("query_id"), F.replace(text, F.lit("{won}"), F.format_number("won", 0)).alias("answer"), "project", "won")
    return rows.join(q, "query_id")


_SQL_DRAFTS = with_sql(["notices", "questions"], f"""
    , dr AS (SELECT query_id, question, project, won, replace([{', '.join(f"'{a}'" for a in _ANSWERS)}][row_num % {len(_ANSWERS)} + 1], '{{won}}', format('{{:,}}', won)) AS answer
             FROM notices JOIN questions ON query_id = row_num)""")


def slot_fill(spark, sf):
    d = _drafts(spark, sf)
    spans = (F.col("query_id") % 4).cast("int")
    mode = F.element_at(F.array(F.lit("extractive"), F.lit("hybrid"), F.lit("generative")), (F.col("query_id") % 3 + 1).cast("int"))
    rows = d.select("query_id", questions.plan(F.col("question"))["required_slots"].alias("slots"), nfkc(F.col("answer")).alias("answer"), spans.alias("spans"), mode.alias("mode"))
    rate = answers.slot_fill_rate(F.col("slots"), F.col("answer"), F.col("spans"))
    rows = rows.withColumn("rate", rate)
    return rows.select(
        "query_id", F.round("rate", 6).alias("rate"), answers.confidence(F.col("rate"), F.col("spans"), F.col("mode")).alias("confidence"),
        answers.uncertain(F.col("answer")).alias("uncertain"),
    )


def _has(words, c="answer"):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


SLOT_SQL = _SQL_DRAFTS + f""",
    pk AS (SELECT *, CASE WHEN contains(replace(lower(question), '비교과', ''), '비교') OR {_has(fixed.PLAN_COMPARE_WORDS, 'lower(question)')}
                OR (contains(question, '각각') AND {_has(fixed.PLAN_COMPARE_EACH_WORDS, 'lower(question)')}) THEN 'comparison'
            WHEN {_has(fixed.PLAN_OWNER_WORDS, 'question')} THEN 'owner' WHEN {_has(fixed.PLAN_DEADLINE_WORDS, 'question')} THEN 'deadline'
            WHEN {_has(fixed.PLAN_NUMERIC_WORDS, 'question')} THEN 'fact_numeric' ELSE 'points' END AS kind,
            regexp_matches(answer, '\\d')::INTEGER AS v, {_has(fixed.SLOT_UNITS)}::INTEGER AS u, {_has(fixed.SLOT_OWNER_WORDS)}::INTEGER AS o, {_has(fixed.SLOT_DOC_A_WORDS)}::INTEGER AS a,
            {_has(fixed.SLOT_DOC_B_WORDS)}::INTEGER AS b, {_has(fixed.SLOT_COMPARE_WORDS)}::INTEGER AS c, (query_id % 4 > 0)::INTEGER AS e, (length(trim(answer)) >= 24)::INTEGER AS k,
            query_id % 4 AS spans FROM dr),
    rt AS (SELECT *, CASE kind WHEN 'comparison' THEN (a + b + c) / 3 WHEN 'owner' THEN (o + e) / 2 WHEN 'points' THEN (k + e) / 2 ELSE (v + u + e) / 3 END AS rate FROM pk)
    SELECT query_id, round(rate, 6) AS rate, round_even(least(1.0, 0.35 + rate * 0.45 + least(0.2, spans * 0.06) + CASE query_id % 3 WHEN 0 THEN 0.05 WHEN 1 THEN 0.03 ELSE 0 END), 3) AS confidence,
           answer = '' OR {_has(fixed.UNCERTAIN_SIGNALS, 'lower(answer)')} AS uncertain FROM rt"""


def prefer_draft(spark, sf):
    """Generated summaries against extracted drafts of several lines."""
    d = _drafts(spark, sf)
    draft = F.concat(F.lit("- 사업명 "), "project", F.lit("\n- 사업비 "), F.format_number("won", 0), F.lit("원\n[근거]\n- 제안서 제출 서류 안내"))
    generated = F.when(F.col("query_id") % 2 == 0, F.concat(draft, F.lit("\n추가 설명"))).otherwise(F.col("answer"))
    summary = F.contains("question", F.lit("요약")) | (F.col("query_id") % 3 == 0)
    rows = d.select("query_id", summary.alias("s"), nfkc(generated).alias("g"), nfkc(draft).alias("d"))
    return rows.select(
        "query_id", answers.prefer_draft(F.col("s"), F.col("g"), F.col("d")).alias("use_draft"), F.size(answers.content_lines(F.col("g"))).alias("n_lines")
    )


PREFER_SQL = _SQL_DRAFTS + f""",
    g AS (SELECT query_id, contains(question, '요약') OR query_id % 3 = 0 AS s, query_id % 2 = 0 AS whole, answer FROM dr)
    SELECT query_id, CASE WHEN whole THEN false ELSE s END AS use_draft, CASE WHEN whole THEN 4 WHEN answer = '' THEN 0 ELSE 1 END AS n_lines FROM g"""


_RAW = (
    "[핵심 답변]\n결론: 문서 기준으로 {project} 사업의 예산은 {won}원 이며\n[근거 요약]\n- 경우에 따라 부가세를 협의함\n- 근거: 공고문\n- 제안사는 {won}원 한도에서 집행\n[출처]\n- 공고.pdf p. 3"
)


def _raw_answers(spark, sf):
    n = notices(spark, sf)
    text = F.replace(F.replace(F.lit(_RAW), F.lit("{project}"), F.col("project")), F.lit("{won}"), F.format_number("won", 0))
    plain = F.concat(F.col("project"), F.lit("\n\n"), F.lit("조정함\n- 제출 가능\n출처: a.pdf"))
    grid = F.concat(F.lit("요약: 표\n|항목|값|\n|---|---|\n|금액|"), F.col("won").cast("string"), F.lit("|"))
    key = F.col("row_num")
    return n.select(key.alias("query_id"), F.when(key % 3 == 0, text).when(key % 3 == 1, plain).otherwise(grid).alias("answer"), (key % 2 == 0).alias("guide"), "project", "won")


def readable_answers(spark, sf):
    rows = _raw_answers(spark, sf).withColumn("answer", nfkc(F.col("answer")))
    return rows.select("query_id", answer_format.readable(F.col("answer"), F.col("guide")).alias("text"))


READABLE_SQL = with_sql(["notices"], """
    , r AS (SELECT row_num AS query_id, row_num % 3 AS k, row_num % 2 = 0 AS guide, project, format('{:,}', won) AS w, won FROM notices)
    SELECT query_id, CASE
        WHEN k = 0 AND guide THEN project || ' 사업의 예산은 ' || w || '원 이며' || chr(10) || '- 경우에 따라 부가세를 협의함' || chr(10) || '- 제안사는 ' || w || '원 한도에서 집행'
        WHEN k = 0 THEN project || ' 사업의 예산은 ' || w || '원 이며' || chr(10) || '경우에 따라 부가세를 협의함'
        WHEN k = 1 AND guide THEN project || chr(10) || '- 조정함' || chr(10) || '- 제출 가능'
        WHEN k = 1 THEN project || chr(10) || '제출 가능'
        ELSE '표' || chr(10) || '|항목|값|' || chr(10) || '|---|---|' || chr(10) || '|금액|' || won::VARCHAR || '|' END AS text FROM r""")


def compact_answers(spark, sf):
    rows = _raw_answers(spark, sf).withColumn("answer", nfkc(F.col("answer")))
    return rows.select("query_id", answer_format.compacted(F.col("answer"), F.col("guide")).alias("text"))


COMPACT_SQL = READABLE_SQL.replace("ELSE '표' || chr(10) || '|항목|값|' || chr(10) || '|---|---|' || chr(10) || '|금액|' || won::VARCHAR || '|' END",
    "WHEN guide THEN '표' || chr(10) || '|항목|값|' || chr(10) || '|---|---|' || chr(10) || '|금액|' || won::VARCHAR || '|' ELSE '표' || chr(10) || '|항목|값|' END")


def polite_answers(spark, sf):
    rows = _raw_answers(spark, sf).select("query_id", nfkc(F.concat("project", F.lit("\n조정함\n- 제출 가능\n- 비용 부담\n확인된다\n- 완료됨!\n집행하며"))).alias("answer"))
    return rows.select("query_id", answer_format.polite(F.col("answer")).alias("text"))


POLITE_SQL = with_sql(["notices"], """SELECT row_num AS query_id, project || '.' || chr(10) || '조정합니다.' || chr(10) || '- 제출 가능합니다.' || chr(10) || '- 비용 부담입니다.' || chr(10)
    || '확인된입니다.' || chr(10) || '- 완료됨!' || chr(10) || '집행합니다.' AS text FROM notices""")


def untagged_answers(spark, sf):
    c = table(spark, sf, "conversations")
    tagged = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("생각\n## 최종 답변: "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("최종 답변:"), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.md5(answers.untagged(tagged)).alias("answer_md5"))


UNTAGGED_SQL = """SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 2 THEN text ELSE trim(text, ' ' || chr(10) || chr(9) || chr(13)) END) AS answer_md5 FROM conversations"""

QUERIES = {
    "history_last5": (history_last5, HISTORY_SQL),
    "follow_up": (follow_up, FOLLOW_UP_SQL),
    "streamed_history": (streamed_history, STREAMED_SQL),
    "distinct_questions": (distinct_questions, DISTINCT_SQL),
    "slot_fill": (slot_fill, SLOT_SQL),
    "prefer_draft": (prefer_draft, PREFER_SQL),
    "readable_answers": (readable_answers, READABLE_SQL),
    "compact_answers": (compact_answers, COMPACT_SQL),
    "polite_answers": (polite_answers, POLITE_SQL),
    "untagged_answers": (untagged_answers, UNTAGGED_SQL),
}
