"""Golden values of the column functions."""

from pyspark.sql import functions as F

from tenderloom.functions import amounts, answer_format, answers, dates, names, questions, summaries, text
from tenderloom.functions import markdown as md
from tenderloom.operators.labels import candidate_score, expected_phrases


def test_amounts(column_of):
    assert column_of(["1,234", "12.7", "약 3억 5천", "abc", ""], amounts.parse_amount) == [1234, 12, 35, 0, 0]
    assert column_of(["210000000", "50000", "9999"], lambda c: amounts.format_amount(c.cast("double"))) == [
        "약 2.1억 원 (210,000,000원)", "약 5만 원 (50,000원)", "9,999원"]
    found = column_of(["사업비: 금1,500원", "사 업 비 : 2.5억 원", "총액 없음", "금액: 30,000원"], lambda c: amounts.amount_in_text(c)["value"])
    assert found == [1500, 250_000_000, 0, 30000]
    assert column_of(["부가세 별도", "vat 포함", "면세 부가가치세", "없음"], amounts.vat_note) == [
        "부가가치세 별도", "부가가치세 포함", "부가가치세 면세", ""]


def test_dates(column_of):
    values = ["2024.10.16 00:00", "2024-10-14 10:00:00", "abc", "2024/1/6", "2024-13-40", "2024-10-14T09:05Z"]
    assert column_of(values, dates.notice_datetime) == ["2024-10-16", "2024-10-14 10:00", "abc", "2024-01-06", "2024-13-40", "2024-10-14 09:05"]
    assert column_of(["2024-10-16 14:30"], lambda c: dates.datetime_answer(c, F.lit("시간 알려줘"))) == ["2024-10-16 오후 2시 30분"]
    assert column_of(["2024-10-16 00:30"], lambda c: dates.datetime_answer(c, F.lit("시간"))) == ["2024-10-16 오전 12시 30분"]
    labels = column_of(["-1", "3", "7", "8", None], lambda c: dates.urgency(c.cast("int")))
    assert labels == ["⛔ 마감", "🔴 긴급", "🟡 임박", "🟢 여유", "⚪ 미확인"]


def test_names(column_of):
    assert column_of(["서울시에서", "가이"], names.remove_josa) == ["서울시에", "가이"]
    assert column_of(["서울시에서"], lambda c: names.remove_josa(c, whole=True)) == ["서울시"]
    assert column_of(["hash_12", "12", "x", "a_b"], names.trailing_index) == [12, 12, None, None]
    pairs = [("A_b.hwp", "a_b.pdf"), ("A b.pdf", "ab"), ("x.csv", "x.pdf"), ("", "a"), ("a.b x", "a.b x.pdf")]
    assert column_of(["|".join(p) for p in pairs], lambda c: names.same_source(F.split_part(c, F.lit("|"), F.lit(1)), F.split_part(c, F.lit("|"), F.lit(2)))) == [
        True, True, False, False, False]
    known = column_of(["a.b x|a.b x.pdf"], lambda c: names.same_source(F.split_part(c, F.lit("|"), F.lit(1)), F.split_part(c, F.lit("|"), F.lit(2)), True))
    assert known == [True]
    assert column_of(["abc"], names.content_id) == ["ba7816bf8f01cfea"]
    assert column_of(["기관_사업 명_a.hwp"], lambda c: F.concat_ws("|", names.org_and_project(c)["org"], names.org_and_project(c)["project"])) == ["기관|사업 명_a"]
    assert column_of(["- **공고 번호**: **123**\n- **x**: y"], lambda c: names.markdown_meta(c, "공고 번호")) == ["123"]


def test_text(column_of):
    assert column_of(["ＡＢＣ ①", "가나", None], text.nfkc) == ["ABC 1", "가나", ""]
    assert column_of(["가" * 10], lambda c: text.clip_at_sentence(c, 360)) == ["가" * 10]
    long = "가" * 300 + "다 " + "나" * 100
    assert column_of([long, "가" * 400, "가" * 250 + ". " + "나" * 200], text.clip_at_sentence) == ["가" * 300 + "다", "가" * 359 + "…", "가" * 250 + "."]
    assert column_of(["사업을 하는", "완료됨.", "첨부 파일", ""], text.looks_incomplete) == [True, False, True, False]
    assert column_of(["- * ## **제안** 제안 제안 제안 내용"], text.clean_line) == ["제안 내용"]
    noise = ["abc", "사업명: 포털 구축 사업", "| --- | --- |", "이 시스템은 데이터를 연계하여 처리한다", "source: somewhere"]
    assert column_of(noise, lambda c: text.is_noise(text.clean_line(c))) == [True, True, True, False, True]
    assert column_of(['x ```json\n{"a": 1}\n``` y', 'say {"b": {"c": 2}} ok', "none"], text.json_object) == ['{"a": 1}', '{"b": {"c": 2}}', None]


def test_summaries(column_of):
    sentence = "이 사업은 시스템 구축을 포함한다. " + "두 번째 문장은 별다른 내용이 없는 문장이다. " * 3 + "셋째 문장은 2024년 데이터 플랫폼 고도화 목표를 담는다."
    out = column_of([sentence], lambda c: summaries.within_limit(c, 80))[0]
    assert out.startswith("이 사업은 시스템 구축을 포함한다.") and "2024년" in out and len(out) <= 80
    assert column_of(["가나, 다라 그리고 마바사아자차카타파하가나다라마바사"], lambda c: summaries.within_limit(c, 20)) == ["가나 다라."]
    assert column_of(["가" * 50], lambda c: summaries.within_limit(c, 20)) == ["가" * 20 + "."]


def test_questions(column_of):
    assert column_of(["사업비는 얼마?", ""], questions.hardness) == [-2, 0]
    kinds = ["고려대 사업비", "사업비가 가장 많은 기관", "5억에서 10억", "3억 이상", "데이터 관련 사업 추천", "마감일은?", "안녕"]
    got = column_of(kinds, lambda c: questions.intent(c)["query_type"])
    assert got == ["org", "ranking", "filter", "filter", "category", "search", "search"]
    assert column_of(["고려대 사업비"], lambda c: questions.intent(c)["org_name"]) == ["고려대학교"]
    plans = ["두 기관을 비교", "비교과시스템", "누가 부담", "언제까지", "몇 개", "가나 및 다라", "개요"]
    assert column_of(plans, lambda c: questions.plan(c)["query_kind"]) == [
        "comparison", "single_doc", "owner", "deadline", "fact_numeric", "multi_doc", "single_doc"]
    reply = 'ok {"query_type": "ORG", "org_name": " x ", "confidence": "3"}'
    rule = questions.intent(F.lit("안녕"))
    assert column_of([reply, "no"], lambda c: questions.model_intent(c, c, rule)["query_type"]) == ["org", "search"]
    assert column_of([reply], lambda c: questions.settle_intent(rule, questions.model_intent(c, c, rule))["confidence"]) == [1.0]
    assert column_of(["비교 알려줘 알려줘 b a1"], questions.signature) == ["a1|비교"]


def test_answers(column_of):
    assert column_of(["A. B."], lambda c: answers.in_context_rate(c, F.lit("a only"))) == [0.5]
    assert column_of(["x"], lambda c: answers.confidence(F.lit(0.5), F.lit(1), F.lit("generative"))) == [0.635]
    assert column_of(["x"], lambda c: answers.confidence(F.lit(1.0), F.lit(3), F.lit("extractive"))) == [1.0]
    assert column_of(["생각 ## 최종 답변: 결과", "그대로"], answers.untagged) == ["결과", "그대로"]
    assert column_of(["- 내용\n[근거]\n출처:\n#1 a b.pdf\n둘째"], lambda c: F.array_join(answers.content_lines(c), "|")) == ["내용|둘째"]


def test_answer_format(column_of):
    answer = "결론: 예산은 5억원이다\n- 다만 부가세는 협의 가능\n출처: a.pdf"
    assert column_of([answer], lambda c: answer_format.readable(c, F.lit(False))) == ["예산은 5억원이다\n다만 부가세는 협의 가능"]
    assert column_of([answer], lambda c: answer_format.readable(c, F.lit(True))) == ["예산은 5억원이다\n- 다만 부가세는 협의 가능"]
    assert column_of(["", "요약:"], lambda c: answer_format.compacted(c, F.lit(False))) == ["", "요청하신 항목은 문서에서 확인되지 않습니다."]
    assert column_of(["할수 있음\n- 확인됨\n그렇다\nABC"], answer_format.polite) == ["할 수 있습니다.\n- 확인됩니다.\n그렇입니다.\nABC."]


def test_markdown_functions(column_of):
    assert column_of(["**제** **1** **장** **총칙**", "a **b** c"], md.join_bold) == ["**제 1 장 총칙**", "a **b** c"]
    assert column_of(["I 사업 개요", "Ⅳ 내용", "x"], md.roman_with_dot) == ["I. 사업 개요", "Ⅳ. 내용", "x"]
    assert column_of(["사 업 개 요 abcdefghijklmnopqrstuvwxyz", "가 나 다"], md.join_spaced_letters) == ["사업개요 abcdefghijklmnopqrstuvwxyz", "가 나 다"]
    kinds = ["제1장 총칙", "1.2.3 x y", "1.2 xy", "3. xy", "IV. xy", "가. xy", "[참고] x", "| a |", "plain"]
    assert column_of(kinds, md.line_heading_type) == ["제N장", "numbered_d3", "numbered_d2", "numbered_d1", "roman", "korean_letter", None, None, None]
    assert column_of(["총칙 ········ 12", "개요  2"], md.heading_title_key) == ["총칙", "개요"]
    assert column_of(["# a\n\n## b", "# a\ntext", " \n"], md.only_headings) == [True, False, False]


def test_label_score(column_of):
    one = lambda c: candidate_score(c, F.array(F.lit("a1"), F.lit("e1")), F.array(F.lit("12"), F.lit("34")), F.array(F.lit("a1"), F.lit("zz")),
                                    F.array(F.lit("e1")), F.array(F.lit("12"), F.lit("34")), F.array(F.lit("x"), F.lit("y"), F.lit("z")))["score"]
    assert [round(v, 6) for v in column_of(["x y z", ""], one)] == [10.1, 0.0]
    assert column_of(["짧음, 시스템 아님 내용 문장 둘; 시스템 아님 내용 문장 둘"], lambda c: F.size(expected_phrases(c))) == [1]
