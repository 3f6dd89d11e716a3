"""Files in and out, model adapters, streams and plans."""

import json

import pytest
import pandas as pd
from pyspark.sql import functions as F

from tenderloom.operators.conversation import exchanges, with_follow_up, with_history, with_intent
from tenderloom.plans import answering, evaluating, ingest
from tenderloom.sources import files, models, notices_csv, stores
from tenderloom.sources.tables import table
from tenderloom.streaming.conversations import followed
from tenderloom.streaming.indexing import index_stream
from tests.conftest import FOLDER


def test_notice_csv(spark, tmp_path):
    path = tmp_path / "data_list.csv"
    path.write_text('﻿공고 번호,사업명,사업 금액,발주 기관,텍스트\n1,"가, 나",100,기관,"첫 줄\n둘째 ""줄"""\n2,다,,기관2,t\n', encoding="utf-8")
    rows = notices_csv.read_notices(spark, str(path)).orderBy("row_num").collect()
    assert [(r["row_num"], r["notice_no"], r["project"], r["amount"], r["body"]) for r in rows] == [
        (1, "1", "가, 나", "100", '첫 줄\n둘째 "줄"'), (2, "2", "다", "", "t")]
    assert rows[0]["bid_end"] == ""
    assert notices_csv.read_notices(spark, str(tmp_path / "none.csv")).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "기관_사업.pdf").write_text("첫 쪽\f둘째 쪽", encoding="utf-8")
    (tmp_path / "bad.pdf").write_bytes(b"\xff\xfe")
    (tmp_path / "other.hwp").write_bytes(b"x")
    assert sorted(r["file_name"] for r in files.list_files(spark, str(tmp_path)).collect()) == ["bad.pdf", "other.hwp", "기관_사업.pdf"]
    done = spark.createDataFrame([("bad.hwp",)], "file_name string")
    assert sorted(r["file_name"] for r in files.not_yet_done(files.list_files(spark, str(tmp_path)), done).collect()) == ["other.hwp", "기관_사업.pdf"]
    pages = files.parse_files(spark, str(tmp_path), files.plain_text_parser)
    rows = {(r["source"], r["page"]): (r["text"], r["error"]) for r in pages.collect()}
    assert rows[("기관_사업.pdf", 2)] == ("둘째 쪽", None) and "UnicodeDecodeError" in rows[("bad.pdf", None)][1]
    parsed = files.page_markdown(pages).first()
    assert parsed["text"].startswith("---\ndocument_title: 기관_사업\nsource_file: 기관_사업.pdf\ntotal_pages: 2\n---\n\n<<PAGE: 1>>\n\n첫 쪽\n")
    assert len(parsed["doc_id"]) == 16
    assert files.first_existing(spark, str(tmp_path / "*.md"), str(tmp_path / "*.pdf")) == str(tmp_path / "*.pdf")


def test_stores(spark, tmp_path):
    (tmp_path / "e.yaml").write_text("- id: eval_1\n  question: q\n  ground_truth: {sources: [a.pdf], chunk_orders: [3], chunk_uids: [h_3]}\n  query_type: single_doc\n", encoding="utf-8")
    item = stores.read_eval_set(spark, str(tmp_path / "e.yaml")).first()
    assert item["ground_truth"]["sources"] == ["a.pdf"] and item["memo"] is None
    (tmp_path / "bad.yaml").write_text("a: 1")
    with pytest.raises(ValueError):
        stores.read_eval_set(spark, str(tmp_path / "bad.yaml"))
    store = {"projects": [{"id": "p", "name": "n", "created_at": "t"}], "items": [{"id": "i", "project_id": "p", "title": "x", "payload": {"a": "1"}}]}
    (tmp_path / "w.json").write_text(json.dumps(store))
    projects, items = stores.read_workspace(spark, str(tmp_path / "w.json"))
    assert projects.first()["name"] == "n" and stores.of_project(items, "p").first()["payload"] == {"a": "1"}
    (tmp_path / "broken.json").write_text("{broken")
    assert stores.read_workspace(spark, str(tmp_path / "broken.json"))[0].count() == 0
    added = stores.with_new(projects, spark.createDataFrame([("m",)], "name string"), F.lit("now"), "created_at")
    assert added.count() == 2 and added.filter("id is null").count() == 0
    assert stores.checklist(spark).count() == 4
    runs = spark.createDataFrame([("f", "ok", 1.0, 2, 2, 2, 1, True, "")], ", ".join(f"{c} {t}" for c, t in zip(
        ["file", "status", "duration_sec", "chunk_count", "sparse_count", "dense_count", "hierarchy_count", "reindexed", "error"],
        ["string", "string", "double", "int", "int", "int", "int", "boolean", "string"])))
    stores.write_run_summary(runs, str(tmp_path / "runs"))
    assert spark.read.option("header", True).csv(str(tmp_path / "runs")).columns[0] == "file"


def test_index_table_is_updated_by_document(spark, tmp_path):
    folder = str(tmp_path / "index")
    rows = lambda values: spark.createDataFrame(values, "doc_id int, t string")
    stores.write_index(rows([(i, f"old{i}") for i in range(50)]), folder)
    ingest.update_index(spark.read.parquet(folder), rows([(3, "new"), (99, "added")]), folder)
    got = {r["doc_id"]: r["t"] for r in spark.read.parquet(folder).collect()}
    assert len(got) == 51 and got[3] == "new" and got[4] == "old4" and got[99] == "added"
    assert stores.written_rows_match(spark, folder, 51)
    few = str(tmp_path / "few")
    stores.write_index(rows([(i, "old") for i in range(50)]), few, buckets=3)
    ingest.update_index(spark.read.parquet(few), rows([(3, "new")]), few)
    assert stores.index_buckets(spark, spark.read.parquet(few)) == 3 and spark.read.parquet(few).where("bucket > 2").count() == 0


def test_models(spark):
    calls = []

    def factory():
        state = {"n": 0}

        def model(prompts):
            state["n"] += 1
            if state["n"] == 1:
                raise RuntimeError("first call fails")
            return [p.upper() for p in prompts]

        return model

    frame = spark.createDataFrame([(1, "a"), (2, "b")], "i int, p string").coalesce(1)
    assert [r["reply"] for r in models.with_replies(frame, F.col("p"), factory).orderBy("i").collect()] == ["A", "B"]
    failed = models.with_replies(frame, F.col("p"), factory, attempts=1)
    assert [r["reply"] for r in failed.collect()] == [None, None]
    asked = spark.createDataFrame([("질문", "문맥", None, "")], "query string, context string, draft string, history string")
    echo = lambda: lambda prompts: ["최종 답변: " + str(len(p)) for p in prompts]
    assert models.generated_answers(asked, echo).first()["answer"].isdigit()
    vectors = frame.select(models.hashed_vectors(16)(F.col("p")).alias("v")).collect()
    assert all(abs(sum(x * x for x in r["v"]) - 1) < 1e-5 for r in vectors) and not calls


def test_evaluation_plan(spark):
    items = spark.createDataFrame(
        [("e1", "q1", "x", {"sources": ["a.pdf"], "chunk_orders": [1], "chunk_uids": ["h_1"]}, "single_doc", None, ""),
         ("e2", "q2", "y", {"sources": ["data_list.csv"], "chunk_orders": None, "chunk_uids": None}, "csv_match", None, "")], stores.EVAL_SCHEMA)
    hits = spark.createDataFrame([("e1", 1, "b.pdf", "b_1", 1), ("e1", 2, "a.hwp", "h_1", 1)], "query_id string, rank int, source string, chunk_id string, chunk_index int")
    judge = lambda: lambda prompts: ['{"correctness": {"score": 4}, "faithfulness": {"score": 5}}' for _ in prompts]
    produced = spark.createDataFrame([("e1", "답", "문맥"), ("e2", "답", "")], "query_id string, answer string, context string")
    scores = evaluating.judged(items, produced, judge)
    runs = spark.createDataFrame([("e1", False, None), ("e2", True, None)], "query_id string, from_table boolean, error string")
    out = evaluating.results(items, hits, scores, runs, 5)
    rows = {r["query_id"]: r for r in out.collect()}
    assert (rows["e1"]["hit_position"], rows["e1"]["chunk_recall"], rows["e1"]["correctness"]) == (2, 1.0, 4)
    assert rows["e2"]["hit_position"] == 1 and rows["e2"]["chunk_recall"] is None
    total = evaluating.run_summary(out, 5).first()
    assert total["mrr_source"] == 0.75 and total["num_chunk_labeled_queries"] == 1


def test_answering_stages(spark):
    asked = answering.understood(spark.createDataFrame(
        [(1, " "), (2, "나공사 사업비는 얼마야?"), (3, "나공사 개요 설명"), (4, "알 수 없는 것"), (5, "가공사 사업비 얼마?")], "query_id int, question string"))
    notices = spark.createDataFrame([(1, "나공사", "포털", "1000", "2024-01-02 14:30")], "row_num int, org string, project string, amount string, bid_end string")
    hits = spark.createDataFrame([(5, 1, "내용 없음"), (5, 2, "총 사 업 비 : 2,500원")], "query_id int, rank int, text string")
    stages = [answering.blank_questions, answering.notice_answers(notices), answering.org_overviews(notices), answering.extracted_answers(hits), answering.not_found]
    found = answering.first_answers(asked, stages)
    got = {r["query_id"]: (r["answer"], r["source_type"]) for r in found.collect()}
    assert got[1] == ("질문을 입력해 주세요.", "none")
    assert got[2] == ("포털의 사업 금액은 1,000원입니다.", "csv")
    assert got[3][0].startswith("나공사은(는) 공고 1건")
    assert got[4] == ("관련 정보를 찾을 수 없습니다.", "none")
    assert got[5] == ("사업비는 2,500원입니다.", "vector")
    done = answering.finished(found, asked)
    assert done.filter("query_id = 2").first()["confidence"] > 0.5


def _counting(spark, monkeypatch, module):
    """Counts the rows whose normal form `module` asks for."""
    rows = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def same(values: pd.Series) -> pd.Series:
        rows.add(len(values))
        return values

    monkeypatch.setattr(module, "nfkc", lambda c: same(F.coalesce(c, F.lit(""))))
    return rows


def test_equal_questions_are_read_and_answered_once(spark, monkeypatch):
    texts = ["나공사 사업비는 얼마야?", "알 수 없는 것", None]
    asked = spark.createDataFrame([(i, texts[i % 3]) for i in range(60)], "query_id int, question string")
    rows = _counting(spark, monkeypatch, answering)
    known = answering.understood(asked).collect()
    assert rows.value == 3
    assert {(r["query_id"], r["question"]) for r in known} == {(i, texts[i % 3]) for i in range(60)} and len(known) == 60
    stored = spark.createDataFrame(known, answering.understood(asked).schema)
    found = stored.select("query_id", F.when(F.col("query_id") % 3 == 0, "1,000원입니다.").otherwise("없음").alias("answer"), F.lit("csv").alias("source_type"),
                          F.lit("extractive").alias("answer_mode")).localCheckpoint()
    before = rows.value
    done = answering.finished(found, stored).collect()
    assert rows.value - before == 3 and len(done) == 60
    assert {(r["query_id"] % 3, r["answer"]) for r in done} == {(0, "1,000원입니다."), (1, "없음"), (2, "없음")}


def test_questions_for_the_text_pass_over_short_answers(spark):
    asked = answering.understood(spark.createDataFrame([(1, "나공사 원문 근거 요약"), (2, "나공사 요약"), (3, "나공사 본문 설명")], "query_id int, question string"))
    everything = lambda a: a.select("query_id", F.lit("x").alias("answer"), F.lit("csv").alias("source_type"), F.lit("e").alias("answer_mode"))
    ids = lambda df: sorted(r["query_id"] for r in df.collect())
    assert ids(answering.unless_text_is_wanted(everything)(asked)) == [2]
    assert ids(answering.unless_text_is_wanted(everything, lambda a: a.filter("query_id = 3"))(asked)) == [2, 3]


def test_conversation_stream_equals_windows(spark, tmp_path):
    source = exchanges(table(spark, FOLDER, "conversations"))
    folder = str(tmp_path / "in")
    source.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(source.schema).parquet(folder)
    query = followed(stream).writeStream.format("memory").queryName("followed").outputMode("append").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    key = lambda r: (r["conv_id"], r["turn"])
    live = {key(r): (r["n_history"], r["summary"], r["is_follow_up"]) for r in spark.table("followed").collect()}
    batch = with_follow_up(with_intent(with_history(source)))
    assert live == {key(r): (len(r["history"]), r["summary"], r["is_follow_up"]) for r in batch.collect()}


def test_index_stream(spark, tmp_path):
    landing, folder = str(tmp_path / "landing"), str(tmp_path / "index")
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string").write.parquet(landing)
    stream = lambda: spark.readStream.schema("doc_id int, text string").parquet(landing)
    run = lambda: index_stream(stream(), lambda b: b, folder, str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(2, "c"), (3, "d")], "doc_id int, text string").write.mode("append").parquet(landing)
    run()
    assert sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(folder).collect()) == [(1, "a"), (2, "c"), (3, "d")]
