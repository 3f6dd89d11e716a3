"""Summary rows of a run, from files to counts."""

from pyspark.sql import functions as F

from tenderloom.plans.ingest import Index, build_index, run_rows
from tenderloom.sources import files


def test_counts_are_of_their_own_tables(spark):
    parsed = spark.createDataFrame([("d", "a/b", 1.5), ("e", "no chunk", 0.5)], "doc_id string, source string, duration_sec double")
    index = Index(
        chunks=spark.createDataFrame([("d", "u1", [1.0]), ("d", "u2", None), ("d", "u3", [2.0])], "doc_id string, uid string, vector array<double>"),
        hierarchy=spark.createDataFrame([("d",), ("d",), ("d",), ("d",)], "doc_id string"),
        sparse=spark.createDataFrame([("d/u1", "x"), ("d/u1", "y"), ("x/d/u3", "z")], "key string, term string"),
    )
    failures = spark.createDataFrame([("bad.pdf", "E: x", 0.1), ("fine.pdf", None, 0.1)], "source string, error string, seconds double")
    rows = {r["file"]: r for r in run_rows(parsed, index, failures).collect()}
    assert tuple(rows["a/b"])[1:] == ("ok", 1.5, 3, 1, 2, 4, True, None)
    assert tuple(rows["no chunk"])[1:] == ("failed", 0.5, 0, 0, 0, 0, False, "zero chunks produced")
    assert tuple(rows["bad.pdf"])[1:] == ("failed", 0.1, 0, 0, 0, 0, False, "E: x") and len(rows) == 3


def test_from_files_to_run_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("# 제1장 총칙\n본문 내용이 있는 쪽입니다.\f둘째 쪽의 본문입니다.", encoding="utf-8")
    (tmp_path / "bad.pdf").write_bytes(b"\xff\xfe")
    pages = files.parse_files(spark, str(tmp_path), files.plain_text_parser).persist()
    parsed = files.page_markdown(pages)
    index = build_index(parsed, F.col("source"), F.lit("2024-01-01T00:00:00"))
    rows = {r["file"]: r for r in run_rows(parsed, index, pages).collect()}
    good, bad = rows["a.pdf"], rows["bad.pdf"]
    assert good["status"] == "ok" and good["chunk_count"] == index.chunks.count() > 0 and 0 < good["sparse_count"] <= good["chunk_count"]
    assert good["dense_count"] == 0 and good["duration_sec"] > 0
    assert bad["status"] == "failed" and bad["duration_sec"] > 0 and "UnicodeDecodeError" in bad["error"]
