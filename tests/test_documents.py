"""Documents to chunks, against plain Python on small texts."""

import random
import re

from pyspark.sql import functions as F

from tenderloom.operators import audit, chunking, hierarchy, pdf_text, tables
from tenderloom.operators.chunking import split_by_size


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def by_doc(frame, column="text"):
    return {r["doc_id"]: r[column] for r in frame.collect()}


def test_split_by_size():
    rng = random.Random(5)
    for _ in range(30):
        text = "".join(rng.choice(["\n\n", "\n", " ", f"가{i}", f"w{i}", f"{i}x" * 9]) for i in range(1500)).strip()
        pieces = split_by_size(text, 300, 60)
        assert all(0 < len(p) <= 300 for p in pieces)
        at = 0
        for piece in pieces:
            found = text.find(piece, max(0, at - 70))
            assert found >= 0 and not text[at:found].strip()
            at = max(at, found + len(piece))
        assert not text[at:].strip()
    assert split_by_size("a" * 25, 10, 3) == ["a" * 10, "a" * 10, "a" * 10, "aaaa"]


def test_table_goldens(spark):
    cases = {
        "|사업명|차세대 포털|\n|---|---|\n|사업기간|24개월|": "사업명: 차세대 포털\n사업기간: 24개월",
        "|항목|내용|\n|---|---|\n|기간|3개월|": "기간: 3개월",
        "|Col1|Col2|Col3|\n|---|---|---|\n|a|b||": "a, b",
        "|품목|수량|": "|품목|수량|",
        "  제목\n|품목|수량|가격|\n|---|---|---|\n|a||c|\nend": "제목\n품목: a, 가격: c\nend",
        "t1\n|a|b|c|\n|1|2|3|\nplain\n  next \n|x|y|z|\n|4|5|6|": "t1\na: 1, b: 2, c: 3\nplain\nnext\nx: 4, y: 5, z: 6",
        "no table": "no table",
        "x" * 90 + " \n|a|b|c|\n|1<br>2|| |": "x" * 90 + " \na: 1 2",
        "|a|b|c|\n|<br>|<br>|<br>|\ntail": "\ntail",
        "|a|b|c|\n| | | |\ntail": "|a|b|c|\n| | | |\ntail",
    }
    assert by_doc(tables.flatten_tables(docs(spark, list(cases)))) == dict(enumerate(cases.values()))


def test_cell_lines(spark):
    text = "| a | b |\n이어짐 |\n더 |\n| c |\n\nplain\n끝 |\n더"
    lines = docs(spark, [text]).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    out = tables.join_cell_lines(lines, F.lit(False)).orderBy("line_no")
    assert [r["line"] for r in out.collect()] == ["| a | b | 이어짐 | 더 |", "| c |", "", "plain", "끝 |", "더"]


def test_headings(spark):
    texts = [
        "<<PAGE: 1>>\n제1장 표지 제목\n<<PAGE: 2>>\n제1장 총칙 하나\n1.1 목적 하나\n[참고] 앞\n제2장 운영 둘\n[붙임] 뒤\n1.1 범위 둘",
        "1. 개요 하나\n가. 목적 둘\n2. 배경 셋",
        "# 이미\n제1장 총칙 하나\n1. 개요 하나",
        "plain",
    ]
    out = by_doc(chunking.insert_headings(docs(spark, texts)))
    assert out[0] == ("<<PAGE: 1>>\n제1장 표지 제목\n<<PAGE: 2>>\n# 제1장 총칙 하나\n## 1.1 목적 하나\n[참고] 앞\n# 제2장 운영 둘\n# [붙임] 뒤\n## 1.1 범위 둘")
    assert out[1] == "# 1. 개요 하나\n## 가. 목적 둘\n# 2. 배경 셋"
    assert out[2] == "# 이미\n# 제1장 총칙 하나\n## 1. 개요 하나"
    assert out[3] == "plain"


def test_sections(spark):
    text = "머리\n# 가\na\n## 나\nb\n## 다\nc\n# 라\n## 마\nd"
    rows = chunking.sections(docs(spark, [text])).orderBy("section_no", "part_no").collect()
    assert [(r["section_level1"], r["section_level2"], r["text"]) for r in rows] == [
        ("N/A", "N/A", "머리"), ("가", "N/A", "# 가\na\n## 나\nb"), ("가", "다", "## 다\nc"), ("라", "N/A", "# 라\n## 마\nd")]


def test_chunks(spark):
    long = " ".join(f"단어{i}" for i in range(600))
    text = f"<<PAGE: 1>>\n표지 글\n<<PAGE: 2>>\n제1장 총칙 하나\n1.1 목적 하나\n{long}\n<<PAGE: 3>>\n1.2 범위 둘\n본문\n제2장 끝 셋"
    rows = chunking.chunk_documents(docs(spark, [text])).orderBy("chunk_order").collect()
    assert [r["chunk_order"] for r in rows] == list(range(len(rows)))
    assert rows[0]["text"] == "표지 글" and rows[0]["page_start"] == 1 and rows[0]["page_end"] == 2
    assert rows[1]["section_level1"] == "제1장 총칙 하나" and rows[1]["section_level2"] == "N/A"
    assert rows[-1]["text"].endswith("# 제2장 끝 셋") and rows[-1]["section_level2"] == "1.2 범위 둘"
    assert all(r["page_start"] <= r["page_end"] for r in rows)
    assert not any("<<PAGE" in r["text"] for r in rows)


def test_page_carry(spark):
    rows = [(0, i, 0, 0, t, "N/A", "N/A") for i, t in enumerate(["<<PAGE: 1>>a<<PAGE: 2>>", "b", "<<PAGE: 4>>c", "<<PAGE: 5>>", "d"])]
    frame = spark.createDataFrame(rows, "doc_id int, section_no int, part_no int, piece_no int, text string, section_level1 string, section_level2 string")
    out = chunking.with_pages(frame).orderBy("section_no").collect()
    assert [(r["text"], r["page_start"], r["page_end"]) for r in out] == [("a", 1, 2), ("b", 2, 2), ("c", 2, 4), ("d", 5, 5)]


def test_only_headings_document(spark):
    rows = chunking.chunk_documents(docs(spark, ["제1장 총칙 하나\n제2장 운영 둘"])).orderBy("chunk_order").collect()
    assert [r["text"] for r in rows] == ["# 제1장 총칙 하나", "# 제2장 운영 둘"]


def test_audit(spark):
    text = ("---\ntitle: x\n---\n<<PAGE: 1>>\n# **제** **1** **장** 총칙 ......... 2\n제2장 운영 ......... 3\n\n<<PAGE: 2>>\n○ 항목\n\n\n\nI 개요 글\n"
            "제1장 총칙\n가. 목적 하나\n그. 아님 둘\n|a|b|\n이어짐\n")
    out = by_doc(audit.audit(docs(spark, [text])))[0]
    assert out.startswith("---\ntitle: x\n---<<PAGE: 1>>\n\n")
    assert "\n제 1 장 총칙 ......... 2" in out or "# 제 1 장 총칙 ......... 2" in out
    # Blanks between single syllables close up across the line end.
    assert "* 항목\n\n## I. 개요글\n# 제1장 총칙\n가. 목적 하나\n그. 아님 둘\n|a|b| 이어짐" in out


def test_contents_headings_are_cleared(spark):
    lines = [("1", 0, 1, ["# 제1장 총칙 ....... 2", "# 제2장 운영 ....... 3"]), ("1", 1, 2, ["# 제1장 총칙", "본문"])]
    rows = [(d, p, n, i, line) for d, p, n, ls in lines for i, line in enumerate(ls)]
    frame = spark.createDataFrame(rows, "doc_id string, page_no int, page int, line_no int, line string")
    out = [r["line"] for r in audit.without_contents_headings(frame).orderBy("page_no", "line_no").collect()]
    assert out == ["제1장 총칙 ....... 2", "# 제2장 운영 ....... 3", "# 제1장 총칙", "본문"]


def test_visual_lines(spark):
    rows = [(1, 1, i, float(x), y, f"t{i}") for i, (x, y) in enumerate([(5, 10.0), (1, 12.5), (0, 13.2), (3, 15.9), (1, 30.0)])]
    out = pdf_text.visual_lines(spark.createDataFrame(rows, "doc_id int, page int, line_id int, x double, y double, text string")).orderBy("group_no")
    assert [r["text"] for r in out.collect()] == ["t1 t0", "t2 t3", "t4"]


def test_visual_lines_pass_a_task_as_one_stream(spark, monkeypatch):
    calls, of_pages = spark.sparkContext.accumulator(0), pdf_text._same_height

    def counted(rows):
        calls.add(1)
        return of_pages(rows)

    monkeypatch.setattr(pdf_text, "_same_height", counted)
    heights = [10.0, 14.0, 12.9, None, 30.0, 33.0]
    rows = [(d, p, i, float(i), y, f"t{i}") for d in range(20) for p in range(10) for i, y in enumerate(heights)] + [(None, 1, 1, 1.0, 1.0, "no id")]
    frame = spark.createDataFrame(rows, "doc_id int, page int, line_id int, x double, y double, text string")
    found = {}
    for r in pdf_text.visual_lines(frame).orderBy("doc_id", "page", "group_no").collect():
        found.setdefault((r["doc_id"], r["page"]), []).append(r["text"])
    assert found == {(d, p): ["t0 t2", "t1", "t4", "t3 t5"] for d in range(20) for p in range(10)}
    assert calls.value <= 8  # tasks, not pages


def test_section_at(spark):
    heads = spark.createDataFrame([(1, 0, 1, "A"), (1, 5, 2, "a"), (1, 9, 1, "B")], "doc_id int, pos int, level int, heading string")
    asked = spark.createDataFrame([(1, p) for p in (0, 4, 5, 8, 9, 20)] + [(2, 3)], "doc_id int, pos int")
    out = {(r[0], r[1]): (r[2], r[3]) for r in hierarchy.section_at(asked, heads).collect()}
    assert out == {(1, 0): ("A", "N/A"), (1, 4): ("A", "N/A"), (1, 5): ("A", "a"), (1, 8): ("A", "a"), (1, 9): ("B", "N/A"), (1, 20): ("B", "N/A"), (2, 3): ("N/A", "N/A")}


def test_chunk_invariants_on_tables(spark):
    from tests.conftest import FOLDER
    from tenderloom.workload.derived import markdown_documents

    chunks = chunking.chunk_documents(tables.flatten_tables(markdown_documents(spark, FOLDER))).collect()
    orders = {}
    for r in chunks:
        orders.setdefault(r["doc_id"], []).append(r["chunk_order"])
        assert r["page_start"] <= r["page_end"]
        assert re.search(r"\S", r["text"])
    assert all(sorted(o) == list(range(len(o))) for o in orders.values())
