from pyspark.sql import functions as F

from tenderloom.operators import audit, chunking, tables
from tenderloom.operators.lines import by_document, explode_lines
from tenderloom.plans import ingest


def test_tasks_grow_in_number_with_the_text(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("line\n"), 20).alias("text"))
    spark.conf.set("spark.tenderloom.chars.per.task", "100")
    try:
        parts = by_document(docs).rdd.getNumPartitions()
        lines = explode_lines(docs)
    finally:
        spark.conf.unset("spark.tenderloom.chars.per.task")
    assert parts == 40 and lines.rdd.getNumPartitions() == 40
    assert lines.count() == 40 * 21 and explode_lines(docs.where("false")).count() == 0


def test_audit_chunks_and_weights_grow_in_number_with_the_text(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("|a|b|\n|---|---|\n|c|d|\nline\n"), 5).alias("text"))
    spark.conf.set("spark.tenderloom.chars.per.task", "100")
    try:
        index = ingest.build_index(docs, F.lit("x.pdf"), F.lit("2024-01-01T00:00:00"))
        parts = [df.rdd.getNumPartitions() for df in (audit.page_rows(docs), audit.audit(docs), chunking.chunk_documents(docs), index.sparse)]
    finally:
        spark.conf.unset("spark.tenderloom.chars.per.task")
    assert min(parts) >= 40, parts
    assert index.sparse.groupBy("key").agg(F.sum("tf").alias("n")).select("n").distinct().count() == 1
    assert index.chunks.select("doc_id").distinct().count() == 40


def test_one_order_of_lines_gives_continued_cells_and_titles(spark):
    cells = "t1\n|h|k|\n|a|b|\nmore|\nend  \n\n|x|\nafter"
    lines = spark.createDataFrame([(d, i, s) for d in (1, 2) for i, s in enumerate(cells.split("\n"))], "doc_id int, line_no int, line string")
    joined = tables.join_cell_lines(lines, F.lit(False)).where("doc_id = 2").orderBy("line_no")
    assert [r.line for r in joined.collect()] == ["t1", "|h|k|", "|a|b| more| end", "", "|x| after"]
    texts = [
        "  t1 \n  t2  \n|h|k|\n|---|---|\n|a|b|\nafter\n\n  one  \n|구분|값|\n|---|---|\n| | |\n",
        "x\n\n|구분|값|\n|---|---|\n| | |\nshort\n|a|b|\n|c|d|",
    ]
    flat = tables.flatten_tables(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id")
    assert [r.text for r in flat.collect()] == [
        "t1 \n  t2\nh: k\na: b\nafter\n\n  one  \n|구분|값|\n|---|---|\n| | |\n",
        "x\n\n|구분|값|\n|---|---|\n| | |\nshort\na: b\nc: d",
    ]
