"""Queries on document structure: pages, headings, tables, chunks, sections, sparse weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.functions import markdown as md
from tenderloom.operators import audit, chunking, hierarchy, pdf_text, sparse, tables
from tenderloom.operators.lines import by_document, explode_lines, parts_of
from tenderloom.operators.ordered import row_numbers
from tenderloom.sources.tables import table
from tenderloom.workload.derived import markdown_documents, with_sql


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "source")


# ---------------------------------------------------------------- pages and front matter
def page_split(spark, sf):
    rows = audit.page_rows(markdown_documents(spark, sf))
    return rows.select("doc_id", "page_no", "page", F.md5("text").alias("content_md5"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
PAGE_SPLIT_SQL = with_sql(["markdown"], rf"""
    , p AS (SELECT doc_id, regexp_extract_all(text, '<<PAGE:\s*(\d+)>>', 1) AS nums, regexp_split_to_array(text, '<<PAGE:\s*\d+>>')[2:] AS parts FROM markdown),
    u AS (SELECT doc_id, unnest(nums) AS n, unnest(parts) AS c, generate_subscripts(nums, 1) AS i FROM p)
    SELECT doc_id, (i - 1)::INTEGER AS page_no, n::INTEGER AS page, md5(trim(c, {_WS})) AS content_md5 FROM u""")


def front_matter(spark, sf):
    docs = markdown_documents(spark, sf)
    full = F.concat(F.lit("---\ntitle: \"T"), F.col("doc_id").cast("string"), F.lit("\"\nsource: a: b\nnothing\n---\n"), "text")
    rows = docs.select("doc_id", md.front_matter(full).alias("f"), md.split_front_matter(full).alias("s"))
    return rows.select(
        "doc_id", F.col("f.meta")["title"].alias("title"), F.col("f.meta")["source"].alias("source"), F.size("f.meta").alias("n_keys"),
        F.length("f.body").alias("body_chars"), F.length("s.body").alias("split_chars"), F.length("s.front").alias("front_chars"),
    )


FRONT_MATTER_SQL = with_sql(["markdown"], """
    SELECT doc_id, 'T' || doc_id::VARCHAR AS title, 'a: b' AS source, 2 AS n_keys, length(text) AS body_chars, length(text) + 1 AS split_chars,
           length('title: "T' || doc_id::VARCHAR || '"') + length('source: a: b') + length('nothing') + 4 AS front_chars FROM markdown""")


# ---------------------------------------------------------------- cleaning
def clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(md.clean_for_chunks(F.col("text"))).alias("clean_md5"))


CLEAN_SQL = r"""WITH a AS (SELECT doc_id, regexp_replace(text, '(?m)^(\s*)[○□❍❏◎◇▶▷►●■★☆◆▪▸ｏ]\s*', '\1- ', 'g') AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(t, '\*\*(.+?)\*\*', '\1', 'g') AS t FROM a),
    c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)^[ \t]*-?\s*\d{1,4}\s*-?[ \t]*$', '', 'g'), '(?m)^[ \t]*\d{1,4}\s*/\s*\d{1,4}[ \t]*$', '', 'g') AS t FROM b),
    d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)^[ \t]*제\s*안\s*요\s*청\s*서[ \t]*$', '', 'g'), '(?m)^[ \t]*\(?\s*비\s*밀\s*\)?\s*$', '', 'g') AS t FROM c)
    SELECT doc_id, md5(regexp_replace(regexp_replace(replace(t, chr(9), '    '), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS clean_md5 FROM d"""


def clean_pages(spark, sf):
    """The full cleaning of every document, those of odd number as HWP; documents left empty are dropped."""
    kind = F.when(F.col("doc_id") % 2 == 0, F.lit("pdf")).otherwise(F.lit("hwp"))
    rows = _docs(spark, sf).select("doc_id", md.clean_page(F.col("text"), kind).alias("t")).filter("t <> ''")
    return rows.select("doc_id", F.md5("t").alias("clean_md5"))


CLEAN_PAGES_SQL = CLEAN_SQL.rsplit("SELECT doc_id, md5", 1)[0].replace(
    r"b AS (SELECT doc_id, regexp_replace(t, '\*\*(.+?)\*\*', '\1', 'g') AS t FROM a)",
    r"""b0 AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\*\*(.+?)\*\*', '\1', 'g'), '(?m)^#{1,6}\s+', '', 'g') AS t FROM a),
    b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN regexp_replace(t, '(?m)^[ \t]*[-_=]{3,}[ \t]*$', '', 'g') ELSE t END AS t FROM b0)""",
) + rf"""SELECT doc_id, md5(t) AS clean_md5 FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(t, chr(9), '    '), '(?m)[ \t]+$', '', 'g'),
    '\n{{3,}}', chr(10) || chr(10), 'g'), {_WS}) AS t FROM d) WHERE t <> ''"""


def repaired_page_text(spark, sf):
    """Repairs of extracted page text over all documents, with damage put in: bold in parts, lost blanks."""
    damaged = F.concat(F.lit("**제** **1** **장** **총칙**\n"), F.replace("text", F.lit(" the "), F.lit("�the ")))
    rows = _docs(spark, sf).select("doc_id", pdf_text.tidy_page(damaged).alias("t"))
    return rows.select("doc_id", F.md5("t").alias("text_md5"))


REPAIRED_SQL = rf"""WITH a AS (SELECT doc_id, replace(text, ' the ', '�the ') AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(t, '([가-힣A-Za-z0-9])�', '\1 ', 'g') AS t FROM a),
    m AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(x,
        '\*\*(.+?)\*\*\s*\*\*(.+?)\*\*', '**\1 \2**', 'g'), '\*\*(.+?)\*\*\s*\*\*(.+?)\*\*', '**\1 \2**', 'g'), '\*\*(.+?)\*\*\s*\*\*(.+?)\*\*', '**\1 \2**', 'g')), chr(10)) AS t FROM b)
    SELECT doc_id, md5(trim(regexp_replace(regexp_replace('**제 1 장 총칙**' || chr(10) || t, '\n{{3,}}', chr(10) || chr(10), 'g'),
        '(?m)^\s*-?\s*\d{{1,3}}\s*-?\s*$', '', 'g'), {_WS})) AS text_md5 FROM m"""


# ---------------------------------------------------------------- headings
_HEADS = r"""CASE WHEN trim(line) = '' OR regexp_matches(trim(line), '^<<PAGE:\s*\d+>>') OR starts_with(trim(line), '|') THEN NULL
    WHEN regexp_matches(trim(line), '^제\s*\d+\s*[장절조편항][\s.:]\s*.+$') THEN '제N' || regexp_extract(trim(line), '제\s*\d+\s*([장절조편항])', 1)
    WHEN regexp_matches(trim(line), '^\d+\.\d+\.\d+(?:\.\d+)*\.?\s+\S.+$') THEN 'numbered_d3'
    WHEN regexp_matches(trim(line), '^\d+\.\d+\.?\s+\S.+$') THEN 'numbered_d2'
    WHEN regexp_matches(trim(line), '^(?:1[0-9]|[1-9])\.\s+\S.+$') THEN 'numbered_d1'
    WHEN regexp_matches(trim(line), '^[IVXivxⅠ-Ⅻⅰ-ⅻ]+\.\s+\S.+$') THEN 'roman'
    WHEN regexp_matches(trim(line), '^[가-하]\.\s+\S.+$') THEN 'korean_letter' END"""
_LINES = """, l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM markdown),
    l1 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l0)"""


def _typed_lines(spark, sf):
    lines = explode_lines(markdown_documents(spark, sf))
    return audit.heading_candidates(lines.withColumn("page_no", F.lit(0)))


def line_headings(spark, sf):
    return _typed_lines(spark, sf).select("doc_id", "line_no", "heading_type")


LINE_HEADINGS_SQL = with_sql(["markdown"], f"""{_LINES},
    h AS (SELECT doc_id, line_no::INTEGER AS line_no, {_HEADS} AS heading_type FROM l1) SELECT * FROM h WHERE heading_type IS NOT NULL""")


def heading_levels(spark, sf):
    return audit.heading_levels(_typed_lines(spark, sf))


HEADING_LEVELS_SQL = with_sql(["markdown"], f"""{_LINES},
    h AS (SELECT doc_id, line_no, {_HEADS} AS heading_type FROM l1),
    f AS (SELECT doc_id, heading_type, min(line_no) AS first_seen FROM h WHERE heading_type IS NOT NULL GROUP BY ALL),
    r AS (SELECT doc_id, heading_type, row_number() OVER (PARTITION BY doc_id ORDER BY first_seen) AS level FROM f)
    SELECT * FROM r WHERE level <= 2""")


def toc_share(spark, sf):
    """Share of dot-leader lines per page, leaders put on the lines of every third document."""
    docs = markdown_documents(spark, sf)
    leaders = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"(?m)^(제.*)$", "$1 ..... 3")).otherwise(F.col("text"))
    pages = audit.page_rows(docs.select("doc_id", leaders.alias("text")))
    lines = pages.select("doc_id", "page", F.explode(F.split("text", "\n", -1)).alias("line"))
    return audit.contents_share(lines)


TOC_SQL = with_sql(["markdown"], rf"""
    , m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '(?m)^(제.*)$', '\1 ..... 3', 'g') ELSE text END AS text FROM markdown),
    p AS (SELECT doc_id, regexp_extract_all(text, '<<PAGE:\s*(\d+)>>', 1) AS nums, regexp_split_to_array(text, '<<PAGE:\s*\d+>>')[2:] AS parts FROM m),
    u AS (SELECT doc_id, unnest(nums)::INTEGER AS page, unnest(parts) AS c FROM p),
    l AS (SELECT doc_id, page, unnest(string_split(c, chr(10))) AS line FROM u)
    SELECT doc_id, page, count(*) FILTER (regexp_matches(line, '[-·―─━│┃═║…⋯・.]{{5,}}')) AS n_leader, count(*) AS n_lines,
           count(*) FILTER (regexp_matches(line, '[-·―─━│┃═║…⋯・.]{{5,}}')) / count(*) > 0.5 AS is_contents
    FROM l WHERE trim(line, {_WS}) <> '' GROUP BY doc_id, page""")


def inserted_headings(spark, sf):
    """Heading lines per level after the hierarchy of every document is written into it."""
    rows = chunking.insert_headings(markdown_documents(spark, sf))
    return rows.select(
        "doc_id", F.regexp_count("text", F.lit(r"(?m)^# ")).alias("n_level1"), F.regexp_count("text", F.lit(r"(?m)^## ")).alias("n_level2"),
        F.md5("text").alias("text_md5"),
    )


def audited_documents(spark, sf):
    rows = audit.audit(markdown_documents(spark, sf))
    return rows.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("text_md5"), audit.table_lines(F.col("text")).alias("table_lines"))


# ---------------------------------------------------------------- tables
def flatten_tables(spark, sf):
    rows = tables.flatten_tables(markdown_documents(spark, sf))
    return rows.select("doc_id", F.md5(F.regexp_replace("text", r"(?m)^\s+|[ \t]+$", "")).alias("text_md5"))


FLATTEN_SQL = with_sql(["markdown"], r"""
    SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\|항목\|내용\|\n\|---\|---\|\n\|기간\|(\d+)\|', '기간: \1', 'g'), '(?m)^\s+|[ \t]+$', '', 'g')) AS text_md5
    FROM markdown""")


def table_rows(spark, sf):
    """Line items as Markdown tables, one per order, flattened to `header: value` lines."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_extendedprice", "l_shipdate")
    placed = row_numbers(items, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"], "n")
    head = F.array(F.lit("품번"), F.lit("수량"), F.lit("구분"))
    line = F.concat(F.lit("| "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("l_quantity").cast("int").cast("string"), F.lit("<br/>개 | "), "l_returnflag", F.lit(" |"))
    return placed.select("l_orderkey", "n", tables.row_text(head, tables.cells(line)).alias("row_text"))


TABLE_ROWS_SQL = """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n,
    '품번: ' || l_partkey::VARCHAR || ', 수량: ' || trunc(l_quantity)::INTEGER::VARCHAR || ' 개, 구분: ' || l_returnflag AS row_text FROM lineitem"""


# ---------------------------------------------------------------- chunks
def fixed_stride_chunks(spark, sf):
    rows = chunking.fixed_stride_pieces(_docs(spark, sf))
    return rows.select("doc_id", "piece_no", F.md5("piece").alias("piece_md5"))


FIXED_STRIDE_SQL = """WITH s AS (SELECT doc_id, text, unnest(generate_series(0, greatest((length(text) - 201) // 800, 0))) AS piece_no FROM documents)
    SELECT doc_id, piece_no::INTEGER AS piece_no, md5(substring(text, (piece_no * 800 + 1)::INTEGER, 1000)) AS piece_md5 FROM s"""


def recursive_chunks(spark, sf):
    """All documents cut to size at paragraphs, lines, words or characters."""
    docs = _docs(spark, sf).repartition("doc_id")
    rows = docs.select("doc_id", F.posexplode(chunking.sized_pieces(F.col("text"))).alias("piece_no", "piece"))
    return rows.select("doc_id", "piece_no", F.length("piece").alias("chars"), F.md5("piece").alias("piece_md5"))


def document_chunks(spark, sf):
    """Whole documents to chunks: flat tables, cleaning, hierarchy, sections, sizes, pages, joined headings."""
    docs = markdown_documents(spark, sf)
    parts = parts_of(docs)
    flat = tables.flatten_tables(docs, keep=("source",), parts=parts)
    chunks = chunking.chunk_documents(flat, keep=("source",), parts=parts)
    full = chunking.with_chunk_metadata(
        chunks.withColumnRenamed("source", "origin"), F.concat(F.col("origin"), F.lit("_사업"), F.col("doc_id").cast("string"), F.lit(".md")),
        F.lit("2024-01-01T00:00:00"),
    )
    return full.select(
        "doc_id", "chunk_order", "uid", "section_level1", "section_level2", "page_start", "page_end", "org", "project_name", "chunk_size",
        F.md5("text").alias("text_md5"),
    )


def _line_pieces(spark, sf):
    """Lines of the Markdown documents as pieces in order, heading lines marked."""
    lines = explode_lines(markdown_documents(spark, sf)).filter(F.col("line") != "")
    head = F.when(F.col("line").rlike("^제"), F.concat(F.lit("# "), "line")).when(F.col("line").rlike(r"^\d+\.1 "), F.concat(F.lit("## "), "line")).otherwise(F.col("line"))
    return lines.select(
        "doc_id", F.col("line_no").alias("section_no"), F.lit(0).alias("part_no"), F.lit(0).alias("piece_no"), head.alias("text"),
        F.when(F.col("line_no") % 2 == 0, F.lit("N/A")).otherwise(F.concat(F.lit("S"), (F.col("line_no") % 5).cast("string"))).alias("section_level1"),
        F.lit("N/A").alias("section_level2"),
    )


_PIECES = f"""{_LINES},
    pc AS (SELECT doc_id, line_no, CASE WHEN starts_with(line, '제') THEN '# ' || line WHEN regexp_matches(line, '^\\d+\\.1 ') THEN '## ' || line ELSE line END AS text,
                  CASE WHEN line_no % 2 = 0 THEN 'N/A' ELSE 'S' || (line_no % 5)::VARCHAR END AS section_level1 FROM l1 WHERE line <> ''),
    pg AS (SELECT *, coalesce(last_value(try_cast(nullif(regexp_extract(text, '<<PAGE: (\\d+)>>', 1), '') AS INTEGER) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 1) AS page_end FROM pc),
    ps AS (SELECT *, coalesce(lag(page_end) OVER (PARTITION BY doc_id ORDER BY line_no), 1) AS page_start FROM pg),
    pp AS (SELECT * REPLACE (trim(regexp_replace(text, '<<PAGE: \\d+>>', '', 'g'), {_WS}) AS text) FROM ps
           WHERE trim(regexp_replace(text, '<<PAGE: \\d+>>', '', 'g'), {_WS}) <> '')"""


def page_carry_forward(spark, sf):
    rows = chunking.with_pages(_line_pieces(spark, sf))
    return rows.select("doc_id", F.col("section_no").alias("line_no"), "page_start", "page_end")


PAGE_CARRY_SQL = with_sql(["markdown"], f"{_PIECES} SELECT doc_id, line_no::INTEGER AS line_no, page_start, page_end FROM pp")


def header_merge(spark, sf):
    rows = chunking.join_heading_pieces(chunking.with_pages(_line_pieces(spark, sf)))
    return rows.select("doc_id", "chunk_order", "section_level1", "page_start", "page_end", F.md5("text").alias("text_md5"))


HEADER_MERGE_SQL = with_sql(["markdown"], f"""{_PIECES},
    fl AS (SELECT *, NOT starts_with(text, '#') AS content, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM pp),
    ct AS (SELECT *, coalesce(count(*) FILTER (content) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen,
                  count(*) FILTER (content) OVER (PARTITION BY doc_id) AS total FROM fl),
    gr AS (SELECT *, CASE WHEN total = 0 THEN n WHEN seen = total THEN total - 1 ELSE seen END AS grp, total > 0 AND seen = total AS at_end FROM ct),
    jn AS (SELECT doc_id, grp, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text, arg_min(section_level1, n) FILTER (content OR total = 0) AS own,
                  arg_max(section_level1, n) FILTER (NOT content AND NOT at_end) AS lead, arg_min(page_start, n) AS page_start, arg_max(page_end, n) AS page_end
           FROM gr GROUP BY doc_id, grp)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1)::INTEGER AS chunk_order,
           CASE WHEN own = 'N/A' THEN coalesce(lead, own) ELSE own END AS section_level1, page_start, page_end, md5(text) AS text_md5 FROM jn""")


# ---------------------------------------------------------------- sections
def _section_chunks(spark, sf):
    """Every line of a document as a chunk with section labels."""
    lines = explode_lines(_docs(spark, sf))
    i = F.col("line_no")
    placed = hierarchy.with_uids(lines, "line_no")
    l2 = F.when(i % 5 < 2, F.lit("N/A")).otherwise(F.concat(F.lit("T"), F.floor(i % 5 / 2).cast("string")))
    return placed.select(
        "doc_id", "chunk_order", "uid", F.col("line").alias("text"),
        F.when(i < 2, F.lit("N/A")).otherwise(F.concat(F.lit("S"), F.floor(i / 10).cast("string"))).alias("section_level1"),
        l2.alias("section_level2"),
    )


_SECTION_CHUNKS = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    c AS (SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS i FROM d),
    ch AS (SELECT doc_id, i::INTEGER AS chunk_order, doc_id::VARCHAR || '_' || i::VARCHAR AS uid, text,
                  CASE WHEN i < 2 THEN 'N/A' ELSE 'S' || (i // 10)::VARCHAR END AS section_level1,
                  CASE WHEN i % 5 < 2 THEN 'N/A' ELSE 'T' || (i % 5 // 2)::VARCHAR END AS section_level2 FROM c)"""
_ENTRIES = f"""{_SECTION_CHUNKS},
    e0 AS (SELECT doc_id, section_level1, NULL AS section_level2, 1 AS level, min(chunk_order) AS start_order, max(chunk_order) AS end_order FROM ch
           WHERE section_level1 <> 'N/A' GROUP BY doc_id, section_level1
           UNION ALL SELECT doc_id, section_level1, section_level2, 2, min(chunk_order), max(chunk_order) FROM ch
           WHERE section_level1 <> 'N/A' AND section_level2 <> 'N/A' GROUP BY doc_id, section_level1, section_level2),
    e1 AS (SELECT *, doc_id::VARCHAR || '_h_' || (row_number() OVER (PARTITION BY doc_id ORDER BY level, start_order))::VARCHAR AS uid FROM e0),
    e AS (SELECT *, CASE WHEN level = 2 THEN max(CASE WHEN level = 1 THEN uid END) OVER (PARTITION BY doc_id, section_level1) END AS parent_uid,
                 CASE WHEN level = 1 THEN section_level1 ELSE section_level2 END AS title FROM e1)"""


def chunk_uid(spark, sf):
    return _section_chunks(spark, sf).select("doc_id", "chunk_order", "uid")


CHUNK_UID_SQL = f"{_SECTION_CHUNKS} SELECT doc_id, chunk_order, uid FROM ch"


def section_hierarchy(spark, sf):
    return hierarchy.section_entries(_section_chunks(spark, sf)).select("doc_id", "uid", "level", "title", "parent_uid", "start_order", "end_order")


HIERARCHY_SQL = f"{_ENTRIES} SELECT doc_id, uid, level, title, parent_uid, start_order, end_order FROM e"


def section_summary(spark, sf):
    rows = hierarchy.hierarchy(_section_chunks(spark, sf))
    return rows.select("uid", "level", F.md5("summary").alias("summary_md5"))


SUMMARY_SQL = _ENTRIES + r""",
    sn AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)),
                     lambda x: x <> '')[1:2], ' ') AS snippet FROM ch),
    mt AS (SELECT e.uid, e.level, e.section_level1, e.section_level2, s.snippet, s.chunk_order,
                  row_number() OVER (PARTITION BY e.uid ORDER BY s.chunk_order) AS rn
           FROM e JOIN sn s ON s.doc_id = e.doc_id AND s.section_level1 = e.section_level1 AND (e.level = 1 OR s.section_level2 = e.section_level2)),
    ag AS (SELECT uid, level, any_value(section_level1) AS l1, any_value(section_level2) AS l2,
                  coalesce(string_agg(snippet, ' ' ORDER BY chunk_order) FILTER (snippet <> ''), '') AS s FROM mt WHERE rn <= 3 GROUP BY uid, level)
    SELECT uid, level, md5('[Level ' || level::VARCHAR || '] ' || CASE WHEN level = 1 THEN l1 ELSE l1 || ' > ' || l2 END || chr(10)
           || CASE WHEN length(s) > 400 THEN substring(s, 1, 400) || '...' ELSE s END) AS summary_md5 FROM ag"""


def chunk_section_link(spark, sf):
    chunks = _section_chunks(spark, sf)
    return hierarchy.with_section_uid(chunks, hierarchy.section_entries(chunks)).select("uid", "section_uid")


LINK_SQL = f"""{_ENTRIES} SELECT ch.uid, coalesce(b.uid, a.uid, 'None') AS section_uid FROM ch
    LEFT JOIN e a ON a.level = 1 AND a.doc_id = ch.doc_id AND a.section_level1 = ch.section_level1
    LEFT JOIN e b ON b.level = 2 AND b.doc_id = ch.doc_id AND b.section_level1 = ch.section_level1 AND b.section_level2 = ch.section_level2"""


def section_range(spark, sf):
    chunks = _section_chunks(spark, sf)
    rows = hierarchy.chunks_of_sections(hierarchy.section_entries(chunks), chunks)
    return rows.groupBy("uid").agg(F.count("*").alias("n_chunks"), F.min("chunk_order").alias("first"), F.max("chunk_order").alias("last"))


RANGE_SQL = f"""{_ENTRIES} SELECT e.uid, count(*) AS n_chunks, min(ch.chunk_order) AS first, max(ch.chunk_order) AS last FROM e
    JOIN ch ON ch.doc_id = e.doc_id AND ch.chunk_order BETWEEN e.start_order AND e.end_order GROUP BY e.uid"""


def section_asof(spark, sf):
    lines = explode_lines(_docs(spark, sf))
    heads = lines.filter("line_no % 4 = 1").select(
        "doc_id", F.col("line_no").alias("pos"), F.when(F.col("line_no") % 12 == 1, 1).otherwise(2).alias("level"),
        F.concat(F.lit("H"), F.col("line_no").cast("string")).alias("heading"),
    )
    return hierarchy.section_at(lines.select("doc_id", F.col("line_no").alias("pos")), heads)


ASOF_SQL = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    c AS (SELECT doc_id, (generate_subscripts(ls, 1) - 1)::INTEGER AS pos FROM d),
    h AS (SELECT doc_id, pos, CASE WHEN pos % 12 = 1 THEN 1 ELSE 2 END AS level, 'H' || pos::VARCHAR AS heading FROM c WHERE pos % 4 = 1),
    a AS (SELECT c.doc_id, c.pos, h.heading AS l1, h.pos AS p1 FROM c ASOF LEFT JOIN (SELECT * FROM h WHERE level = 1) h ON h.doc_id = c.doc_id AND h.pos <= c.pos),
    b AS (SELECT a.*, h.heading AS l2, h.pos AS p2 FROM a ASOF LEFT JOIN (SELECT * FROM h WHERE level = 2) h ON h.doc_id = a.doc_id AND h.pos <= a.pos)
    SELECT doc_id, pos, coalesce(l1, 'N/A') AS section_level1, CASE WHEN p2 > coalesce(p1, -1) THEN l2 ELSE 'N/A' END AS section_level2 FROM b"""


def chunk_stats(spark, sf):
    return chunking.chunk_statistics(_docs(spark, sf)).withColumn("avg_size", F.round("avg_size", 4))


CHUNK_STATS_SQL = """SELECT count(*) AS total, sum(length(text)) AS total_size, round(avg(length(text)), 4) AS avg_size, min(length(text)) AS min_size,
    max(length(text)) AS max_size FROM documents"""


# ---------------------------------------------------------------- sparse weights and PDF spans
def bm25_weights(spark, sf):
    rows = sparse.sparse_weights(by_document(_docs(spark, sf)), "doc_id", "text")
    return rows.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


BM25_SQL = """WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[0-9a-z가-힣]+'), lambda x: length(x) <= 40) AS ts FROM documents),
    u AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM t)
    SELECT doc_id, term, count(*) AS tf, round(count(*) * 2.2 / (count(*) + 1.2 * (0.25 + 0.75 * any_value(n) / 256.0)), 6) AS weight FROM u GROUP BY doc_id, term"""


def _spans(spark, sf):
    """Lines of the documents as text spans on pages of twenty lines; short ones in a larger font, two per height."""
    lines = explode_lines(_docs(spark, sf))
    n = F.col("line_no")
    y = F.floor(n % 20 / 2) * 12.0 + n % 2
    return lines.select(
        "doc_id", (F.floor(n / 20) + 1).cast("int").alias("page"), (n % 20).alias("line_id"), n.alias("span_no"), ((n % 2) * 100.0).alias("x"),
        y.alias("y0"), (y + 10.0).alias("y1"), F.when(F.length("line") < 60, 14.04).otherwise(10.02).alias("size"), F.col("line").alias("text"),
    )


def recovered_headers(spark, sf):
    """Large-font lines missing from page texts; the page texts here hold only every other line."""
    spans = _spans(spark, sf)
    pages = spans.filter("span_no % 3 <> 0").groupBy("doc_id", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda r: r["text"]), "\n").alias("text")
    )
    found = pdf_text.recovered_headers(spans, pages)
    return found.select("doc_id", "page", "group_no", F.md5("header").alias("header_md5"))


def table_recovery(spark, sf):
    """Rows of tables appended to the page texts that lack them."""
    lines = explode_lines(_docs(spark, sf)).select("doc_id", (F.floor(F.col("line_no") / 20) + 1).cast("int").alias("page"), "line_no", "line")
    pages = lines.filter("line_no % 2 = 0").groupBy("doc_id", "page").agg(F.max("line").alias("text"))
    rows = lines.select("doc_id", "page", F.col("line_no").alias("row_no"), F.array(F.col("line"), F.lit(None).cast("string"), F.lit(" ")).alias("cells"))
    out = pdf_text.with_table_rows(pages, rows)
    return out.select("doc_id", "page", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


TABLE_RECOVERY_SQL = f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, (generate_subscripts(ls, 1) - 1)::INTEGER AS i FROM d),
    p AS (SELECT doc_id, i // 20 + 1 AS page, max(line) AS text FROM l WHERE i % 2 = 0 GROUP BY ALL),
    r AS (SELECT doc_id, i // 20 + 1 AS page, i, trim(line, {_WS}) AS line FROM l),
    m AS (SELECT p.doc_id, p.page, string_agg(r.line, chr(10) ORDER BY r.i) AS rows FROM p JOIN r USING (doc_id, page)
          WHERE length(r.line) > 5 AND NOT contains(p.text, r.line) GROUP BY p.doc_id, p.page),
    o AS (SELECT p.doc_id, p.page::INTEGER AS page, CASE WHEN m.rows IS NULL THEN p.text ELSE p.text || chr(10) || chr(10) || '[테이블에서 추출]' || chr(10) || m.rows END AS text
          FROM p LEFT JOIN m USING (doc_id, page))
    SELECT doc_id, page, length(text) AS chars, md5(text) AS text_md5 FROM o"""

QUERIES = {
    "page_split": (page_split, PAGE_SPLIT_SQL),
    "front_matter": (front_matter, FRONT_MATTER_SQL),
    "clean_text": (clean_text, CLEAN_SQL),
    "clean_pages": (clean_pages, CLEAN_PAGES_SQL),
    "repaired_page_text": (repaired_page_text, REPAIRED_SQL),
    "line_headings": (line_headings, LINE_HEADINGS_SQL),
    "heading_levels": (heading_levels, HEADING_LEVELS_SQL),
    "toc_share": (toc_share, TOC_SQL),
    "inserted_headings": (inserted_headings, None),
    "audited_documents": (audited_documents, None),
    "flatten_tables": (flatten_tables, FLATTEN_SQL),
    "table_rows": (table_rows, TABLE_ROWS_SQL),
    "fixed_stride_chunks": (fixed_stride_chunks, FIXED_STRIDE_SQL),
    "recursive_chunks": (recursive_chunks, None),
    "document_chunks": (document_chunks, None),
    "page_carry_forward": (page_carry_forward, PAGE_CARRY_SQL),
    "header_merge": (header_merge, HEADER_MERGE_SQL),
    "chunk_uid": (chunk_uid, CHUNK_UID_SQL),
    "section_hierarchy": (section_hierarchy, HIERARCHY_SQL),
    "section_summary": (section_summary, SUMMARY_SQL),
    "chunk_section_link": (chunk_section_link, LINK_SQL),
    "section_range": (section_range, RANGE_SQL),
    "section_asof": (section_asof, ASOF_SQL),
    "chunk_stats": (chunk_stats, CHUNK_STATS_SQL),
    "bm25_weights": (bm25_weights, BM25_SQL),
    "recovered_headers": (recovered_headers, None),
    "table_recovery": (table_recovery, TABLE_RECOVERY_SQL),
}
