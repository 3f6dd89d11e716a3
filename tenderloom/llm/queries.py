"""The registered queries of the operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_LIMIT = 2048


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tenderloom.llm.exact_dedup import exact_groups

    found = exact_groups(_table(spark, folder, "documents"), all_rows=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH digests AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), placed AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id
  FROM digests
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM placed
"""


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from tenderloom.llm.common import bucket_of
    from tenderloom.llm.toxicity import scored

    held_out = bucket_of("doc_id", 5) == 0
    found = scored(_table(spark, folder, "documents"), _table(spark, folder, "labels"), held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from tenderloom.llm.quality import judged

    return judged(_table(spark, folder, "documents"))


OP3_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), split_up AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), places AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM split_up WHERE len(w) > 5
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS times FROM places
), gaps AS (
  SELECT doc_id, least(5, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 5)) AS words FROM windows WHERE times > 1
), repeats AS (
  SELECT doc_id, sum(words)::BIGINT AS n FROM gaps GROUP BY doc_id
), measured AS (
  SELECT s.doc_id, s.w, s.lines, len(s.w)::BIGINT AS n_words,
         length(regexp_replace(s.t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(s.t) - length(regexp_replace(s.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         (len(s.lines) - len(list_distinct(s.lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM split_up s LEFT JOIN repeats r USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols * 10 > n_words
    OR (len(lines) - n_dup_lines) * 2 < len(lines)
    OR word_chars * 2 < n_words * 5 OR word_chars > n_words * 15
    OR len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) * 10 < n_words * 4
    OR len(list_filter(range(2, n_words + 1), lambda i: w[i] = w[i - 1])) * 10 > n_words * 3
    OR len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-•*‣]'))) * 10 > len(lines) * 9
    OR len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) * 3 > len(lines) AS rejected
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged
"""


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from tenderloom.llm.token_counts import counted

    return counted(_table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"), TOKEN_LIMIT)


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    from tenderloom.llm.chat import read_back, rendered_turns

    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(rendered_turns(turns.unionByName(added)))


# The digests and the loss text follow from the table alone; the length of the formatted text from the template and its escapes.
OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), measured AS (
  SELECT *,
    len(regexp_extract_all(role || chr(0) || text, '<s>|</s>|\[ROLE\]|\[/ROLE\]|\[INST\]|\[/INST\]')) AS controls,
    len(regexp_extract_all(role || chr(0) || text, '[\\<\[]')) AS marks,
    contains(role, chr(92)) OR contains(text, chr(92)) AS slashes
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + 24 + CASE WHEN slashes THEN marks ELSE controls END)::BIGINT AS formatted_chars
FROM measured GROUP BY conv_id
"""


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    from tenderloom.llm.warc import archived, read_archives

    found = read_archives(*archived(_table(spark, folder, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first_id FROM payloads WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM payloads p LEFT JOIN firsts f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""


def op7_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tenderloom.llm.simhash import near_groups

    return near_groups(_table(spark, folder, "documents"))


def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """As many documents as there are, each source weighing the square root of its size."""
    from tenderloom.llm.mixing import mixed

    found = mixed(_table(spark, folder, "documents"), carry=["doc_id", "source"])
    return found.select("doc_id", "source", F.col("_copy").alias("copy"), F.col("_copies").alias("copies"),
                        F.col("_weight").alias("weight"), F.col("_order").alias("shuffle_key"))


OP8_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), rates AS (
  SELECT source, round(sqrt(n) / sum(sqrt(n)) OVER (), 12) AS weight,
         round(sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n, 9) AS rate
  FROM sizes
), terms AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms WHERE k < ceil(rate + sqrt(rate) * 12) + 24
), drawn AS (
  SELECT doc_id, source, ('0x' || substr(md5('mixture|' || doc_id || '|0'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents
), counted AS (
  SELECT d.doc_id, d.source, count(*) FILTER (WHERE t.c <= d.u) AS copies
  FROM drawn d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.doc_id, d.source
), spread AS (
  SELECT doc_id, source, copies, unnest(range(1, copies + 1)) AS copy FROM counted
)
SELECT s.doc_id, s.source, s.copy, s.copies, r.weight, md5('mixture|order|' || s.doc_id || '|' || s.copy) AS shuffle_key
FROM spread s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
"""


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    from tenderloom.llm.packing import pack

    return pack(_table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), TOKEN_LIMIT)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from tenderloom.llm.language import identified

    return identified(_table(spark, folder, "documents"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    from tenderloom.llm.conversation_repair import damaged, repaired, reported

    turns = _table(spark, folder, "conversations")
    return reported(repaired(damaged(turns), turns))


# DuckDB has no crc32: its table and the loop over the bytes are spelled out. The walk keeps the cheapest and least edits
# (cost, audit, repaired rows) for every state of the grammar: z nothing yet, s, u, a the last role.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) r(i)
)"""
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295]::BIGINT[], {bytes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"


def _went(state: str, cost: str, letter: str, row: str = "") -> str:
    added = f" || {row}" if row else ""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {letter}, 'r': {state}.r{added}}}"


_INSERT_USER, _INSERT_ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_TO_USER, _TO_ASSISTANT = (
    [_went(f"w.{state}", f"CASE WHEN faulty THEN 1000000000 WHEN initial = '{role[0]}' THEN t ELSE t + 3 END", f"CASE initial WHEN '{role[0]}' THEN 'K' ELSE 'R' END",
           f"chr(10) || CASE initial WHEN '{role[0]}' THEN role ELSE '{role}' END || ':' || text") for state in states]
    for role, states in (("user", "zsa"), ("assistant", "u")))
OP11_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), hashed AS (
  SELECT keyed.*, {_CRC.format(bytes="list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)")} % 20 AS kind FROM keyed, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS time
  FROM hashed
), placed AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), time) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, time) > 1 AS again,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut_off
  FROM damaged
), judged AS (
  SELECT *, blank OR again AS faulty, CASE WHEN cut_off THEN 3 ELSE 0 END AS t,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS clash
  FROM placed
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
         count(*) FILTER (WHERE cut_off AND NOT faulty) AS truncated, count(*) FILTER (WHERE clash) AS illegal
  FROM judged GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS z, {{'c': 1000000000::BIGINT, 'a': '', 'r': ''}} AS s,
         {{'c': 3::BIGINT, 'a': 'I', 'r': {_INSERT_USER}}} AS u, {{'c': 6::BIGINT, 'a': 'II', 'r': {_INSERT_USER} || {_INSERT_ASSISTANT}}} AS a
  FROM counted
  UNION ALL
  SELECT conv_id, i, z, s, u, list_min([a, {_went("u", "3", "'I'", _INSERT_ASSISTANT)}]) AS a
  FROM (
    SELECT conv_id, i, z, s, a, list_min([u, {_went("z", "3", "'I'", _INSERT_USER)}, {_went("s", "3", "'I'", _INSERT_USER)}, {_went("a", "3", "'I'", _INSERT_USER)}]) AS u
    FROM (
      SELECT j.conv_id, j.i, {_went("w.z", "4", "'D'")} AS z,
        list_min([{_went("w.s", "4", "'D'")}, {_went("w.z", "CASE WHEN faulty OR initial <> 's' THEN 1000000000 ELSE t END", "'K'", "chr(10) || role || ':' || text")}]) AS s,
        list_min([{_went("w.u", "4", "'D'")}, {", ".join(_TO_USER)}]) AS u,
        list_min([{_went("w.a", "4", "'D'")}, {", ".join(_TO_ASSISTANT)}]) AS a
      FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
    )
  )
), ends AS (
  SELECT c.*, list_min([w.z, w.a]) AS best FROM counted c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n
)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    from tenderloom.llm.spelling import variants

    return variants(_table(spark, folder, "documents"))


# Neighbours by words without one letter: two words of one length that agree without their i-th letters, or a word that
# is another without one. Characters of the runs have one byte, or 195 and the code point less 64.
_RUN_BYTES = "flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END))"
OP12_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), distinct_runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS times FROM runs GROUP BY 1, 2
), hashed AS (
  SELECT run, times, {_CRC.format(bytes=_RUN_BYTES.format(text="id || ':' || run"))} AS h FROM distinct_runs, crc_table
), hurt AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM hurt WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), shorter AS (
  SELECT DISTINCT ON (word, part, i) word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.i = b.i AND a.part = b.part AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON w.word = s.part
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.part
), counted AS (
  SELECT x.word, count(*) AS n_near, list_min(list({{'minus': -w.n, 'word': w.word}})) AS best FROM near x JOIN words w ON w.word = x.other GROUP BY x.word
), formed AS (
  SELECT w.word, w.n, coalesce(c.n_near, 0) AS n_near, CASE WHEN -c.best.minus >= 5 * w.n THEN c.best.word END AS form, CASE WHEN -c.best.minus >= 5 * w.n THEN -c.best.minus END AS form_n
  FROM words w LEFT JOIN counted c USING (word)
), led AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT l.word, f.form, l.steps + 1 FROM led l JOIN formed f ON f.word = l.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(root, steps) AS root FROM led GROUP BY word) l USING (word)
"""


def op13_html_text(spark: SparkSession, folder: str) -> DataFrame:
    from tenderloom.llm.html_text import extracted

    return extracted(_table(spark, folder, "pages"))


QUERIES = {
    "op1_exact_dedup": (op1_exact_dedup, OP1_SQL),
    "op2_toxicity": (op2_toxicity, None),
    "op3_quality_rules": (op3_quality_rules, OP3_SQL),
    "op4_token_counts": (op4_token_counts, None),
    "op5_chat_format": (op5_chat_format, OP5_SQL),
    "op6_warc": (op6_warc, OP6_SQL),
    "op7_simhash_dedup": (op7_simhash_dedup, None),
    "op8_mix_sources": (op8_mix_sources, OP8_SQL),
    "op9_packing": (op9_packing, None),
    "op10_language_id": (op10_language_id, None),
    "op11_conversation_repair": (op11_conversation_repair, OP11_SQL),
    "op12_spelling_variants": (op12_spelling_variants, OP12_SQL),
    "op13_html_text": (op13_html_text, None),
}
