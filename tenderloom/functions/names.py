"""File, source and chunk names and the keys under which they are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions.text import NON_TOKEN, collapse_spaces, first_non_blank, let, strip

_KNOWN_EXT = r"(?i)\.(pdf|hwp|hwpx|csv)$"


def base_name(c: Column) -> Column:
    """Last path component, trailing slashes ignored."""
    return F.substring_index(F.rtrim(strip(F.coalesce(c, F.lit(""))), F.lit("/")), "/", -1)


def path_suffix(name: Column) -> Column:
    """The extension without its dot; empty for dot files and names without one."""
    return F.regexp_extract(name, r"(?s)\A\.*[^.].*\.([^.]+)\z", 1)


def path_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)\A(\.*[^.].*)\.[^.]+\z", "$1")


def source_stem(c: Column) -> Column:
    """File name, its document extension cut."""
    return strip(F.regexp_replace(base_name(c), r"(?is)\A(\.*[^.].*)\.(?:pdf|hwp|hwpx|csv)\z", "$1"))


def source_extension(c: Column) -> Column:
    ext = F.lower(path_suffix(base_name(c)))
    return F.when(ext.isin(fixed.DOCUMENT_EXTENSIONS), ext).otherwise(F.lit(""))


def family_extension(c: Column) -> Column:
    """pdf, hwp (also for hwpx), csv or nothing."""
    ext = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"^\.+", "")
    return F.when(ext.isin("pdf", "csv"), ext).when(ext.isin("hwp", "hwpx"), F.lit("hwp")).otherwise(F.lit(""))


def source_label(normalized: Column) -> Column:
    """Lower-case file name without path and document extension; expects NFKC text."""
    text = strip(collapse_spaces(F.lower(normalized)))
    name = F.element_at(F.split(F.replace(text, F.lit("\\"), F.lit("/")), "/", -1), -1)
    return strip(F.regexp_replace(name, _KNOWN_EXT, ""))


def source_key(normalized: Column) -> Column:
    return F.regexp_replace(source_label(normalized), NON_TOKEN, "")


def hit_label(c: Column) -> Column:
    """Label used by the evaluation: any extension is cut."""
    text = F.lower(strip(F.coalesce(c, F.lit(""))))
    name = F.element_at(F.split(F.replace(text, F.lit("\\"), F.lit("/")), "/", -1), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def is_notice_table(label: Column) -> Column:
    return (label == "data_list") | F.startswith(label, F.lit("data_list_"))


def eval_name(c: Column) -> Column:
    return F.lower(base_name(c))


_ANY_EXT, _DOCUMENT_EXT = "[^.]+", "(?:pdf|hwp|hwpx|csv)"


def eval_extension(c: Column, known_only: bool = False) -> Column:
    """Extension of a source. `known_only` ignores what follows a dot inside a name without extension."""
    ext = _DOCUMENT_EXT if known_only else _ANY_EXT
    return F.regexp_extract(eval_name(c), rf"(?s)\A\.*[^.].*\.({ext})\z", 1)


def eval_stem_key(c: Column, known_only: bool = False) -> Column:
    """Letters and digits of the stem: equal keys mean the same document."""
    ext = _DOCUMENT_EXT if known_only else _ANY_EXT
    stem = F.regexp_replace(eval_name(c), rf"(?s)\A(\.*[^.].*)\.{ext}\z", "$1")
    return F.regexp_replace(stem, r"[^\p{L}\p{N}]+", "")


def extensions_agree(left: Column, right: Column) -> Column:
    """Whether two extensions of one stem may name the same document."""
    converted = left.isin(fixed.CONVERTED_EXTENSIONS) & right.isin(fixed.CONVERTED_EXTENSIONS)
    return (left == "") | (right == "") | converted


def same_source(left: Column, right: Column, known_only: bool = False) -> Column:
    a, b = eval_name(left), eval_name(right)
    by_stem = (eval_stem_key(left, known_only) == eval_stem_key(right, known_only)) & extensions_agree(
        eval_extension(left, known_only), eval_extension(right, known_only)
    )
    return (a != "") & (b != "") & ((a == b) | by_stem)


def trailing_index(c: Column) -> Column:
    """The number a chunk marker ends in: `hash_12` or `12`."""
    text = strip(c)
    return F.coalesce(
        F.regexp_extract(text, r"^(\d+)$", 1).try_cast("bigint"), F.regexp_extract(text, r"_(\d+)$", 1).try_cast("bigint")
    )


def chunk_id(metadata_chunk_id: Column, uid: Column, row_id: Column) -> Column:
    return F.nullif(strip(F.coalesce(metadata_chunk_id, uid, row_id)), F.lit(""))


def chunk_index(index: Column, order: Column, resolved_id: Column, row_id: Column) -> Column:
    given = F.coalesce(index, order).cast("string").try_cast("bigint")
    return F.coalesce(given, trailing_index(resolved_id), trailing_index(row_id))


def first_page(*candidates: Column, refs: Column | None = None) -> Column:
    """The first positive page among the candidates, then among the page references."""
    pages = [F.when(c.try_cast("int") > 0, c.try_cast("int")) for c in candidates]
    if refs is not None:
        positive = F.filter(F.transform(refs, lambda r: r.try_cast("int")), lambda p: p > 0)
        pages.append(F.try_element_at(positive, F.lit(1)))
    return F.coalesce(*pages)


def from_metadata(metadata: Column, keys: list[str]) -> Column:
    """First non-blank value of a string map under the keys, in order."""
    return first_non_blank(*[metadata[k] for k in keys])


def remove_josa(c: Column, whole: bool = False) -> Column:
    """Cut a particle at the end: one character, or with `whole` the particle itself."""
    particle = "(?:" + "|".join(fixed.JOSA) + r")\z"
    text = F.coalesce(c, F.lit(""))
    if whole:
        return F.when(F.length(text) > 2, F.regexp_replace(text, particle, "")).otherwise(text)
    ends = (F.length(text) > 2) & text.rlike(particle)
    return F.when(ends, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def org_of_file(c: Column) -> Column:
    plain = c
    for ext in (".hwp", ".pdf", ".hwpx"):
        plain = F.replace(plain, F.lit(ext), F.lit(""))
    return remove_josa(strip(F.split_part(plain, F.lit("_"), F.lit(1))))


def org_and_project(c: Column) -> Column:
    """`org_project.ext` as a struct; without an underscore the stem is both."""
    return let(F.regexp_replace(path_stem(c), r"(?i)\.(docx|pdf|hwpx?)$", ""), _org_and_project)


def _org_and_project(stem: Column) -> Column:
    head = F.split_part(stem, F.lit("_"), F.lit(1))
    rest = F.when(F.contains(stem, F.lit("_")), F.substring(stem, F.length(head) + 2, F.length(stem))).otherwise(stem)
    return F.struct(strip(head).alias("org"), strip(rest).alias("project"))


def standard_org(c: Column) -> Column:
    """The standard name of the first alias a name contains."""
    out = c
    for alias, standard in reversed(fixed.ORG_ALIASES.items()):
        out = F.when(F.contains(c, F.lit(alias)), F.lit(standard)).otherwise(out)
    return out


def notice_number(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")


def notice_number_in_question(normalized: Column) -> Column:
    return F.regexp_extract(F.coalesce(normalized, F.lit("")), r"\d{8,14}", 0)


def markdown_meta(markdown: Column, label: str) -> Column:
    """Value of a `- **label**: value` line."""
    quoted = "".join("\\" + ch if ch in r".^$*+?{}[]\|()-" else ch for ch in label)
    value = strip(F.regexp_extract(markdown, rf"(?d)-\s*\*\*{quoted}\*\*:\s*(.+)", 1))
    return F.regexp_replace(value, r"(?s)^\*\*(.*)\*\*$", "$1")


def content_id(c: Column) -> Column:
    """Identifier of a document: the first 16 hex digits of the SHA-256 of its content."""
    return F.substring(F.sha2(c, 256), 1, 16)
