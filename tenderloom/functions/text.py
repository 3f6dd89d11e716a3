"""Text functions. All of them stay in the JVM except `nfkc`, for which Spark SQL has no function."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom import fixed_values as fixed

# Whitespace as Python's str.strip and its Unicode \s see it.
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WS_CHARS = "".join(chr(n) for n in range(0x3001) if chr(n).isspace())
TOKEN = "[0-9A-Za-z가-힣]+"
NON_TOKEN = "[^0-9A-Za-z가-힣]+"
# Text of these characters alone is its own NFKC form.
NFKC_STABLE = r"^[\x00-\x7fÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-ž가-힣]*$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often the expression reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pattern(regex: str, multiline: bool = False) -> str:
    """A regex with Unicode classes and newline as the only line terminator."""
    return ("(?Umd)" if multiline else "(?Ud)") + regex


def matches(c: Column, regex: str) -> Column:
    return F.coalesce(c.rlike(pattern(regex)), F.lit(False))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WS_CHARS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(_WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(_WS_CHARS))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, WS + "+", " ")


def blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def first_non_blank(*columns: Column) -> Column:
    """The first candidate that is not blank, stripped; an empty string if there is none."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns], F.lit(""))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(c, F.lit(word))
    return F.coalesce(found, F.lit(False))


def starts_with_any(c: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.startswith(c, F.lit(word))
    return F.coalesce(found, F.lit(False))


def ends_with_any(c: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.endswith(c, F.lit(word))
    return F.coalesce(found, F.lit(False))


def replace_matches(c: Column, regex: str, change: Callable[[Column], Column]) -> Column:
    """Replace every match by a function of the matched text."""
    between = F.split(c, regex, -1)
    found = F.concat(F.regexp_extract_all(c, F.lit(regex), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, found, lambda gap, hit: F.concat(gap, change(hit))), "")


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKC")


def nfkc(c: Column) -> Column:
    """NFKC form. Rows that already have it reach Python only as nulls."""
    text = F.coalesce(c, F.lit(""))
    stable = text.rlike(NFKC_STABLE)
    return F.coalesce(F.when(stable, text), _nfkc(F.when(~stable, text)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc_all(values: pd.Series) -> pd.Series:
    return values.map(lambda texts: None if texts is None else [unicodedata.normalize("NFC", t) for t in texts])


def nfc_all(texts: Column) -> Column:
    """NFC form of every text of an array without nulls. Arrays that already have it reach Python only as nulls."""
    stable = F.array_join(texts, " ").rlike(NFKC_STABLE)
    return F.coalesce(F.when(stable, texts), _nfc_all(F.when(~stable, texts)), F.array().cast("array<string>"))


def tokens(c: Column) -> Column:
    """Distinct lower-case word tokens of two characters or more."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[0-9a-z가-힣]{2,}"), F.lit(0))
    )


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN))


def overlap_share(left: Column, right: Column) -> Column:
    """|left and right| / |left| for distinct token arrays."""
    return F.size(F.array_intersect(left, right)) / F.greatest(F.size(left), F.lit(1))


def overlap_coefficient(left: Column, right: Column) -> Column:
    """|left and right| / the smaller size; 0 when a side is empty."""
    smaller = F.least(F.size(left), F.size(right))
    return F.when(smaller > 0, F.size(F.array_intersect(left, right)) / smaller).otherwise(F.lit(0.0))


def match_key(normalized: Column) -> Column:
    """Letters and digits only, lower case; expects NFKC text."""
    kept = F.regexp_extract_all(F.lower(normalized), F.lit("[0-9a-z가-힣]+"), F.lit(0))
    return F.array_join(kept, "")


def sentences(c: Column) -> Column:
    """Sentences cut after . ! or ? and white space."""
    flat = strip(collapse_spaces(F.coalesce(c, F.lit(""))))
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+", -1), strip), lambda s: s != "")


def strip_heading_marks(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"^#{1,6}\s+", "")


def clip_at_sentence(normalized: Column, max_len: int = 360) -> Column:
    """Cut at the last sentence end in the final 40 % of the limit, else one short with an ellipsis.

    The greedy prefix finds the last end mark; a Korean ending counts only before white space or the end of the text.
    """
    low = max(20, int(max_len * 0.6))
    at_mark = rf"(?s)\A(.{{{low},{max_len - 1}}}[.!?;:)\]}}\"'”’])"
    at_ending = rf"(?s)\A(.{{{low},{max_len - 1}}}[다됨요함])(?={WS}|\z)"

    def cut(text: Column) -> Column:
        head = F.substring(text, 1, max_len + 1)
        by_mark, by_ending = F.regexp_extract(head, at_mark, 1), F.regexp_extract(head, at_ending, 1)
        best = F.when(F.length(by_mark) >= F.length(by_ending), by_mark).otherwise(by_ending)
        return (
            F.when(F.length(text) <= max_len, text)
            .when(best != "", rstrip(best))
            .otherwise(F.concat(rstrip(F.substring(text, 1, max_len - 1)), F.lit("…")))
        )

    return let(strip(F.coalesce(normalized, F.lit(""))), cut)


def looks_incomplete(normalized: Column) -> Column:
    return let(
        strip(F.coalesce(normalized, F.lit(""))),
        lambda value: F.when(value == "", F.lit(False))
        .when(value.rlike(pattern(fixed.INCOMPLETE_MEDIA_PATTERN)), F.lit(True))
        .when(ends_with_any(value, fixed.COMPLETE_ENDINGS), F.lit(False))
        .otherwise(value.rlike(fixed.INCOMPLETE_ENDINGS_PATTERN)),
    )


def clean_line(normalized: Column) -> Column:
    """Strip bullets, table remains and repeated words from one extracted line; expects NFKC text."""
    line = strip(F.regexp_replace(F.coalesce(normalized, F.lit("")), r"[\r\t]", " "))
    for regex, replacement in fixed.LINE_CLEAN_STEPS:
        line = F.regexp_replace(line, pattern(regex), replacement)
    return strip_chars(line, " -|;")


def is_noise(cleaned: Column) -> Column:
    """Whether a line cleaned by `clean_line` carries no content."""
    size = F.length(cleaned)
    valid = F.regexp_count(cleaned, F.lit(pattern(r"[0-9A-Za-z가-힣\s\.\,\-\:\;\(\)\/%_]")))
    compact = F.replace(cleaned, F.lit(" "), F.lit(""))
    spaces = size - F.length(compact)
    long_word = (F.length(compact) > 140) & (spaces == 0) & ~compact.rlike(pattern(r"\d{2,}"))
    long_korean = (F.length(compact) > 80) & (spaces <= 1) & compact.rlike("[가-힣]{30,}")
    metadata = starts_with_any(compact, [w.replace(" ", "") for w in fixed.NOISE_METADATA_WORDS])
    lowered = F.lower(cleaned)
    bars = F.regexp_count(cleaned, F.lit(r"\|"))
    cells = F.filter(F.transform(F.split(strip_chars(cleaned, "|"), r"\|", -1), strip), lambda x: x != "")
    rule_cells = (bars >= 3) & (F.size(cells) > 0) & F.forall(cells, lambda x: x.isin("-", "--", "---", ":"))
    double_spaces = F.regexp_count(cleaned, F.lit("  "))
    return (
        (size < 6)
        | cleaned.rlike(pattern(r"(?i)^col\s*\d+\s*:\s*$"))
        | ((size >= 24) & (valid / F.greatest(size, F.lit(1)) < 0.65))
        | long_word
        | long_korean
        | metadata
        | starts_with_any(cleaned, fixed.NOISE_PREFIXES)
        | cleaned.rlike(pattern(fixed.NOISE_LABEL_PATTERN))
        | F.startswith(lowered, F.lit("source:"))
        | F.contains(lowered, F.lit("logical page"))
        | F.startswith(cleaned, F.lit("| ---"))
        | cleaned.rlike(pattern(r"\A\|?\s*[:\-]+\s*(\|\s*[:\-]+\s*)+\|?\z"))
        | rule_cells
        | ((double_spaces >= 4) & contains_any(cleaned, fixed.NOISE_WIDE_WORDS))
    )


def compare_form(normalized: Column) -> Column:
    """Lower case with single spaces, for comparing two answers; expects NFKC text."""
    return strip(collapse_spaces(F.lower(normalized)))


def json_object(c: Column) -> Column:
    """The JSON object in a model reply: inside a code fence, or from the first to the last brace."""
    fenced = F.regexp_extract(c, r"(?s)```[^\n]*\n(.*?)(?:\n\s*```|\z)", 1)
    body = F.when(F.contains(c, F.lit("```")), fenced).otherwise(c)
    return F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit(""))
