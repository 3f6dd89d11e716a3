"""Final shape of answers: readable sections, compact lines, polite endings. Expects NFKC text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions.text import (
    collapse_spaces,
    contains_any,
    let,
    looks_incomplete,
    match_key,
    overlap_coefficient,
    pattern,
    rstrip,
    starts_with_any,
    strip,
    tokens,
)

_NO_LINES = "array<string>"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != "")


def _empty() -> Column:
    return F.array().cast(_NO_LINES)


def trimmed(c: Column, size: int) -> Column:
    return F.when(F.length(c) <= size, c).otherwise(F.concat(rstrip(F.substring(c, 1, size - 1)), F.lit("…")))


def has_table(text: Column) -> Column:
    """Three lines in a row with two bars or more."""
    rows = F.transform(F.split(text, "\n", -1), lambda x: F.when(F.regexp_count(x, F.lit(r"\|")) >= 2, "t").otherwise("-"))
    return F.contains(F.array_join(rows, ""), F.lit("ttt"))


def without_label(c: Column) -> Column:
    return F.regexp_replace(c, pattern(fixed.ANSWER_LABEL_PATTERN), "")


def is_source_line(c: Column) -> Column:
    text = F.lower(c)
    bar = F.contains(c, F.lit("|"))
    return (
        starts_with_any(text, ["출처:", "source:"])
        | text.rlike(pattern(fixed.SOURCE_FILE_PATTERN))
        | (F.contains(text, F.lit("data_list")) & F.contains(text, F.lit("csv")))
        | (bar & text.rlike("(pdf|hwp|hwpx|csv)"))
        | (text.rlike(pattern(r"\bp\.\s*\d+\b")) & (bar | F.contains(c, F.lit(":"))))
    )


# ---------------------------------------------------------------- sections
def _sections(lines: Column) -> Column:
    """Lines sorted under core, evidence and source headings; `before` holds those ahead of any heading."""
    start = F.struct(
        F.lit("before").alias("at"), *[_empty().alias(n) for n in ("before", "core", "evidence", "source")]
    )
    bracket = pattern(rf"\A\[{fixed.SECTION_NAMES_PATTERN}\]\s*(.*)\z")
    plain = pattern(rf"\A(?:#{{1,6}}\s*)?{fixed.SECTION_NAMES_PATTERN}\s*:?\s*(.*)\z")

    def add(state: Column, line: Column) -> Column:
        named = F.coalesce(
            F.nullif(F.regexp_extract(line, bracket, 1), F.lit("")), F.nullif(F.regexp_extract(line, plain, 1), F.lit(""))
        )
        rest = strip(F.when(line.rlike(bracket), F.regexp_extract(line, bracket, 2)).otherwise(F.regexp_extract(line, plain, 2)))
        at = F.when(named.isNull(), state["at"]).when(named == "핵심 답변", "core").when(named == "출처", "source").otherwise("evidence")
        value = F.when(named.isNull(), line).otherwise(F.nullif(rest, F.lit("")))
        grown = [
            F.when((at == n) & value.isNotNull(), F.array_append(state[n], value)).otherwise(state[n]).alias(n)
            for n in ("before", "core", "evidence", "source")
        ]
        return F.struct(at.alias("at"), *grown)

    return F.aggregate(lines, start, add)


def _arranged(s: Column) -> Column:
    """Core, evidence and source lists; without headings the first line that names no file is the core."""
    none = F.size(s["core"]) + F.size(s["evidence"]) + F.size(s["source"]) == 0
    text_lines = F.filter(s["before"], lambda x: ~is_source_line(x))
    file_lines = F.filter(s["before"], is_source_line)
    rest = lambda a: F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    lead = F.size(s["core"]) == 0
    core = F.when(none, F.slice(text_lines, 1, 1)).when(lead, F.slice(s["before"], 1, 1)).otherwise(s["core"])
    evidence = F.when(none, rest(text_lines)).otherwise(
        F.concat(s["evidence"], F.when(lead, rest(s["before"])).otherwise(s["before"]))
    )
    source = F.when(none, file_lines).otherwise(s["source"])
    take = F.size(source) == 0
    return F.struct(
        core.alias("core"),
        F.when(take, F.filter(evidence, lambda x: ~is_source_line(x))).otherwise(evidence).alias("evidence"),
    )


# ---------------------------------------------------------------- items
def _softened(c: Column) -> Column:
    text = without_label(c)
    for old, new in fixed.SOFTENED_PHRASES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(strip(F.regexp_replace(text, pattern(r"\s{2,}"), " ")), pattern(r"\A[,.:;]\s*"), "")


def _item(c: Column) -> Column:
    text = F.regexp_replace(c, pattern(r"\A[-*•]\s*"), "")
    text = F.regexp_replace(text, pattern(r"(?i)\A(?:출처|source)\s*:\s*"), "")
    return strip(_softened(without_label(text)))


def _unique_items(values: Column) -> Column:
    return let(F.filter(F.transform(values, _item), lambda x: x != ""), _first_of_each)


def _first_of_each(lines: Column) -> Column:
    """Lines without later copies that differ only in case."""
    return let(
        F.transform(lines, F.lower),
        lambda keys: F.filter(lines, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1),
    )


def _numbers(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern(fixed.NUMERIC_MARKER_PATTERN)), F.lit(0))
    return F.array_distinct(F.transform(found, lambda m: F.lower(F.regexp_replace(m, pattern(r"\s+"), ""))))


def _labelled(c: Column) -> Column:
    return c.rlike(pattern(r"(?i)\A(근거|출처|source)\s*:"))


def _follow_up(primary: Column, evidence: Column) -> Column:
    """The first evidence item that adds to the first sentence: new words and numbers, a condition or its end."""
    unfinished = looks_incomplete(primary)

    def inside_of(a: Column, b: Column) -> Column:
        return (a != "") & (b != "") & (F.contains(b, a) | F.contains(a, b))

    def repeats(item: Column) -> Column:
        inside = let(match_key(primary), lambda a: let(match_key(item), lambda b: inside_of(a, b)))
        return (
            inside
            | (overlap_coefficient(tokens(primary), tokens(item)) >= 0.45)
            | (F.size(F.array_intersect(_numbers(primary), _numbers(item))) > 0)
        )

    def completed(item: Column) -> Column:
        ends = F.filter(
            evidence, lambda n: (n != item) & ~looks_incomplete(n) & starts_with_any(n, fixed.CONTINUATION_STARTS)
        )
        end = F.get(ends, F.lit(0))
        return F.when(~looks_incomplete(item), item).when(end.isNotNull(), strip(F.concat(item, F.lit(" "), end)))

    wanted = F.filter(
        evidence,
        lambda e: ~_labelled(e) & (unfinished | contains_any(F.lower(e), fixed.CONTEXT_MARKERS)) & ~repeats(e),
    )
    whole = F.filter(
        F.transform(wanted, lambda e: F.rtrim(completed(e), F.lit(",;: "))), lambda e: e.isNotNull() & (e != "")
    )
    return F.get(whole, F.lit(0))


def readable(answer: Column, guide: Column) -> Column:
    """An answer as plain sentences for the reader: the core, then points (guide) or one addition (concise)."""
    text = strip(F.replace(F.coalesce(answer, F.lit("")), F.lit("\r\n"), F.lit("\n")))

    def shape(t: Column) -> Column:
        kept = F.transform(
            _lines(t), lambda x: F.when(F.regexp_count(x, F.lit(r"\|")) >= 2, x).otherwise(strip(without_label(x)))
        )
        table = F.array_join(F.filter(kept, lambda x: x != ""), "\n")
        parts = let(_sections(_lines(t)), _arranged)
        plain = let(parts, lambda p: F.when(guide, _as_guide(p)).otherwise(_as_concise(p)))
        return F.when(t == "", F.lit("")).when(has_table(t), table).otherwise(strip(plain))

    return let(text, shape)


def _core(parts: Column, count: int, size: int) -> Column:
    items = F.slice(F.transform(_unique_items(parts["core"]), lambda x: trimmed(x, size)), 1, count)
    return let(items, lambda i: F.when(F.size(i) == 0, F.array(F.lit(fixed.NO_ANSWER))).otherwise(i))


def _as_guide(parts: Column) -> Column:
    points = F.slice(F.transform(_unique_items(parts["evidence"]), lambda x: trimmed(x, 240)), 1, 6)
    bullets = F.transform(F.filter(points, lambda p: ~_labelled(p)), lambda p: F.concat(F.lit("- "), p))
    return F.array_join(F.concat(F.slice(_core(parts, 3, 320), 1, 2), bullets), "\n")


def _as_concise(parts: Column) -> Column:
    evidence = F.slice(F.transform(_unique_items(parts["evidence"]), lambda x: trimmed(x, 320)), 1, 2)

    def with_follow(primary: Column) -> Column:
        follow = let(evidence, lambda e: _follow_up(primary, e))
        known = ~F.contains(primary, F.lit("확인되지 않습니다"))
        return let(
            F.when(known, follow), lambda f: F.when(f.isNull(), primary).otherwise(F.concat(primary, F.lit("\n"), trimmed(f, 320)))
        )

    return let(F.get(_core(parts, 2, 280), F.lit(0)), with_follow)


def compacted(answer: Column, guide: Column) -> Column:
    """The readable form without label lines, at most six different lines (guide) or two (concise)."""

    def cut(text: Column) -> Column:
        lines = F.filter(
            F.transform(_lines(text), lambda x: strip(collapse_spaces(x))),
            lambda x: ~x.rlike(pattern(fixed.ANSWER_LABEL_ONLY_PATTERN)),
        )

        def chosen(ls: Column) -> Column:
            different = _first_of_each(ls)
            short = F.transform(F.slice(ls, 1, 2), lambda x, i: F.when(i == 0, trimmed(x, 300)).otherwise(trimmed(x, 360)))
            return F.array_join(F.when(guide, F.slice(different, 1, 6)).otherwise(short), "\n")

        return let(lines, chosen)

    return let(readable(answer, guide), cut)


# ---------------------------------------------------------------- tone
def _polite_end(c: Column) -> Column:
    """A Korean clause end as a polite sentence end."""
    text = c
    stem = F.substring(text, F.lit(1), F.length(text) - 1)
    polite = (
        F.when(F.endswith(text, F.lit("함")), F.concat(stem, F.lit("합니다")))
        .when(F.endswith(text, F.lit("됨")), F.concat(stem, F.lit("됩니다")))
        .when(F.endswith(text, F.lit("가능")), F.concat(text, F.lit("합니다")))
        .when(F.endswith(text, F.lit("다")) & ~F.endswith(text, F.lit("니다")), F.concat(stem, F.lit("입니다")))
        .otherwise(F.concat(text, F.lit("입니다")))
    )
    open_end = text.rlike("[가-힣]$") & ~text.rlike(fixed.HONORIFIC_ENDINGS_PATTERN)
    return F.when(open_end, polite).otherwise(text)


def _stopped(c: Column) -> Column:
    return F.when((c == "") | c.rlike(r"[.!?]\z"), c).otherwise(F.concat(c, F.lit(".")))


def _polite_line(line: Column) -> Column:
    text = line
    for old, new in fixed.HONORIFIC_PHRASES:
        text = F.replace(text, F.lit(old), F.lit(new))
    for ending, polite in fixed.HONORIFIC_CONNECTIVES:
        text = F.regexp_replace(text, ending + r"\z", polite)

    def ended(t: Column) -> Column:
        bullet = F.startswith(t, F.lit("- "))
        as_bullet = let(
            strip(F.substring(t, 3, 1_000_000_000)),
            lambda c: F.when(c == "", t).otherwise(F.concat(F.lit("- "), let(_polite_end(c), _stopped))),
        )
        return F.when(bullet, as_bullet).otherwise(let(_polite_end(t), _stopped))

    return let(text, ended)


def polite(answer: Column) -> Column:
    """Every line of an answer with a polite ending and a full stop."""
    lines = F.filter(
        F.transform(F.split(strip(F.coalesce(answer, F.lit(""))), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), strip), lambda x: x != ""
    )
    return strip(F.array_join(F.transform(lines, _polite_line), "\n"))
