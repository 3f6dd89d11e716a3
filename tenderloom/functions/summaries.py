"""Summaries within a length, from whole sentences where possible."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions.text import WS, collapse_spaces, let, pattern, strip, strip_chars

_END = "[.!?。？！]\\z"


def _closed(text: Column) -> Column:
    return let(text, lambda t: F.when((t != "") & ~t.rlike(_END), F.concat(t, F.lit("."))).otherwise(t))


def _score(sentence: Column) -> Column:
    return (
        F.when(sentence.rlike(pattern(r"\d")), 3).otherwise(0)
        + F.regexp_count(sentence, F.lit(fixed.SUMMARY_KEYWORDS_PATTERN))
        + F.when(F.length(sentence).between(20, 110), 1).otherwise(0)
    )


def _sentence_choice(parts: Column, limit: int) -> Column:
    """The first sentence and, best score first, every other one that still fits; empty if the first is too long."""
    last_index = F.size(parts) - 1
    ranked = F.array_sort(
        F.transform(
            F.slice(parts, 2, F.greatest(last_index, F.lit(1))),
            lambda s, i: F.struct((-_score(s)).alias("cost"), (i + 1).cast("int").alias("at"), F.length(s).alias("size"),
                                  (~s.rlike(_END)).cast("int").alias("open")),
        )
    )
    first = F.get(parts, F.lit(0))
    start = F.struct(
        F.length(first).alias("size"), F.lit(0).alias("last"), (~first.rlike(_END)).cast("int").alias("open"),
        F.array(F.lit(0)).alias("chosen"),
    )

    def add(state: Column, s: Column) -> Column:
        total = state["size"] + 1 + s["size"]
        later = s["at"] > state["last"]
        ends_open = F.when(later, s["open"]).otherwise(state["open"])
        grown = F.struct(
            total.alias("size"), F.greatest(state["last"], s["at"]).alias("last"), ends_open.alias("open"),
            F.array_append(state["chosen"], s["at"]).alias("chosen"),
        )
        return F.when(total + ends_open <= limit, grown).otherwise(state)

    chosen = F.aggregate(ranked, start, add)["chosen"]
    text = F.array_join(F.transform(F.array_sort(chosen), lambda i: F.get(parts, i)), " ")
    return F.when(F.length(_closed(first)) <= limit, _closed(strip(text))).otherwise(F.lit(""))


def _clause_choice(first: Column, limit: int) -> Column:
    """Leading clauses of a sentence that fit together; empty if not even one does."""
    clauses = F.filter(
        F.transform(F.split(first, pattern(fixed.CLAUSE_SPLIT_PATTERN), -1), strip), lambda c: c != ""
    )
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(state: Column, clause: Column) -> Column:
        trial = F.when(state["text"] == "", clause).otherwise(F.concat(state["text"], F.lit(" "), clause))
        fits = ~state["full"] & (F.length(_closed(trial)) <= limit)
        return F.when(fits, F.struct(trial.alias("text"), F.lit(False).alias("full"))).otherwise(
            F.struct(state["text"].alias("text"), F.lit(True).alias("full"))
        )

    return _closed(F.aggregate(clauses, start, add)["text"])


def within_limit(c: Column, max_chars: int) -> Column:
    """Whole sentences up to the limit, else clauses of the first one, else words; always closed by an end mark."""
    limit = max(20, int(max_chars))

    def shorten(flat: Column) -> Column:
        found = F.filter(
            F.transform(F.split(flat, pattern(fixed.SUMMARY_SPLIT_PATTERN), -1), lambda s: strip_chars(s, " -•\t")),
            lambda s: s != "",
        )
        parts = let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(flat)))
        words = strip(F.regexp_replace(F.substring(flat, 1, limit), r"(?s) [^ ]*\z", ""))
        hard = _closed(let(words, lambda w: F.when(w != "", w).otherwise(strip(F.substring(flat, 1, limit)))))

        def by_clause(p: Column) -> Column:
            return let(_clause_choice(F.get(p, F.lit(0)), limit), lambda c: F.when(c != "", c).otherwise(hard))

        def by_sentence(p: Column) -> Column:
            return let(_sentence_choice(p, limit), lambda s: F.when(s != "", s).otherwise(by_clause(p)))

        return F.when(F.length(flat) <= limit, flat).otherwise(let(parts, by_sentence))

    return let(strip(collapse_spaces(F.coalesce(c, F.lit("")))), shorten)


def headline_and_points(answer: Column) -> Column:
    """An answer as a summary of its first two sentences and up to five points."""
    flat_sentences = F.filter(
        F.transform(
            F.split(strip(collapse_spaces(F.coalesce(answer, F.lit("")))), rf"(?<=[.!?]){WS}+", -1),
            lambda s: F.regexp_replace(strip(s), pattern(r"\A#{1,6}\s+"), ""),
        ),
        lambda s: s != "",
    )
    summary = let(
        F.slice(flat_sentences, 1, 2),
        lambda two: F.when(F.size(two) > 0, F.array_join(two, " ")).otherwise(F.lit("답변이 생성되지 않았습니다.")),
    )

    def heading(x: Column) -> Column:
        return F.regexp_replace(strip(x), pattern(r"\A#{1,6}\s+"), "")

    lines = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), "\n", -1), strip), lambda x: x != "")
    point = lambda x: (
        F.when(x.rlike(r"\A[-*]"), heading(F.ltrim(F.lit("-* "), x)))
        .when(F.startswith(x, F.lit("|")), F.lit(None).cast("string"))
        .when(F.startswith(x, F.lit("#")), F.when(F.length(heading(x)) > 2, heading(x)))
        .when(F.length(x) > 8, x)
    )
    points = F.slice(F.filter(F.transform(lines, point), lambda p: p.isNotNull()), 1, 5)
    return F.struct(summary.alias("summary"), points.alias("points"))
