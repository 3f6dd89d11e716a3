"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample.

Every rule is a Boolean expression over a text that is true if the text is rejected. On a sample of bounded size the
cascade measures each rule's selectivity and time, sorts the rules by rejections per second, and becomes one CASE
expression: a text stops at the first rule that rejects it, later rules are not evaluated. The order changes the cost
only; the verdict is the same in any order. Everything is a Spark SQL expression evaluated row by row, so there is no
shuffle and no group of any size.

Null texts count as empty and have no words; the measures are then 0. Repeated rows are judged one by one. Extra columns
are kept out of the result, whatever they are called.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.text import let
from tenderloom.llm.common import BLANK, text_of, words_of
from tenderloom.session import frozen

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
SAMPLE_ROWS = 4000


def symbol_count(text: Column) -> Column:
    return (F.size(F.split(text, SYMBOLS)) - 1).cast("long")


def filled_lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    return let(filled_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more. Sorts the windows once: no pairs are compared."""

    def twice(ranked: Column) -> Column:
        def is_repeated(x: Column, i: Column) -> Column:
            before, after = F.get(ranked, i - 1)["h"], F.get(ranked, i + 1)["h"]
            return x["h"].eqNullSafe(before) | x["h"].eqNullSafe(after)

        places = F.sort_array(F.transform(F.filter(ranked, is_repeated), lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(p, i - 1)))),
            F.lit(0), lambda total, x: total + x,
        ))

    return let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice)


def repeated_words(words: Column) -> Column:
    """Words in five-word windows that are found twice or more in the text, the first place included."""
    last = F.size(words) - F.lit(WINDOW)
    windows = F.when(last < 1, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    )
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w)).cast("long"))


def base_measures(text: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    return let(words_of(text), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        symbol_count(text).alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
    ))


def word_count(text: Column) -> Column:
    return F.size(words_of(text))


def standard_rules() -> dict:
    """name -> rejecting expression of a text."""
    return {
        # over one symbol in ten words
        "symbols": lambda t: symbol_count(t) * 10 > word_count(t),
        # over half of the lines seen before
        "duplicate_lines": lambda t: let(filled_lines(t), lambda lines: F.size(F.array_distinct(lines)) * 2 < F.size(lines)),
        # words of fewer than 2.5 or more than 15 characters on average
        "word_length": lambda t: let(
            F.char_length(F.regexp_replace(t, BLANK, "")), lambda n: let(word_count(t), lambda k: (n * 2 < k * 5) | (n > k * 15))
        ),
        # under 40 % of the words have a letter
        "letters": lambda t: let(words_of(t), lambda w: F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))) * 10 < F.size(w) * 4),
        # over 30 % of the words are the word before them again
        "stutters": lambda t: let(words_of(t), lambda w: F.size(F.filter(w, lambda x, i: x.eqNullSafe(F.get(w, i - 1)))) * 10 > F.size(w) * 3),
        # nine in ten lines are list items
        "bullets": lambda t: let(filled_lines(t), lambda lines: F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-•*‣]"))) * 10 > F.size(lines) * 9),
        # a third of the lines end in an ellipsis
        "ellipses": lambda t: let(filled_lines(t), lambda lines: F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))) * 3 > F.size(lines)),
    }


def measured_order(docs: DataFrame, rules: dict, text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """The rules with their sample rejection share, seconds and rank, best first. An empty table keeps the given order."""
    texts = docs.select(text_of(text_column).alias("text"))
    rows = texts.count()
    sample = frozen(texts.sample(fraction=min(1.0, sample_rows / max(rows, 1)), seed=7))

    def timed(measure: Column) -> tuple[float, int, int]:
        began = time.perf_counter()
        got = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(measure), F.lit(0)).alias("v")).first()
        return time.perf_counter() - began, got["n"], int(got["v"])

    timed(F.char_length("text"))
    floor, n, _ = timed(F.char_length("text"))
    found = []
    for name, rule in rules.items():
        seconds, _, rejected = timed(F.coalesce(rule(F.col("text")), F.lit(False)).cast("int"))
        cost = max(seconds - floor, 1e-3)
        found.append({"rule": name, "rejects": rejected / max(n, 1), "seconds": cost, "rank": rejected / max(n, 1) / cost})
    return sorted(found, key=lambda x: -x["rank"])


def first_failure(text: Column, rules: dict, order: list[dict]) -> Column:
    """The name of the first rule of the order that rejects the text, null if none does."""
    verdict = F.lit(None).cast("string")
    for step in reversed(order):
        verdict = F.when(F.coalesce(rules[step["rule"]](text), F.lit(False)), F.lit(step["rule"])).otherwise(verdict)
    return verdict


def judged(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: dict | None = None) -> DataFrame:
    """doc_id, the base measures, base_failed and kept: a text that passes the base limits goes through the cascade."""
    rules = standard_rules() if rules is None else rules
    order = measured_order(docs, rules, text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    rows = rows.select("doc_id", "text", base_measures(F.col("text")).alias("m"))
    failed = (F.col("m.n_words") < 10) | (F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * 20)
    kept = F.when(failed, F.lit(False)).otherwise(first_failure(F.col("text"), rules, order).isNull())
    return rows.select("doc_id", "m.*", failed.alias("base_failed"), kept.alias("kept"))
