"""Money: parsing, formatting and finding amounts in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions.text import let, matches, pattern, strip


def won(amount: Column) -> Column:
    return F.concat(F.format_number(amount, 0), F.lit("원"))


def format_amount(amount: Column) -> Column:
    """In units of 억 or 만 with the full figure in parentheses."""
    full = F.concat(F.lit(" 원 ("), won(amount), F.lit(")"))
    return (
        F.when(
            amount >= fixed.EOK,
            F.concat(F.lit("약 "), F.format_string("%.1f", amount / fixed.EOK), F.lit("억"), full),
        )
        .when(
            amount >= fixed.MAN,
            F.concat(F.lit("약 "), F.format_number(amount / fixed.MAN, 0), F.lit("만"), full),
        )
        .otherwise(won(amount))
    )


def parse_amount(c: Column) -> Column:
    """Thousands separators dropped, a number truncated to an integer, else all digit runs joined, else 0."""
    plain = strip(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit("")))
    number = plain.try_cast("double")
    digits = F.regexp_replace(plain, r"\D", "").try_cast("bigint")
    return F.coalesce(number.try_cast("bigint"), digits, F.lit(0).cast("bigint"))


def parse_budget_input(c: Column, default: int) -> Column:
    value = F.regexp_replace(c.cast("string"), pattern(r"[,\s원]"), "").try_cast("double").try_cast("bigint")
    return F.when(value >= 0, value).otherwise(F.lit(default).cast("bigint"))


def notice_amount(c: Column) -> Column:
    """Amount of a notice as shown in its Markdown; text that is no number passes through."""
    value = c.try_cast("double")
    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit("정보 없음"))
        .when(value.isNull(), c)
        .when(
            value >= fixed.EOK,
            F.concat(won(value), F.lit(" ("), F.format_string("%.2f", value / fixed.EOK), F.lit("억원)")),
        )
        .otherwise(won(value))
    )


def budget_label(c: Column) -> Column:
    return F.coalesce(won(c.try_cast("double").try_cast("bigint")), F.lit("미확인"))


def answer_amount(c: Column) -> Column:
    text = F.coalesce(strip(c), F.lit(""))
    return F.when(text == "", F.lit("정보 없음")).otherwise(
        F.coalesce(won(text.try_cast("double").try_cast("bigint")), c)
    )


def amount_in_text(c: Column) -> Column:
    """The first amount named in a document text: struct of its label and its value in won."""
    digits = [
        F.nullif(F.regexp_replace(F.regexp_extract(c, pattern(regex), 1), r"[,()]", ""), F.lit(""))
        for regex in fixed.AMOUNT_PATTERNS
    ]
    nothing = F.struct(F.lit("").alias("label"), F.lit(0).cast("bigint").alias("value"))
    number = F.regexp_extract(c, pattern(fixed.AMOUNT_UNIT_PATTERN), 1).try_cast("double")
    unit = F.regexp_extract(c, pattern(fixed.AMOUNT_UNIT_PATTERN), 2)
    in_units = let(
        number,
        lambda n: F.when(
            n.isNotNull(),
            F.struct(
                F.concat(n.cast("string"), unit, F.lit("원")).alias("label"),
                (n * F.when(unit == "억", fixed.EOK).otherwise(fixed.MAN)).cast("bigint").alias("value"),
            ),
        ),
    )

    def plain(value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(won(value).alias("label"), value.alias("value"))).otherwise(
            F.coalesce(in_units, nothing)
        )

    return let(F.coalesce(*digits).try_cast("bigint"), plain)


def vat_note(normalized: Column) -> Column:
    """Tax note of a text in NFKC lower case: included, then excluded, then exempt."""
    word, gap = fixed.VAT_WORD, fixed.VAT_GAP

    def near(other: str) -> Column:
        return matches(normalized, word + gap + other) | matches(normalized, other + gap + word)

    return (
        F.when(near(fixed.VAT_INCLUDED_WORD), F.lit("부가가치세 포함"))
        .when(near(fixed.VAT_EXCLUDED_WORD), F.lit("부가가치세 별도"))
        .when(F.contains(normalized, F.lit("면세")) & matches(normalized, word), F.lit("부가가치세 면세"))
        .otherwise(F.lit(""))
    )
