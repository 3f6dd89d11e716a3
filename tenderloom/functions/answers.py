"""Column forms of the answer checks: slots, confidence, uncertainty and the choice of a draft."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions.text import WS, contains_any, pattern, strip


def slot_fill_rate(slots: Column, answer: Column, spans: Column) -> Column:
    """Share of the required slots an answer fills; `spans` is the number of evidence spans. Expects NFKC text."""
    lowered = F.lower(answer)
    filled = {
        "value": answer.rlike(pattern(r"\d")),
        "unit": contains_any(answer, fixed.SLOT_UNITS),
        "owner": contains_any(lowered, fixed.SLOT_OWNER_WORDS),
        "docA_claim": contains_any(answer, fixed.SLOT_DOC_A_WORDS),
        "docB_claim": contains_any(answer, fixed.SLOT_DOC_B_WORDS),
        "comparison_point": contains_any(lowered, fixed.SLOT_COMPARE_WORDS),
        "evidence": spans > 0,
        "key_points": F.length(strip(answer)) >= fixed.SLOT_KEY_POINTS_LENGTH,
    }
    def asked(name: str) -> Column:
        return F.size(F.filter(slots, lambda s: s == name))

    total = sum((asked(name) * condition.cast("int") for name, condition in filled.items()), F.lit(0))
    return F.when(F.size(slots) == 0, (strip(answer) != "").cast("double")).otherwise(total / F.size(slots))


def confidence(slot_rate: Column, spans: Column, mode: Column) -> Column:
    bonus = F.when(mode == "extractive", 0.05).when(mode == "hybrid", 0.03).otherwise(0.0)
    raw = 0.35 + slot_rate * 0.45 + F.least(F.lit(0.2), spans * 0.06) + bonus
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 3)


def uncertain(answer: Column) -> Column:
    return (F.coalesce(answer, F.lit("")) == "") | contains_any(F.lower(answer), fixed.UNCERTAIN_SIGNALS)


def content_lines(answer: Column) -> Column:
    """Lines of an answer that carry content: no labels, no file lines. Expects NFKC text."""
    lines = F.transform(
        F.split(F.coalesce(answer, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1),
        lambda x: strip(F.regexp_replace(x, pattern(r"^\s*[-*•]\s*"), "")),
    )
    return F.filter(
        lines,
        lambda x: (x != "")
        & ~x.rlike(fixed.BRACKET_ONLY_PATTERN)
        & ~x.rlike(pattern(fixed.SOURCE_LABEL_PATTERN))
        & ~F.lower(x).rlike(pattern(fixed.NUMBERED_FILE_PATTERN)),
    )


def _content_tokens(lines: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.array_join(lines, " ")), F.lit("[0-9a-zA-Z가-힣]{2,}"), F.lit(0))
    return F.array_distinct(
        F.filter(found, lambda t: ~t.rlike(pattern(r"\A\d+\z")) & ~t.isin(fixed.DRAFT_STOP_TOKENS))
    )


def prefer_draft(
    summary_focus: Column,
    generated: Column,
    draft: Column,
    is_uncertain: Callable[[Column], Column] = uncertain,
    lines_of: Callable[[Column], Column] = content_lines,
) -> Column:
    """Whether the extracted draft should replace a generated summary that lost too much of it."""
    draft_text, text = strip(F.coalesce(draft, F.lit(""))), strip(F.coalesce(generated, F.lit("")))
    ours, theirs = lines_of(draft_text), lines_of(text)
    n_ours, n_theirs = F.size(ours), F.size(theirs)
    our_tokens, their_tokens = _content_tokens(ours), _content_tokens(theirs)
    share = F.size(F.array_intersect(our_tokens, their_tokens)) / F.greatest(F.size(our_tokens), F.lit(1))
    least_share = F.when(F.size(our_tokens) >= 6, 0.35).otherwise(0.25)
    joined_ours, joined_theirs = F.array_join(ours, " "), F.array_join(theirs, " ")
    numbers = F.array_distinct(
        F.filter(
            F.transform(
                F.regexp_extract_all(joined_ours, F.lit(r"\d{2,}(?:[.,]\d+)?"), F.lit(0)),
                lambda n: F.regexp_replace(n, "[^0-9]", ""),
            ),
            lambda n: F.length(n) >= 2,
        )
    )
    digits = F.regexp_replace(text, "[^0-9]", "")
    found = F.size(F.filter(numbers, lambda n: F.contains(digits, n)))
    our_length = F.length(F.regexp_replace(joined_ours, WS + "+", ""))
    their_length = F.length(F.regexp_replace(joined_theirs, WS + "+", ""))
    return (
        F.when(~summary_focus | (draft_text == ""), F.lit(False))
        .when(text == "", F.lit(True))
        .when(is_uncertain(text) & ~is_uncertain(draft_text), F.lit(True))
        .when(n_ours == 0, F.lit(False))
        .when(n_theirs == 0, F.lit(True))
        .when((n_ours >= 3) & (n_theirs <= 1), F.lit(True))
        .when((n_ours >= 4) & (n_theirs < F.greatest(F.lit(2), F.floor(n_ours / 2))), F.lit(True))
        .when((F.size(our_tokens) > 0) & (share < least_share) & (n_theirs < n_ours), F.lit(True))
        .when(
            (F.size(numbers) > 0) & (found < F.greatest(F.lit(1), F.floor((F.size(numbers) + 1) / 2))), F.lit(True)
        )
        .otherwise(their_length < F.greatest(F.lit(18), F.floor(our_length / 3)))
    )


def untagged(answer: Column) -> Column:
    """The text after the last final-answer tag."""
    out = answer
    for tag in reversed(fixed.FINAL_ANSWER_TAGS):
        out = F.when(F.contains(answer, F.lit(tag)), strip(F.substring_index(answer, tag, -1))).otherwise(out)
    return out


def in_context_rate(answer: Column, context: Column) -> Column:
    """Share of the sentences of an answer, cut at full stops, that occur in the context; 1 without sentences."""
    parts = F.filter(F.transform(F.split(answer, r"\.", -1), strip), lambda s: s != "")
    lowered = F.lower(context)
    inside = F.size(F.filter(parts, lambda s: F.contains(lowered, F.lower(s))))
    return F.when(F.size(parts) == 0, F.lit(1.0)).otherwise(inside / F.size(parts))


def hallucination_rate(answer: Column, context: Column) -> Column:
    return 1.0 - in_context_rate(answer, context)
