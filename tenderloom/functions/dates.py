"""Dates as they occur in notice tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions.text import collapse_spaces, contains_any, let, strip

# One numeric date with one separator throughout, and an optional time.
_NOTICE_DATE = r"^(\d{4})([-./])(\d{1,2})\2(\d{1,2})(?: (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?$"


def notice_datetime(c: Column) -> Column:
    """`yyyy-MM-dd`, with `HH:mm` unless it is midnight; text in no known form passes through."""
    spaced = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(""))
    return let(strip(collapse_spaces(spaced)), _known_datetime)


def _known_datetime(text: Column) -> Column:
    dashed = F.concat(F.translate(F.substring(text, 1, 10), "./", "--"), F.substring(text, F.lit(11), F.length(text)))
    # A timestamp without zone prints as its own digits, whatever the time zone of the session is.
    moment = F.when(text.rlike(_NOTICE_DATE), dashed.try_cast("timestamp_ntz")).cast("string")
    midnight = F.substring(moment, 12, 5) == "00:00"
    return F.when(moment.isNull(), text).when(midnight, F.substring(moment, 1, 10)).otherwise(F.substring(moment, 1, 16))


def notice_date_label(c: Column) -> Column:
    return F.coalesce(F.nullif(notice_datetime(c), F.lit("")), F.lit("정보 없음"))


def date_in_text(c: Column) -> Column:
    """The first y-m-d, y.m.d or y/m/d in a text; null if there is none or it is no date."""
    found = F.regexp_extract(c, r"\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}", 0)
    return F.translate(found, "./", "--").try_cast("date")


def asks_for_time(normalized: Column) -> Column:
    return contains_any(normalized, fixed.TIME_QUERY_WORDS)


def asks_for_vat(normalized: Column) -> Column:
    return contains_any(normalized, fixed.VAT_QUERY_WORDS)


def datetime_answer(c: Column, normalized_query: Column) -> Column:
    """A date for an answer; with a 12-hour Korean time when the question asks for the time."""
    return let(notice_datetime(c), lambda value: _spoken(value, normalized_query))


def _spoken(value: Column, normalized_query: Column) -> Column:
    hour = F.regexp_extract(value, r"^\d{4}-\d\d-\d\d (\d\d):(\d\d)$", 1).try_cast("int")
    minute = F.regexp_extract(value, r"^\d{4}-\d\d-\d\d (\d\d):(\d\d)$", 2).try_cast("int")
    twelve = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    spoken = F.concat(
        F.substring(value, 1, 10),
        F.when(hour < 12, F.lit(" 오전 ")).otherwise(F.lit(" 오후 ")),
        twelve.cast("string"),
        F.lit("시"),
        F.when(minute > 0, F.concat(F.lit(" "), minute.cast("string"), F.lit("분"))).otherwise(F.lit("")),
    )
    return F.when(asks_for_time(normalized_query) & hour.isNotNull(), spoken).otherwise(value)


def d_day(deadline: Column, today: Column) -> Column:
    return F.datediff(deadline, today)


def d_day_label(days: Column) -> Column:
    return (
        F.when(days.isNull(), F.lit("-"))
        .when(days < 0, F.concat(F.lit("D+"), F.abs(days).cast("string")))
        .otherwise(F.concat(F.lit("D-"), days.cast("string")))
    )


def urgency(days: Column) -> Column:
    return (
        F.when(days.isNull(), F.lit(fixed.URGENCY_UNKNOWN))
        .when(days < 0, F.lit(fixed.URGENCY_CLOSED))
        .when(days <= 3, F.lit(fixed.URGENCY_3_DAYS))
        .when(days <= 7, F.lit(fixed.URGENCY_7_DAYS))
        .otherwise(F.lit(fixed.URGENCY_LATER))
    )


def default_deadline(open_date: Column) -> Column:
    return F.date_add(open_date, fixed.DEADLINE_AFTER_OPEN_DAYS)
