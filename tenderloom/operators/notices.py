"""Operators on tables of notices: filters, ranking, registry, reports."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions import amounts, dates, names
from tenderloom.functions.text import blank, first_non_blank, strip
from tenderloom.operators.ordered import row_numbers


# ---------------------------------------------------------------- filters
def matching(df: DataFrame, org: Column, project: Column, institution: str, keyword: str, regex: bool = True) -> DataFrame:
    """Notices of an institution with a keyword, ignoring case; nulls never match.

    Patterns are regular expressions as in a spreadsheet filter, or plain text with `regex=False`.
    """
    return df.filter(_hit(org, institution, regex) & _hit(project, keyword, regex))


def _hit(c: Column, text: str, regex: bool = True) -> Column:
    if not text:
        return F.lit(True)
    found = c.rlike("(?iu)" + text) if regex else F.contains(F.lower(c), F.lit(text.lower()))
    return F.coalesce(found, F.lit(False))


def relaxed_matching(
    df: DataFrame, org: Column, project: Column, institution: str, keyword: str, regex: bool = True
) -> DataFrame:
    """As `matching`; if no notice has the keyword, all notices of the institution. `match_level` is 0 or 1."""
    at_institution = df.filter(_hit(org, institution, regex))
    leveled = at_institution.withColumn("match_level", F.when(_hit(project, keyword, regex), 0).otherwise(1))
    if not institution:
        return leveled.filter("match_level = 0")
    best = leveled.agg(F.min("match_level").alias("best_level"))
    return leveled.join(F.broadcast(best), F.col("match_level") == F.col("best_level"), "left_semi")


def within_budget(df: DataFrame, budget: Column, low: float, high: float) -> DataFrame:
    """Budgets in a range; a budget below the known-from value counts as unknown and always stays."""
    known = F.when(budget >= fixed.BUDGET_KNOWN_FROM, budget)
    return df.filter(known.isNull() | known.between(low, high))


def urgent(df: DataFrame, days: Column) -> DataFrame:
    return df.filter(days.between(0, fixed.URGENT_DAYS))


def with_keyword(df: DataFrame, project: Column, org: Column, keyword: str, regex: bool = False) -> DataFrame:
    return df.filter(_hit(project, keyword, regex) | _hit(org, keyword, regex)) if keyword.strip() else df


def sorted_notices(df: DataFrame, by: str, tie: str = "notice_no") -> DataFrame:
    """Order of the notice list: deadline, budget, org or project; unknown values last."""
    orders = {
        "deadline": F.asc_nulls_last("d_day"),
        "budget": F.desc_nulls_last("budget"),
        "org": F.asc_nulls_last("org"),
        "project": F.asc_nulls_last("project"),
    }
    return df.orderBy(orders[by], F.asc(tie))


# ---------------------------------------------------------------- shapes
def bid_table(notices: DataFrame) -> DataFrame:
    """Notice rows as strings to the typed bid table; notices without a number are numbered by their row."""
    numbered = row_numbers(notices, [], ["row_num"], "__row")
    given = strip(F.coalesce("notice_no", F.lit("")))
    made = F.format_string("RFP-%03d", F.col("__row"))
    return numbered.select(
        F.when(given.isin("", "nan", "None"), made).otherwise(given).alias("notice_no"),
        strip(F.coalesce("project", F.lit(""))).alias("project"),
        strip(F.coalesce("org", F.lit(""))).alias("org"),
        F.col("amount").try_cast("double").try_cast("bigint").alias("budget"),
        dates.date_in_text(F.col("bid_end")).alias("deadline"),
    )


def registry_bid_table(registry: DataFrame) -> DataFrame:
    """The organisation registry as a bid table, numbered in name order, deadline 30 days after opening."""
    numbered = row_numbers(registry, [], ["name"], "__row")
    return numbered.select(
        F.format_string("RFP-%03d", F.col("__row")).alias("notice_no"),
        F.when(blank(F.col("project_name")), F.col("name")).otherwise(F.col("project_name")).alias("project"),
        F.col("name").alias("org"),
        F.when(F.col("amount_numeric") > 0, F.col("amount_numeric").cast("bigint")).alias("budget"),
        dates.default_deadline(dates.date_in_text(F.col("open_date"))).alias("deadline"),
    )


def file_bid_table(files: DataFrame) -> DataFrame:
    """A listing of document files (`file_name`) as a bid table without budgets and deadlines."""
    parts = names.org_and_project(F.col("file_name"))
    kind = F.when(F.lower("file_name").endswith(".hwp"), 0).when(F.lower("file_name").endswith(".hwpx"), 1).otherwise(2)
    numbered = row_numbers(files.withColumn("__kind", kind), [], ["__kind", "file_name"], "__row")
    return numbered.select(
        F.format_string("RFP-%03d", F.col("__row")).alias("notice_no"),
        parts["project"].alias("project"),
        parts["org"].alias("org"),
        F.lit(None).cast("bigint").alias("budget"),
        F.lit(None).cast("date").alias("deadline"),
    )


def first_usable_bid_table(
    registry: DataFrame | None, csv: DataFrame | None, files: DataFrame | None, spark: SparkSession | None = None
) -> DataFrame:
    """The registry if it knows any budget or deadline, else the CSV rows, else the file names, else a table without rows."""
    if registry is not None:
        table = registry_bid_table(registry)
        if not table.filter(F.col("budget").isNotNull() | F.col("deadline").isNotNull()).isEmpty():
            return table
    if csv is not None and not csv.isEmpty():
        return bid_table(csv)
    if files is not None:
        return file_bid_table(files)
    session = spark or SparkSession.active()
    return session.createDataFrame([], "notice_no string, project string, org string, budget bigint, deadline date")


def with_days_left(df: DataFrame, today: Column) -> DataFrame:
    """Days to the deadline with the labels shown for them and for the budget."""
    days = dates.d_day(F.col("deadline"), today)
    shown = F.when(F.col("budget") >= fixed.BUDGET_KNOWN_FROM, amounts.won(F.col("budget"))).otherwise("미확인")
    return df.select(
        "*",
        days.alias("d_day"),
        dates.urgency(days).alias("urgency"),
        dates.d_day_label(days).alias("d_day_label"),
        shown.alias("budget_label"),
        F.coalesce(F.col("deadline").cast("string"), F.lit("미확인")).alias("deadline_label"),
    )


def bid_metrics(df: DataFrame) -> DataFrame:
    """Row count, urgent count and the range of the known budgets."""
    known = F.when(F.col("budget") >= fixed.BUDGET_KNOWN_FROM, F.col("budget"))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("d_day").between(0, fixed.URGENT_DAYS)).alias("urgent"),
        F.coalesce(F.min(known), F.lit(0)).alias("budget_min"),
        F.coalesce(F.max(known), F.lit(5_000_000_000)).alias("budget_max"),
    )


# ---------------------------------------------------------------- top lists
def top_budgets(df: DataFrame, n: int = 3) -> DataFrame:
    """The n largest budgets with their rank, ties by notice number."""
    best = df.filter(F.col("budget").isNotNull()).orderBy(F.desc("budget"), F.asc("notice_no")).limit(n)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("budget"), F.asc("notice_no")))
    return best.withColumn("rank", rank)


def top_budget_lines(top: DataFrame) -> DataFrame:
    """The rows of the top-budget answer, one text per rank."""
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.col("project"), F.lit(" ("), F.col("org"), F.lit(")\n"),
        F.lit("   - 공고번호: "), F.col("notice_no"), F.lit(" | 사업비: "), amounts.budget_label(F.col("budget")),
        F.lit(" | 마감일: "), F.coalesce(F.col("deadline").cast("string"), F.lit("미확인")),
    )
    evidence = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.col("project"), F.lit(" | "), F.col("org"), F.lit(" | "),
        amounts.budget_label(F.col("budget")),
    )
    return top.select("rank", line.alias("line"), evidence.alias("evidence"))


def nearest_deadline(df: DataFrame, today: Column) -> DataFrame:
    """The notice whose deadline is next, today included."""
    open_notices = df.filter(F.col("deadline") >= today)
    return open_notices.orderBy(F.asc("deadline"), F.asc("notice_no")).limit(1)


def nearest_deadline_answer(nearest: DataFrame, today: Column) -> DataFrame:
    days = dates.d_day(F.col("deadline"), today).cast("string")
    text = F.concat(
        F.lit("**가장 마감이 임박한 공고**\n\n- 공고번호: "), F.col("notice_no"), F.lit("\n- 사업명: "), F.col("project"),
        F.lit("\n- 기관: "), F.col("org"), F.lit("\n- 사업비: "), amounts.budget_label(F.col("budget")),
        F.lit("\n- 마감일: "), F.col("deadline").cast("string"), F.lit(" (D-"), days, F.lit(")"),
    )
    return nearest.select("notice_no", text.alias("answer"))


def org_ranking(registry: DataFrame, top_n: int = fixed.DEFAULT_TOP_N, descending: bool = True) -> DataFrame:
    """Organisations with a known amount, largest or smallest first, ties in registration order."""
    order = F.desc("amount_numeric") if descending else F.asc("amount_numeric")
    return registry.filter("amount_numeric > 0").orderBy(order, F.asc("name")).limit(top_n)


# ---------------------------------------------------------------- registry
def merge_registry(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One row per organisation name: largest amount, first non-empty texts in arrival order, flags or-ed.

    Every aggregate has a map-side part, so an organisation with very many rows costs no extra.
    """
    named = rows.filter(~blank(F.col("name")))
    amount_first = F.struct(F.col("amount_numeric"), -F.col(order))

    def first_filled(c: str) -> Column:
        filled = F.when(F.coalesce(c, F.lit("")) != "", F.col(order))
        return F.coalesce(F.min_by(c, filled), F.lit("")).alias(c)

    return named.groupBy("name").agg(
        F.max_by("amount", amount_first).alias("amount"),
        F.max("amount_numeric").alias("amount_numeric"),
        *[first_filled(c) for c in ("project_name", "summary", "open_date", "file_format")],
        F.bool_or("has_pdf").alias("has_pdf"),
        F.bool_or("has_hwp").alias("has_hwp"),
    )


def index_stats(chunks: DataFrame) -> DataFrame:
    """Number of organisations, or of sources when no chunk names one, and of chunks."""
    org, source = F.nullif(strip("org"), F.lit("")), F.nullif(strip("source"), F.lit(""))
    counts = chunks.agg(
        F.count_distinct(org).alias("orgs"), F.count_distinct(source).alias("sources"), F.count("*").alias("chunks")
    )
    return counts.select(F.when(F.col("orgs") > 0, F.col("orgs")).otherwise(F.col("sources")).alias("orgs"), "chunks")


def project_list(df: DataFrame) -> DataFrame:
    """The list answer for every organisation as rows: a head line with the count, then one line per project.

    The lines stay rows, so that an organisation with very many projects is never gathered in one place.
    """
    def clean(c: str) -> Column:
        text = strip(c)
        return F.when(F.lower(text).isin("nan", "none", ""), F.lit(None)).otherwise(text)

    listed = df.select(clean("org").alias("org"), clean("project").alias("project"), "notice_no").filter(
        F.col("project").isNotNull() & F.col("org").isNotNull()
    )
    heads = listed.groupBy("org").agg(F.count("*").alias("n")).select(
        "org",
        F.lit(0).alias("line_kind"),
        F.lit("").alias("notice_no"),
        F.concat(F.lit("**"), F.col("org"), F.lit("** 진행 사업 — 총 "), F.col("n").cast("string"), F.lit("개")).alias("line"),
    )
    lines = listed.select("org", F.lit(1).alias("line_kind"), "notice_no", F.concat(F.lit("- "), F.col("project")).alias("line"))
    return heads.unionByName(lines)


def notice_answers(df: DataFrame, short_summary: Column, vat: Column | None = None) -> DataFrame:
    """Budget, schedule and summary answers of each notice.

    `short_summary` is the summary cut to its limit; `vat` the tax note found for the notice (by default the budget
    answer says that tax is included).
    """
    project, org = strip("project"), strip("org")
    amount = amounts.answer_amount(F.col("amount"))
    note = F.lit("VAT 포함") if vat is None else F.when(vat == "", F.lit("VAT 미확인")).otherwise(vat)
    start, end = strip(F.coalesce("bid_start", F.lit(""))), strip(F.coalesce("bid_end", F.lit("")))

    def or_missing(c: Column) -> Column:
        return F.when(c == "", F.lit("정보 없음")).otherwise(c)

    def when_given(c: Column, text: Column) -> Column:
        return F.when(c != "", text).otherwise(F.lit(""))

    budget = F.concat(F.lit("**"), project, F.lit("** ("), org, F.lit(")\n\n사업 금액: **"), amount, F.lit("** ("), note, F.lit(")"))
    schedule = F.concat(
        F.lit("**"), project, F.lit("**\n\n- 입찰 참여 시작일: **"), or_missing(start),
        F.lit("**\n- 입찰 참여 마감일: **"), or_missing(end), F.lit("**"),
    )
    summary = F.concat(
        F.lit("**"), project, F.lit("** ("), org, F.lit(")\n\n- 사업 금액: **"), amount, F.lit("**"),
        when_given(start, F.concat(F.lit("\n- 입찰 참여 시작일: "), start)),
        when_given(end, F.concat(F.lit("\n- 입찰 참여 마감일: "), end)),
        when_given(short_summary, F.concat(F.lit("\n\n**사업 요약:**\n"), short_summary)),
    )
    return df.select("notice_no", budget.alias("budget"), schedule.alias("schedule"), summary.alias("summary_answer"))


def evidence_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows behind a table answer: their file (or the table) and a short text."""
    return df.orderBy("row_num").limit(n).select(
        first_non_blank(F.col("file_name"), F.lit("data_list.csv")).alias("source"),
        F.lit(None).cast("int").alias("page"),
        F.concat_ws(" | ", F.coalesce("project", F.lit("")), F.coalesce("org", F.lit(""))).alias("text"),
    )


# ---------------------------------------------------------------- Markdown form
def notice_markdown(df: DataFrame, vat: Column) -> DataFrame:
    """Each notice row as a Markdown document with its metadata; `vat` is its tax note."""
    text = {c: F.coalesce(c, F.lit("")) for c in fixed.NOTICE_CSV_COLUMNS.values()}
    org = names.remove_josa(text["org"])
    summary = (
        F.when(text["summary"] == "", F.lit("사업 요약 정보가 없습니다."))
        .when(text["summary"].contains("- "), strip(F.replace(text["summary"], F.lit("- "), F.lit("\n- "))))
        .otherwise(text["summary"])
    )
    body = F.when(
        F.length(text["body"]) > fixed.TEXT_LIMIT,
        F.concat(F.substring(text["body"], 1, fixed.TEXT_LIMIT), F.lit("\n\n...(생략)")),
    ).otherwise(text["body"])

    def or_else(c: str, default: str) -> Column:
        return F.when(text[c] == "", F.lit(default)).otherwise(text[c])

    fields = {
        "org": org,
        "project": or_else("project", "사업명 없음"),
        "notice_no": or_else("notice_no", "정보 없음"),
        "notice_round": or_else("notice_round", "0"),
        "amount": amounts.notice_amount(text["amount"]),
        "open_date": dates.notice_date_label(text["open_date"]),
        "bid_start": dates.notice_date_label(text["bid_start"]),
        "bid_end": dates.notice_date_label(text["bid_end"]),
        "summary": summary,
        "file_format": F.when(text["file_format"] == "", F.lit("HWP")).otherwise(F.upper(text["file_format"])),
        "file_name": text["file_name"],
        "body": body,
    }
    return df.select(
        "row_num",
        fill_template(fixed.NOTICE_MARKDOWN, fields).alias("markdown"),
        org.alias("org_name"),
        text["project"].alias("project_name"),
        text["amount"].alias("amount"),
        summary.alias("summary"),
        text["file_name"].alias("filename"),
        text["file_format"].alias("file_format"),
        F.struct(
            text["notice_no"].alias("notice_num"),
            text["notice_round"].alias("notice_round"),
            text["amount"].alias("amount_raw"),
            text["open_date"].alias("open_date_raw"),
            text["bid_start"].alias("start_date_raw"),
            text["bid_end"].alias("end_date_raw"),
            vat.alias("vat_note"),
            vat.contains("포함").alias("vat_included"),
        ).alias("metadata"),
    )


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """A `{name}` template as one concatenation."""
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(fields[name])
    return F.concat(*parts)


def markdown_sections(df: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Sections of a Markdown text, cut at `## `, that are long enough to be kept."""
    sections = F.filter(
        F.split(F.col(markdown), "## ", -1), lambda s: F.length(strip(s)) > fixed.SECTION_MIN_LENGTH
    )
    return df.select("row_num", F.posexplode(sections).alias("section_no", "section"))


def payload_pairs(df: DataFrame, key: str, payload: str) -> DataFrame:
    """A map column as (key, value) rows without null, blank and `nan` values."""
    pairs = df.select(key, F.explode(payload).alias("item", "content"))
    return pairs.filter(F.col("content").isNotNull() & ~strip("content").isin("", "nan", "None"))


def saved_selection(selected: DataFrame, notices: DataFrame) -> DataFrame:
    """Selected notice numbers with the first notice row of that number."""
    first = notices.groupBy("notice_no").agg(F.min_by(F.struct(*notices.columns), "row_num").alias("n"))
    return selected.join(first, "notice_no").select("n.*")
