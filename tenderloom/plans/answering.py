"""A batch of questions to answers, cheap sources first.

The order of the stages follows the published description of the application; its own orchestration code is not
public, so names and texts of the short answers are ours.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions import amounts, answer_format, answers, dates, questions
from tenderloom.functions.names import trailing_index
from tenderloom.functions.text import blank, contains_any, nfkc, strip
from tenderloom.operators import notices as notice_ops
from tenderloom.operators import rerank
from tenderloom.operators.ordered import top_per_group
from tenderloom.session import frozen

Stage = Callable[[DataFrame], DataFrame]
ANSWER = ["query_id", "answer", "source_type", "answer_mode"]


def _once_each(rows: DataFrame, keys: Sequence[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with what `derive` makes of their keys, which it sees once per different combination; nulls are values too.

    `derive` keeps the keys, one row each, and names its columns unlike those of the rows.
    """
    made = derive(frozen(rows.select(*keys).distinct())).withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return rows.join(made, same).drop(*[f"__key_{k}" for k in keys])


def understood(asked: DataFrame) -> DataFrame:
    """Questions (query_id, question) with their normal form, intent and plan as columns. Equal questions are read once."""

    def rules(texts: DataFrame) -> DataFrame:
        rows = texts.withColumn("q", F.lower(nfkc(F.col("question"))))
        rows = rows.withColumn("intent", questions.intent(F.col("question")))
        return rows.withColumn("plan", questions.plan(F.col("question"), F.col("intent.org_name"))).select(
            "question", "q", F.col("intent.query_type").alias("query_type"), F.col("intent.org_name").alias("org"),
            F.col("intent.rank_order").alias("rank_order"), F.get("intent.categories", F.lit(0)).alias("category"), "intent.confidence",
            "plan.query_kind", "plan.required_slots", "plan.is_comparison",
        )

    return _once_each(asked.select("query_id", "question"), ["question"], rules)


def _answer(df: DataFrame, text: Column, source: str, mode: str) -> DataFrame:
    return df.select("query_id", text.alias("answer"), F.lit(source).alias("source_type"), F.lit(mode).alias("answer_mode"))


def blank_questions(asked: DataFrame) -> DataFrame:
    return _answer(asked.filter(blank(F.col("question"))), F.lit("질문을 입력해 주세요."), "none", "fixed")


def ranking_answers(registry: DataFrame, top_n: int = fixed.DEFAULT_TOP_N) -> Stage:
    """Ranking questions without a named organisation: one list per direction, looked up by it."""

    def answer(asked: DataFrame) -> DataFrame:
        lists = []
        for way in ("desc", "asc"):
            top = notice_ops.org_ranking(registry, top_n, way == "desc")
            # At most top_n rows.
            line = F.struct(F.col("amount_numeric"), F.concat("name", F.lit(": "), amounts.format_amount(F.col("amount_numeric"))).alias("line"))
            listed = F.array_sort(F.collect_list(line))
            ordered = F.reverse(listed) if way == "desc" else listed
            lists.append(top.agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("answer")).select(F.lit(way).alias("way"), "answer"))
        wanted = asked.filter("query_type = 'ranking'").withColumn("way", F.when(F.col("rank_order") == "asc", "asc").otherwise("desc"))
        return _answer(wanted.join(lists[0].unionByName(lists[1]), ["way"], "inner"), F.col("answer"), "csv", "extractive")

    return answer


def category_answers(notices: DataFrame, top_n: int = fixed.DEFAULT_TOP_N) -> Stage:
    """Category questions: the first notices whose project names a word of the category."""

    def answer(asked: DataFrame) -> DataFrame:
        lists = None
        for name, words in fixed.CATEGORY_WORDS.items():
            found = notices.filter(contains_any(F.lower("project"), words)).orderBy("row_num").limit(top_n)
            listed = F.array_sort(F.collect_list(F.struct("row_num", F.concat(F.lit("- "), "project", F.lit(" ("), "org", F.lit(")")).alias("line"))))
            one = found.agg(F.array_join(F.transform(listed, lambda r: r["line"]), "\n").alias("answer")).select(F.lit(name).alias("category"), "answer")
            lists = one if lists is None else lists.unionByName(one)
        wanted = asked.filter("query_type = 'category'")
        return _answer(wanted.join(lists.filter("answer <> ''"), ["category"], "inner"), F.col("answer"), "csv", "extractive")

    return answer


def notice_answers(notices: DataFrame) -> Stage:
    """Budget and date questions on one organisation, from its first notice that has the value."""

    def answer(asked: DataFrame) -> DataFrame:
        wanted = asked.filter((F.col("org") != "") & ~F.col("is_comparison"))
        budget = questions.about_budget(F.col("q"))
        deadline = (F.col("query_kind") == "deadline") & ~budget
        wanted = wanted.withColumn("slot", F.when(budget, "budget").when(deadline, "deadline")).filter("slot is not null")
        value = {"budget": F.col("amount").try_cast("double").isNotNull(), "deadline": ~blank(F.col("bid_end"))}
        first = notices.groupBy("org").agg(
            *[F.min_by(F.struct("project", "amount", "bid_end"), F.when(known, F.col("row_num"))).alias(slot) for slot, known in value.items()]
        )
        rows = wanted.join(first, ["org"], "inner")
        text = F.when(
            F.col("slot") == "budget",
            F.concat(F.col("budget.project"), F.lit("의 사업 금액은 "), amounts.answer_amount(F.col("budget.amount")), F.lit("입니다.")),
        ).otherwise(
            F.concat(F.col("deadline.project"), F.lit("의 마감일은 "), dates.datetime_answer(F.col("deadline.bid_end"), F.col("q")), F.lit("입니다."))
        )
        return _answer(rows.withColumn("__a", text).filter("__a is not null"), F.col("__a"), "csv", "extractive")

    return answer


def org_overviews(notices: DataFrame) -> Stage:
    """Questions for an overview of one organisation: the number of its notices and the sum of their budgets."""

    def answer(asked: DataFrame) -> DataFrame:
        wanted = asked.filter((F.col("org") != "") & ~F.col("is_comparison") & (questions.answer_style(F.col("question")) == "guide"))
        per_org = notices.groupBy("org").agg(F.count("*").alias("n"), F.sum(F.col("amount").try_cast("double").try_cast("bigint")).alias("total"))
        text = F.concat(
            F.col("org"), F.lit("은(는) 공고 "), F.col("n").cast("string"), F.lit("건, 확인된 사업 금액 합계 "),
            F.coalesce(amounts.won(F.col("total")), F.lit("미확인")), F.lit("입니다."),
        )
        return _answer(wanted.join(per_org, ["org"], "inner"), text, "csv", "extractive")

    return answer


def unless_text_is_wanted(stage: Stage, sure: Callable[[DataFrame], DataFrame] | None = None) -> Stage:
    """A short-answer stage that passes over questions for the document text.

    `sure` may name questions (query_id) whose table match is certain enough to answer them all the same.
    """

    def answer(asked: DataFrame) -> DataFrame:
        wanted = questions.wants_document_text(F.col("question"))
        if sure is None:
            return stage(asked.filter(~wanted))
        flagged = asked.join(sure(asked).select("query_id", F.lit(True).alias("__sure")), "query_id", "left")
        return stage(flagged.filter(~wanted | F.col("__sure").isNotNull()).drop("__sure"))

    return answer


def to_search_again(asked: DataFrame, hits: DataFrame, enough: int) -> DataFrame:
    """Questions whose search goes on: too few hits, or a question for an owner or a budget without evidence for it."""
    found = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = asked.join(found, "query_id", "left").join(rerank.evidence_flags(hits), "query_id", "left")
    few = F.coalesce("n", F.lit(0)) < enough
    owner = (F.col("query_kind") == "owner") & ~F.coalesce("has_owner", F.lit(False))
    budget = questions.about_budget(F.col("q")) & ~F.coalesce("has_budget", F.lit(False))
    return rows.filter(few | owner | budget).select(*asked.columns)


def extracted_answers(hits: DataFrame) -> Stage:
    """Budget questions answered from the amount named in the best hit that names one. `hits`: query_id, rank, text."""

    def answer(asked: DataFrame) -> DataFrame:
        wanted = asked.filter(questions.about_budget(F.col("q"))).select("query_id")
        found = hits.join(wanted, "query_id", "left_semi").withColumn("a", amounts.amount_in_text(F.col("text"))).filter("a.value > 0")
        best = top_per_group(found, ["query_id"], [F.asc("rank")], 1)
        return _answer(best, F.concat(F.lit("사업비는 "), F.col("a.label"), F.lit("입니다.")), "vector", "extractive")

    return answer


def with_institution(question: Column, institution: Column) -> Column:
    """The question with the institution of its filter before it, unless it names it already."""
    named = strip(F.coalesce(institution, F.lit("")))
    return F.when((named == "") | F.contains(question, named), question).otherwise(F.concat(named, F.lit(" "), question))


def adapted_hits(raw: DataFrame) -> DataFrame:
    """Search results of any origin in the form of the metrics: query_id, rank, source, page, score, content, chunk_id, chunk_index.

    `raw`: query_id, rank, and what is there of source, page, score, content or text, chunk_id, uid or id, chunk_index or
    chunk_order, and a metadata map with the same names. The first name with a value counts, the hit before its metadata.
    """
    metadata = F.col("metadata") if "metadata" in raw.columns else F.lit(None).cast("map<string,string>")

    def first(*names: str) -> Column:
        own = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in raw.columns]
        return F.coalesce(*own, *[F.nullif(F.try_element_at(metadata, F.lit(n)), F.lit("")) for n in names], F.lit(None).cast("string"))

    chunk = strip(first("chunk_id", "uid", "id"))
    chunk = F.nullif(chunk, F.lit(""))
    place = F.coalesce(first("chunk_index", "chunk_order").try_cast("int"), trailing_index(chunk).cast("int"))
    return raw.select(
        "query_id", "rank", F.coalesce(first("source", "source_file", "filename"), F.lit("unknown")).alias("source"), first("page").try_cast("int").alias("page"),
        F.coalesce(first("score").try_cast("double"), F.lit(0.0)).alias("score"), F.coalesce(first("content", "text"), F.lit("")).alias("content"),
        chunk.alias("chunk_id"), place.alias("chunk_index"),
    )


def not_found(asked: DataFrame) -> DataFrame:
    named = F.concat(F.lit("'"), F.col("org"), F.lit("' 관련 정보를 찾을 수 없습니다."))
    return _answer(asked, F.when(F.col("org") != "", named).otherwise(F.lit("관련 정보를 찾을 수 없습니다.")), "none", "fixed")


def first_answers(asked: DataFrame, stages: Sequence[Stage], costly: Sequence[Stage] = (), stored: bool = False) -> DataFrame:
    """The answer of the first stage that has one, for every question.

    The questions are written once, unless they are `stored`, so that their rules are not evaluated again in every stage. Cheap stages all see all
    questions, and one rank per question picks the first answer. A costly stage, one that calls a model, sees only what
    the stages before it left open; their answers are written first.
    """
    still_open, answered, tried = asked if stored else frozen(asked), None, None

    def first_of(found: DataFrame) -> DataFrame:
        return top_per_group(found, ["query_id"], [F.asc("__stage"), F.asc("answer")], 1, "__place").select(*ANSWER)

    for number, stage in enumerate(stages):
        if any(stage is c for c in costly) and tried is not None:
            done = frozen(first_of(tried))
            answered = done if answered is None else answered.unionByName(done)
            still_open, tried = frozen(still_open.join(done.select("query_id"), "query_id", "left_anti")), None
        found = stage(still_open).select(*ANSWER, F.lit(number).alias("__stage"))
        tried = found if tried is None else tried.unionByName(found)
    last = first_of(tried)
    return last if answered is None else answered.unionByName(last)


def contexts(hits: DataFrame, results: int = fixed.CONTEXT_RESULTS, chars: int = fixed.CONTEXT_CHARS) -> DataFrame:
    """The context of each question: its first hits, each cut to a length."""
    near = hits.filter(F.col("rank") <= results)
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, chars).alias("text"))))
    return near.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n\n").alias("context"))


def expanded(asked: DataFrame, expansions: Column, cap: int = fixed.EXPANSION_CAP) -> DataFrame:
    """Every question with itself and at most `cap` expansions as search texts, numbered as passes."""
    texts = F.concat(F.array(F.col("question")), F.slice(expansions, 1, cap))
    return asked.select("query_id", F.posexplode(F.array_distinct(texts)).alias("pass_no", "search_text"))


def scoped_or_global(scoped: DataFrame, everywhere: DataFrame, top_k: int) -> DataFrame:
    """Hits within the organisation first; questions that have too few are filled up from the global search."""
    return rerank.merge(scoped, everywhere, ["id"], top_k)


def finished(answered: DataFrame, asked: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Final payload: compact text, slot filling, confidence. `spans`: query_id, n_spans.

    What is equal in all that the form depends on is formed once.
    """
    rows = answered.join(asked.select("query_id", "question", "required_slots"), "query_id")
    rows = rows.withColumn("n_spans", F.lit(1)) if spans is None else rows.join(spans, "query_id", "left")
    # written first, as they are read twice
    rows = frozen(rows.withColumnRenamed("answer", "__found").withColumn("__count", F.coalesce("n_spans", F.lit(0))))

    def form(each: DataFrame) -> DataFrame:
        guide = questions.answer_style(F.col("question")) == "guide"
        each = each.withColumn("answer", nfkc(F.col("__found")))
        each = each.withColumn("answer", answer_format.compacted(F.col("answer"), guide))
        return each.withColumn("__rate", answers.slot_fill_rate(F.col("required_slots"), F.col("answer"), F.col("__count")))

    rows = _once_each(rows, ["__found", "question", "required_slots", "__count"], form)
    return rows.select(
        "query_id", "answer", "source_type", "answer_mode", F.round("__rate", 4).alias("slot_fill_rate"),
        answers.confidence(F.col("__rate"), F.col("__count"), F.col("answer_mode")).alias("confidence"),
    )


def usable(answered: DataFrame) -> DataFrame:
    return answered.filter(strip("answer") != "")
