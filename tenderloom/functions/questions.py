"""Rules that read a question. Columns named `q` are expected in NFKC form and lower case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions.names import standard_org
from tenderloom.functions.text import (
    WS,
    collapse_spaces,
    contains_any,
    ends_with_any,
    json_object,
    let,
    matches,
    starts_with_any,
    strip,
    token_count,
)


# ---------------------------------------------------------------- hardness and search mode
def org_like_count(question: Column) -> Column:
    """How many parts of the text before 에서 look like organisations."""
    head = F.split_part(strip(question), F.lit("에서"), F.lit(1))
    parts = F.transform(
        F.split(head, rf"{WS}+(?:과|와|및){WS}+", -1),
        lambda p: strip(F.regexp_replace(p, r"[\"'“”‘’\[\]{}()]", "")),
    )
    return F.size(
        F.filter(
            parts,
            lambda p: (F.length(p) >= 3)
            & (p.rlike(fixed.ORG_SUFFIX_PATTERN) | starts_with_any(p, fixed.ORG_PREFIXES)),
        )
    )


def hardness(question: Column) -> Column:
    """Difficulty points from length, tokens, wording, connectives and named organisations."""
    return let(strip(F.coalesce(question, F.lit(""))), _hardness)


def _hardness(text: Column) -> Column:
    count = token_count(text)
    complex_wording = matches(text, fixed.COMPLEX_QUERY_PATTERN)

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, F.lit(n)).otherwise(F.lit(0))

    total = (
        points(F.length(text) >= 45, 1)
        + points(F.length(text) >= 80, 1)
        + points(count >= 10, 1)
        + points(count >= 16, 1)
        + points(complex_wording, 2)
        + points(F.regexp_count(text, F.lit(fixed.CONNECTOR_PATTERN)) >= 2, 1)
        + points(org_like_count(text) >= 2, 2)
        - points(matches(text, fixed.FACTOID_QUERY_PATTERN) & (count <= 12) & ~complex_wording, 2)
    )
    return F.when(text == "", F.lit(0)).otherwise(total)


def search_mode(question: Column, threshold: int = fixed.HARD_THRESHOLD) -> Column:
    """Hard questions are searched by vectors only, the others by vectors and words."""
    return F.when(hardness(question) >= max(1, threshold), F.lit("chroma")).otherwise(F.lit("hybrid"))


# ---------------------------------------------------------------- single predicates
def needs_original(q: Column) -> Column:
    return contains_any(q, fixed.ORIGINAL_PRIORITY_WORDS)


def about_budget(q: Column) -> Column:
    how_much = F.contains(q, F.lit("얼마"))
    amount = F.contains(q, F.lit("금액")) & contains_any(q, fixed.BUDGET_AMOUNT_WORDS)
    budget = F.contains(q, F.lit("예산")) & (
        matches(q, fixed.BUDGET_TOPIC_PATTERN) | (how_much & ~F.contains(q, F.lit("예산회계")))
    )
    return contains_any(q, fixed.BUDGET_HARD_WORDS) | amount | budget


def accuracy_mode(mode: Column) -> Column:
    return F.coalesce(F.lower(strip(mode)).isin(fixed.ACCURACY_MODES), F.lit(False))


def precise_fact(q: Column) -> Column:
    return matches(q, fixed.PRECISION_CODE_PATTERN) | contains_any(q, fixed.PRECISION_WORDS)


def compares(q: Column) -> Column:
    doc_a, doc_b = matches(q, fixed.COMPARE_DOC_A_PATTERN), matches(q, fixed.COMPARE_DOC_B_PATTERN)
    each = F.contains(q, F.lit("각각")) & (contains_any(q, fixed.COMPARE_EACH_WORDS) | doc_a | doc_b)
    return (
        matches(q, fixed.COMPARE_PATTERN) | contains_any(q, fixed.COMPARE_STRONG_WORDS) | (doc_a & doc_b) | each
    )


def single_document(q: Column, orgs: Column | None = None) -> Column:
    many_orgs = F.lit(False) if orgs is None else orgs >= 2
    return (q != "") & ~compares(q) & ~many_orgs & ~contains_any(q, fixed.MULTI_DOC_WORDS)


def implicit_follow_up(q: Column) -> Column:
    text = strip(q)
    short_request = (F.length(text) <= 12) & ends_with_any(text, fixed.FOLLOW_UP_ENDINGS)
    return (
        (text != "")
        & ~contains_any(text, fixed.FRESH_QUERY_WORDS)
        & (contains_any(text, fixed.FOLLOW_UP_SLOTS) | short_request)
    )


def project_phrase(q: Column) -> Column:
    return contains_any(q, fixed.PROJECT_WORDS)


def owner_evidence(text: Column) -> Column:
    ahead = fixed.OWNER_RIGHTS + fixed.OWNER_GAP + fixed.OWNER_DUTIES
    behind = fixed.OWNER_DUTIES + fixed.OWNER_GAP + fixed.OWNER_RIGHTS
    return matches(text, ahead) | matches(text, behind)


def budget_evidence(text: Column) -> Column:
    return contains_any(text, fixed.BUDGET_EVIDENCE_WORDS) & matches(text, fixed.BUDGET_VALUE_PATTERN)


# ---------------------------------------------------------------- intent
def org_in_question(question: Column) -> Column:
    """Organisation named in a question: a known alias, else the first of the name endings that occurs."""
    found = F.when(contains_any(question, fixed.ORG_ALIASES), standard_org(question))
    for ending in fixed.ORG_NAME_ENDINGS:
        # The plain search spares most questions the pattern.
        present = F.contains(question, F.lit(ending)) & question.rlike(f"[가-힣]{ending}")
        found = found.when(present, F.regexp_extract(question, f"([가-힣]+{ending})", 1))
    return found


def _category(q: Column) -> Column:
    value = F.lit(None).cast("string")
    for name, words in reversed(fixed.CATEGORY_WORDS.items()):
        value = F.when(contains_any(q, words), F.lit(name)).otherwise(value)
    return F.when(contains_any(q, fixed.DISCOVERY_WORDS), value)


def intent(question: Column) -> Column:
    """Kind of question with its confidence: organisation, ranking, filter, category or search."""
    return let(
        org_in_question(question), lambda org: let(strip(F.lower(question)), lambda q: _intent(question, q, org))
    )


def _intent(question: Column, q: Column, org: Column) -> Column:
    category = _category(q)
    extreme = contains_any(q, fixed.RANK_EXTREME_WORDS) & contains_any(q, fixed.RANK_CONTEXT_WORDS)
    ranking = (
        matches(q, fixed.RANK_NUMBER_PATTERN)
        | contains_any(q, fixed.RANK_STRONG_WORDS)
        | extreme
        | contains_any(q, fixed.RANK_WORDS)
    ) & ~contains_any(q, fixed.RANK_BLOCKERS)
    in_range = matches(question, fixed.RANGE_PATTERNS[0]) | matches(question, fixed.RANGE_PATTERNS[1])
    bounded = contains_any(question, fixed.RANGE_WORDS)
    rank_order = (
        F.when(contains_any(q, fixed.RANK_DESC_WORDS), F.lit("desc"))
        .when(contains_any(q, fixed.RANK_ASC_WORDS), F.lit("asc"))
        .otherwise(F.lit(""))
    )
    none = F.array().cast("array<string>")

    def result(kind: str, confidence: float, org_name=None, order=None, categories=None) -> Column:
        return F.struct(
            F.lit(kind).alias("query_type"),
            (F.lit("") if org_name is None else org_name).alias("org_name"),
            (F.lit("") if order is None else order).alias("rank_order"),
            F.lit(None).cast("bigint").alias("amount_min"),
            F.lit(None).cast("bigint").alias("amount_max"),
            none.alias("qualifications"),
            (none if categories is None else categories).alias("categories"),
            question.alias("raw_query"),
            F.lit(confidence).alias("confidence"),
        )

    return (
        F.when(org.isNotNull(), result("org", 0.82, org_name=F.coalesce(org, F.lit(""))))
        .when(ranking, result("ranking", 0.95, order=rank_order))
        .when(in_range, result("filter", 0.8))
        .when(bounded, result("filter", 0.7))
        .when(category.isNotNull(), result("category", 0.82, categories=F.array(category)))
        .when(contains_any(q, fixed.SEARCH_SLOT_WORDS), result("search", 0.82))
        .otherwise(result("search", 0.6))
    )


def intents_conflict(q: Column) -> Column:
    """Whether a question carries marks of several intents, other than one organisation with one fact."""
    text = strip(q)
    has_org = matches(text, fixed.CONFLICT_ORG_PATTERN)
    has_fact = contains_any(text, fixed.CONFLICT_FACT_WORDS)
    marks = [
        matches(text, fixed.CONFLICT_RANK_PATTERN),
        matches(text, fixed.CONFLICT_RANGE_PATTERN),
        contains_any(text, fixed.CONFLICT_CATEGORY_WORDS),
        has_org,
        has_fact,
    ]
    count = sum((m.cast("int") for m in marks), F.lit(0))
    return (count > 1) & ~(has_org & has_fact & (count == 2))


def needs_model(q: Column, intent_column: Column) -> Column:
    """Whether the rule-based intent is unsure enough to ask a model."""
    confidence = intent_column["confidence"]
    unsure_search = (intent_column["query_type"] == "search") & (confidence < fixed.SEARCH_CONFIDENCE_REVIEW)
    return intents_conflict(q) | (confidence < fixed.INTENT_CONFIDENCE_REVIEW) | unsure_search


def model_intent(reply: Column, question: Column, fallback: Column) -> Column:
    """Intent from a model's JSON reply, its kind and confidence brought into range; the fallback if unreadable."""
    parsed = F.from_json(
        json_object(reply),
        "query_type string, org_name string, rank_order string, amount_min bigint, amount_max bigint,"
        " qualifications array<string>, categories array<string>, confidence string",
    )
    kind = F.lower(strip(F.coalesce(F.nullif(parsed["query_type"], F.lit("")), F.lit("search"))))
    confidence = F.coalesce(parsed["confidence"].try_cast("double"), F.lit(fixed.MODEL_DEFAULT_CONFIDENCE))
    none = F.array().cast("array<string>")
    built = F.struct(
        F.when(kind.isin(fixed.INTENT_TYPES), kind).otherwise(F.lit("search")).alias("query_type"),
        strip(F.coalesce(parsed["org_name"], F.lit(""))).alias("org_name"),
        strip(F.coalesce(parsed["rank_order"], F.lit(""))).alias("rank_order"),
        parsed["amount_min"].alias("amount_min"),
        parsed["amount_max"].alias("amount_max"),
        F.coalesce(parsed["qualifications"], none).alias("qualifications"),
        F.coalesce(parsed["categories"], none).alias("categories"),
        question.alias("raw_query"),
        F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
    )
    return F.when(parsed.isNotNull() & json_object(reply).isNotNull(), built).otherwise(fallback)


def settle_intent(rule: Column, model: Column) -> Column:
    """The model's intent if it is confident and by a margin more so than the rules."""
    bar = F.greatest(F.lit(fixed.MODEL_MIN_CONFIDENCE), rule["confidence"] + fixed.MODEL_MARGIN)
    return F.when(model["confidence"] >= bar, model).otherwise(rule)


def cache_key(q: Column) -> Column:
    return strip(collapse_spaces(q))


def signature(q: Column) -> Column:
    """Key of questions that differ only in word order and filler words."""
    found = F.regexp_extract_all(cache_key(q), F.lit("[0-9a-zA-Z가-힣]{2,}"), F.lit(0))
    kept = F.filter(found, lambda t: ~t.isin(fixed.SIGNATURE_STOPWORDS))
    chosen = F.when(F.size(kept) > 0, kept).otherwise(found)
    return F.array_join(F.slice(F.array_sort(F.array_distinct(chosen)), 1, fixed.SIGNATURE_TOKENS), "|")


# ---------------------------------------------------------------- question plan
def plan(question: Column, target_org: Column | None = None) -> Column:
    """What a question asks for and the slots an answer has to fill."""
    spaced = F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), WS + "+", " ")
    return let(spaced, lambda q: _plan(q, F.lit("") if target_org is None else target_org))


def _plan(q: Column, target_org: Column) -> Column:
    each = F.contains(q, F.lit("각각")) & contains_any(q, fixed.PLAN_COMPARE_EACH_WORDS)
    comparison = matches(q, fixed.COMPARE_PATTERN) | contains_any(q, fixed.PLAN_COMPARE_WORDS) | each
    several = contains_any(q, fixed.PLAN_MULTI_WORDS)
    for regex in fixed.PLAN_MULTI_PATTERNS:
        several = several | matches(q, regex)

    def result(kind: str) -> Column:
        return F.struct(
            F.lit(kind).alias("query_kind"),
            F.array(*[F.lit(s) for s in fixed.PLAN_SLOTS[kind]]).alias("required_slots"),
            F.lit(kind == "comparison").alias("is_comparison"),
            target_org.alias("target_org"),
        )

    return (
        F.when(comparison, result("comparison"))
        .when(contains_any(q, fixed.PLAN_OWNER_WORDS), result("owner"))
        .when(contains_any(q, fixed.PLAN_DEADLINE_WORDS), result("deadline"))
        .when(contains_any(q, fixed.PLAN_NUMERIC_WORDS), result("fact_numeric"))
        .when(several, result("multi_doc"))
        .otherwise(result("single_doc"))
    )


def follows_up(question: Column) -> Column:
    """Whether a question points back to the turn before it."""
    return contains_any(F.lower(question), fixed.FOLLOW_UP_WORDS)


def wants_document_text(question: Column) -> Column:
    """Summary questions that ask for the text of the document itself; short answers from tables do not serve them."""
    return (answer_style(question) == "guide") & contains_any(question, fixed.BODY_CHECK_WORDS)


def answer_style(question: Column, hint: Column | None = None) -> Column:
    given = F.lit("") if hint is None else F.lower(strip(F.coalesce(hint, F.lit(""))))
    q = strip(F.lower(F.coalesce(question, F.lit(""))))
    by_words = F.when(contains_any(q, fixed.DESCRIPTIVE_WORDS), F.lit("guide")).otherwise(F.lit("concise"))
    return F.when(given.isin("concise", "guide"), given).when(given == "descriptive", F.lit("guide")).otherwise(by_words)
