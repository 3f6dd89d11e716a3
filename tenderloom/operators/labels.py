"""Matching ground-truth labels to the sources and chunks that exist now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.functions import names
from tenderloom.functions.text import collapse_spaces, contains_any, let, pattern, strip, strip_chars
from tenderloom.operators.ordered import top_per_group
from tenderloom.session import frozen


# ---------------------------------------------------------------- sources
def source_index(chunks: DataFrame, source: Column) -> DataFrame:
    """Distinct source values with the label and key they are found by. Expects NFKC names."""
    raw = chunks.select(strip(source).alias("raw")).filter("raw <> ''").distinct()
    return raw.select("raw", names.source_label(F.col("raw")).alias("label"), names.source_key(F.col("raw")).alias("key"))


GRAM = 3


def _grams(key: Column, n: int) -> Column:
    """The distinct runs of n characters of a key; none if it is shorter."""
    places = F.when(F.length(key) >= n, F.sequence(F.lit(1), F.length(key) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(key, i, n)))


def contained_in(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """label, raw for every wanted key (label, key, not empty) that is part of an index key (raw, key).

    A key that contains another contains each of its grams, so the two meet on one gram only: the one fewest index keys
    have. Both sides grow with the length of their keys, never with its square. Wanted keys shorter than a gram meet on
    themselves.
    """
    met = []
    for n in range(1, GRAM + 1):
        asked = wanted.filter(F.length("key") >= n if n == GRAM else F.length("key") == n).select("label", F.col("key").alias("part"), F.explode(_grams(F.col("key"), n)).alias("gram"))
        stored = index.select("raw", F.col("key").alias("whole"), F.explode(_grams(F.col("key"), n)).alias("gram"))
        if n == GRAM:
            common = stored.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
            # a gram no index key has settles it: the label is in none of them
            sized = asked.join(common, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            asked = sized.groupBy("label", "part").agg(F.min(F.struct("n", "gram")).alias("rarest")).filter("rarest.n > 0").select("label", "part", "rarest.gram")
        met.append(stored.join(asked, "gram").filter(F.contains("whole", "part")).select("label", "raw"))
    return met[0].unionByName(met[1]).unionByName(met[2])


def match_sources(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """Sources for each wanted label: by label, else by key, else the first three whose key contains it.

    `wanted`: label (distinct, not blank). Result: label, raw, level.
    """
    keyed = wanted.select("label", names.source_key(F.col("label")).alias("key"))
    by_label = keyed.join(index.select("label", "raw"), "label").select("label", "raw", F.lit(1).alias("level"))
    open_keys = keyed.join(by_label.select("label").distinct(), "label", "left_anti").filter("key <> ''")
    by_key = open_keys.join(index.select("key", "raw"), "key").select("label", "raw", F.lit(2).alias("level"))
    open_parts = open_keys.join(by_key.select("label").distinct(), "label", "left_anti")
    contained = contained_in(open_parts, index)
    by_part = top_per_group(contained, ["label"], [F.asc("raw")], 3).select("label", "raw", F.lit(3).alias("level"))
    return by_label.unionByName(by_key).unionByName(by_part)


# ---------------------------------------------------------------- scores
QUESTION_WEIGHT, ANSWER_WEIGHT, NUMBER_WEIGHT, PHRASE_WEIGHT = 1.8, 3.2, 1.4, 1.6


def label_text(normalized: Column) -> Column:
    return strip(collapse_spaces(F.lower(F.coalesce(normalized, F.lit("")))))


def label_tokens(text: Column) -> Column:
    """Distinct runs of two letters or more that are no stop words. Without lambdas, which Spark does not compile."""
    found = F.regexp_extract_all(text, F.lit(fixed.LABEL_TOKEN_PATTERN[:-1] + "{2,}"), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in fixed.LABEL_STOPWORDS]))


def label_numbers(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern(fixed.LABEL_NUMBER_PATTERN)), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(""))))


def expected_phrases(text: Column) -> Column:
    """Up to six informative phrases of an expected answer."""
    parts = F.transform(F.split(text, r"[,\n;:()]+", -1), lambda p: strip_chars(p, " -•\t"))
    kept = F.filter(parts, lambda p: (F.length(p) >= 8) & (F.size(label_tokens(p)) >= 2))
    return F.slice(F.array_distinct(kept), 1, 6)


def candidate_score(
    text: Column, have: Column, have_numbers: Column,
    question_tokens: Column, answer_tokens: Column, numbers: Column, phrases: Column,
) -> Column:
    """Struct of the score and its parts; `text` is normalised, `have` its tokens."""

    def share(wanted: Column) -> Column:
        return F.size(F.array_intersect(wanted, have)) / F.greatest(F.size(wanted), F.lit(1))

    ov_q, ov_e = share(question_tokens), share(answer_tokens)
    num_hit = F.size(F.array_intersect(numbers, have_numbers))
    phrase_hit = F.size(F.filter(phrases, lambda p: (p != "") & F.contains(text, p)))
    score = QUESTION_WEIGHT * ov_q + ANSWER_WEIGHT * ov_e + NUMBER_WEIGHT * num_hit + PHRASE_WEIGHT * F.least(phrase_hit, F.lit(2))
    empty = text == ""
    return F.struct(
        F.when(empty, F.lit(0.0)).otherwise(score).alias("score"),
        F.when(empty, F.lit(0.0)).otherwise(F.round(ov_q, 4)).alias("ov_q"),
        F.when(empty, F.lit(0.0)).otherwise(F.round(ov_e, 4)).alias("ov_e"),
        F.when(empty, F.lit(0)).otherwise(num_hit).alias("num_hit"),
        F.when(empty, F.lit(0)).otherwise(phrase_hit).alias("phrase_hit"),
    )


def acceptable(question: Column, query_type: Column, text: Column, parts: Column, numbers: Column) -> Column:
    """Rules a candidate has to pass besides its score: some overlap, and evidence fitting special questions."""
    least = F.when(F.lower(strip(query_type)) == "multi_doc", 0.02).otherwise(0.05)
    overlaps = (parts["ov_q"] + parts["ov_e"] >= least) | (parts["phrase_hit"] > 0)
    guide = ~contains_any(question, fixed.LABEL_GUIDE_QUESTION) | contains_any(text, fixed.LABEL_GUIDE_TEXT)
    shape = F.contains(text, F.lit("mm")) | contains_any(text, fixed.LABEL_SIZE_TEXT) | text.rlike(
        pattern(fixed.LABEL_SIZE_PATTERN)
    )
    sized = ((F.size(numbers) == 0) | (parts["num_hit"] >= 2)) & shape
    return overlaps & guide & (~contains_any(question, fixed.LABEL_SIZE_QUESTION) | sized)


_RUN = fixed.LABEL_TOKEN_PATTERN
# All other characters as ranges: Java matches a negated class of these ranges ten times slower.
_OTHER = r"[\x00-/:-@\[-`{-\x{abff}\x{d7a4}-\x{10ffff}]"
_GAP = f"(?<={_RUN[:-1]}){_OTHER}+(?={_RUN[:-1]})"


# Each gap between two runs, with up to two letters before it and after it. Both patterns only go forward.
_BEFORE = f"{_RUN[:-1]}{{1,2}}{_OTHER}+(?={_RUN[:-1]})"
_AFTER = f"{_OTHER}+{_RUN[:-1]}{{1,2}}"


def _joints(text: Column) -> Column:
    """Where two runs of letters meet: what stands between them, once with two letters before it, once with two after it.

    A text that contains a phrase has the joints of the phrase, but for those `_sure_joints` leaves out.
    """
    inner = F.regexp_replace(text, f"^{_OTHER}+", "")
    before, after = F.regexp_extract_all(inner, F.lit(_BEFORE), F.lit(0)), F.regexp_extract_all(inner, F.lit(_AFTER), F.lit(0))
    return F.zip_with(before, after, lambda b, a: F.concat(b, a))


def _sure_joints(phrase: Column) -> Column:
    """The joints of a phrase that a text with it has, too.

    Joints with the first or last run are left out if that has one character, as it may be the rest of a longer run.
    """
    def joined(parts: Column) -> Column:
        runs, gaps = parts["runs"], parts["gaps"]
        joints = F.transform(gaps, lambda g, i: F.struct(i.alias("i"), F.concat(F.right(F.get(runs, i), F.lit(2)), g, g, F.left(F.get(runs, i + 1), F.lit(2))).alias("joint")))
        whole = lambda j: ((j["i"] > 0) | (F.length(F.get(runs, F.lit(0))) > 1)) & (
            (j["i"] < F.size(gaps) - 1) | (F.length(F.get(runs, F.size(runs) - 1)) > 1))
        return F.transform(F.filter(joints, whole), lambda j: j["joint"])

    found = [F.regexp_extract_all(phrase, F.lit(p), F.lit(0)) for p in (_RUN, _GAP)]
    return let(F.struct(found[0].alias("runs"), found[1].alias("gaps")), joined)


def _anchor(phrase: Column) -> Column:
    """The posting every text with the phrase has: the longest token inside it, or a joint if only its ends are tokens.

    A run of letters at either end of the phrase may be part of a longer one in the text; those between are whole.
    """
    runs = F.regexp_extract_all(phrase, F.lit(_RUN), F.lit(0))
    inner = F.when(F.size(runs) > 2, F.slice(runs, F.lit(2), F.size(runs) - 2)).otherwise(F.array().cast("array<string>"))
    tokens = F.filter(inner, lambda t: (F.length(t) >= 2) & ~t.isin(fixed.LABEL_STOPWORDS))

    def longest(keys: Column) -> Column:
        return F.array_max(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]

    return F.coalesce(F.concat(F.lit("t"), longest(tokens)), F.concat(F.lit("p"), longest(_sure_joints(phrase))))


def _weighted(kind: str, keys: Column, weight: Column | float, droppable: bool) -> Column:
    weight = F.lit(weight) if isinstance(weight, float) else weight
    return F.transform(keys, lambda k: F.struct(F.concat(F.lit(kind), k).alias("key"), weight.alias("weight"), F.lit(droppable).alias("droppable")))


def likely_pairs(prepared: DataFrame, read: DataFrame, min_score: float) -> DataFrame:
    """item_id, label, source, chunk_id of all pairs that can reach the score: a weighted prefix-filtered set join.

    What a pair scores with comes from tokens, numbers and phrases it shares. A posting is a (source, token) of a chunk,
    or a number, or the joint of two words; a phrase is looked up by its anchor. An item leaves out its commonest tokens as long as their weights
    together stay below the score; a pair that shares nothing else cannot reach it. The weights of the postings met, with
    what was left out, bound the score from above.
    """
    ids = ["item_id", "label", "source"]
    keys = F.concat(
        _weighted("t", F.col("__q"), QUESTION_WEIGHT / F.size("__q"), True), _weighted("t", F.col("__e"), ANSWER_WEIGHT / F.size("__e"), True),
        _weighted("n", F.col("__n"), NUMBER_WEIGHT, False), _weighted("", F.array_compact(F.transform("__p", _anchor)), PHRASE_WEIGHT, False))
    wanted = prepared.select(*ids, F.explode(keys).alias("k")).groupBy(*ids, "k.key").agg(F.sum("k.weight").alias("weight"), F.min("k.droppable").alias("droppable"))
    wanted = frozen(wanted)
    has = {"t": F.col("__t"), "n": F.col("__tn")}
    if not wanted.filter(F.col("key").startswith("p")).isEmpty():
        has["p"] = F.array_distinct(_joints(F.col("text")))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), keys.alias("keys")) for kind, keys in has.items()])
    postings = read.filter(F.col("chunk_id").isNotNull()).select("source", "chunk_id", F.explode(kinds).alias("k"))
    postings = postings.select("source", "chunk_id", "k.kind", F.explode("k.keys").alias("part")).select("source", "chunk_id", F.concat("kind", "part").alias("key"))
    # only what some item of the source asks for is kept
    postings = frozen(postings.join(wanted.select("source", "key").distinct(), ["source", "key"], "left_semi"))
    sizes = postings.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n"))
    commonest = Window.partitionBy(*ids).orderBy(F.desc("droppable"), F.desc("n"), F.asc("key")).rowsBetween(Window.unboundedPreceding, 0)
    summed = wanted.join(sizes, ["source", "key"]).withColumn("running", F.sum("weight").over(commonest))
    # a hair below, as sums of fractions differ in their last digits
    dropped = F.col("droppable") & (F.col("running") < min_score - 1e-9)
    left_out = F.max(F.when(dropped, F.col("running"))).over(Window.partitionBy(*ids))
    kept = summed.select(*ids, "key", "weight", dropped.alias("dropped"), F.coalesce(left_out, F.lit(0.0)).alias("left_out")).filter("NOT dropped")
    bound = F.sum("weight") + F.max("left_out")
    met = kept.join(postings, ["source", "key"]).groupBy(*ids, "chunk_id").agg(bound.alias("bound"))
    return met.filter(F.col("bound") >= min_score - 1e-6).select(*ids, "chunk_id")


def score_candidates(items: DataFrame, chunks: DataFrame, min_score: float = 0.0, fill: int = 2 * fixed.LABEL_PER_SOURCE) -> DataFrame:
    """Items with chunks of their sources, scored: every pair that reaches `min_score`, and some more.

    With a `min_score` of zero all pairs that score at all, and the first `fill` chunks of each source, so that the best
    `fill` / 2 of every label are there even if they score nothing.

    `items`: item_id, source, question, answer (normalised), query_type, and label if a label stands for several stored
    sources (else the source is the label). `chunks`: source, chunk_id, text (normalised); those without an id count in
    no list.
    """
    label = F.col("label") if "label" in items.columns else F.col("source")
    # written once, so that no expression over the arrays takes a text apart again for each of their elements
    prepared = frozen(items.select(
        "item_id", label.alias("label"), "source", "query_type", "question",
        label_tokens(F.col("question")).alias("__q"), label_tokens(F.col("answer")).alias("__e"),
        label_numbers(F.col("answer")).alias("__n"), expected_phrases(F.col("answer")).alias("__p"),
    ))
    def read(rows: DataFrame) -> DataFrame:
        return rows.select("source", "chunk_id", "text", label_tokens(F.col("text")).alias("__t"), label_numbers(F.col("text")).alias("__tn"))

    # the texts are normalised once, not anew for each list of parts and again for the pairs
    chunks = frozen(chunks.select("source", "chunk_id", "text"))
    ids = ["item_id", "label", "source"]
    pairs = likely_pairs(prepared, read(chunks), min_score)
    if min_score <= 0:
        first = top_per_group(chunks.select("source", "chunk_id").distinct(), ["source"], [F.asc("chunk_id")], fill).drop("rank")
        pairs = pairs.unionByName(prepared.select(*ids).join(first, "source")).distinct()
    pairs = frozen(pairs)
    # tokens are taken once per chunk, and only of chunks that are in a pair
    met = read(chunks.join(pairs.select("source", "chunk_id").distinct(), ["source", "chunk_id"], "left_semi"))
    rows = met.join(pairs, ["source", "chunk_id"]).join(prepared, ids)
    scored = rows.withColumn("parts", candidate_score(*[F.col(c) for c in ("text", "__t", "__tn", "__q", "__e", "__n", "__p")]))
    fits = acceptable(F.col("question"), F.col("query_type"), F.col("text"), F.col("parts"), F.col("__n"))
    return scored.select("item_id", "label", "source", "chunk_id", "parts.*", fits.alias("acceptable"))


def synchronised(items: DataFrame, chunks: DataFrame, targets: DataFrame, min_score: float = fixed.LABEL_MIN_SCORE) -> DataFrame:
    """New labels for items whose sources are named by labels: matched, scored and chosen in one plan.

    `items`: item_id, label, question, answer, query_type; one row for every label of an item. Otherwise as in
    `score_candidates` and `select_labels`.
    """
    wanted = items.select("label").filter(strip("label") != "").distinct()
    found = match_sources(wanted, source_index(chunks, F.col("source"))).select("label", F.col("raw").alias("source"))
    scored = score_candidates(items.join(found, "label"), chunks, min_score - 1e-6)
    return select_labels(scored.withColumn("score", F.round("score", 6)), targets, min_score)


def select_labels(scored: DataFrame, targets: DataFrame, min_score: float = fixed.LABEL_MIN_SCORE) -> DataFrame:
    """Chunks chosen as new labels: the best of every label, then the best of the rest up to the target number.

    `targets`: item_id, target_n. Only the twenty best of a label, over all its sources, are ever considered. Adds
    `pick`, the order.
    """
    best_first = [F.desc("score"), F.asc("chunk_id")]
    if "label" not in scored.columns:
        scored = scored.withColumn("label", F.col("source"))
    best = top_per_group(scored, ["item_id", "label"], best_first, fixed.LABEL_PER_SOURCE, "place")
    usable = best.filter(F.col("acceptable") & (F.col("score") >= min_score) & (strip("chunk_id") != ""))
    # A chunk counts once, as the head of a source if it is one.
    tier = F.when(F.col("place") == 1, 0).otherwise(1)
    once = top_per_group(
        usable.withColumn("tier", tier), ["item_id", "chunk_id"], [F.asc("tier"), F.desc("score")], 1, "__copy"
    ).drop("__copy")
    order = Window.partitionBy("item_id").orderBy(F.asc("tier"), *best_first)
    ranked = once.withColumn("pick", F.row_number().over(order)).join(targets, "item_id")
    return ranked.filter((F.col("tier") == 0) | (F.col("pick") <= F.col("target_n"))).drop("tier", "target_n", "place", "label")


def label_changes(items: DataFrame, selected: DataFrame) -> DataFrame:
    """Old and new labels of every item; items without a selection keep theirs.

    `items`: item_id, chunk_uids, chunk_orders. The new lists are as long as the target of the item.
    """
    order = names.trailing_index(F.col("chunk_id"))
    lists = selected.groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("pick", "chunk_id", order.alias("chunk_order")))).alias("s")
    )
    fresh = lists.select(
        "item_id",
        F.transform("s", lambda r: r["chunk_id"]).alias("new_uids"),
        F.array_distinct(F.array_compact(F.transform("s", lambda r: r["chunk_order"]))).alias("new_orders"),
    )
    joined = items.join(fresh, "item_id", "left")
    differs = ~(F.col("chunk_uids").eqNullSafe(F.col("new_uids")) & F.col("chunk_orders").eqNullSafe(F.col("new_orders")))
    return joined.select(
        "item_id",
        F.coalesce("new_uids", "chunk_uids").alias("chunk_uids"),
        F.coalesce("new_orders", "chunk_orders").alias("chunk_orders"),
        F.col("new_uids").isNull().alias("unresolved"),
        (F.col("new_uids").isNotNull() & differs).alias("changed"),
    )
