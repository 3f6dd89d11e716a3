"""Mixing sources to target weights by Poisson replication.

A source of n documents that shall make up the share w of a mixture of N documents is repeated at the rate N * w / n.
Every document draws its number of copies from the Poisson distribution with that mean, by inverting the distribution at
a number in [0, 1) that a hash of seed and document id gives. The draw depends on nothing but these, so a task that is
run again draws the same. A rate over `STEP` is split into equal parts whose draws are added, which is the same
distribution and keeps the inverted table short. Documents are exploded by their counts and put in the order of a hash
of (seed, id, copy), which shuffles all sources through each other.

Source sizes come from one aggregate over all rows; the join back has one row per source on its other side. Null sources
form a source of their own. Null and empty texts are documents like any other. Rows that repeat an id draw the same
number and are all replicated. A null id draws like the text '\\N'. Sources without a target weight get none and their
documents go; a weight for an absent source is left out and the others are scaled up. An empty table gives an empty
mixture. Extra columns travel with their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.text import let
from tenderloom.session import frozen

STEP = 32.0
SEED = "mixture"


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _inverted(rate: Column, at: Column) -> Column:
    """The smallest k whose distribution function exceeds `at`. The table ends where nothing is left to double precision."""
    def table(r: Column) -> Column:
        ks = F.sequence(F.lit(1), (F.ceil(r + F.sqrt(r) * 12) + 24).cast("int"))
        start = F.struct(F.exp(-r).alias("p"), F.exp(-r).alias("c"), F.when(F.exp(-r) > at, 0).otherwise(1).cast("long").alias("n"))

        def step(acc: Column, k: Column) -> Column:
            p = acc["p"] * r / k
            return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), (acc["n"] + F.when(acc["c"] + p > at, 0).otherwise(1)).cast("long").alias("n"))

        return F.aggregate(ks, start, step, lambda acc: acc["n"])

    return let(rate, table)


def poisson_count(rate: Column, key: Column, seed: str) -> Column:
    """A Poisson draw with mean `rate` for each key."""
    parts = F.greatest(F.ceil(rate / F.lit(STEP)), F.lit(1)).cast("int")
    draws = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: _inverted(rate / parts, _unit(F.lit(seed), key, j.cast("string"))))
    return F.when(rate <= 0, F.lit(0).cast("long")).otherwise(F.aggregate(draws, F.lit(0).cast("long"), lambda a, x: a + x))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None,
                 power: float = 0.5, source_column: str = "source") -> DataFrame:
    """source, n_source, weight, rate. Without given weights a source weighs its size to the `power`."""
    sizes = frozen(docs.groupBy(F.col(source_column).alias("source")).agg(F.count(F.lit(1)).alias("n_source")))
    if weights is None:
        raw = F.pow(F.col("n_source").cast("double"), F.lit(power))
    else:
        raw = F.lit(0.0)
        for name, weight in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(raw)
    sizes = sizes.withColumn("raw", raw)
    sums = sizes.agg(F.sum("raw").alias("w"), F.sum("n_source").alias("n")).first()
    wanted = float(total if total is not None else sums["n"] or 0)
    weight = F.col("raw") / F.lit(sums["w"] or 1.0)
    # rounded, so that the order of the sum above cannot move a draw
    return frozen(sizes.select("source", "n_source", F.round(weight, 12).alias("weight"), F.round(weight * wanted / F.col("n_source"), 9).alias("rate")))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: str = SEED,
          id_column: str = "doc_id", source_column: str = "source", carry: list[str] | None = None, tell: bool = True) -> DataFrame:
    """The mixture: the carried columns (by default all) of every copy and, with `tell`, _copy (from 1), _copies, _weight, _order.

    Partitions are ranges of the order, each sorted, so the rows as they are stored are shuffled globally.
    """
    rates = source_rates(docs, weights, total, source_column=source_column)
    rates = rates.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"), F.col("weight").alias("_weight"))
    key = F.coalesce(F.col(id_column).cast("string"), F.lit("\\N"))
    # the carried columns travel as one struct, so that none can clash with those added here
    drawn = docs.select(F.struct(*(carry or docs.columns)).alias("_row"), key.alias("_key"), F.col(source_column).alias("_own"))
    drawn = drawn.join(rates, F.col("_own").eqNullSafe(F.col("_source"))).withColumn("_copies", poisson_count(F.col("_rate"), F.col("_key"), seed))
    copies = drawn.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("_key"), F.col("_copy").cast("string")).cast("binary"))
    out = copies.select("_row", "_copy", "_copies", "_weight", order.alias("_order")).repartitionByRange("_order").sortWithinPartitions("_order")
    return out.select("_row.*", *(["_copy", "_copies", "_weight", "_order"] if tell else []))
