"""Ordered operations over groups of any size.

A window function sorts a whole group in one task. These forms cut the rows once into ranges of (keys, order), store
them with their range numbers, work on each range by itself, and add the totals of the ranges before it. Sums are added
as decimals, so the result does not depend on the cuts. Row numbers need no ranges for groups that a task can hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.session import frozen, setting

_RANGE = "__range"
BLOCK_ROWS = 100_000
# Sums of fractions: nine decimals, nineteen digits before them.
_EXACT = "decimal(28,9)"


def _with_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The stored rows with the number of their range; a range ends where its task ends, within a group or not."""
    return frozen(df.repartitionByRange(*keys, *order).withColumn(_RANGE, F.spark_partition_id()))


def _totals_before(df: DataFrame, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Sums of the measures over all earlier ranges of the group: one small row per group and range."""
    by_range = df.groupBy(*keys, _RANGE).agg(*[m.alias(name) for name, m in measures.items()])
    earlier = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in measures]
    return by_range.select(*keys, _RANGE, *sums)


def _on(keys: Sequence[str]) -> list[str]:
    return [*keys, _RANGE]


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """1-based number of each row in its group. The order columns must tell all rows of a group apart.

    Only groups of more than `BLOCK_ROWS` rows are cut into ranges; the others are numbered by a window, each in one
    task. Rows with a null key have no group and go.
    """
    if not keys:
        return _numbered_by_range(df, keys, order, name)
    rows = df.dropna(subset=list(keys))
    limit = setting(df.sparkSession, "ordered.block.rows", BLOCK_ROWS)
    large = frozen(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(*keys))
    inside = Window.partitionBy(*keys).orderBy(*order)
    if large.isEmpty():
        return rows.withColumn(name, F.row_number().over(inside).cast("bigint"))
    small = rows.join(large, list(keys), "left_anti").withColumn(name, F.row_number().over(inside).cast("bigint"))
    return small.unionByName(_numbered_by_range(rows.join(large, list(keys), "left_semi"), keys, order, name)).select(*df.columns, name)


def _numbered_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    ranged = _with_ranges(df, keys, order)
    inside = F.row_number().over(Window.partitionBy(*keys, _RANGE).orderBy(*order))
    before = _totals_before(ranged, keys, {"__before": F.count("*")})
    numbered = ranged.withColumn(name, inside)
    return (
        numbered.join(before, _on(keys)).withColumn(name, (F.col(name) + F.col("__before")).cast("bigint"))
    ).drop(_RANGE, "__before")


def running_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, count_name: str, sum_name: str
) -> DataFrame:
    """Number and sum of the non-null values in all rows before the current one."""
    exact = value.cast(_EXACT)
    ranged = _with_ranges(df.withColumn("__value", exact), keys, order)
    earlier = Window.partitionBy(*keys, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(_EXACT)
    before = _totals_before(ranged, keys, {"__count": F.count("__value"), "__sum": F.coalesce(F.sum("__value"), zero)})
    inside = ranged.withColumn("__n", F.count("__value").over(earlier)).withColumn("__s", F.coalesce(F.sum("__value").over(earlier), zero))
    return (
        inside.join(before, _on(keys))
        .withColumn(count_name, F.col("__n") + F.col("__count"))
        .withColumn(sum_name, (F.col("__s") + F.col("__sum")).cast("double"))
        .drop(_RANGE, "__value", "__n", "__s", "__count", "__sum")
    )


def carried(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], before: bool = False
) -> DataFrame:
    """The last non-null value at or before each row (with `before`: before it), for every named value."""
    ranged = _with_ranges(df, keys, order)
    inside = Window.partitionBy(*keys, _RANGE).orderBy(*order)
    frame = inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    names = list(values)
    prepared = ranged.select("*", *[values[n].alias(f"__v_{n}") for n in names])
    out = prepared.select("*", *[F.last(f"__v_{n}", ignorenulls=True).over(frame).alias(f"__c_{n}") for n in names])
    place = F.struct(*[F.col(c) for c in order])
    last_of_range = prepared.groupBy(*keys, _RANGE).agg(
        *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), place)).alias(f"__l_{n}") for n in names]
    )
    earlier = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried_in = last_of_range.select(
        *keys, _RANGE, *[F.last(f"__l_{n}", ignorenulls=True).over(earlier).alias(f"__i_{n}") for n in names]
    )
    out = out.join(carried_in, _on(keys)).select("*", *[F.coalesce(f"__c_{n}", f"__i_{n}").alias(f"__r_{n}") for n in names])
    out = out.drop(_RANGE, *[f"__{p}_{n}" for n in names for p in ("c", "i", "v")], *[n for n in names if n in df.columns])
    return out.withColumnsRenamed({f"__r_{n}": n for n in names})


def look_back(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], rows: int
) -> DataFrame:
    """For each named struct the array of its values in the `rows` rows before and the row itself, oldest first.

    Rows are cut into blocks of consecutive rows; each block also receives the last rows of the block before it.
    """
    block = max(BLOCK_ROWS, rows)
    placed = row_numbers(df, keys, order, "__row")
    number = F.floor((F.col("__row") - 1) / block)
    at_end = (F.col("__row") - 1) % block >= block - rows
    copies = F.when(at_end, F.array(number, number + 1)).otherwise(F.array(number))
    spread = placed.withColumn("__own", number).withColumn("__block", F.explode(copies))
    window = Window.partitionBy(*keys, "__block").orderBy("__row").rowsBetween(-rows, 0)
    out = spread.select("*", *[F.collect_list(v).over(window).alias(n) for n, v in values.items()])
    return out.filter(F.col("__own") == F.col("__block")).drop("__row", "__own", "__block")


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank", spread: Column | None = None
) -> DataFrame:
    """The first k rows of every group with their rank.

    The filter on the rank makes Spark keep at most k rows of a group per task before the shuffle; `spread` adds a
    first round on parts of a group, for groups that reach the shuffle from very many tasks.
    """
    if spread is not None:
        parts = Window.partitionBy(*keys, "__part").orderBy(*order)
        df = df.withColumn("__part", spread).withColumn(name, F.row_number().over(parts))
        df = df.filter(F.col(name) <= k).drop("__part", name)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
