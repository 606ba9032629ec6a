"""Running sums and ranks in the order of a value of any range, without a task that holds a whole group.

A group's values are cut at its approximate quantiles.  Sums per range are few and are run up
first; inside a range the order is the engine's own, and starts from where the ranges before it end.  Where the cuts fall
decides only how even the ranges are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a group, about.
RANGES = 64


def _ranged(rows: DataFrame, by: list[str], value: str, ranges: int) -> DataFrame:
    """``rows`` with ``__range``: the number of the group's cuts at or under the value. Nulls come first."""
    cuts = F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000).alias("__cuts")
    if by:
        met = rows.join(F.broadcast(rows.groupBy(*by).agg(cuts)), by)  # a row per group, of so many numbers
    else:
        met = rows.crossJoin(F.broadcast(rows.agg(cuts)))
    under = F.size(F.filter(F.array_distinct(F.coalesce("__cuts", F.array().cast("array<double>"))), lambda c: c <= F.col(value)))
    return met.withColumn("__range", F.when(F.col(value).isNull(), -1).otherwise(under)).drop("__cuts")


def _join(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(F.broadcast(small), keys)


def running(rows: DataFrame, by: list[str], value: str, sums: dict[str, str], ranges: int = RANGES) -> DataFrame:
    """``rows``, one for each of a group's values, with what runs in their order.

    ``sums`` names running sums, this row included, of columns; ``previous`` and ``next`` are the group's neighbouring values. Groups are few
    (folds, feature keys); values are not.
    """
    at = _ranged(rows, by, value, ranges)
    keys = [*by, "__range"]
    per = at.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), *[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    over = Window.partitionBy(*by).orderBy("__range")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    # a row per group and range
    ends = per.select(*keys, F.lag("__hi").over(over).alias("__before"), F.lead("__lo").over(over).alias("__after"), *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy(*keys).orderBy(value)
    met = at.withColumn("__p", F.lag(value).over(inside)).withColumn("__n", F.lead(value).over(inside))
    met = met.withColumns({f"__i_{n}": F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for n, c in sums.items()})
    out = _join(met, ends, keys)
    return out.select(*rows.columns, F.coalesce("__p", "__before").alias("previous"), F.coalesce("__n", "__after").alias("next"), *[(F.col(f"__b_{n}") + F.col(f"__i_{n}")).alias(n) for n in sums])


def ranked(rows: DataFrame, by: list[str], value: str, *ties: str | Column, name: str = "rank", ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``name``: the place of each in its group, the greatest value first, and by ``ties`` among equal ones."""
    at = _ranged(rows, by, value, ranges)
    keys = [*by, "__range"]
    per = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    after = Window.partitionBy(*by).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(*keys, F.coalesce(F.sum("__c").over(after), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), *ties))
    out = _join(at.withColumn("__place", place), starts, keys)
    return out.select(*rows.columns, (F.col("__start") + F.col("__place")).cast("long").alias(name))
