"""Running sums over groups of any size, without one task per group.

A plain window over a hot group puts the whole group into one task.  Here a
group is divided into buckets that follow the order of the rows: bucket totals
are summed first (map-side combined), their running sums are taken over the few
bucket rows, and only the rows inside a bucket are ordered together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def bucket_count(rows: int) -> int:
    """About the square root of the rows: buckets and their sizes grow alike."""
    return max(1, math.isqrt(max(0, rows)))


def buckets_along(df: DataFrame, value: str, out: str = "bucket") -> DataFrame:
    """``df``, written once, with buckets of equal width along a number, about as many as the root of the rows."""
    df = cut(df)
    low, high, n = df.agg(F.min(value), F.max(value), F.count("*")).first()
    many = bucket_count(n)
    width = (float(high) - float(low)) / many if n and high > low else 1.0
    return df.withColumn(out, F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(many - 1)).cast("int"))


def hash_order(df: DataFrame, keys: list[str], by: Column, out: str) -> DataFrame:
    """``df`` with ``out``: each row's place, from 1, within its group by the md5 of ``by`` (text), then by ``cell``."""
    df = cut(df.withColumn("__h", F.conv(F.substring(F.md5(by), 1, 13), 16, 10).cast("long")))
    many = bucket_count(df.count())
    dealt = df.withColumn("__b", F.floor(F.col("__h") / F.lit(float(1 << 52)) * many).cast("int"))
    return running_sum(dealt, keys, "__b", [F.col("__h"), F.col("cell")], F.lit(1).cast("long"), out).withColumn(out, F.col(out) + 1).drop("__h", "__b")


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: each row's place, from 0, along an order of all rows; only counts of a sort's partitions meet in one task."""
    placed = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    parts = placed.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("__n"))
    before = parts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    place = (F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    return placed.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(before), "__part").withColumn(out, place).drop("__at", "__part", "__first")  # a row a partition


def quantile(df: DataFrame, value: str, share: float, out: str) -> DataFrame:
    """One row: the exact quantile of a column's numbers, between two neighbours in proportion; nulls don't count, of no number it is null.

    Equal numbers are counted first, where they are.  The different ones are sorted over
    all tasks; only counts of the sort's partitions meet in one.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    placed = cut(rows.orderBy("__v").withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    parts = placed.groupBy("__part").agg(F.sum("__n").alias("__all"))
    before = parts.select("__part", (F.sum("__all").over(Window.orderBy("__part")) - F.col("__all")).alias("__first"))
    inside = F.sum("__n").over(Window.partitionBy("__part").orderBy("__at")) - F.col("__n")
    ranked = placed.withColumn("__inside", inside).join(F.broadcast(before), "__part").withColumn("__from", F.col("__first") + F.col("__inside"))  # a row a partition
    at = (F.col("__total") - 1) * F.lit(float(share))
    near = ranked.crossJoin(F.broadcast(parts.agg(F.sum("__all").alias("__total")))).withColumn("__low", F.floor(at)).withColumn("__high", F.ceil(at))  # one row
    holds = lambda rank: (F.col("__from") <= F.col(rank)) & (F.col(rank) < F.col("__from") + F.col("__n"))
    ends = near.where(holds("__low") | holds("__high")).select(F.when(holds("__low"), F.col("__v")).alias("__a"), F.when(holds("__high"), F.col("__v")).alias("__b"), "__low", "__high", at.alias("__pos"))
    one = ends.agg(*[F.max(c).alias(c) for c in ends.columns])
    between = (F.col("__high") - F.col("__pos")) * F.col("__a") + (F.col("__pos") - F.col("__low")) * F.col("__b")
    return one.select(F.when(F.col("__low") == F.col("__high"), F.col("__a")).otherwise(between).alias(out))


def running_max(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the largest ``value`` of the earlier rows of its group (null for the first); as ``running_sum``."""
    group, before = [*keys, bucket], (Window.unboundedPreceding, -1)
    tops = df.groupBy(*group).agg(F.max(value).alias("__top"))
    starts = tops.select(*group, F.max("__top").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(*before)).alias("__start"))
    inside = df.withColumn("__inside", F.max(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(*before)))
    return inside.join(starts, group).withColumn(out, F.greatest("__inside", "__start")).drop("__inside", "__start")


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column | list[Column], out: str | list[str]) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the earlier rows of its group; several at once as lists.

    ``bucket`` is a column that never decreases along ``order`` within a group.
    Keys may be null (nulls are one group). ``df`` is read twice, so it should
    be cheap or already materialised.  An empty ``df`` gives an empty result.
    """
    values, outs = (value, out) if isinstance(out, list) else ([value], [out])
    group = [*keys, bucket]
    before = (Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(*before)
    within = Window.partitionBy(*group).orderBy(*order).rowsBetween(*before)
    totals = df.groupBy(*group).agg(*[F.sum(v).alias(f"__total{i}") for i, v in enumerate(values)])
    starts = totals.select(*[F.col(c).alias(f"__s_{c}") for c in group], *[F.coalesce(F.sum(f"__total{i}").over(ahead), F.lit(0)).alias(f"__start{i}") for i in range(len(values))])
    inside = df.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"__inside{i}") for i, v in enumerate(values)])
    # without keys the buckets' totals, about the square root of the rows, are one group
    same = [F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in group]
    kept = [c for c in df.columns if c not in outs]
    return inside.join(starts, same).select(*kept, *[(F.col(f"__inside{i}") + F.col(f"__start{i}")).alias(name) for i, name in enumerate(outs)])
