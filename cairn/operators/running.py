"""Running totals in order, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.storage import saved


def _ranged(rows: DataFrame, by: list[str], order: list[Column], values: list[Column]) -> tuple[DataFrame, list[str]]:
    """rows dealt by ranges of (group, order) as a written table, with the range's number, the order's columns and values __v0, __v1 .."""
    names = [f"__o{i}" for i in range(len(order))]
    keyed = rows.select("*", *(c.alias(n) for c, n in zip(order, names, strict=True)), *(c.alias(f"__v{i}") for i, c in enumerate(values)))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ranges are numbered in order, so earlier ones have smaller numbers
    return saved(keyed.repartitionByRange(parts, *by, *names).withColumn("__part", F.spark_partition_id()), "ranges"), names


def _same(by: list[str]) -> Column:
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    return same


def _summed(ranged: DataFrame, names: list[str], by: list[str], totals: list[str], keep: list[str]) -> DataFrame:
    """Sums within a range added to those of the group's ranges before."""
    sums = ranged.groupBy(*by, "__part").agg(*(F.sum(f"__v{i}").alias(f"__s{i}") for i in range(len(totals))))
    earlier = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*(F.col(c).alias(f"__b_{c}") for c in by), F.col("__part").alias("__p"), *(F.coalesce(F.sum(f"__s{i}").over(earlier), F.lit(0)).alias(f"__e{i}") for i in range(len(totals))))
    inside = W.partitionBy(*by, "__part").orderBy(*names).rowsBetween(W.unboundedPreceding, 0)
    within = ranged.select("*", *(F.sum(f"__v{i}").over(inside).alias(f"__w{i}") for i in range(len(totals))))
    return within.join(before, _same(by)).select(*keep, *((F.col(f"__w{i}") + F.col(f"__e{i}")).alias(n) for i, n in enumerate(totals)))


def _ahead(ranged: DataFrame, names: list[str], by: list[str], value: str, name: str, keep: list[str]) -> DataFrame:
    """The largest value from a row to its range's end, or in the group's ranges behind."""
    tops = ranged.groupBy(*by, "__part").agg(F.max(value).alias("__t"))
    later = W.partitionBy(*by).orderBy("__part").rowsBetween(1, W.unboundedFollowing)
    ahead = tops.select(*(F.col(c).alias(f"__b_{c}") for c in by), F.col("__part").alias("__p"), F.max("__t").over(later).alias("__a"))
    # backwards, as a frame that ends with the group is summed up anew for each row
    inside = W.partitionBy(*by, "__part").orderBy(*(F.col(c).desc() for c in names)).rowsBetween(W.unboundedPreceding, 0)
    return ranged.withColumn("__w", F.max(value).over(inside)).join(ahead, _same(by)).select(*keep, F.greatest("__w", "__a").alias(name))


def running(rows: DataFrame, by: list[str], order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """rows with the sum of each of ``totals`` over a group's rows up to this one, in order.

    Rows are dealt by ranges of (group, order), so a group of any size is spread over tasks; sums within a range are added to
    the sums of the group's ranges before, which are a few rows a group. Rows alike in the whole order share a range.
    """
    ranged, names = _ranged(rows, by, order, list(totals.values()))
    return _summed(ranged, names, by, list(totals), rows.columns)


def running_ahead(rows: DataFrame, by: list[str], order: list[Column], totals: dict[str, Column], value: Column, name: str) -> DataFrame:
    """As ``running``, with a column ``name``: the largest of ``value``, which may refer to the totals, over a group's rows from this one on. Both come
    from the same ranges."""
    ranged, names = _ranged(rows, by, order, list(totals.values()))
    summed = _summed(ranged, names, by, list(totals), [*rows.columns, *names, "__part"]).withColumn("__value", value)
    return _ahead(summed, names, by, "__value", name, [*rows.columns, *totals])


def largest_ahead(rows: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """rows with the largest ``value`` of a group's rows from this one on, in order; dealt like ``running``."""
    ranged, names = _ranged(rows, by, order, [])
    return _ahead(ranged, names, by, value, name, rows.columns)
