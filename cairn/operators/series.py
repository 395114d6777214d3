"""Series in order: smoothed values, folds, normalised score tables, tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.storage import saved


def smoothed(rows: DataFrame, by: str, order: tuple[str, ...], value: str, window: int = 20) -> DataFrame:
    """Mean and lower median of the last ``window`` values, and mean of all values so far."""
    last = W.partitionBy(by).orderBy(*order).rowsBetween(-(window - 1), 0)
    so_far = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    kept = F.sort_array(F.collect_list(value).over(last))
    median = F.try_element_at(kept, F.ceil(F.size(kept) / 2).cast("int"))
    return rows.withColumn("recent_mean", F.avg(value).over(last)).withColumn("recent_median", median).withColumn("global_mean", F.avg(value).over(so_far))


def exponential_mean(rows: DataFrame, by: str, order: str, value: str, momentum: float) -> DataFrame:
    """The last state of c = momentum * c + (1 - momentum) * value, from zero. As weights are powers of the momentum, it is a
    weighted sum, which groups combine before they are shuffled."""
    last = rows.groupBy(by).agg(F.max(order).alias("__last"))
    weight = F.pow(F.lit(momentum), (F.col("__last") - F.col(order)).cast("double")) * (1 - momentum)
    return rows.join(last, by).groupBy(by).agg(F.sum(weight * F.col(value)).alias("state"))


def sinkhorn(scores: DataFrame, row: str, column: str, score: str, temperature: float = 1.0, rounds: int = 3) -> DataFrame:
    """exp(score / temperature) scaled so that columns, then rows, have equal sums, ``rounds`` times; at the end each row sums to
    one. Sums are groupings joined back, so a row or a column of any length is no single task."""
    highest = scores.agg(F.max(score).alias("__m"))
    q = scores.join(F.broadcast(highest)).withColumn("q", F.exp((F.col(score) - F.col("__m")) / temperature)).drop("__m")
    q = saved(q, "sinkhorn")  # each step reads the last one several times
    for _ in range(rounds):
        for axis in (column, row):
            sums = q.groupBy(axis).agg(F.sum("q").alias("__s"))
            q = saved(q.join(sums, axis).withColumn("q", F.col("q") / F.col("__s") / sums.count()).drop("__s"), "sinkhorn")
    sums = q.groupBy(row).agg(F.sum("q").alias("__s"))
    return q.join(sums, row).withColumn("q", F.col("q") / F.col("__s")).drop("__s")


def tile_starts(length: int, crop: int, stride: int) -> list[int]:
    """Starts of windows that cover a length; the last is moved back to end with it."""
    steps = max(math.ceil((length - crop) / stride), 0) + 1
    return sorted({min(i * stride, max(length - crop, 0)) for i in range(steps)})


def stitched(tiles: DataFrame, by: tuple[str, ...] = ("image", "y", "x"), value: str = "value") -> DataFrame:
    """Mean of the values that overlapping windows give for each pixel. tiles: image, oy, ox (the window's place), ty, tx."""
    placed = tiles.withColumn("y", F.col("oy") + F.col("ty")).withColumn("x", F.col("ox") + F.col("tx"))
    return placed.groupBy(*by).agg(F.avg(value).alias(value), F.count("*").alias("windows"))


def cosine_step(start: float, end: float, share: Column) -> Column:
    return end + (start - end) / 2 * (F.cos(F.lit(math.pi) * share) + 1)


def linear_step(start: float, end: float, share: Column) -> Column:
    return (end - start) * share + start
