"""Losses of depth images and the points of masks that training looks at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What is added to depths under the logarithm, the weight of the squared mean, and strides of the gradient.
EPS, MEAN_WEIGHT, STRIDES = 0.001, 0.15, (1, 2, 4, 6)


def _valid(rows: DataFrame, valid: str | None) -> Column:
    return F.lit(True) if valid is None else F.coalesce(F.col(valid).cast("boolean"), F.lit(False))


def scale_invariant(pairs: DataFrame, by: Sequence[str], warm: bool = False, predicted: str = "pred", truth: str = "gt", valid: str | None = None) -> DataFrame:
    """by, loss: the root of the variance of log ratios plus a part of their squared mean, over a group's valid pixels; ``warm`` leaves the variance
    out. A group without valid pixels, or with one only unless ``warm``, has no loss (null)."""
    g = F.when(_valid(pairs, valid), F.log(F.col(predicted) + EPS) - F.log(F.col(truth) + EPS))
    one = pairs.withColumn("__g", g).groupBy(*by).agg(F.avg("__g").alias("__m"), F.var_samp("__g").alias("__v"))
    return one.select(*by, F.sqrt(MEAN_WEIGHT * F.col("__m") * F.col("__m") + (F.lit(0.0) if warm else F.col("__v"))).alias("loss"))


def gradient(pixels: DataFrame, by: Sequence[str], strides: Sequence[int] = STRIDES, predicted: str = "pred", truth: str = "gt", valid: str | None = None) -> DataFrame:
    """by, loss: over grids of every 1st, 2nd, 4th and 6th pixel, how much errors change from a pixel to the second next to the right and
    below, over the grid's valid pixels, summed. pixels: by, y, x, both depths. Grids without a valid pixel add nothing; a group without any has no
    row. Pixels meet their partners in an equi-join that is sorted, never broadcast: how many pixels there are isn't seen from the tables they are made of."""
    some = pixels.where(_valid(pixels, valid)).select(*by, "y", "x", (F.col(predicted) - F.col(truth)).alias("d"))
    stride = F.explode(F.array(*map(F.lit, strides)))
    grid = some.withColumn("k", stride).where((F.col("y") % F.col("k") == 0) & (F.col("x") % F.col("k") == 0))
    grid = grid.select(*by, "k", F.floor(F.col("y") / F.col("k")).alias("y"), F.floor(F.col("x") / F.col("k")).alias("x"), "d")
    places = F.explode(F.array(F.struct((F.col("y") - 2).alias("y"), F.col("x").alias("x")), F.struct(F.col("y").alias("y"), (F.col("x") - 2).alias("x"))))
    ahead = grid.select(*by, "k", places.alias("p"), F.col("d").alias("e")).select(*by, "k", "p.y", "p.x", "e")
    changes = grid.join(ahead.hint("merge"), [*by, "k", "y", "x"]).groupBy(*by, "k").agg(F.sum(F.abs(F.col("d") - F.col("e"))).alias("s"))
    sizes = grid.groupBy(*by, "k").agg(F.count("*").alias("n"))
    return sizes.join(changes.hint("merge"), [*by, "k"], "left").groupBy(*by).agg(F.sum(F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("loss"))


def uncertain_points(logits: DataFrame, by: Sequence[str], n: int, oversample: float = 3.0, share: float = 0.75, seed: int = 0) -> DataFrame:
    """The rows (by, y, x, logit) that a mask's loss is taken on, with ``kind``: of oversample * n points drawn at random the share * n that are nearest to
    the border (logit zero), then further ones at random up to n. Draws depend on the seed and the place alone; a mask with fewer points gives all that
    the rule reaches. A mask's points are one group; the largest of them is ranked by its first oversample * n points only."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in (*by, "y", "x"))))
    drawn, near = int(n * oversample), int(n * share)
    place = F.row_number().over(W.partitionBy(*by).orderBy("__h", "y", "x"))
    ranked = logits.withColumn("__h", key).withColumn("__n", place).where(F.col("__n") <= drawn + n - near)
    close = F.row_number().over(W.partitionBy(*by, F.col("__n") <= drawn).orderBy(F.abs("logit"), "__h", "y", "x"))
    told = ranked.withColumn("__c", close)
    kind = F.when((F.col("__n") <= drawn) & (F.col("__c") <= near), "uncertain").when(F.col("__n") > drawn, "random")
    return told.withColumn("kind", kind).where("kind is not null").drop("__h", "__n", "__c")
