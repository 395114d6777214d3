"""Categories of coloured points by a palette. Rules are applied to distinct colours only and joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A palette is broadcast up to so many rows (two names and four numbers each); a larger one is joined by Spark's choice.
PALETTE_ROWS = 100_000


def _pairs(points: DataFrame, palette: DataFrame, tolerance: int) -> DataFrame:
    """Distinct colours with the palette colours within the tolerance in every channel, found by cells of the red channel."""
    side = max(1, tolerance + 1)
    colours = points.select("r", "g", "b").distinct().withColumn("cell", F.explode(F.array(*(F.floor(F.col("r") / side) + k for k in (-1, 0, 1)))))
    own = palette.select("class_id", "name", F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb"), F.floor(F.col("r") / side).alias("cell"))
    if palette.count() <= PALETTE_ROWS:
        own = F.broadcast(own)
    return colours.join(own, "cell").where(linf() <= tolerance)


def linf() -> Column:
    return F.greatest(*(F.abs(F.col(c) - F.col(f"p{c}")) for c in "rgb"))


def l1() -> Column:
    return sum((F.abs(F.col(c) - F.col(f"p{c}")) for c in "rgb"), F.lit(0))


def l2() -> Column:
    return sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in "rgb"), F.lit(0))


def _chosen(pairs: DataFrame, first: Column) -> DataFrame:
    return pairs.groupBy("r", "g", "b").agg(F.min_by(F.struct("class_id", "name"), first).alias("hit")).select("r", "g", "b", "hit.class_id", "hit.name")


def nearest_in_box(points: DataFrame, palette: DataFrame, tolerance: int = 7) -> DataFrame:
    """Within the tolerance in every channel, the least summed difference, ties to the smaller id; black has none."""
    return _back(points, _chosen(_pairs(points.where("r + g + b > 0"), palette, tolerance), F.struct(l1(), "class_id")))


def nearest_in_ball(points: DataFrame, palette: DataFrame, tolerance: int = 7) -> DataFrame:
    """The least squared difference, if it is at most three squared tolerances; ties to the smaller id."""
    reach = int((3 * tolerance * tolerance) ** 0.5) + 1
    return _back(points, _chosen(_pairs(points, palette, reach).where(l2() <= 3 * tolerance * tolerance), F.struct(l2(), "class_id")))


def named_or_unknown(points: DataFrame, palette: DataFrame, tolerance: int = 7) -> DataFrame:
    """As nearest_in_box, black included; a colour without a category is named by its channels."""
    found = _back(points, _chosen(_pairs(points, palette, tolerance), F.struct(l1(), "class_id")))
    own = F.concat(F.lit("unknown"), *(F.concat(F.lit("_"), F.lpad(F.col(c).cast("string"), 3, "0")) for c in "rgb"))
    return found.withColumn("name", F.coalesce("name", own))


def last_in_box(points: DataFrame, palette: DataFrame, tolerance: int = 15) -> DataFrame:
    """Within the tolerance in every channel, the category with the largest id."""
    return _back(points, _chosen(_pairs(points, palette, tolerance), -F.col("class_id")))


def exact(points: DataFrame, palette: DataFrame) -> DataFrame:
    """The same colour; of categories that share one, the largest id."""
    one = palette.groupBy("r", "g", "b").agg(F.max_by(F.struct("class_id", "name"), "class_id").alias("hit")).select("r", "g", "b", "hit.class_id", "hit.name")
    return _back(points, one)


def without(points: DataFrame, palette: DataFrame, tolerance: int = 7) -> DataFrame:
    """Points whose colour is within the tolerance of none of the palette's."""
    return points.join(_pairs(points, palette, tolerance).select("r", "g", "b").distinct(), ["r", "g", "b"], "left_anti")


def _back(points: DataFrame, found: DataFrame) -> DataFrame:
    return points.join(found, ["r", "g", "b"], "left")


def histogram(points: DataFrame, palette: DataFrame, tolerance: int = 7) -> DataFrame:
    """Points and share of each category (nearest_in_ball), of black points and of other colours."""
    of = F.when(F.col("r") + F.col("g") + F.col("b") == 0, "black").otherwise(F.coalesce("name", F.lit("unclassified")))
    counts = nearest_in_ball(points, palette, tolerance).groupBy(of.alias("category")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(total)).select("category", "n", (F.col("n") / F.col("all")).alias("share"))


def colour_groups(points: DataFrame, least: int = 100) -> DataFrame:
    """Colours with at least ``least`` points."""
    return points.groupBy("r", "g", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
