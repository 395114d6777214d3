"""Instances of several frames put together: observations of (point, instance), their links, components and majorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.storage import saved, spread
from cairn.operators.colour import _pairs
from cairn.operators.components import connected

#: Instances of a point whose pairs are made without cells.
PAIRED = 256


def labelled_instances(pixels: DataFrame, instances: DataFrame, allowed: DataFrame) -> DataFrame:
    """Pixels (frame, y, x, label, instance) with the label that counts: the instance's category where its metadata (frame,
    instance, category) names an allowed one (category, label), else the pixel's own label."""
    named = instances.join(allowed.select("category", F.col("label").alias("__l")), "category").select("frame", "instance", "__l")
    return pixels.join(named, ["frame", "instance"], "left").withColumn("label", F.coalesce("__l", "label")).drop("__l")


def centroids(obs: DataFrame, group: str = "gid", key: str = "pid") -> DataFrame:
    """Mean place of the distinct points of each instance."""
    return obs.select(group, key, "x", "y", "z").dropDuplicates([group, key]).groupBy(group).agg(F.count("*").alias("points"), *(F.avg(a).alias(f"c{a}") for a in "xyz"))


def neighbouring(groups: DataFrame, width: int, group: str = "gid", key: str = "pid") -> DataFrame:
    """Links (a, b) that join the same instances as all pairs of a point with ids less than ``width`` apart, at most two a row:
    ids of a bucket as wide link to its smallest, and its smallest to the largest of the bucket before, if near enough."""
    own = groups.select(F.col(group), F.col(key), F.floor(F.col(group) / width).alias("__b")).distinct()
    ends = own.groupBy(key, "__b").agg(F.min(group).alias("least"), F.max(group).alias("most"))
    inner = own.join(ends, [key, "__b"]).where(F.col(group) > F.col("least")).select(F.col("least").alias("a"), F.col(group).alias("b"))
    after = ends.select(F.col(key), (F.col("__b") - 1).alias("__b"), F.col("least").alias("b"))
    across = ends.join(after, [key, "__b"]).where(F.col("b") - F.col("most") < width).select(F.col("most").alias("a"), "b")
    return inner.union(across)


def co_observed(obs: DataFrame, reach: float, group: str = "gid", key: str = "pid") -> DataFrame:
    """Links (a, b) of instances that share a point and whose centroids are closer than ``reach``; each pair once.

    Instances of a point with up to PAIRED of them meet by the point alone. Of a point with more only those in the same or touching
    cells of centroids, as wide as the reach, are put together; only there are rows dealt to 27 cells."""
    c = centroids(obs, group, key)
    own = saved(obs.select(group, key).distinct().join(c, group).select(group, key, "cx", "cy", "cz"), "observed")
    crowded = own.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > PAIRED).select(key)
    few, many = own.join(crowded, key, "left_anti"), own.join(crowded, key, "left_semi")

    def near(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        squared = sum(((F.col(f"a{v}") - F.col(f"b{v}")) * (F.col(f"a{v}") - F.col(f"b{v}")) for v in "xyz"), F.lit(0.0))
        return left.join(right, on).where("a < b").where(squared < reach * reach).select("a", "b")

    side = lambda rows, s: rows.select(F.col(group).alias(s), key, *(F.col(f"c{v}").alias(f"{s}{v}") for v in "xyz"))
    left, right = side(many, "a"), spread(side(many, "b"), key, "b")
    for v in "xyz":
        left = left.withColumn(f"__{v}", F.floor(F.col(f"a{v}") / reach))
        cell = F.floor(F.col(f"b{v}") / reach)
        right = right.withColumn(f"__{v}", F.explode(F.array(cell - 1, cell, cell + 1)))
    return near(side(few, "a"), side(few, "b"), [key]).union(near(left, right, [key, "__x", "__y", "__z"])).distinct()


def associated(obs: DataFrame, reach: float = 3.0, group: str = "gid", key: str = "pid") -> DataFrame:
    """Every instance with ``object``, the smallest instance that links reach."""
    roots = connected(co_observed(obs, reach, group, key))
    return obs.select(group).distinct().join(roots, F.col(group) == F.col("node"), "left").select(group, F.coalesce("root", group).alias("object"))


def point_owner(obs: DataFrame, objects: DataFrame, group: str = "gid", key: str = "pid") -> DataFrame:
    """Each point's object: that which most of its observations belong to, ties to the smaller."""
    n = obs.join(objects, group).groupBy(key, "object").agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by("object", F.struct(-F.col("n"), F.col("object"))).alias("object"))


def majority_category(points: DataFrame, palette: DataFrame, tolerance: int, by: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """For each group the palette category with most points within the tolerance in every channel (a point may count for several),
    ties to the earlier category; excluded ones don't count."""
    colours = points.groupBy(by, "r", "g", "b").agg(F.count("*").alias("k"))
    near = _pairs(points, palette.where(~F.col("name").isin(*excluded)) if excluded else palette, tolerance).select("r", "g", "b", "class_id", "name")
    counts = colours.join(near, ["r", "g", "b"]).groupBy(by, "class_id", "name").agg(F.sum("k").alias("n"))
    return counts.groupBy(by).agg(F.min_by(F.struct("name", "n"), F.struct(-F.col("n"), F.col("class_id"))).alias("b")).select(by, "b.name", "b.n")


def presence(rows: DataFrame, label: str, known: DataFrame) -> DataFrame:
    """Every known label with whether it occurs."""
    return known.select(label).distinct().join(rows.select(label).distinct().withColumn("present", F.lit(True)), label, "left").fillna(False, ["present"])


def latest(rows: DataFrame, number: str, n: int) -> DataFrame:
    """The n largest whole-numbered names; others are passed over."""
    kept = rows.withColumn("__v", F.col(number).try_cast("long")).where(F.col("__v").isNotNull())
    return kept.withColumn("__k", F.row_number().over(W.orderBy(F.col("__v").desc()))).where(F.col("__k") <= n).drop("__k", "__v")
