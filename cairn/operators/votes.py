"""Labels of points from many observations: counts, winners, confidence, occlusion, voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def vote_counts(obs: DataFrame, point: str = "pid", label: str = "label") -> DataFrame:
    """How often each point was seen with each label; observations without a label don't count."""
    return obs.where(F.col(label).isNotNull()).groupBy(point, label).agg(F.count("*").alias("votes"))


def ranked_votes(obs: DataFrame, point: str = "pid", label: str = "label") -> DataFrame:
    """One row a point: winner (ties to the smallest label), first and second counts, total."""
    counts = vote_counts(obs, point, label)
    order = W.partitionBy(point).orderBy(F.col("votes").desc(), label)
    placed = counts.withColumn("place", F.row_number().over(order))
    return placed.groupBy(point).agg(
        F.max(F.when(F.col("place") == 1, F.col(label))).alias("winner"),
        F.max(F.when(F.col("place") == 1, F.col("votes"))).alias("first"),
        F.coalesce(F.max(F.when(F.col("place") == 2, F.col("votes"))), F.lit(0)).cast("long").alias("second"),
        F.sum("votes").alias("total"),
    )


def majority(obs: DataFrame, least: int = 5, point: str = "pid", label: str = "label") -> DataFrame:
    """The winner of each point with at least ``least`` observations. Two groupings, no window: both combine before shuffling."""
    return majority_of(vote_counts(obs, point, label), least, point, label)


def majority_of(counts: DataFrame, least: int = 5, point: str = "pid", label: str = "label") -> DataFrame:
    """The same from votes (point, label, votes) that are counted already."""
    best = F.min_by(F.struct(label, "votes"), F.struct(-F.col("votes"), label))
    return counts.groupBy(point).agg(best.alias("best"), F.sum("votes").alias("total")).where(F.col("total") >= least).select(point, F.col(f"best.{label}").alias("winner"), F.col("best.votes").alias("votes"), "total")


def confident(obs: DataFrame, share: float = 0.6, margin: int = 2, point: str = "pid", label: str = "label") -> DataFrame:
    """Winners with at least ``share`` of all votes and ``margin`` more than the runner-up."""
    return ranked_votes(obs, point, label).withColumn("accepted", (F.col("first") / F.col("total") >= share) & (F.col("first") - F.col("second") >= margin))


def visible(obs: DataFrame, tolerance: float, pixel: tuple[str, ...] = ("frame", "py", "px"), depth: str = "depth") -> DataFrame:
    """Observations not farther than the nearest of their pixel by more than the tolerance. The nearest depth is a grouping
    that is joined back, so that a crowded pixel isn't sorted in one task."""
    nearest = obs.groupBy(*pixel).agg(F.min(depth).alias("__nearest"))
    return obs.join(nearest, list(pixel)).where(F.col(depth) <= F.col("__nearest") + tolerance).drop("__nearest")


def looked_up(points: DataFrame, pixels: DataFrame, width: int, height: int, u: str = "u", v: str = "v", frame: str = "frame") -> DataFrame:
    """Label of the pixel nearest to each projected point; none outside the image. Pixels are never broadcast: they are many more than the
    tables they may be made of let Spark expect."""
    px, py = F.rint(u).cast("int"), F.rint(v).cast("int")
    inside = (px >= 0) & (px < width) & (py >= 0) & (py < height)
    placed = points.withColumn("__x", F.when(inside, px)).withColumn("__y", F.when(inside, py))
    return placed.join(pixels.select(F.col(frame).alias("__f"), F.col("x").alias("__px"), F.col("y").alias("__py"), "label").hint("merge"), (F.col(frame) == F.col("__f")) & (F.col("__x") == F.col("__px")) & (F.col("__y") == F.col("__py")), "left").drop("__x", "__y", "__f", "__px", "__py")


def _cells(size: float, axes: tuple[str, ...]) -> list[Column]:
    return [F.floor(F.col(a) / F.lit(size)).alias(f"v{a}") for a in axes]


def voxel_majority(points: DataFrame, size: float, least: int = 3, axes: tuple[str, ...] = ("x", "y", "z"), label: str = "label") -> DataFrame:
    """For each voxel with enough labelled points: the winner, its votes, and the mean place of all of the voxel's points."""
    keys = [f"v{a}" for a in axes]
    per = points.select(*_cells(size, axes), *axes, label).groupBy(*keys, label).agg(F.count("*").alias("n"), *(F.sum(a).alias(f"s{a}") for a in axes))
    order = W.partitionBy(*keys).orderBy(F.col(label).isNull(), F.col("n").desc(), label)
    whole = W.partitionBy(*keys)
    out = per.select(*keys, label, "n", F.row_number().over(order).alias("place"), F.sum(F.when(F.col(label).isNotNull(), F.col("n"))).over(whole).alias("total"), F.sum("n").over(whole).alias("all"), *(F.sum(f"s{a}").over(whole).alias(f"s{a}") for a in axes))
    return out.where((F.col("place") == 1) & (F.col("total") >= least)).select(*keys, F.col(label).alias("winner"), F.col("n").alias("votes"), "total", *((F.col(f"s{a}") / F.col("all")).alias(f"m{a}") for a in axes))


def voxel_means(points: DataFrame, size: float, by: tuple[str, ...] = ("label",), axes: tuple[str, ...] = ("x", "y", "z"), origin: dict[str, float] | None = None) -> DataFrame:
    """Mean place of the points of each voxel, by label; cells are counted from ``origin`` (zero if not given)."""
    shift = origin or {}
    cells = [F.floor((F.col(a) - F.lit(float(shift.get(a, 0.0)))) / F.lit(size)).alias(f"v{a}") for a in axes]
    return points.select(*by, *axes, *cells).groupBy(*by, *(f"v{a}" for a in axes)).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m{a}") for a in axes))


def bound_voxel_means(points: DataFrame, size: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """As voxel_means over all points, with cells counted from half a voxel below the least coordinates."""
    low = points.agg(*(F.min(a).alias(a) for a in axes)).first()
    origin = {a: (low[a] or 0.0) - size / 2 for a in axes}
    return voxel_means(points, size, (), axes, origin)


def temporal_mean(series: DataFrame, reach: int, group: str, time: tuple[str, ...], value: str) -> DataFrame:
    """Mean over the rows up to ``reach`` before and behind, cut off at a group's ends."""
    near = W.partitionBy(group).orderBy(*time).rowsBetween(-reach, reach)
    return series.withColumn("smoothed", F.avg(value).over(near))
