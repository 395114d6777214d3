"""Label images as long tables (frame, y, x, label): borders, erosion, resizing, sampling, depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _neighbours(pixels: DataFrame, reach: int, frame: str) -> DataFrame:
    """Every pixel with the labels in the square around it (pixels outside the image don't count)."""
    offsets = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
    spread = pixels.select(F.col(frame), "label", F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in offsets))).alias("at")).select(frame, F.col("at.y").alias("y"), F.col("at.x").alias("x"), "label")
    return spread


def boundary_ignored(pixels: DataFrame, reach: int = 1, classes: tuple[int, ...] | None = None, frame: str = "frame") -> DataFrame:
    """Labels are dropped (null) where the square around a pixel has both a class and something else: dilation less erosion. Of
    each pixel only the least and largest neighbour label are kept, so the grouping combines before it shuffles."""
    target = F.lit(True) if classes is None else F.col("label").isin(*classes)
    code = F.when(target, F.coalesce("label", F.lit(-1))).otherwise(F.lit(-1))
    around = _neighbours(pixels.withColumn("label", code), reach, frame).groupBy(frame, "y", "x").agg(F.min("label").alias("__lo"), F.max("label").alias("__hi"))
    return pixels.join(around, [frame, "y", "x"]).withColumn("label", F.when(F.col("__lo") == F.col("__hi"), F.col("label"))).drop("__lo", "__hi")


def eroded(pixels: DataFrame, reach: int, classes: tuple[int, ...], least_area: int = 20, frame: str = "frame") -> DataFrame:
    """Pixels of the classes stay only if the whole square around them, as far as it is in the image, has their label; classes of
    a frame with fewer than ``least_area`` pixels, or that erosion would remove, stay as they are."""
    around = _neighbours(pixels.withColumn("label", F.coalesce("label", F.lit(-1))), reach, frame).groupBy(frame, "y", "x").agg((F.min("label") == F.max("label")).alias("__same"))
    marked = pixels.join(around, [frame, "y", "x"]).withColumn("__hit", F.col("label").isin(*classes))
    sizes = marked.where("__hit").groupBy(frame, F.col("label").alias("__l")).agg(F.count("*").alias("__n"), F.count_if("__same").alias("__left"))
    out = marked.join(sizes, (marked[frame] == sizes[frame]) & (F.col("label") == F.col("__l")), "left").drop(sizes[frame])
    gone = F.coalesce(F.col("__hit"), F.lit(False)) & ~F.col("__same") & (F.col("__n") >= least_area) & (F.col("__left") > 0)
    return out.withColumn("label", F.when(~gone, F.col("label"))).select(*pixels.columns)


def resized(pixels: DataFrame, from_size: tuple[int, int], to_size: tuple[int, int], frame: str = "frame") -> DataFrame:
    """Nearest-neighbour resize of images of (height, width): the new pixel (y, x) takes the old (floor(y * h / H), ...)."""
    (h, w), (nh, nw) = from_size, to_size
    spark = pixels.sparkSession
    rows = spark.range(nh).select(F.col("id").cast("int").alias("ny"), F.floor(F.col("id") * h / nh).cast("int").alias("y"))
    columns = spark.range(nw).select(F.col("id").cast("int").alias("nx"), F.floor(F.col("id") * w / nw).cast("int").alias("x"))
    return pixels.join(F.broadcast(rows), "y").join(F.broadcast(columns), "x").select(frame, F.col("ny").alias("y"), F.col("nx").alias("x"), "label")


def bilinear(points: DataFrame, pixels: DataFrame, value: str = "value", frame: str = "frame", key: str = "pid") -> DataFrame:
    """Values between pixels: each point (key, frame, u, v) takes its four neighbours by their weights; null if one is missing."""
    x0, y0 = F.floor("u"), F.floor("v")
    fx, fy = F.col("u") - x0, F.col("v") - y0
    taps = F.array(*(F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"), ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("w")) for dx in (0, 1) for dy in (0, 1)))
    asked = points.select(key, frame, F.explode(taps).alias("t")).select(key, frame, "t.*")
    got = asked.join(pixels.select(F.col(frame), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), value), [frame, "x", "y"], "left")
    return got.groupBy(key, frame).agg(F.when(F.count_if(F.col(value).isNull() & (F.col("w") > 0)) == 0, F.sum(F.col("w") * F.coalesce(value, F.lit(0.0)))).alias(value))


def backprojected(depth: DataFrame, fx: float, fy: float, cx: float, cy: float, far: float = 10.0) -> DataFrame:
    """Points in camera coordinates of depth pixels (frame, y, x, depth) with 0 < depth < far."""
    d = F.col("depth")
    return depth.where((d > 0) & (d < far)).select("frame", "y", "x", ((F.col("x") - cx) * d / fx).alias("px"), ((F.col("y") - cy) * d / fy).alias("py"), d.alias("pz"))


def density(points: DataFrame, frame: str = "frame") -> DataFrame:
    """Points of each pixel, and their number over the largest of the frame."""
    n = points.groupBy(frame, "y", "x").agg(F.count("*").alias("n"))
    most = n.groupBy(frame).agg(F.max("n").alias("__m"))
    return n.join(most, frame).select(frame, "y", "x", "n", (F.col("n") / F.col("__m")).alias("share"))
