"""Nested annotations: collected, padded, filtered, indexed; tables put together with running offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def collected(rows: DataFrame, by: str, order: Sequence[str], fields: Sequence[str], name: str = "items") -> DataFrame:
    """One row for each ``by`` with an array of structs in order. A group is one record's parts (captions of an image, frames
    of a track), which fit a row by their nature."""
    return rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*order, *(f for f in fields if f not in order)))).alias(name))


def flattened(rows: DataFrame, name: str = "items") -> DataFrame:
    """One row for each item with its position from 0; records without items give a row of nulls."""
    rest = [c for c in rows.columns if c != name]
    return rows.select(*rest, F.posexplode_outer(name).alias("position", "item")).select(*rest, "position", "item.*")


def multi_hot(indices: Column, n: int) -> Column:
    """An array of n zeros with ones at the given places."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.array_contains(indices, i), F.lit(False)).cast("int"))


def padded(values: Column, size: Column, fill: int = -1) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(size - F.size(values), F.lit(0)).cast("int")))


def offset_union(parts: list[tuple[DataFrame, DataFrame]], vertex_order: str = "vid", references: Sequence[str] = ("a", "b", "c")) -> tuple[DataFrame, DataFrame]:
    """Tables of (vertices, faces) put together: ids of later parts are moved up by the vertices before them. Only the counts of
    the parts, one number each, are read first."""
    before, vertices, faces = 0, None, None
    for v, f in parts:
        n = v.count()
        moved_v = v.withColumn(vertex_order, F.col(vertex_order) + F.lit(before))
        moved_f = f.withColumns({c: F.col(c) + F.lit(before) for c in references})
        vertices = moved_v if vertices is None else vertices.unionByName(moved_v, allowMissingColumns=True)
        faces = moved_f if faces is None else faces.unionByName(moved_f, allowMissingColumns=True)
        before += n
    return vertices, faces


def having_all(rows: DataFrame, key: str, member: str, wanted: Sequence) -> DataFrame:
    """Keys that have every wanted member."""
    return rows.where(F.col(member).isin(*wanted)).groupBy(key).agg(F.count_distinct(F.col(member)).alias("n")).where(F.col("n") == len(set(wanted))).select(key)


def next_pairs(rows: DataFrame, by: str, order: Sequence[str], value: str, unit: int = 1) -> DataFrame:
    """(this, next) values of adjacent rows of a group, times ``unit``; the last row of a group has no next and goes."""
    step = W.partitionBy(by).orderBy(*order)
    return rows.withColumn("start_offset", F.col(value) * unit).withColumn("end_offset", F.lead(value).over(step) * unit).where(F.col("end_offset").isNotNull())


def dense_index(rows: DataFrame, key: str, name: str = "index") -> DataFrame:
    """Distinct keys numbered from 0 in order. Keys are a dimension: far fewer than rows."""
    return rows.select(key).distinct().where(F.col(key).isNotNull()).withColumn(name, (F.row_number().over(W.orderBy(key)) - 1).cast("long"))


def instance_areas(pixels: DataFrame, by: Sequence[str] = ("image", "instance")) -> DataFrame:
    """Area and box (x, y, width, height) of each instance, and whether all its pixels have one category."""
    return pixels.groupBy(*by).agg(F.count("*").alias("area"), F.min("x").alias("bx"), F.min("y").alias("by"), (F.max("x") - F.min("x") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"), (F.min("category") == F.max("category")).alias("one_category"))


def remapped(rows: DataFrame, mapping: DataFrame, column: str, source: str = "from_id", target: str = "to_id", default: int | None = None) -> DataFrame:
    """``column`` replaced through a mapping; ids without an entry take the default."""
    out = rows.join(mapping.select(F.col(source).alias("__from"), F.col(target).alias("__to")), F.col(column) == F.col("__from"), "left")
    value = F.col("__to") if default is None else F.coalesce("__to", F.lit(default))
    return out.withColumn(column, value).drop("__from", "__to")


def any_uncrowded(rows: DataFrame, name: str = "annotations", flag: str = "iscrowd") -> DataFrame:
    """Records with at least one annotation that isn't a crowd."""
    return rows.where(F.exists(name, lambda a: F.coalesce(a[flag], F.lit(0)) == 0))


def by_conditions(rows: DataFrame, videos: Sequence | None = None, categories: Sequence | None = None, area: tuple[float, float] | None = None, crowd: int | None = None) -> DataFrame:
    """Annotations that meet all conditions given; the area's bounds are strict."""
    for column, values in (("video_id", videos), ("category_id", categories)):
        if values:
            rows = rows.where(F.col(column).isin(*values))
    if area is not None:
        rows = rows.where((F.col("avg_area") > area[0]) & (F.col("avg_area") < area[1]))
    return rows if crowd is None else rows.where(F.col("iscrowd") == crowd)


def emptied_ids(rows: DataFrame, identity: str, width: str, height: str, area: str, least: float = 1e-5) -> DataFrame:
    """The id of an instance with an empty box or mask becomes -1."""
    empty = (F.col(width) <= least) | (F.col(height) <= least) | (F.col(area) <= 0)
    return rows.withColumn(identity, F.when(empty, F.lit(-1)).otherwise(F.col(identity)))


def run_area(runs: Column) -> Column:
    """Pixels of a mask of runs (array of structs start, len)."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + r["len"])


def run_iou(left: DataFrame, right: DataFrame, by: Sequence[str], cell: int = 1024) -> DataFrame:
    """Intersection over union of every left and right mask of the same ``by`` that meet. Both sides: by, id, runs (array of
    start, len). Runs are dealt to the cells of the image that they cover, so masks meet by equi-join."""
    def dealt(side: DataFrame, name: str) -> DataFrame:
        one = side.select(*by, F.col("id").alias(name), F.explode("runs").alias("r")).select(*by, name, F.col("r.start").alias(f"{name}_s"), (F.col("r.start") + F.col("r.len")).alias(f"{name}_e"))
        return one.where(F.col(f"{name}_e") > F.col(f"{name}_s")).withColumn("cell", F.explode(F.sequence(F.floor(F.col(f"{name}_s") / cell), F.floor((F.col(f"{name}_e") - 1) / cell))))

    lo, hi = F.greatest("l_s", "g_s", F.col("cell") * cell), F.least("l_e", "g_e", (F.col("cell") + 1) * cell)
    both = dealt(left, "l").join(dealt(right, "g"), [*by, "cell"]).withColumn("n", F.greatest(hi - lo, F.lit(0)))
    inter = both.groupBy(*by, F.col("l").alias("left"), F.col("g").alias("right")).agg(F.sum("n").alias("inter")).where("inter > 0")
    for name, side in (("left", left), ("right", right)):
        inter = inter.join(side.select(*by, F.col("id").alias(name), run_area(F.col("runs")).alias(f"{name}_area")), [*by, name])
    return inter.select(*by, "left", "right", (F.col("inter") / (F.col("left_area") + F.col("right_area") - F.col("inter"))).alias("iou"))
