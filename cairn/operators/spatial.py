"""Joins by distance and by boxes, on a grid of cells; clusters and outliers from them.

A point is dealt to its own cell; the other side to that cell's neighbours (27 in space). With cells as wide as the radius
no pair is lost, and cells make an equi-join, which Spark shuffles and splits like any other.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.storage import saved
from cairn.operators.components import connected

AXES = ("x", "y", "z")


def within(left: DataFrame, right: DataFrame, radius: float, axes: tuple[str, ...] = AXES, by: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of a left and a right row at most ``radius`` apart (of the same ``by``), with ``distance``. Columns of the right
    side get the prefix ``r_``."""
    other = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), *(F.col(c).alias(f"__by_{c}") for c in by))
    for c in by:
        left = left.withColumn(f"__by_{c}", F.col(c))
    for a in axes:
        left = left.withColumn(f"__{a}", F.floor(F.col(a) / radius))
        cell = F.floor(F.col(f"r_{a}") / radius)
        other = other.withColumn(f"__{a}", F.explode(F.array(cell - 1, cell, cell + 1)))
    keys = [*(f"__by_{c}" for c in by), *(f"__{a}" for a in axes)]
    squared = sum(((F.col(a) - F.col(f"r_{a}")) * (F.col(a) - F.col(f"r_{a}")) for a in axes), F.lit(0.0))
    return left.join(other, keys).withColumn("distance", F.sqrt(squared)).where(F.col("distance") <= radius).drop(*keys)


#: Sizes of cells that neighbours are looked for in, each half as wide as the one before.
LEVELS = 12


def _sides(radius: float, axes: tuple[str, ...]) -> Column:
    """How wide a cell of ``__level`` is: any two points of a cell of level j are at most radius / 2 ** j apart."""
    return F.lit(radius / len(axes) ** 0.5 * (1 - 1e-9)) / F.pow(F.lit(2.0), F.col("__level"))


def _celled(rows: DataFrame, side: Column, axes: tuple[str, ...]) -> DataFrame:
    return rows.select("*", *(F.floor(F.col(a) / side).alias(f"__{a}") for a in axes))


def _levelled(rows: DataFrame, side: Column, axes: tuple[str, ...]) -> DataFrame:
    return _celled(rows.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))), side, axes)


def _around(rows: DataFrame, side: Column, axes: tuple[str, ...], key: str) -> DataFrame:
    """rows once for each cell of their level that is no further than ``__bound``, which is a cell's diagonal at most."""
    cells = [f"__{a}" for a in axes]
    reach = range(-int(len(axes) ** 0.5) - 1, int(len(axes) ** 0.5) + 2)
    offsets = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(o, cells, strict=True))) for o in product(reach, repeat=len(axes))))

    def near(o: Column) -> Column:
        low = {a: (F.col(c) + o[c]) * side for a, c in zip(axes, cells, strict=True)}
        gaps = [F.greatest(low[a] - F.col(a), F.col(a) - low[a] - side, F.lit(0.0)) for a in axes]
        return F.sqrt(sum((g * g for g in gaps), F.lit(0.0))) <= F.col("__bound") + side * 1e-6

    return rows.withColumn("__o", F.explode(F.filter(offsets, near))).select(key, *axes, "__bound", "__level", *((F.col(c) + F.col(f"__o.{c}")).alias(c) for c in cells))


def nearest_within(left: DataFrame, right: DataFrame, radius: float, key: str = "pid", axes: tuple[str, ...] = AXES) -> DataFrame:
    """Left rows with the id and distance of the nearest right row within the radius (ties to the smaller id), or nulls.

    Pairs aren't made within the whole radius where right rows are dense: one right row of each cell around a left row bounds its
    distance, from the widest cell to the smallest, and only cells as near as that are looked into. Left rows whose widest cell holds
    none meet all within the radius. Of right rows at the same place only that of the smallest id can be nearest.
    """
    finite = reduce(Column.__and__, (F.abs(a) < float("inf") for a in axes))
    places = lambda rows: rows.select(key, *(F.col(a).cast("double").alias(a) for a in axes)).where(finite)
    own, side = saved(places(left), "points"), _sides(radius, axes)
    held = saved(places(right).groupBy(*axes).agg(F.min(key).alias(key)).select(key, *axes), "held")
    at = ["__level", *(f"__{a}" for a in axes)]
    squared = sum(((F.col(a) - F.col(f"r_{a}")) * (F.col(a) - F.col(f"r_{a}")) for a in axes), F.lit(0.0))
    other = _levelled(held, side, axes).select(*at, F.col(key).alias(f"r_{key}"), *(F.col(a).alias(f"r_{a}") for a in axes))
    one = other.groupBy(*at).agg(F.min(F.struct(f"r_{key}", *(f"r_{a}" for a in axes))).alias("__r")).select(*at, "__r.*")
    bounds = _levelled(own, side, axes).join(one, at).groupBy(key).agg(F.max("__level").alias("__level"), F.min(F.sqrt(squared)).alias("__bound"))
    placed = saved(own.join(bounds, key, "left"), "placed")
    asked = _around(_celled(placed.where("__level is not null"), side, axes), side, axes, key)
    close = asked.join(other, at).withColumn("distance", F.sqrt(squared)).where((F.col("distance") <= F.col("__bound")) & (F.col("distance") <= radius))
    alone = within(placed.where("__level is null").select(key, *axes), held, radius, axes)
    pairs = close.select(key, f"r_{key}", "distance").unionByName(alone.select(key, f"r_{key}", "distance"))
    best = pairs.groupBy(key).agg(F.min(F.struct("distance", f"r_{key}")).alias("best"))
    return left.join(best, key, "left").select(*left.columns, F.col(f"best.r_{key}").alias("nearest"), F.col("best.distance").alias("distance"))


def knn_within(points: DataFrame, k: int, radius: float, key: str = "pid", axes: tuple[str, ...] = AXES) -> DataFrame:
    """pid, place and distance of up to k nearest other points within the radius (ties to the smaller id).

    Pairs aren't made within the whole radius where points are dense. The smallest cell around a point that holds more than k bounds its
    k-th distance, first by the cell's diagonal, then by what the cell holds; only cells as near as that are looked into. Points that even the
    widest cell leaves alone meet all within the radius. Of points at the same place only the k + 1 smallest ids can be anyone's neighbours.
    """
    finite = reduce(Column.__and__, (F.abs(a) < float("inf") for a in axes))
    own = saved(points.select(key, *(F.col(a).cast("double").alias(a) for a in axes)).where(finite), "points")
    same_place = W.partitionBy(*axes).orderBy(key)
    held = saved(own.withColumn("__n", F.row_number().over(same_place)).where(F.col("__n") <= k + 1).drop("__n"), "held")
    side = _sides(radius, axes)
    cells = [f"__{a}" for a in axes]
    at = ["__level", *cells]
    full = _levelled(held, side, axes).groupBy(*at).agg(F.count("*").alias("__n")).where(F.col("__n") > k).drop("__n")
    finest = _levelled(own, side, axes).join(full, at).groupBy(key).agg(F.max("__level").alias("__level"))
    placed = saved(own.join(finest, key, "left"), "placed")
    dense = _celled(placed.where("__level is not null"), side, axes)
    other = _levelled(held, side, axes).select(*at, F.col(key).alias(f"r_{key}"), *(F.col(a).alias(f"r_{a}") for a in axes))
    squared = sum(((F.col(a) - F.col(f"r_{a}")) * (F.col(a) - F.col(f"r_{a}")) for a in axes), F.lit(0.0))
    met = lambda rows: rows.join(other, at).where(F.col(key) != F.col(f"r_{key}")).withColumn("distance", F.sqrt(squared))
    bounds = met(dense).groupBy(key).agg(F.get(F.sort_array(F.collect_list("distance")), F.lit(k - 1)).alias("__bound"))
    asked = _around(dense.join(bounds, key), side, axes, key)
    close = met(asked).where(F.col("distance") <= F.col("__bound")).select(key, f"r_{key}", "distance")
    alone = within(placed.where("__level is null").select(key, *axes), held, radius, axes).where(F.col(key) != F.col(f"r_{key}"))
    pairs = close.unionByName(alone.select(key, f"r_{key}", "distance"))
    order = W.partitionBy(key).orderBy("distance", f"r_{key}")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(key, "place", F.col(f"r_{key}").alias("neighbour"), "distance")


def absorbed(points: DataFrame, radius: float, cluster: str = "cluster", key: str = "pid", axes: tuple[str, ...] = AXES) -> DataFrame:
    """Points without a cluster take that of the nearest clustered point within the radius."""
    noise, known = points.where(F.col(cluster).isNull()), points.where(F.col(cluster).isNotNull())
    near = nearest_within(noise.select(key, *axes), known, radius, key, axes).select(key, "nearest")
    of = known.select(F.col(key).alias("nearest"), F.col(cluster).alias("__c"))
    return points.join(near.join(of, "nearest", "left").select(key, "__c"), key, "left").withColumn(cluster, F.coalesce(cluster, "__c")).drop("__c")


def outliers(points: DataFrame, k: int, ratio: float, radius: float, key: str = "pid", axes: tuple[str, ...] = AXES) -> DataFrame:
    """Mean distance to k neighbours, and whether it is more than ``ratio`` standard deviations over the mean of all. Points
    without a neighbour within the radius are outliers with a null mean."""
    means = knn_within(points, k, radius, key, axes).groupBy(key).agg(F.avg("distance").alias("mean_distance"))
    limit = means.agg((F.avg("mean_distance") + ratio * F.stddev_pop("mean_distance")).alias("limit"))
    return points.select(key).join(means, key, "left").join(F.broadcast(limit)).select(key, "mean_distance", F.coalesce(F.col("mean_distance") > F.col("limit"), F.lit(True)).alias("outlier"))


def in_boxes(points: DataFrame, boxes: DataFrame, margin: float = 0.0, cell: float = 8.0, axes: tuple[str, ...] = AXES) -> DataFrame:
    """All (point, box) with the point strictly within the box grown by the margin. boxes: box_id and <axis>0, <axis>1. Boxes
    are dealt to the cells that they cover in the first two axes."""
    a, b = axes[:2]
    spans = {v: F.sequence(F.floor((F.col(f"{v}0") - margin) / cell), F.floor((F.col(f"{v}1") + margin) / cell)) for v in (a, b)}
    dealt = boxes.withColumn("__i", F.explode(spans[a])).withColumn("__j", F.explode(spans[b]))
    own = points.withColumn("__i", F.floor(F.col(a) / cell)).withColumn("__j", F.floor(F.col(b) / cell))
    inside = [(F.col(v) > F.col(f"{v}0") - margin) & (F.col(v) < F.col(f"{v}1") + margin) for v in axes]
    hit = inside[0]
    for test in inside[1:]:
        hit = hit & test
    return own.join(dealt, ["__i", "__j"]).where(hit).select("pid", "box_id")


#: Pairs of groups that ``overlaps`` lists at most with their zeros.
GROUP_PAIRS = 1_000_000


def overlaps(left: DataFrame, right: DataFrame, tolerance: float, group: str = "label", key: str = "pid", axes: tuple[str, ...] = AXES, zeros: bool = True) -> DataFrame:
    """For pairs of a left and a right group: left points with a right point closer than the tolerance, over the smaller group's size.
    Pairs without any are listed too unless ``zeros`` is false; then there may be at most GROUP_PAIRS pairs of groups, which is seen
    from the counts of both, before their sizes are put together."""
    near = within(left.select(key, group, *axes), right.select(key, group, *axes), tolerance, axes).where(F.col("distance") < tolerance)
    hits = near.groupBy(F.col(group).alias("a"), F.col(f"r_{group}").alias("b")).agg(F.countDistinct(key).alias("near"))
    sizes = [side.groupBy(F.col(group).alias(name)).agg(F.count("*").alias(f"n_{name}")) for side, name in ((left, "a"), (right, "b"))]
    if zeros:
        pairs = left.agg(F.count_distinct(group)).first()[0] * right.agg(F.count_distinct(group)).first()[0]
        if pairs > GROUP_PAIRS:
            raise ValueError(f"{pairs} pairs of groups are over the bound of {GROUP_PAIRS}: take zeros=False")
        both = sizes[0].join(F.broadcast(sizes[1])).join(hits, ["a", "b"], "left")
    else:
        both = hits.join(sizes[0], "a").join(sizes[1], "b")
    return both.select("a", "b", F.coalesce("near", F.lit(0)).cast("long").alias("near"), (F.coalesce("near", F.lit(0)) / F.least("n_a", "n_b")).alias("overlap"))


#: Core points of a cell that are compared with those of another cell first.
FIRST = 16


def dbscan(points: DataFrame, eps: float, least: int, key: str = "pid", axes: tuple[str, ...] = AXES, by: tuple[str, ...] = ()) -> DataFrame:
    """pid, core and cluster. A core point has ``least`` points within eps, itself included; a cluster is named by its smallest
    core id; a border point takes the smallest cluster within eps, others have none. With ``by`` (say, the scene) only points
    of the same are neighbours; keys are unique over all.

    Cells are so small that all points of one are neighbours: where a cell holds ``least`` of them, all are core, and no pairs are made within it.
    Only points of emptier cells are compared with those around them. Cells with core points are linked by the first few of their points;
    pairs of cells that are not in one component yet are then compared by all points that lie within eps of the other cell's box.
    """
    n_axes = len(axes)
    side = eps / n_axes**0.5 * (1 - 1e-9)
    reach = range(-int(eps / side) - 1, int(eps / side) + 2)
    cells = [f"__{a}" for a in axes]
    keys = [*by, *cells]
    offsets = [o for o in product(reach, repeat=n_axes) if sum(max(0, abs(i) - 1) ** 2 for i in o) * side * side <= eps * eps]
    around = lambda some: F.explode(F.array(*(F.struct(*((F.col(c) + o).alias(c) for c, o in zip(cells, offset, strict=True))) for offset in some)))
    squared = lambda left, right: sum(((F.col(f"{left}{a}") - F.col(f"{right}{a}")) * (F.col(f"{left}{a}") - F.col(f"{right}{a}")) for a in axes), F.lit(0.0))
    near = lambda left, right: F.sqrt(squared(left, right)) <= eps

    own = points.select(key, *by, *axes, *(F.floor(F.col(a) / side).alias(c) for a, c in zip(axes, cells, strict=True))).dropna(subset=[key, *axes])
    counts = own.groupBy(*keys).agg(F.count("*").alias("__n"))
    named = counts.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)), "__n")
    same_cell = lambda: _all(F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys))
    placed = saved(own.join(named, same_cell()).drop(*(f"__k{i}" for i in range(len(keys)))), "placed")
    sparse = placed.where(F.col("__n") < least)

    # of points in emptier cells: who is within eps
    asked = sparse.select(F.col(key).alias("p"), *(F.col(a).alias(f"p_{a}") for a in axes), *by, around(offsets).alias("__at")).select("p", *(f"p_{a}" for a in axes), *(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), *(F.col(f"__at.{c}").alias(f"__k{len(by) + i}") for i, c in enumerate(cells)))
    pairs = saved(asked.join(placed, same_cell()).where(near("p_", "")).select("p", F.col(key).alias("q")), "pairs")
    few = pairs.groupBy(F.col("p").alias(key)).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key)
    cores = placed.where(F.col("__n") >= least).unionByName(sparse.join(few, key)).drop("__n")

    # cells with core points, each known by its smallest core id
    boxes = cores.groupBy(*keys).agg(F.min(key).alias("cell"), F.count("*").alias("__size"), *(f(a).alias(f"{n}_{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))))
    boxes = saved(boxes, "boxes")
    of_box = boxes.select(F.col("cell"), *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)))
    cores = saved(cores.join(of_box, same_cell()).select(key, "cell", *axes), "cores")
    forward = [o for o in offsets if o > (0,) * n_axes]
    side_of = lambda n: [F.col("cell").alias(n), F.col("__size").alias(f"{n}_n"), *(F.col(f"{e}_{a}").alias(f"{n}_{e}_{a}") for a in axes for e in ("lo", "hi"))]
    left = boxes.select(*side_of("a"), *(F.col(c).alias(f"__b{i}") for i, c in enumerate(by)), around(forward).alias("__at")).select("*", *(F.col(f"__at.{c}").alias(f"__b{len(by) + i}") for i, c in enumerate(cells))).drop("__at")
    right = boxes.select(*side_of("b"), *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)))
    gap = sum((F.greatest(F.col(f"a_lo_{a}") - F.col(f"b_hi_{a}"), F.col(f"b_lo_{a}") - F.col(f"a_hi_{a}"), F.lit(0.0)) ** 2 for a in axes), F.lit(0.0))
    meets = left.join(right, _all(F.col(f"__b{i}").eqNullSafe(F.col(f"__k{i}")) for i in range(len(keys)))).where(gap <= eps * eps * (1 + 1e-9))
    meets = saved(meets.drop(*(f"__b{i}" for i in range(len(keys))), *(f"__k{i}" for i in range(len(keys)))), "meets")

    some = cores.withColumn("__r", F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64(key), key))).where(F.col("__r") <= FIRST)
    at = lambda rows, n: rows.select(F.col("cell").alias(n), *(F.col(a).alias(f"{n}_{a}") for a in axes))
    linked = meets.select("a", "b").join(at(some, "a"), "a").join(at(some, "b"), "b").where(near("a_", "b_")).select("a", "b").distinct()
    roots = connected(linked)
    root = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root"))
    # where both cells have no more points than were compared, there is nothing left to see
    open_ = meets.where(F.greatest("a_n", "b_n") > FIRST).join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).drop("a_root", "b_root")
    open_ = saved(open_, "open")
    if open_.take(1):
        beside = lambda n, other: sum((F.greatest(F.col(f"{other}_lo_{a}") - F.col(f"{n}_{a}"), F.col(f"{n}_{a}") - F.col(f"{other}_hi_{a}"), F.lit(0.0)) ** 2 for a in axes), F.lit(0.0)) <= eps * eps * (1 + 1e-9)
        first = open_.join(at(cores, "a"), "a").where(beside("a", "b")).select("a", "b", *(f"a_{a}" for a in axes))
        second = open_.join(at(cores, "b"), "b").where(beside("b", "a")).select("a", "b", *(f"b_{a}" for a in axes))
        more = first.join(second, ["a", "b"]).where(near("a_", "b_")).select("a", "b").distinct()
        roots = connected(linked.unionByName(more))
    labelled = cores.join(roots, F.col("cell") == F.col("node"), "left").select(key, F.coalesce("root", "cell").alias("cluster"))
    border = pairs.join(labelled.select(F.col(key).alias("q"), "cluster"), "q").groupBy(F.col("p").alias(key)).agg(F.min("cluster").alias("near"))
    return points.select(key).join(labelled, key, "left").join(border, key, "left").select(key, F.col("cluster").isNotNull().alias("core"), F.coalesce("cluster", "near").alias("cluster"))


def _all(conditions) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def log_gap(sizes: DataFrame, least: int = 10, most: int = 50, gap: float = 1.0, n: str = "n") -> DataFrame:
    """The cut at the first gap of at least ``gap`` between the logarithms of sorted sizes (the size below the gap plus one),
    held within least and most; the least if there is no gap. Sizes of groups, so one row a group; equal sizes count once."""
    one = sizes.select(F.col(n).cast("long").alias("n")).distinct()
    steps = one.withColumn("next", F.lead("n").over(W.orderBy("n"))).where(F.log1p("next") - F.log1p("n") >= gap)
    return steps.agg(F.min("n").alias("below")).select(F.least(F.greatest(F.coalesce(F.col("below") + 1, F.lit(least)), F.lit(least)), F.lit(most)).cast("long").alias("cut"))


def covariance(points: DataFrame, by: str = "label") -> DataFrame:
    """Sample covariances of each group's coordinates."""
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    return points.groupBy(by).agg(F.count("*").alias("n"), *(F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in pairs))


def planarity(points: DataFrame, by: str = "label") -> DataFrame:
    """(second - third) / first eigenvalue of each group's covariance, descending; 0 for fewer than four points. The
    eigenvalues of a symmetric 3x3 matrix in closed form."""
    c = covariance(points, by)
    q = (F.col("cxx") + F.col("cyy") + F.col("czz")) / 3
    p1 = F.col("cxy") * F.col("cxy") + F.col("cxz") * F.col("cxz") + F.col("cyz") * F.col("cyz")
    p2 = sum(((F.col(f"c{a}{a}") - q) * (F.col(f"c{a}{a}") - q) for a in AXES), F.lit(0.0)) + 2 * p1
    p = F.sqrt(p2 / 6)
    x, y, z = ((F.col(f"c{a}{a}") - q) for a in AXES)
    det = x * (y * z - F.col("cyz") * F.col("cyz")) - F.col("cxy") * (F.col("cxy") * z - F.col("cyz") * F.col("cxz")) + F.col("cxz") * (F.col("cxy") * F.col("cyz") - y * F.col("cxz"))
    r = F.least(F.greatest(F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    phi = F.acos(r) / 3
    first = q + 2 * p * F.cos(phi)
    third = q + 2 * p * F.cos(phi + F.lit(2.0943951023931953))
    second = 3 * q - first - third
    return c.select(by, "n", F.when(F.col("n") < 4, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(second - third, first), F.lit(0.0))).alias("planarity"))
