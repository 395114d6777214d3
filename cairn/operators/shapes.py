"""Boxes, normals, planes and density hierarchies of point groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.spatial import AXES, knn_within, within


def corners(boxes: DataFrame, keep: tuple[str, ...] = ("box_id",)) -> DataFrame:
    """The eight corners of boxes (x0 ... z1), numbered by which of the larger x, y, z they take."""
    signs = F.array(*(F.struct(F.lit(k).alias("corner"), *(F.col(f"{a}{(k >> i) & 1}").alias(a) for i, a in enumerate(AXES))) for k in range(8)))
    return boxes.select(*keep, F.explode(signs).alias("c")).select(*keep, "c.*")


def to_centre(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
    return (x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0


def to_corners(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def box_delta(src: tuple[Column, ...], dst: tuple[Column, ...]) -> tuple[Column, ...]:
    """Offsets (of centres, over the size; of sizes, as logarithms) that take one (cx, cy, w, h) box to another."""
    return (dst[0] - src[0]) / src[2], (dst[1] - src[1]) / src[3], F.log(dst[2] / src[2]), F.log(dst[3] / src[3])


def apply_delta(src: tuple[Column, ...], delta: tuple[Column, ...]) -> tuple[Column, ...]:
    return src[0] + delta[0] * src[2], src[1] + delta[1] * src[3], src[2] * F.exp(delta[2]), src[3] * F.exp(delta[3])


def crop(width: Column, height: Column, x: Column, y: Column, size: int) -> tuple[Column, Column, Column, Column]:
    """A square around (x, y), moved so that it lies in the image, as x0, y0, x1, y1."""
    x0 = F.greatest(F.lit(0), F.least(x - size // 2, width - size))
    y0 = F.greatest(F.lit(0), F.least(y - size // 2, height - size))
    return x0, y0, F.least(x0 + size, width), F.least(y0 + size, height)


def normals(points: DataFrame, k: int, radius: float, key: str = "pid") -> DataFrame:
    """nx, ny, nz (the direction in which a point's k nearest, itself included, spread least, with nz >= 0); null for fewer than three."""
    near = knn_within(points, k - 1, radius, key).select(key, F.col("neighbour"))
    own = points.select(F.col(key), F.col(key).alias("neighbour"))
    members = near.unionByName(own).join(points.select(F.col(key).alias("neighbour"), *AXES), "neighbour")
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    c = members.groupBy(key).agg(F.count("*").alias("n"), *(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs))

    def run(batches):
        for pdf in batches:
            m = np.zeros((len(pdf), 3, 3))
            for i, a in enumerate(AXES):
                for j, b in enumerate(AXES):
                    m[:, i, j] = pdf[f"c{min(a, b)}{max(a, b)}"]
            v = np.linalg.eigh(m)[1][:, :, 0] if len(pdf) else np.zeros((0, 3))
            v = np.where(v[:, 2:] < 0, -v, v)
            v[pdf["n"].to_numpy() < 3] = np.nan
            yield pd.DataFrame({key: pdf[key], "nx": v[:, 0], "ny": v[:, 1], "nz": v[:, 2]})

    kind = points.schema[key].dataType.simpleString()
    return c.mapInPandas(run, f"{key} {kind}, nx double, ny double, nz double").withColumns({a: F.when(~F.isnan(a), F.col(a)) for a in ("nx", "ny", "nz")})


def without_splash(points: DataFrame, k: int, radius: float, steep: float = 0.85, key: str = "pid") -> DataFrame:
    """Points whose normal isn't nearly vertical; points without a normal stay."""
    flat = normals(points, k, radius, key).where(F.abs("nz") > steep).select(key)
    return points.join(flat, key, "left_anti")


def candidate_planes(points: DataFrame, tries: int, seed: int, key: str = "pid", sample: int = 3000) -> list[tuple[int, float, float, float, float]]:
    """Planes (id, a, b, c, d with unit normal) through three points of a bounded sample that a hash draws."""
    drawn = points.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(min(sample, 3 * tries)).select(*AXES).collect()
    out = []
    for i in range(len(drawn) // 3):
        p = np.array([[r[a] for a in AXES] for r in drawn[3 * i : 3 * i + 3]])
        n = np.cross(p[1] - p[0], p[2] - p[0])
        size = np.linalg.norm(n)
        if size > 1e-12:
            n = n / size
            out.append((i, *map(float, n), float(-n @ p[0])))
    return out


def ground_plane(points: DataFrame, distance: float, tries: int = 200, level: float = 0.8, most: int = 3, seed: int = 0, key: str = "pid") -> DataFrame:
    """points with ``ground``: within the distance of the first of up to ``most`` best planes (each found on what the planes before
    it leave) whose normal is within ``level`` of vertical; nothing is ground if none is. All planes are tried in one pass."""
    spark, rest = points.sparkSession, points
    for step in range(most):
        planes = candidate_planes(rest, tries, seed + step, key)
        if not planes:
            break
        table = spark.createDataFrame(planes, "plane int, a double, b double, c double, d double")
        far = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d"))
        hits = rest.select(*AXES).join(F.broadcast(table)).where(far <= distance).groupBy("plane").agg(F.count("*").alias("n"))
        best = hits.orderBy(F.col("n").desc(), "plane").first()
        if best is None:
            break
        a, b, c, d = next(p[1:] for p in planes if p[0] == best["plane"])
        near = F.abs(F.col("x") * a + F.col("y") * b + F.col("z") * c + d) <= distance
        if abs(c) >= level:
            return points.withColumn("ground", near)
        rest = rest.where(~near)
    return points.withColumn("ground", F.lit(False))


#: Distances that are held at once.
_HELD = 1 << 20


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1))


def stable_clusters(p: np.ndarray, least: int, samples: int) -> np.ndarray:
    """Clusters of a density hierarchy (-1: noise) of points: mutual reachability, a minimum spanning tree, and the clusters of
    greatest excess of mass; numbered by their smallest member. Distances are made anew where they are needed, never kept as a
    matrix: memory grows with the points, time with their square."""
    n = len(p)
    if n < max(2, least):
        return np.full(n, -1)
    k, step = min(samples, n) - 1, max(1, _HELD // n)
    # copies, as a column that is a view would keep all distances of its step
    core = np.concatenate([np.partition(_distances(p[i : i + step], p), k, axis=1)[:, k].copy() for i in range(0, n, step)])

    def reach(i: int) -> np.ndarray:
        return np.maximum(_distances(p[i : i + 1], p)[0], np.maximum(core[i], core))

    # minimum spanning tree from row 0
    best, source, inside, edges = reach(0), np.zeros(n, int), np.zeros(n, bool), []
    inside[0] = True
    for _ in range(n - 1):
        at = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((best[at], int(source[at]), at))
        inside[at] = True
        row = reach(at)
        closer = row < best
        best[closer], source[closer] = row[closer], at
    return condensed(n, edges, least)


def condensed(n: int, edges: list[tuple[float, int, int]], least: int) -> np.ndarray:
    """The clusters of greatest excess of mass from the edges (distance, row, row) of a minimum spanning tree of n rows. A forest will
    do: its trees are joined at an infinite distance."""
    out = np.full(n, -1)
    if n < max(2, least):
        return out
    # merge tree: node n + i joins two nodes at a distance
    parent, size, low, children, height = list(range(n)), [1] * n, list(range(n)), {}, {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = sorted(edges)
    if len(edges) < n - 1:
        joined = list(range(n))

        def top(x: int) -> int:
            while joined[x] != x:
                joined[x] = joined[joined[x]]
                x = joined[x]
            return x

        for _, a, b in edges:
            joined[top(a)] = top(b)
        first = top(0)
        for x in range(1, n):
            if top(x) != first:
                edges.append((np.inf, 0, x))
                joined[top(x)] = first
    for i, (d, a, b) in enumerate(edges):
        a, b, new = find(a), find(b), n + i
        parent.append(new)
        parent[a] = parent[b] = new
        size.append(size[a] + size[b])
        low.append(min(low[a], low[b]))
        children[new], height[new] = (a, b), d
    # condense: a split into two large parts makes clusters; small parts fall out of theirs
    born, nodes, total, parts = [0.0], [n + len(edges) - 1], [], []
    for c, here in enumerate(nodes):
        total.append(0.0)
        parts.append([])
        while here >= n:
            density = 1 / height[here] if height[here] > 0 else 1e12
            large = [s for s in children[here] if size[s] >= least]
            total[c] += size[here] * (density - born[c]) if len(large) != 1 else 0.0
            if len(large) == 2:
                parts[c] = [len(nodes), len(nodes) + 1]
                nodes += large
                born += [density, density]
            if len(large) != 1:
                break
            small = next(s for s in children[here] if s != large[0])
            total[c] += size[small] * (density - born[c])
            here = large[0]
    split = [False] * len(nodes)
    for c in reversed(range(len(nodes))):
        below = sum(total[x] for x in parts[c])
        if below > total[c]:
            total[c], split[c] = below, True
    chosen, todo = [], [0]
    while todo:
        c = todo.pop()
        if split[c]:
            todo += parts[c]
        else:
            chosen.append(nodes[c])
    for number, node in enumerate(sorted(chosen, key=low.__getitem__)):
        todo = [node]
        while todo:
            x = todo.pop()
            if x < n:
                out[x] = number
            else:
                todo += children[x]
    return out


def density_clusters(points: DataFrame, by: str, least: int, samples: int | None = None, key: str = "pid", most: int | None = None, radius: float | None = None) -> DataFrame:
    """by, key and cluster (null: noise) from the density hierarchy of each group.

    Without a radius a group is one task, whose memory grows with the group's points and whose time with their square; with
    ``most``, a larger group raises an error instead. With a radius, core distances and the minimum spanning forest are made by
    Spark, from pairs within the radius only (see ``spanning_forest``), and a task sees no more than a group's edges of the
    forest, one for each point; what lies further apart is joined at an infinite distance. Where no core distance and no edge
    of the tree is longer than the radius, both give the same clusters, but for ties of distances.
    """
    kind = points.schema
    schema = f"{by} {kind[by].dataType.simpleString()}, {key} {kind[key].dataType.simpleString()}, cluster int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if most is not None and len(pdf) > most:
            raise ValueError(f"a group of {len(pdf)} points is over the bound of {most}")
        pdf = pdf.sort_values(key, ignore_index=True)
        return pd.DataFrame({by: pdf[by], key: pdf[key], "cluster": stable_clusters(pdf[list(AXES)].to_numpy(float), least, samples or least)})

    def from_edges(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(left[key].to_numpy())
        a, b = (np.searchsorted(ids, right[c].to_numpy()) for c in "ab")
        edges = list(zip(right["w"].tolist(), a.tolist(), b.tolist(), strict=True))
        group = left[by].iloc[0] if len(left) else None
        return pd.DataFrame({by: [group] * len(ids), key: ids, "cluster": condensed(len(ids), edges, least)})

    if radius is None:
        out = points.select(by, key, *AXES).groupBy(by).applyInPandas(run, schema)
    else:
        forest = spanning_forest(points, by, samples or least, radius, key)
        out = points.select(by, key).groupBy(by).cogroup(forest.groupBy(by)).applyInPandas(from_edges, schema)
    return out.withColumn("cluster", F.when(F.col("cluster") >= 0, F.col("cluster")))


def spanning_forest(points: DataFrame, by: str, samples: int, radius: float, key: str = "pid") -> DataFrame:
    """by, a, b, w: a minimum spanning forest of each group under mutual reachability (the largest of the distance and both ends' core
    distances, that to the samples-th nearest point, the point itself included), from pairs within the radius.

    Rounds: every tree takes its shortest edge to another one (ties by the edge's ends), trees that such edges join become one, and
    edges within a tree are left out of the next round's table. Rounds grow with the logarithm of the points.
    """
    from pyspark.sql import Window as W

    from cairn.functions.storage import saved
    from cairn.operators.components import connected

    own = points.select(by, key, *AXES)
    pairs = saved(within(own, own, radius, by=(by,)).where(F.col(key) != F.col(f"r_{key}")).select(by, F.col(key).alias("a"), F.col(f"r_{key}").alias("b"), "distance"), "pairs")
    # row_number up to a bound is limited before the shuffle
    place = F.row_number().over(W.partitionBy("a").orderBy("distance", "b"))
    core = own.select(F.col(key).alias("a"), F.lit(0.0).alias("core")) if samples < 2 else pairs.withColumn("k", place).where(F.col("k") == samples - 1).select("a", F.col("distance").alias("core"))
    core = saved(core, "core")
    edges = pairs.where("a < b").join(core, "a").join(core.select(F.col("a").alias("b"), F.col("core").alias("other")), "b")
    edges = saved(edges.select(by, "a", "b", F.greatest("distance", "core", "other").alias("w"), F.col("a").alias("ta"), F.col("b").alias("tb")), "edges")
    forest = None
    while edges.take(1):
        sides = edges.select("ta", by, "a", "b", "w", "tb").union(edges.select("tb", by, "a", "b", "w", "ta"))
        best = saved(sides.groupBy("ta").agg(F.min(F.struct("w", "a", "b", by)).alias("e")).select("e.*").distinct(), "chosen")
        forest = best if forest is None else forest.unionByName(best)
        trees = edges.join(best.select("a", "b"), ["a", "b"], "left_semi").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
        root = saved(connected(trees), "trees")
        for side in ("ta", "tb"):
            edges = edges.join(root.select(F.col("node").alias("__n"), F.col("root").alias("__r")), F.col(side) == F.col("__n"), "left").withColumn(side, F.coalesce("__r", side)).drop("__n", "__r")
        edges = saved(edges.where("ta <> tb"), "edges")
    if forest is None:
        return edges.select(by, "a", "b", "w")
    return forest.select(by, "a", "b", "w").distinct()


def fragments_dropped(points: DataFrame, by: str, cluster: str = "cluster", share: float = 0.05, least: int = 50) -> DataFrame:
    """Clusters of at least max(share of the group's largest, least) points; points of others lose their cluster."""
    sizes = points.where(F.col(cluster).isNotNull()).groupBy(by, cluster).agg(F.count("*").alias("__n"))
    largest = sizes.groupBy(by).agg(F.max("__n").alias("__m"))
    kept = sizes.join(largest, by).where(F.col("__n") >= F.greatest(F.col("__m") * share, F.lit(least))).select(F.col(by).alias("__g"), F.col(cluster).alias("__c"))
    return points.join(kept, (F.col(by) == F.col("__g")) & (F.col(cluster) == F.col("__c")), "left").withColumn(cluster, F.col("__c")).drop("__g", "__c")


def mesh_components(faces: DataFrame, least: int = 1, key: str = "fid") -> DataFrame:
    """key and component of triangles (corners a, b, c) that share edges, components of at least ``least`` triangles. Each edge
    links its triangles to its smallest one, so a shared edge of any number of triangles gives no pairs."""
    from cairn.operators.components import connected

    edges = faces.select(key, F.inline(F.array(*(F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))))))
    # edges of one triangle link nothing
    first = edges.groupBy("p", "q").agg(F.min(key).alias("f"), F.max(key).alias("__last")).where("f < __last").drop("__last")
    roots = connected(edges.join(first, ["p", "q"]).where(F.col(key) != F.col("f")).select(F.col(key).alias("a"), F.col("f").alias("b")))
    out = faces.select(key).join(roots, F.col(key) == F.col("node"), "left").select(key, F.coalesce("root", key).alias("component"))
    if least <= 1:
        return out.where("component is not null")
    sizes = out.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component")
    return out.join(sizes, "component").select(key, "component")


def neighbours_of(points: DataFrame, radius: float, key: str = "pid") -> DataFrame:
    """How many other points lie within the radius of each."""
    pairs = within(points.select(key, *AXES), points.select(key, *AXES), radius).where(F.col(key) != F.col(f"r_{key}"))
    counts = pairs.groupBy(key).agg(F.count("*").alias("neighbours"))
    return points.select(key).join(counts, key, "left").select(key, F.coalesce("neighbours", F.lit(0)).cast("long").alias("neighbours"))
