"""Small worked cases with answers found by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.functions.labels import answer, hex_colour, normalised_label, safe_name, shortened
from cairn.operators import annotations, colour, images, knn, matching, metrics, sampling, scene, series, spatial, votes
from cairn.operators.components import connected


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_zbuffer(spark):
    p = spark.createDataFrame([(1, 0.4, 0.4, 1.0), (2, 0.49, 0.2, 1.1), (3, 0.3, 0.3, 1.2), (4, 3.6, 1.0, 2.0), (5, 2.5, 1.5, 3.0)], "pid long, u double, v double, depth double")
    seen = p.withColumn("px", F.least(F.greatest(F.rint("u"), F.lit(0)), F.lit(3))).withColumn("py", F.least(F.greatest(F.rint("v"), F.lit(0)), F.lit(2))).withColumn("frame", F.lit(1))
    assert [r.pid for r in votes.visible(seen, 0.15).orderBy("pid").collect()] == [1, 2, 4, 5]
    pixels = spark.createDataFrame([(1, y, x, y * 4 + x) for y in range(3) for x in range(4)], "frame int, y int, x int, label int")
    found = dict(votes.looked_up(seen, pixels, 4, 3).select("pid", "label").collect())
    assert found[4] is None and found[5] == 10


def test_votes(spark):
    seen = [(10, "A")] * 3 + [(10, "B")] * 2 + [(11, "A")] * 2 + [(11, "B")] * 2 + [(11, "C")] + [(12, "A")] * 4 + [(13, "A")] * 4 + [(13, "B")] + [(14, None)] * 9
    obs = spark.createDataFrame(seen, "pid int, label string")
    assert [(r.pid, r.winner) for r in votes.majority(obs).orderBy("pid").collect()] == [(10, "A"), (11, "A"), (13, "A")]
    assert {r.pid: r.accepted for r in votes.confident(obs).collect()} == {10: False, 11: False, 12: True, 13: True}
    assert votes.majority(obs.where("pid is null")).count() == 0


def test_voxels(spark):
    p = spark.createDataFrame([(i, x, 0.0, 0.0, "a") for i, x in enumerate((0.1, 0.4, 0.6, -0.1))], "pid int, x double, y double, z double, label string")
    assert [(r.vx, round(r.mx, 6)) for r in votes.voxel_means(p, 0.5).orderBy("vx").collect()] == [(-1, -0.1), (0, 0.25), (1, 0.6)]


def test_colours(spark):
    palette = spark.createDataFrame([(0, "wall", 120, 120, 120), (1, "road", 140, 140, 140), (2, "grass", 4, 250, 7), (3, "skyscraper", 140, 140, 140), (4, "bottle", 0, 255, 10)], "class_id int, name string, r int, g int, b int")
    p = spark.createDataFrame([(140, 140, 140), (0, 0, 0), (127, 127, 127), (128, 120, 120)], "r int, g int, b int")
    names = lambda df: {(r.r, r.g, r.b): r.name for r in df.collect()}
    box, ball = names(colour.nearest_in_box(p, palette)), names(colour.nearest_in_ball(p, palette))
    assert box == {(140, 140, 140): "road", (0, 0, 0): None, (127, 127, 127): "wall", (128, 120, 120): None}
    assert ball[(128, 120, 120)] == "wall" and ball[(127, 127, 127)] == "wall"
    assert names(colour.exact(p, palette))[(140, 140, 140)] == "skyscraper"
    assert names(colour.named_or_unknown(p, palette))[(0, 0, 0)] == "unknown_000_000_000"


def test_relations(spark):
    def boxes(found):
        return spark.createDataFrame([(i, f"n{i}", label, kind, 20, *map(float, c)) for i, (label, kind, c) in enumerate(found)], "ord long, node_id string, label string, kind string, n long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")

    room = boxes([("floor", "region", (0, 0, -0.1, 10, 10, 0)), ("table", "object", (1, 1, 0, 3, 2, 0.8)), ("box", "object", (1.5, 1.2, 0.8, 1.9, 1.6, 1.1))])
    assert round(scene.near_threshold(room).first()[0], 5) == 0.49675
    found = scene.edge_ids(scene.relations(room, ("floor", "table"), ("floor",), ("floor",)))
    kept = [(r.edge_id, r.source, r.target, r.relation, r.confidence) for r in found.orderBy("edge_id").collect() if r.relation == "on"]
    assert [k[1:] for k in kept] == [("n1", "n0", "on", 1.0), ("n2", "n1", "on", 1.0)]
    chairs = boxes([("chair", "object", (0, 0, 0, 0.5, 0.5, 1)), ("chair", "object", (0.6, 0, 0, 1.1, 0.5, 1))])
    assert {r.relation: r.confidence for r in scene.relations(chairs, (), (), ()).collect()} == {"near": 0.9, "adjacent_to": 0.9778}


def test_confusion(spark):
    pairs = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(255, 1)], "gt int, pred int")
    r = metrics.mean_scores(metrics.class_areas(metrics.confusion(pairs, ignore=255))).first()
    assert [round(v, 6) for v in (r.accuracy, r.miou, r.macc, r.fwiou)] == [0.833333, 0.708333, 0.875, 0.722222]


def test_as_of(spark):
    clouds = spark.createDataFrame([(1, 0, 500), (2, 0, 1400), (3, 0, 2800)], "id int, s int, ts long")
    poses = spark.createDataFrame([(7, 0, 0), (8, 0, 1000), (9, 0, 2000)], "id int, s int, ts long")
    assert {r.id: r.match_ts for r in matching.nearest_in_time(clouds, poses, 700, "s").collect()} == {1: 0, 2: 1000, 3: None}


def test_knn_vote(spark):
    near = spark.createDataFrame([(1, 1, "A", 0.9), (1, 2, "B", 0.8), (1, 3, "B", 0.8)], "query_id int, rank int, label string, score double")
    assert {r.k: r.predicted for r in knn.vote(near, (1, 3)).collect()} == {1: "A", 3: "A"}
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "vec_id long, embedding array<double>")
    got = {}
    for r in knn.top_k(df.where("vec_id < 9"), df, 3, block=4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.neighbour
    s = v @ v.T
    np.fill_diagonal(s, -9)
    assert all([got[i][k] for k in (1, 2, 3)] == np.argsort(-s[i])[:3].tolist() for i in range(9))


def test_latency(spark):
    df = spark.createDataFrame([("a", 10.0 * i) for i in range(1, 6)] + [("b", 10.0 * i) for i in range(1, 5)], "g string, v double")
    assert {r.g: (r.p50, r.p95) for r in metrics.latency(df, "g", "v").collect()} == {"a": (30.0, 50.0), "b": (30.0, 40.0)}


def test_log_gap(spark):
    assert spatial.log_gap(spark.createDataFrame([(n,) for n in (3, 4, 5, 60, 80)], "n long")).first()[0] == 10
    assert spatial.log_gap(spark.createDataFrame([], "n long")).first()[0] == 10


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (5, 4), (6, 6), (None, 7)], "a long, b long")
    assert rows(connected(links)) == [(2, 1), (3, 1), (5, 4)]
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in connected(chain).collect()} == {0}
    assert connected(links.where("a > 99")).count() == 0


def test_reciprocal_rank(spark):
    scores = [(0, 0, [0.5, 0.3, 0.2]), (1, 0, [0.4, 0.4, 0.2]), (2, 1, [0.6, 0.3, 0.1])]
    df = spark.createDataFrame([(i, k, v, t) for i, t, s in scores for k, v in enumerate(s)], "id int, label int, score double, gt int")
    assert round(metrics.mean_reciprocal_rank(df, 3).first()[0], 7) == 0.4166664


def test_fused(spark):
    table = [[0.9, 0.8], [0.85, 0.2], [0.1, 0.16]]
    pairs = spark.createDataFrame([(0, i, j, v) for i, r in enumerate(table) for j, v in enumerate(r)], "grp int, row int, col int, score double")
    assert rows(matching.fused(pairs, "grp", column="col"), "row") == [(0, 0, 0, 0.9, "one"), (0, 1, 1, 0.2, "many"), (0, 2, 1, 0.16, "many")]


@pytest.mark.parametrize("seed", range(5))
def test_assignment(seed):
    from itertools import permutations

    cost = np.random.default_rng(seed).random((4, 5))
    best = min(sum(cost[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))
    assert abs(sum(cost[r, c] for r, c in matching.assign(cost)) - best) < 1e-12
    assert abs(sum(cost.T[r, c] for r, c in matching.assign(cost.T)) - best) < 1e-12


def test_answers_and_names(spark):
    df = spark.createDataFrame([("对",), ("Y",), (" true ",), ("错",), ("no",), ("0",), ("",), ("maybe",), (None,)], "c string")
    assert [r[0] for r in df.select(answer(F.col("c"))).collect()] == [1, 1, 1, 0, 0, 0, None, None, None]
    one = spark.createDataFrame([(" Big__Red  box ", "é!", 255)], "a string, b string, n int")
    got = one.select(normalised_label(F.col("a")), safe_name(F.col("b")), hex_colour(F.lit(1), F.lit(16), F.col("n")), shortened(F.lit("abcdef"), 4)).first()
    assert tuple(got) == ("big red box", "_", "#0110ff", "abc…")


def test_confidence(spark):
    df = spark.createDataFrame([(1,), (15,), (150,), (300,)], "n int")
    assert [round(r[0], 5) for r in df.select(G.count_confidence(F.col("n"), 15)).collect()] == [0.35, 0.35, 0.78761, 1.0]


def test_rotation(spark):
    half = 0.5**0.5
    m = G.quaternion_matrix(F.lit(0.0), F.lit(0.0), F.lit(2 * half), F.lit(2 * half))  # a quarter turn about z, not normalised
    got = spark.range(1).select(*G.rotate(m, (F.lit(1.0), F.lit(0.0), F.lit(0.0)))).first()
    assert np.allclose(tuple(got), (0, 1, 0))


def test_dbscan(spark):
    p = [(i, 0.1 * i, 0.0, 0.0) for i in range(5)] + [(10, 5.0, 5.0, 5.0), (11, 0.55, 0.0, 0.0)]
    df = spark.createDataFrame(p, "pid long, x double, y double, z double")
    got = {r.pid: (r.core, r.cluster) for r in spatial.dbscan(df, 0.16, 3).collect()}
    assert got[2] == (True, 1) and got[0] == (False, 1) and got[10] == (False, None) and got[11] == (False, 1) or got[11] == (False, None)


def test_planarity(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(200, 3)) * (3, 2, 0.1)
    df = spark.createDataFrame([(1, *map(float, r)) for r in p], "label int, x double, y double, z double")
    e = np.sort(np.linalg.eigvalsh(np.cov(p.T)))[::-1]
    assert abs(spatial.planarity(df).first().planarity - (e[1] - e[2]) / e[0]) < 1e-9


def test_sampling_is_disjoint_and_stable(spark):
    df = spark.range(100).withColumn("label", F.col("id") % 3)
    shards = sampling.even_shards(df, "id", 1, 7).collect()
    assert len({r.id for r in shards}) == 98 and {r.shard: sum(x.shard == r.shard for x in shards) for r in shards} == dict.fromkeys(range(7), 14)
    assert rows(sampling.per_class(df, 5, "label", "id", 2)) == rows(sampling.per_class(df.repartition(7), 5, "label", "id", 2))
    assert sampling.batches(df, "id", 1, 32).count() == 96


def test_nested(spark):
    df = spark.createDataFrame([(1, [0, 2]), (2, [])], "id int, at array<int>")
    assert [r[0] for r in df.orderBy("id").select(annotations.multi_hot(F.col("at"), 3)).collect()] == [[1, 0, 1], [0, 0, 0]]
    assert [r[0] for r in df.orderBy("id").select(annotations.padded(F.col("at"), F.lit(3))).collect()] == [[0, 2, -1], [-1, -1, -1]]
    parts = [(spark.range(3).withColumnRenamed("id", "vid"), spark.createDataFrame([(0, 1, 2)], "a long, b long, c long"))] * 2
    v, f = annotations.offset_union(parts)
    assert rows(v) == [(i,) for i in range(6)] and rows(f) == [(0, 1, 2), (3, 4, 5)]


def test_images(spark):
    grid = spark.createDataFrame([(0, y, x, int(x >= 3)) for y in range(6) for x in range(6)], "frame int, y int, x int, label int")
    ignored = {(r.y, r.x): r.label for r in images.boundary_ignored(grid).collect()}
    assert ignored[(0, 2)] is None and ignored[(0, 3)] is None and ignored[(0, 1)] == 0 and ignored[(0, 4)] == 1
    eaten = {(r.y, r.x): r.label for r in images.eroded(grid, 1, (1,), 5).collect()}
    assert eaten[(3, 3)] is None and eaten[(3, 4)] == 1 and eaten[(3, 2)] == 0
    values = grid.withColumn("value", F.col("x").cast("double"))
    at = spark.createDataFrame([(1, 0, 1.25, 2.5), (2, 0, 9.0, 9.0)], "pid int, frame int, u double, v double")
    assert {r.pid: r.value for r in images.bilinear(at, values).collect()} == {1: 1.25, 2: None}


def test_series(spark):
    assert series.tile_starts(10, 4, 3) == [0, 3, 6] and series.tile_starts(11, 4, 3) == [0, 3, 6, 7] and series.tile_starts(3, 4, 3) == [0]
    df = spark.createDataFrame([("a", i, float(i)) for i in range(1, 5)], "g string, i int, v double")
    state = 0.0
    for i in range(1, 5):
        state = 0.9 * state + 0.1 * i
    assert abs(series.exponential_mean(df, "g", "i", "v", 0.9).first().state - state) < 1e-12
    assert [r.recent_median for r in series.smoothed(df, "g", ("i",), "v", 3).orderBy("i").collect()] == [1.0, 1.0, 2.0, 3.0]
