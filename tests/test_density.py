import tracemalloc

import numpy as np

from cairn.operators import shapes


def test_large_groups_have_clusters(spark):
    rng = np.random.default_rng(4)
    p = np.r_[rng.normal(0, 0.3, (2600, 3)), rng.normal(9, 0.3, (2600, 3))]
    df = spark.createDataFrame([(i, *map(float, r), 0) for i, r in enumerate(p)], "pid long, x double, y double, z double, label int")
    got = {r.pid: r.cluster for r in shapes.density_clusters(df, "label", 50).collect()}
    first, second = [got[i] for i in range(2600)], [got[i] for i in range(2600, 5200)]
    assert len(got) == 5200 and first.count(0) > 2300 and second.count(1) > 2300 and 1 not in first and 0 not in second


def test_deep_hierarchies():
    # spacing grows along the line, so that pairs join one after the other: as many levels as pairs
    x = np.repeat(np.cumsum(np.arange(1.0, 1501.0)), 2) + np.tile([0, 0.01], 1500)
    got = shapes.stable_clusters(np.c_[x, np.zeros((3000, 2))], 2, 2)
    assert len(got) == 3000 and got.max() >= 1


def test_clusters_by_spark_are_those_of_one_task(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in (0, 1):
        p = np.r_[rng.normal(0, 0.4, (60, 3)), rng.normal(4, 0.4, (50, 3)), rng.uniform(-3, 7, (15, 3))]
        rows += [(1000 * g + i, *map(float, r), g) for i, r in enumerate(p)]
    rows.append((5000, 0.0, 0.0, 0.0, 2))
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, label int").repartition(3)
    one = {r.pid: r.cluster for r in shapes.density_clusters(df, "label", 8, 5).collect()}
    two = {r.pid: r.cluster for r in shapes.density_clusters(df, "label", 8, 5, radius=40.0).collect()}
    assert one == two and len(set(one.values())) > 2
    # pairs beyond the radius are never looked at: the two crowds are still told apart
    near = {r.pid: r.cluster for r in shapes.density_clusters(df.where("label = 0"), "label", 8, 5, radius=1.5).collect()}
    assert len(near) == 125 and len({near[i] for i in range(60)} & {near[i] for i in range(60, 110)} - {None}) == 0
    assert sum(near[i] is not None for i in range(110)) > 80


def test_distances_are_not_kept():
    p = np.random.default_rng(5).normal(size=(6000, 3))
    tracemalloc.start()
    shapes.stable_clusters(p, 5, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160e6  # all distances would be 288 MB
