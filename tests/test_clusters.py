"""Density clusters by cells against brute force: dense heaps, thin bridges, several scenes, repeated and missing places."""

import numpy as np
import pytest

from cairn.operators import spatial


def brute(rows, eps, least, axes):
    """Each point with whether it is core, and its cluster."""
    out = {}
    for scene in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == scene and None not in r[2:]]
        x = np.array([r[2 : 2 + axes] for r in own], float).reshape(-1, axes)
        near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
        core = near.sum(1) >= least
        ids = [r[0] for r in own]
        cluster = [i if c else None for i, c in zip(ids, core, strict=True)]
        moved = True
        while moved:
            moved = False
            for i in np.flatnonzero(core):
                low = min(cluster[j] for j in np.flatnonzero(near[i] & core))
                if low < cluster[i]:
                    cluster[i], moved = low, True
        for i, c in enumerate(core):
            close = [cluster[j] for j in np.flatnonzero(near[i] & core)]
            out[ids[i]] = (bool(c), cluster[i] if c else min(close, default=None))
    return {r[0]: out.get(r[0], (False, None)) for r in rows}


@pytest.mark.parametrize("seed,eps,least,axes", [(1, 0.5, 4, 3), (2, 0.9, 12, 2), (3, 0.3, 2, 3), (4, 2.0, 30, 1), (5, 0.05, 1, 2)])
def test_clusters_are_those_of_brute_force(spark, seed, eps, least, axes):
    rng = np.random.default_rng(seed)
    heaps = rng.normal(size=(6, 3)) * 3
    x = np.concatenate([heaps[rng.integers(0, 6, 220)] + rng.normal(size=(220, 3)) * 0.4, rng.uniform(-6, 6, (80, 3)), np.linspace(heaps[0], heaps[1], 40), np.round(rng.normal(size=(30, 3)) * 2)])
    rows = [(int(i * 7 % 1000), int(i % 2) if seed % 2 else 0, *map(float, v)) for i, v in enumerate(x)]
    rows += [(5000, 0, None, 1.0, 1.0), (5001, 0, *rows[0][2:]), (5002, 1, *rows[0][2:])]
    df = spark.createDataFrame(rows, "pid long, scene int, x double, y double, z double").repartition(3)
    got = spatial.dbscan(df, eps, least, axes=("x", "y", "z")[:axes], by=("scene",))
    assert {r.pid: (r.core, r.cluster) for r in got.collect()} == brute(rows, eps, least, axes)


def test_a_heap_of_points_makes_no_pairs(spark):
    """Ten thousand points at one place and a few around it: pairs would be a hundred million."""
    rng = np.random.default_rng(9)
    rows = [(i, *map(float, rng.normal(size=3) * 0.01)) for i in range(10_000)] + [(20_000 + i, 0.3 + 0.1 * i, 0.0, 0.0) for i in range(5)] + [(30_000, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    got = {r.pid: (r.core, r.cluster) for r in spatial.dbscan(df, 0.5, 10).collect()}
    assert {got[i] for i in range(10_000)} == {(True, 0)} and got[30_000] == (False, None)
    assert [got[20_000 + i] for i in range(5)] == [(True, 0)] * 3 + [(False, 0)] * 2
