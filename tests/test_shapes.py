import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import shapes


def cloud(spark, p, label=0):
    return spark.createDataFrame([(i, *map(float, r), label) for i, r in enumerate(p)], "pid long, x double, y double, z double, label int")


def test_ground_and_normals(spark):
    rng = np.random.default_rng(1)
    floor = np.c_[rng.uniform(0, 10, (300, 2)), rng.normal(0, 0.01, 300)]
    wall = np.c_[rng.uniform(0, 10, 450), rng.normal(5, 0.01, 450), rng.uniform(0.5, 5, 450)]
    df = cloud(spark, np.r_[floor, wall])
    got = {r.pid: r.ground for r in shapes.ground_plane(df, 0.05).collect()}
    assert sum(got[i] for i in range(300)) > 290 and sum(got[i] for i in range(300, 750)) < 20
    n = {r.pid: r for r in shapes.normals(df, 8, 3.0).collect()}
    assert np.median([abs(n[i].nz) for i in range(300)]) > 0.95 and np.median([abs(n[i].ny) for i in range(300, 750)]) > 0.95
    assert {r.ground for r in shapes.ground_plane(df.where("pid < 2"), 0.05).collect()} == {False}


def test_density_clusters(spark):
    rng = np.random.default_rng(2)
    p = np.r_[rng.normal(0, 0.1, (40, 3)), rng.normal(5, 0.3, (40, 3)), rng.uniform(-20, 20, (8, 3)) + 40]
    got = {r.pid: r.cluster for r in shapes.density_clusters(cloud(spark, p), "label", 10).collect()}
    first, second = [got[i] for i in range(40)], [got[i] for i in range(40, 80)]
    assert first.count(0) >= 36 and second.count(1) >= 34 and all(got[i] is None for i in range(80, 88))
    assert shapes.density_clusters(cloud(spark, p[:3]), "label", 10).where("cluster is not null").count() == 0
    with pytest.raises(Exception, match="over the bound"):
        shapes.density_clusters(cloud(spark, p), "label", 10, most=50).collect()


def test_boxes(spark):
    one = spark.createDataFrame([(0.0, 0.0, 2.0, 4.0, 1.0, 1.0, 5.0, 3.0)], "a0 double, a1 double, a2 double, a3 double, b0 double, b1 double, b2 double, b3 double")
    a, b = (shapes.to_centre(*(F.col(f"{s}{i}") for i in range(4))) for s in "ab")
    back = shapes.to_corners(*shapes.apply_delta(a, shapes.box_delta(a, b)))
    assert np.allclose(tuple(one.select(*back).first()), (1, 1, 5, 3))


def test_mesh(spark):
    faces = spark.createDataFrame([(0, 1, 2, 3), (1, 2, 3, 4), (2, 3, 4, 5), (3, 7, 8, 9), (4, 4, 7, 1)], "fid long, a long, b long, c long")
    assert {r.fid: r.component for r in shapes.mesh_components(faces).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    assert {r.fid for r in shapes.mesh_components(faces, 2).collect()} == {0, 1, 2}


def test_corners_that_are_null_link_nothing(spark):
    """As in SQL, where null is not equal to null; and components of any size need no second pass over the triangles."""
    faces = spark.createDataFrame([(0, 1, None, None), (1, 2, None, None), (2, 2, 3, 4)], "fid long, a long, b long, c long")
    found = shapes.mesh_components(faces)
    assert {r.fid: r.component for r in found.collect()} == {0: 0, 1: 1, 2: 2}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
