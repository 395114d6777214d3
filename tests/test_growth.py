"""Forms of plans whose work grows no faster than the rows."""

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import fusion, matching, metrics, running, spatial
from cairn.sources import formats


def plan(df):
    return df._jdf.queryExecution().toString()


def test_detections_of_many_groups_share_a_batch(spark):
    n = 3000
    dets = spark.range(n).selectExpr("id % 1000 AS video", "id", "CAST(id % 7 AS DOUBLE) AS score")
    pairs = spark.range(n).selectExpr("id % 1000 AS video", "id", "id % 2000 AS truth", "0.5 + (id % 10) / 20 AS iou").where("id % 3 > 0")
    truths = spark.range(2000).selectExpr("id % 1000 AS video", "id AS truth", "CAST(id % 5 = 0 AS INT) AS ignore")
    got = matching.detections_matched(pairs, dets, truths, ("video",), (0.5, 0.75))
    assert "FlatMapGroupsInPandas" not in plan(got)
    rows = {(r.video, r.threshold, r.id): (r.truth, r.ignored) for r in got.collect()}
    want = {}
    for v in range(1000):
        for t in (0.5, 0.75):
            taken = set()
            for i in sorted(range(v, n, 1000), key=lambda i: (-(i % 7), i)):
                own, free = i % 2000, i % 2000 % 5 == 0 or i % 2000 not in taken
                hit = own if i % 3 > 0 and 0.5 + i % 10 / 20 >= t and free else None
                taken.add(hit)
                want[v, t, i] = (hit, hit is not None and hit % 5 == 0)
    assert rows == want


def test_curves_meet_no_row_twice(spark):
    rows = spark.range(500).selectExpr("CAST(id % 2 AS STRING) AS k", "id", "CAST(id AS DOUBLE) AS score", "id % 3 = 0 AS tp")
    curve = metrics.precision_recall(rows, "k", rows.groupBy("k").agg(F.count_if("tp").alias("n")))
    assert "NestedLoop" not in plan(metrics.average_precision(curve, "k"))
    ahead = running.largest_ahead(rows.select("k", "id"), ["k"], [F.col("id")], "id", "most")
    # a frame from the row to the group's end is summed up anew for each row; that over ranges has a few rows a group
    assert "currentrow$(), unboundedfollowing$()" not in plan(ahead)
    assert {r.most for r in ahead.collect()} == {498, 499}
    for r in metrics.average_precision(curve, "k", 11).collect():
        own = [c for c in curve.collect() if c.k == r.k]
        assert abs(r.ap - sum(max((c.envelope for c in own if c.recall >= i / 10), default=0.0) for i in range(11)) / 11) < 1e-12


def test_few_instances_of_a_point_meet_without_cells(spark):
    rows = [(g, p, float(g % 13), float(g % 5), float(g % 3)) for p in range(60) for g in range(p % 7, 90, 7 + p % 3)] + [(g, 1000, float(g % 13), float(g % 5), float(g % 3)) for g in range(fusion.PAIRED + 40)]
    obs = spark.createDataFrame(rows, "gid long, pid long, x double, y double, z double")
    got = fusion.co_observed(obs, 2.5)
    assert "LeftAnti" in plan(got)
    at, seen = {g: r for g, _, *r in rows}, {}
    for g, p, *_ in rows:
        seen.setdefault(p, []).append(g)
    want = {(a, b) for own in seen.values() for a in own for b in own if a < b and sum((u - v) ** 2 for u, v in zip(at[a], at[b], strict=True)) < 6.25}
    assert {(r.a, r.b) for r in got.collect()} == want and got.count() == len(want)


def test_ply_is_read_in_blocks(monkeypatch):
    monkeypatch.setattr(formats, "BATCH", 10)
    head = "ply\nformat ascii 1.0\nelement vertex 25\nproperty float x\nproperty float y\nproperty float z\nelement face 21\nproperty list uchar int vertex_indices\nend_header\n"
    text = (head + "".join(f"{i} {i + 1} 0.5\n" for i in range(25)) + "".join(f"3 {i} {i + 1} {i + 2}\n" for i in range(20)) + "4 0 1 2 3").encode()
    assert [len(b["x"]) for b in formats.ply_blocks(io.BytesIO(text), "vertex")] == [10, 10, 5]
    assert [len(b) for b in formats.ply_blocks(io.BytesIO(text), "face")] == [10, 10, 2]
    vertices, faces = formats.parse_ply(text)
    assert vertices["y"].tolist() == [i + 1.0 for i in range(25)] and vertices["g"].tolist() == [255] * 25
    assert faces.tolist() == [[i, i + 1, i + 2] for i in range(20)] + [[0, 1, 2], [0, 2, 3]]
    with pytest.raises(ValueError, match="ends before"):
        formats.parse_ply(text[: len(text) // 2])


def test_nearest_in_a_dense_cloud_meets_few(spark):
    rng = np.random.default_rng(3)
    spots = np.vstack([rng.normal(0, 0.2, (700, 3)), rng.uniform(-4, 4, (300, 3)), np.zeros((40, 3))]).round(2)
    rows = [(i, *map(float, p)) for i, p in enumerate(spots)]
    make = lambda some: spark.createDataFrame(some, "pid long, x double, y double, z double")
    left, right = [r for r in rows if r[0] % 4 == 0] + [(5000, float("nan"), 0.0, 0.0)], [r for r in rows if r[0] % 4]
    got = spatial.nearest_within(make(left), make(right), 1.5)
    assert "__bound" in plan(got)
    want = {}
    for i, *p in left:
        d = [(j, *(a - b for a, b in zip(p, q, strict=True))) for j, *q in right]
        far = [(math.sqrt(u * u + v * v + w * w), j) for j, u, v, w in d]  # added up as Spark does
        want[i] = min([f for f in far if f[0] <= 1.5], default=(None, None))
    assert {r.pid: (r.distance, r.nearest) for r in got.collect()} == want
