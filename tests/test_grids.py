import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import catalogs, evaluators, metrics, running, sampling


def brute_grid(pairs, dets, truths, thresholds, areas, most):
    """Greedy matching and interpolated precision by plain loops."""
    out = {}
    cats = {t[1] for t in truths}
    for cat in cats:
        for name, (lo, hi) in areas.items():
            for t in thresholds:
                for m in most:
                    rows, positives = [], 0
                    for video in {x[0] for x in truths} | {x[0] for x in dets}:
                        gt = {g[2]: g[3] == 1 or not lo <= g[4] <= hi for g in truths if g[:2] == (video, cat)}
                        positives += sum(not ig for ig in gt.values())
                        taken = set()
                        own = sorted((d for d in dets if d[:2] == (video, cat)), key=lambda d: (-d[3], d[2]))[: max(most)]
                        for place, d in enumerate(own, 1):
                            free = [(gt[g], -iou, g) for v, c, i, g, iou in pairs if (v, c, i) == (video, cat, d[2]) and iou >= t and g in gt and (gt[g] or g not in taken)]
                            hit = min(free) if free else None
                            if hit:
                                taken.add(hit[2])
                            ignored = hit[0] if hit else not lo <= d[4] <= hi
                            if place <= m and not ignored:
                                rows.append((-d[3], video, place, hit is not None))
                    if not positives:
                        out[cat, name, t, m] = (-1.0, -1.0)
                        continue
                    tp, curve = 0, []
                    for k, r in enumerate(sorted(rows), 1):
                        tp += r[3]
                        curve.append((tp / positives, tp / k))
                    grid = [max((p for rec, p in curve if rec >= i / 100), default=0.0) for i in range(101)]
                    out[cat, name, t, m] = (sum(grid) / 101, curve[-1][0] if curve else 0.0)
    return out


def test_detection_grid(spark):
    rng = np.random.default_rng(8)
    dets = [(int(v), int(c), int(i), float(round(rng.uniform(), 2)), float(rng.uniform(0, 200))) for v in range(4) for c in (1, 2) for i in range(7)]
    truths = [(int(v), int(c), int(g), int(rng.uniform() < 0.2), float(rng.uniform(0, 200))) for v in range(4) for c in (1, 2, 3) for g in range(rng.integers(0, 5))]
    truths.append((0, 4, 0, 1, 10.0))
    pairs = [(v, c, i, g, float(round(rng.uniform(0.3, 1), 3))) for v, c, i, *_ in dets for w, e, g, *_ in truths if (v, c) == (w, e) and rng.uniform() < 0.6]
    areas, thresholds, most = {"all": (0.0, 1e9), "small": (0.0, 100.0)}, (0.5, 0.75), (1, 3)
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = metrics.detection_grid(make(pairs, "video int, category int, id int, truth int, iou double"), make(dets, "video int, category int, id int, score double, size double"), make(truths, "video int, category int, truth int, crowd int, size double"), thresholds, areas, most)
    want = brute_grid(pairs, dets, truths, thresholds, areas, most)
    rows = {(r.category, r.area, r.threshold, r.most): (r.ap, r.ar) for r in got.collect()}
    assert set(rows) == set(want) and all(rows[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    one = {(r.area, r.most): r for r in metrics.summarised(got).collect()}
    counted = [v[0] for k, v in want.items() if k[1] == "all" and k[3] == 3 and v[0] > -1]
    assert one["all", 3].ap == pytest.approx(np.mean(counted)) and one["all", 3].ap50 == pytest.approx(np.mean([v[0] for k, v in want.items() if k[1:] == ("all", 0.5, 3) and v[0] > -1]))


def test_running_totals(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k == 0 else "ab"[k % 2], int(rng.integers(0, 40)), i, int(rng.integers(0, 9))) for i in range(500) for k in [int(rng.integers(0, 6))]]
    df = spark.createDataFrame(rows, "g string, o int, i int, v long").repartition(5)
    got = {r.i: r.t for r in running.running(df, ["g"], [F.col("o"), F.col("i")], {"t": F.col("v")}).collect()}
    top = {r.i: r.m for r in running.largest_ahead(df, ["g"], [F.col("o"), F.col("i")], "v", "m").collect()}
    for g, o, i, _ in rows:
        assert got[i] == sum(v for h, p, j, v in rows if h == g and (p, j) <= (o, i))
        assert top[i] == max(v for h, p, j, v in rows if h == g and (p, j) >= (o, i))


def test_block_masks(spark):
    ids = spark.range(5).withColumn("id", F.concat(F.lit("im"), "id"))
    got = sampling.block_masks(ids, 8, 10, 0.35, 3).collect()
    cells = {}
    for r in got:
        cells.setdefault(r.id, set()).add((r.y, r.x))
    assert len(cells) == 5 and all(len(c) == 28 for c in cells.values()) and len({frozenset(c) for c in cells.values()}) == 5
    assert sorted(map(tuple, sampling.block_masks(ids.repartition(3), 8, 10, 0.35, 3).collect())) == sorted(map(tuple, got))
    assert sampling.block_masks(ids, 4, 4, 1.0, 3).count() == 80


def test_plans_and_errors(spark):
    assert sampling.batch_plan(16, 4, 100) == {"per_worker": 4, "batches": 6}
    with pytest.raises(ValueError):
        sampling.batch_plan(10, 4)
    with pytest.raises(ValueError):
        catalogs.chained({"a": spark.range(1), "b": spark.range(0)})


def test_endless_covers_every_pass(spark):
    rows = spark.range(10)
    parts = [sampling.endless(rows, "id", 5, w, 3, 3).collect() for w in range(3)]
    for p in range(3):
        assert sorted(r.id for part in parts for r in part if r["pass"] == p) == list(range(10))
    assert all(sorted(r.at for r in part) == list(range(len(part))) for part in parts)


def test_video_evaluation(spark):
    """Two masks over two frames of four by four pixels: one found exactly, one found in half of its frames."""
    run = lambda *r: [{"start": a, "len": n} for a, n in r]
    schema = "video int, category int, id int, frame int, runs array<struct<start: long, len: long>>"
    truths = spark.createDataFrame([(1, 1, 1, 0, run((0, 4))), (1, 1, 1, 1, run((4, 4))), (1, 1, 2, 0, run((8, 4))), (1, 1, 2, 1, run((8, 4)))], schema)
    dets = spark.createDataFrame([(1, 1, 7, 0, run((0, 2), (2, 2))), (1, 1, 7, 1, run((4, 4))), (1, 1, 8, 0, run((8, 4)))], schema)
    scores = spark.createDataFrame([(1, 1, 7, 0.9), (1, 1, 8, 0.8)], "video int, category int, id int, score double")
    got = {(r.area, r.most): r for r in evaluators.evaluated("video", dets, truths, scores, pixels=16, frames=2, most=(1, 100)).collect()}
    # the second has an overlap of exactly a half: found at the first threshold only
    assert got["all", 100].ap50 == pytest.approx(1.0) and got["all", 100].ap75 == pytest.approx(51 / 101)
    assert got["all", 1].ar == pytest.approx(0.5) and got["all", 100].ar == pytest.approx((1.0 + 9 * 0.5) / 10) and got["large", 100].ap == -1
    with pytest.raises(ValueError):
        evaluators.evaluated("none")


def test_order_of_files(spark):
    df = spark.createDataFrame([("/a/10.pcd",), ("/a/9.pcd",), ("/b/x.pcd",), ("/a/b.pcd",)], "path string")
    assert [r.path for r in df.orderBy(*evaluators.by_stem("path")).collect()] == ["/a/9.pcd", "/a/10.pcd", "/a/b.pcd", "/b/x.pcd"]
