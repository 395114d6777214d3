"""Erosion by ellipses, depth losses, uncertain points and batches against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import batches, losses, masks


def ellipse(mask, share, least):
    area = mask.sum()
    if area < least:
        return mask
    h, w = mask.shape
    r = max(1, int(area**0.5 * share))
    out = mask.copy()
    for y, x in zip(*np.nonzero(mask), strict=True):
        for dy in range(-r, r + 1):
            half = round((r * r - dy * dy) ** 0.5)
            if 0 <= y + dy < h and not mask[y + dy, max(0, x - half) : min(w, x + half + 1)].all():
                out[y, x] = False
                break
    return out if out.any() else mask


@pytest.mark.parametrize("share,least", [(0.05, 20), (0.3, 5), (1.0, 1)])
def test_erosion_by_ellipses(spark, share, least):
    rng = np.random.default_rng(int(share * 100))
    rows, want = [], {}
    for i in range(40):
        h, w = int(rng.integers(1, 14)), int(rng.integers(1, 18))
        m = rng.random((h, w)) < rng.choice([0.3, 0.9, 0.97, 1.0])
        flat = np.concatenate(([0], m.ravel().astype(int), [0]))
        steps = np.diff(flat)
        runs = [(int(a), int(b - a)) for a, b in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1), strict=True)]
        rows.append((i, h, w, runs))
        want[i] = ellipse(m, share, least)
    df = spark.createDataFrame(rows, "id int, height long, width long, runs array<struct<start:bigint,len:bigint>>").repartition(3)
    for r in masks.eroded(df, ["id"], share, least).collect():
        flat = np.zeros(r.height * r.width, bool)
        for s, n in r.runs:
            flat[s : s + n] = True
        assert np.array_equal(flat.reshape(r.height, r.width), want[r.id]), r.id


def test_depth_losses(spark):
    rng = np.random.default_rng(4)
    pred, gt, ok = rng.uniform(1, 9, (3, 9, 14)), rng.uniform(1, 9, (3, 9, 14)), rng.random((3, 9, 14)) < 0.8
    ok[2] = False
    ok[2, 0, 1] = True
    rows = [(i, y, x, float(pred[i, y, x]), float(gt[i, y, x]), bool(ok[i, y, x]) or None) for i, y, x in np.ndindex(3, 9, 14)]
    df = spark.createDataFrame(rows, "image int, y int, x int, pred double, gt double, valid boolean").repartition(3)
    plain = {r.image: r.loss for r in losses.scale_invariant(df, ["image"], valid="valid").collect()}
    warm = {r.image: r.loss for r in losses.scale_invariant(df, ["image"], True, valid="valid").collect()}
    change = {r.image: r.loss for r in losses.gradient(df, ["image"], valid="valid").collect()}
    for i in range(3):
        g = (np.log(pred[i] + 0.001) - np.log(gt[i] + 0.001))[ok[i]]
        assert math.isclose(warm[i], (0.15 * g.mean() ** 2) ** 0.5)
        assert plain[i] is None if i == 2 else math.isclose(plain[i], (0.15 * g.mean() ** 2 + g.var(ddof=1)) ** 0.5)
        total = 0.0
        for k in (1, 2, 4, 6):
            m, d = ok[i, ::k, ::k], ((pred[i] - gt[i]) * ok[i])[::k, ::k]
            if m.sum():
                v, h = abs(d[:-2] - d[2:]) * (m[:-2] & m[2:]), abs(d[:, :-2] - d[:, 2:]) * (m[:, :-2] & m[:, 2:])
                total += (v.sum() + h.sum()) / m.sum()
        assert math.isclose(change[i], total, abs_tol=1e-12)
    assert losses.gradient(df.where("false"), ["image"]).count() == 0


def test_uncertain_points(spark):
    rng = random.Random(5)
    rows = [(m, y, x, rng.uniform(-3, 3)) for m in range(3) for y in range(10 if m else 2) for x in range(10)]
    df = spark.createDataFrame(rows, "mask int, y int, x int, logit double")
    got = losses.uncertain_points(df, ["mask"], 16, seed=2).collect()
    kinds = collections.Counter((r.mask, r.kind) for r in got)
    assert kinds == {(0, "uncertain"): 12, (1, "uncertain"): 12, (1, "random"): 4, (2, "uncertain"): 12, (2, "random"): 4}
    assert len({(r.mask, r.y, r.x) for r in got}) == len(got)
    small = sorted(abs(v) for m, _, _, v in rows if m == 0)[:12]
    assert sorted(abs(r.logit) for r in got if r.mask == 0) == small
    assert {(r.mask, r.y, r.x) for r in losses.uncertain_points(df.repartition(5), ["mask"], 16, seed=2).collect()} == {(r.mask, r.y, r.x) for r in got}


def test_batches_and_masks(spark):
    df = spark.createDataFrame([(i % 70 if i % 30 else None,) for i in range(100)], "id int").repartition(3).selectExpr("*", "'clash' AS bucket_", "1 AS height", "2 AS width")
    rows = batches.shuffled(df, 16, 1)
    got = [(r.batch, r.slot) for r in rows.collect()]
    assert sorted(got) == [(i // 16, i % 16) for i in range(96)]
    sized = batches.mask_sizes(rows, 49, (0.1, 0.5), 0.5, 2)
    for b in range(6):
        assert sorted(r.masked for r in sized.where(F.col("batch") == b).collect() if r.masked) == sorted(int(49 * (0.1 + 0.4 * (i + 1) / 8)) for i in range(8))
    cells = batches.masked_cells(sized, 7, 7, 3)
    told = {(r.batch, r.slot): r for r in batches.collated(cells, 49).collect()}
    wanted = {(r.batch, r.slot): r.masked for r in sized.collect()}
    assert set(told) == set(wanted)
    for at, r in told.items():
        assert len(r.cells) == len(set(r.cells)) == wanted[at] and all(0 <= c < 49 for c in r.cells)
        most = max(n for (b, _), n in wanted.items() if b == at[0])
        assert r.padded == r.cells + [-1] * (most - len(r.cells)) and r.places == [c + 49 * at[1] for c in r.cells] and r.weight == 1 / max(1, len(r.cells))
    assert {r.slot for r in batches.part_of(cells, 16, 3).collect()} == set(range(6))
    images = spark.createDataFrame([(i, 2 + i % 3, 3) for i in range(50)], "id int, width int, height int")
    grouped = batches.by_aspect(images, 8).collect()
    assert len(grouped) == 16 // 8 * 8 + 34 // 8 * 8 and all((r.width > r.height) == (r.bucket == 0) for r in grouped)
    assert batches.shuffled(df.where("false"), 4).count() == 0
