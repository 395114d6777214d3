"""Masks from polygons, their compressed form, and the panoptic contest, against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import evaluators, masks, panoptic


def inside(coords, height, width):
    """Pixels whose centre is in the polygon, by the even-odd rule."""
    out = np.zeros((height, width), bool)
    p = np.array(coords, float).reshape(-1, 2)
    for y in range(height):
        for x in range(width):
            for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, 0), strict=True):
                if (x0 > x + 0.5) != (x1 > x + 0.5) and y + 0.5 < y0 + (x + 0.5 - x0) * (y1 - y0) / (x1 - x0):
                    out[y, x] ^= True
    return out


def drawn(runs, height, width):
    flat = np.zeros(height * width, bool)
    for r in runs:
        flat[r["start"] : r["start"] + r["len"]] = True
    return flat.reshape(width, height).T


def test_polygons_are_their_pixels(spark):
    rng = random.Random(1)
    rows, want, by_rows = [], {}, {}
    for i in range(150):
        height, width = 9 + i % 3, 12
        m = np.zeros((height, width), bool)
        for _ in range(rng.randint(1, 3)):
            coords = [rng.choice([rng.uniform(-3, 14), float(rng.randint(-2, 13)), rng.randint(0, 12) + 0.5]) for _ in range(2 * rng.randint(3, 7))]
            rows.append((i, coords, height, width))
            m |= inside(coords, height, width)
            # centres on an edge: what counts as inside depends on the direction of the scan
            turned = [c for x, y in zip(coords[::2], coords[1::2], strict=True) for c in (y, x)]
            by_rows[i] = by_rows.get(i, False) | inside(turned, width, height).T
        want[i] = m
    for i, coords in ((900, None), (901, []), (902, [1.0, 1.0, 5.0, 5.0]), (903, [1.0, float("nan"), 5.0, 5.0, 2.0, 3.0]), (904, [1.0, None, 5.0, 5.0, 2.0, 3.0]), (905, [-9.0, -9.0, -5.0, -9.0, -5.0, -2.0]), (None, [0.0, 0.0, 4.0, 0.0, 4.0, 3.0, 0.0, 3.0])):
        rows.append((i, coords, 9, 12))
        want[i] = np.zeros((9, 12), bool)
    want[None][:3, :4] = True
    rows.append((903, [2.0, 2.0, 3.0, 2.0, 3.0, 3.0, 2.0, 3.0], 9, 12))
    want[903][2, 2] = True
    df = spark.createDataFrame(rows, "id long, coords array<double>, height int, width int").repartition(3).selectExpr("*", "'clash' AS runs", "1 AS s")
    size = F.col("height") * F.col("width")
    found = masks.polygon_runs(df, ["id"]).withColumn("box", masks.run_box(F.col("runs"), F.col("height"))).withColumn("counts", masks.counts(F.col("runs"), size)).withColumn("text", masks.compressed(F.col("counts")))
    got = found.withColumn("back", masks.decompressed(F.col("text"))).withColumn("again", masks.from_counts(F.col("back"))).collect()
    assert {r.id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        m = want[r.id]
        assert np.array_equal(drawn(r.runs, *m.shape), m)
        ends = [x.start + x.len for x in r.runs]
        assert all(x.start > e for x, e in zip(r.runs[1:], ends, strict=False))
        y, x = np.nonzero(m)
        assert tuple(r.box) == ((x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1) if len(x) else (0, 0, 0, 0))
        assert sum(r.counts) == m.size and r.back == r.counts and r.again == r.runs and r.text == packed(r.counts)
    rows_first = masks.polygon_runs(df, ["id"], by_columns=False).collect()
    for r in rows_first:
        h, w = want[r.id].shape
        assert np.array_equal(drawn(r.runs, w, h).T, by_rows.get(r.id, want[r.id]))
    assert masks.polygon_runs(df.where("false"), ["id"]).count() == 0
    some = masks.pixels(found, ["id"]).where("id = 3").collect()
    assert {(r.y, r.x) for r in some} == set(zip(*map(list, np.nonzero(want[3])), strict=True))


def packed(counts):
    """The compressed form, number by number."""
    out = ""
    for i, c in enumerate(counts):
        v = c - counts[i - 2] if i > 2 else c
        more = True
        while more:
            low = v & 31
            v >>= 5
            more = v != (-1 if low & 16 else 0)
            out += chr(48 + low + (32 if more else 0))
    return out


def test_compressed_form_of_any_counts(spark):
    rng = random.Random(2)
    lists = [[0], [5], [0, 7], [1, 2, 3, 4], [2**31, 1, 0, 2**30], [15, 16, 17, 31, 32, 33], [10**6, 1, 10**6, 1, 3]]
    lists += [[rng.choice([0, 1, 15, 16, 500, 511, 512, 10**5, rng.randint(0, 10**7)]) for _ in range(rng.randint(1, 40))] for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<bigint>").withColumn("text", masks.compressed(F.col("v"))).withColumn("back", masks.decompressed(F.col("text")))
    for r in df.collect():
        assert r.text == packed(r.v) and r.back == r.v


def test_united_masks(spark):
    rng = random.Random(3)
    rows = [(i % 12, sorted((a, rng.randint(0, 9)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 5))))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, runs array<struct<start:bigint,len:bigint>>")
    want = {i: np.zeros((80, 1), bool) for i in range(12)}
    for i, runs in rows:
        for s, n in runs:
            want[i][s : s + n] = True
    got = masks.united(df, ["id"]).collect()
    assert {r.id: drawn(r.runs, 80, 1).tolist() for r in got} == {i: m.tolist() for i, m in want.items()}
    assert all(b.start > a.start + a.len for r in got for a, b in zip(r.runs, r.runs[1:], strict=False))


def test_videos_of_polygons_are_those_of_runs_made_by_hand(spark):
    square = lambda x, y, n: [float(v) for v in (x, y, x + n, y, x + n, y + n, x, y + n)]
    tracks = [(v, c, t, f, square(f + t, 1 + t, 4 + t), 12, 16) for v in range(2) for c in range(2) for t in range(2) for f in range(3)]
    df = spark.createDataFrame(tracks, "video int, category int, id int, frame int, coords array<double>, height int, width int")
    made = masks.polygon_runs(df, ["video", "category", "id", "frame"]).drop("height", "width")
    byhand = []
    for v, c, t, f, *_ in tracks:
        byhand.append((v, c, t, f, [((f + t + k) * 12 + 1 + t, 4 + t) for k in range(4 + t)]))
    hand = spark.createDataFrame(byhand, "video int, category int, id int, frame int, runs array<struct<start:bigint,len:bigint>>")
    scores = spark.createDataFrame([(v, c, t, 0.5 + t / 4) for v in range(2) for c in range(2) for t in range(2)], "video int, category int, id int, score double")
    told = [sorted(map(tuple, evaluators.evaluated("video", a, hand.where("id = 0 OR frame < 2"), scores, 12 * 16, frames=3).collect())) for a in (made, hand)]
    assert told[0] == told[1] and any(x[2] > 0.5 for x in told[0])


def numpy_panoptic(logits, values, none, things, least, overlap):
    """One image at a time. logits: queries x classes; values: queries x height x width."""
    e = np.exp(logits - logits.max(1, keepdims=True))
    share = e / e.sum(1, keepdims=True)
    label, score = share.argmax(1), share.max(1)
    kept = [q for q in range(len(label)) if label[q] != none and score[q] > least]
    out, segments, of_stuff = np.zeros(values.shape[1:], int), {}, {}
    if not kept:
        return out, segments
    value = 1 / (1 + np.exp(-values))
    winner = np.array(kept)[(score[kept][:, None, None] * value[kept]).argmax(0)]
    for q in kept:
        held = (winner == q) & (value[q] >= 0.5)
        whole = (value[q] >= 0.5).sum()
        if not held.any() or (winner == q).sum() / whole < overlap:
            continue
        c = int(label[q])
        number = of_stuff.get(c, len(segments) + 1)
        if c not in things:
            of_stuff[c] = number
        out[held] = number
        old = segments.get(number, (c, c in things, 0))
        segments[number] = (c, c in things, old[2] + int(held.sum()))
    return out, segments


@pytest.mark.parametrize("least,overlap", [(0.0, 0.0), (0.35, 0.5), (0.99, 0.8)])
def test_panoptic_contest(spark, least, overlap):
    rng = np.random.default_rng(5)
    logits, values = rng.normal(size=(6, 7, 4)) * 2, rng.normal(size=(6, 7, 5, 6)) * 2
    values[0, 3] = values[0, 2]
    logits[0, 3] = logits[0, 2]
    classes = spark.createDataFrame([(i, q, c, float(logits[i, q, c])) for i, q, c in np.ndindex(6, 7, 4)], "image int, query int, class int, logit double").repartition(3)
    masks_ = spark.createDataFrame([(i, q, y, x, float(values[i, q, y, x])) for i, q, y, x in np.ndindex(6, 7, 5, 6)], "image int, query int, y int, x int, logit double").repartition(3)
    pixels, segments = panoptic.panoptic(classes, masks_, 3, (0, 2), least, overlap)
    got, told = np.full((6, 5, 6), -1), {}
    for r in pixels.collect():
        got[r.image, r.y, r.x] = r.segment
    for r in segments.collect():
        told.setdefault(r.image, {})[r.segment] = (r.category, r.thing, r.area)
    for i in range(6):
        out, want = numpy_panoptic(logits[i], values[i], 3, (0, 2), least, overlap)
        assert np.array_equal(got[i], out) and told.get(i, {}) == want
    if least == 0.0:
        share = np.exp(logits) / np.exp(logits).sum(-1, keepdims=True)
        want = np.einsum("iqc,iqyx->iycx", share[..., :3], 1 / (1 + np.exp(-values))).argmax(2)
        assert all(want[r.image, r.y, r.x] == r.category for r in panoptic.semantic(classes, masks_, 3).collect())
        found = panoptic.instances(classes, masks_, 3, 5, (0, 2)).collect()
        for i in range(6):
            order = sorted(((-share[i, q, c], q, c) for q in range(7) for c in range(3)))[:5]
            assert {(r.query, r.category) for r in found if r.image == i} == {(q, c) for _, q, c in order if c in (0, 2)}
        for r in found:
            own = values[r.image, r.query] > 0
            mean = (1 / (1 + np.exp(-values[r.image, r.query])))[own].sum() / (own.sum() + 1e-6)
            assert r.area == own.sum() and abs(r.final - share[r.image, r.query, r.category] * mean) < 1e-9
        none = panoptic.panoptic(classes.where("false"), masks_, 3, (0, 2))
        assert none[0].where("segment <> 0").count() == 0 and none[0].count() == 180 and none[1].count() == 0


def test_compressed_form_of_many_runs(spark):
    """A mask of very many runs: what is before a run or a count isn't made anew for each of them."""
    n = 1500
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 5 + 1).cast("long").alias("start"), (i % 3 + 1).cast("long").alias("len"))).alias("runs"))
    begun = time.monotonic()
    got = df.select("runs", masks.from_counts(masks.decompressed(masks.compressed(masks.counts(F.col("runs"), F.lit(5 * n))))).alias("back")).first()
    assert got.back == got.runs and len(got.runs) == n
    assert time.monotonic() - begun < 60
