import json

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import annotations, metrics, sampling, scene
from cairn.sources import formats, sinks


def test_run_masks(spark):
    left = spark.createDataFrame([(0, 1, [(0, 5), (2000, 100)]), (0, 2, [(90, 10)])], "image int, id int, runs array<struct<start:long,len:long>>")
    right = spark.createDataFrame([(0, 7, [(3, 4), (1990, 60)]), (1, 8, [(0, 5)])], "image int, id int, runs array<struct<start:long,len:long>>")
    got = {(r.left, r.right): r.iou for r in annotations.run_iou(left, right, ["image"]).collect()}
    assert got == {(1, 7): 52 / (105 + 64 - 52)}
    assert [r[0] for r in left.orderBy("id").select(annotations.run_area(F.col("runs"))).collect()] == [105, 10]


def test_annotation_filters(spark):
    rows = spark.createDataFrame([(1, [(0,), (1,)]), (2, [(1,)]), (3, [])], "id int, annotations array<struct<iscrowd:int>>")
    assert [r.id for r in annotations.any_uncrowded(rows).collect()] == [1]
    a = spark.createDataFrame([(1, 5, 10.0, 0), (2, 5, 20.0, 1), (2, 6, 30.0, 0)], "video_id int, category_id int, avg_area double, iscrowd int")
    assert annotations.by_conditions(a, categories=[5], area=(10, 25)).count() == 1 and annotations.by_conditions(a, crowd=0).count() == 2
    e = spark.createDataFrame([(4, 1.0, 1.0, 3), (5, 0.0, 1.0, 3)], "id int, w double, h double, n int")
    assert [r.id for r in annotations.emptied_ids(e, "id", "w", "h", "n").collect()] == [4, -1]


def test_clips_and_mixing(spark):
    frames = spark.range(30).select((F.col("id") % 3).alias("video_id"), F.floor(F.col("id") / 3).alias("frame"))
    clips = sampling.clip_frames(frames, 2, 4, 1).collect()
    assert len(clips) == 12 and all(0 <= r.frame <= 9 for r in clips)
    for v in range(3):
        own = sorted((r.slot, r.frame) for r in clips if r.video_id == v)
        assert [f for _, f in own] == sorted(f for _, f in own) and own[-1][1] - own[0][1] <= 4
    out = sampling.mixed([(spark.range(100), 3.0), (spark.range(100), 1.0)], "id", 5)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert n[0] == 100 and 30 <= n[1] <= 36


def test_losses_and_bests(spark):
    x, t = [2.0, -1.0, 0.5], [1.0, 0.0, 1.0]
    df = spark.createDataFrame([(1, a, b) for a, b in zip(x, t, strict=True)], "g int, logit double, target double")
    p = 1 / (1 + np.exp(-np.array(x)))
    assert abs(metrics.dice_loss(df, ("g",)).first().dice_loss - (1 - (2 * (p * t).sum() + 1) / (p.sum() + 2 + 1))) < 1e-12
    bce = -np.mean(np.array(t) * np.log(p) + (1 - np.array(t)) * np.log(1 - p))
    assert abs(metrics.logistic_loss(df, ("g",)).first().bce - bce) < 1e-12
    r = spark.createDataFrame([("a", "m1", 0.5), ("a", "m2", 0.5), ("b", "m1", None), ("b", "m2", 0.1)], "k string, model string, v double")
    assert {x.k: x.model for x in metrics.best_of(r, "k", "v", "model").collect()} == {"a": "m1", "b": "m2"}
    im = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 0, 0)], "image int, gt int, pred int")
    assert {x.image: x.miou for x in metrics.image_miou(im).collect()} == {1: 0.25, 2: 0.0}


def test_completeness_and_layout(spark):
    e = spark.createDataFrame([("Red_Box", "1", ""), ("lamp", "yes", "n9"), ("door", "1", None), ("cat", "0", ""), ("示例 x", "1", ""), (" ", "1", "")], "expected_label string, required string, matched_node_id string")
    n = spark.createDataFrame([("red box",), ("cat",)], "label string")
    r = scene.completeness(e, n).first()
    assert (r.required, r.matched, round(r.completeness, 6)) == (3, 2, 0.666667)
    flat = spark.createDataFrame([(0.0, 0.0, 9), (10.0, 0.0, 99)], "cx double, cy double, n int")
    assert [(r.px, r.py) for r in scene.laid_out(flat, 100, 50, 10).orderBy("px").collect()] == [(10.0, 25.0), (90.0, 25.0)]


def test_sinks(spark, tmp_path):
    formats.register(spark)
    p = spark.createDataFrame([("a", "wall", 0.5, 1.0, 2.0, 1, 2, 3), ("a", "door", 1.5, 1.0, 2.0, 4, 5, 6), ("a", "wall", 2.5, 1.0, 2.0, 7, 8, 9)], "scene string, category string, x double, y double, z double, r int, g int, b int")
    files = sinks.write_clouds(p, f"file://{tmp_path}/clouds", ("scene", "category")).collect()
    assert {(r.category, r.points) for r in files} == {("wall", 2), ("door", 1)}
    back = spark.read.format("pcd").load(f"file://{tmp_path}/clouds")
    assert sorted((r.scene, r.x, r.b) for r in back.collect()) == [("a_door", 1.5, 6), ("a_wall", 0.5, 3), ("a_wall", 2.5, 9)]
    v = spark.createDataFrame([(10, 0.0, 0.0, 0.0, 1, 1, 1), (20, 1.0, 0.0, 0.0, 1, 1, 1), (30, 0.0, 1.0, 0.0, 1, 1, 1)], "vid long, x double, y double, z double, r int, g int, b int")
    f = spark.createDataFrame([(0, 30, 10, 20)], "fid long, a long, b long, c long")
    told = sinks.write_mesh(v, f, f"file://{tmp_path}/mesh.ply").first()
    text = (tmp_path / "mesh.ply").read_bytes()
    vertices, faces = formats.parse_ply(text)
    assert vertices["x"].tolist() == [0, 1, 0] and faces.tolist() == [[2, 0, 1]] and (told.vertices, told.faces, told.bytes) == (3, 1, len(text))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["clouds", "mesh.ply"]
    box = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "box_id int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    assert sinks.box_wires(box, 0.01).count() == 24
    e = spark.createDataFrame([("e0", None)], "edge_id string, gap double")
    assert json.loads(sinks.graph_documents(e, e)[1].first().value) == {"edge_id": "e0"}
    h = spark.createDataFrame([("wall", 3, 0.75), ("door", 1, 0.25), ("none", 0, 0.0)], "category string, n long, share double")
    assert [r.value.split()[0] for r in sinks.category_report(h).collect()] == ["wall", "door"]


def test_meshes_are_written_by_tasks(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    n = 3000
    v = spark.createDataFrame([(int(i * 5 % 30_011), *map(float, rng.normal(size=3)), i % 256, 1, 2) for i in range(n)], "vid long, x double, y double, z double, r int, g int, b int").repartition(5)
    ids = sorted(r.vid for r in v.select("vid").collect())
    corners = rng.choice(ids, (5000, 3))
    f = spark.createDataFrame([(i, *map(int, c), 9, 8, 7) for i, c in enumerate(corners)] + [(9999, ids[0], ids[1], -1, 0, 0, 0)], "fid long, a long, b long, c long, r int, g int, blue int").repartition(4)
    told = sinks.write_mesh(v, f, f"file://{tmp_path}/m.ply").first()
    text = (tmp_path / "m.ply").read_bytes()
    vertices, faces = formats.parse_ply(text)
    place = {x: i for i, x in enumerate(ids)}
    assert (told.vertices, told.faces) == (n, 5000) and faces.tolist() == [[place[x] for x in c] for c in corners.tolist()]
    want = {r.vid: r for r in v.collect()}
    assert vertices["r"].tolist() == [want[i].r for i in ids] and np.allclose(vertices["z"], [want[i].z for i in ids], atol=1e-6)
    assert text.rstrip().endswith(b"9 8 7") and not list(tmp_path.glob("*.parts*"))
    empty = sinks.write_mesh(v.where("false"), f.where("false"), f"file://{tmp_path}/e.ply").first()
    assert (empty.vertices, empty.faces) == (0, 0) and (tmp_path / "e.ply").read_bytes().endswith(b"end_header\n")


def test_edges_become_thin_rectangles(spark):
    import numpy as np

    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 0.0, 3.0)], "vid long, x double, y double, z double")
    e = spark.createDataFrame([(0, 0, 1, 1, 2, 3), (1, 0, 2, 4, 5, 6), (2, 1, 1, 0, 0, 0), (3, 1, 9, 0, 0, 0)], "eid long, a long, b long, r int, g int, b_ int").withColumnRenamed("b_", "blue")
    e = e.select("eid", "a", "b", "r", "g", "blue")
    points, faces = sinks.edge_quads(v, e, 0.2)
    got = {r.vid: (r.x, r.y, r.z) for r in points.collect()}
    assert set(got) == set(range(8)) and faces.count() == 4
    assert np.allclose([got[i] for i in range(4)], [(0, 0.1, 0), (0, -0.1, 0), (1, -0.1, 0), (1, 0.1, 0)])
    assert np.allclose([got[i] for i in range(4, 8)], [(0.1, 0, 0), (-0.1, 0, 0), (-0.1, 0, 3), (0.1, 0, 3)])
    assert {(r.fid, r.a, r.b, r.c, r.r, r.blue) for r in faces.collect()} == {(0, 0, 1, 2, 1, 3), (1, 0, 2, 3, 1, 3), (2, 4, 5, 6, 4, 6), (3, 4, 6, 7, 4, 6)}
