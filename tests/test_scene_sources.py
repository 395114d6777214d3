import json

import numpy as np
import pytest

from cairn.functions import geometry as G
from cairn.operators import catalogs, profiles
from cairn.sources import catalogs as named
from cairn.sources import formats, scenes
from pyspark.sql import functions as F


def test_which_cloud_is_taken(tmp_path):
    for n in ("b.pcd", "a.pcd"):
        (tmp_path / n).write_bytes(b"")
    assert scenes.cloud_path(str(tmp_path)).endswith("/a.pcd")
    with pytest.raises(ValueError):
        scenes.cloud_path(str(tmp_path), only=True)
    (tmp_path / "z_color.pcd").write_bytes(b"")
    assert scenes.cloud_path(str(tmp_path), only=True).endswith("/z_color.pcd")
    assert scenes.cloud_path(str(tmp_path / "b.pcd")) == str(tmp_path / "b.pcd")
    with pytest.raises(FileNotFoundError):
        scenes.cloud_path(str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        scenes.cloud_path(str(tmp_path / "empty"))


def test_calibration(spark, tmp_path):
    (tmp_path / "e.yaml").write_text("%YAML:1.0\n# outer\nextrin_calib:\n  Pcl: [1.0, 2.0,\n    3.0]\n  Rcl: [0, -1, 0, 1, 0, 0, 0, 0, 1]\n")
    (tmp_path / "i.yaml").write_text("scale: 0.5\ncam_width: 641 # pixels\ncam_height: 480\ncam_fx: 500.0\ncam_fy: 510.0\ncam_cx: 320.0\ncam_cy: 240.0\ncam_d0: 0.1\ncam_d1: -0.2\ncam_d2: 0.01\ncam_d3: 0.02\nname: 'front'\nitems:\n  - 1\n  - two\n")
    assert scenes.settings(spark, str(tmp_path / "i.yaml"))["items"] == [1, "two"] and scenes.settings(spark, str(tmp_path / "i.yaml"))["name"] == "front"
    camera, mount = scenes.calibration(spark, str(tmp_path / "e.yaml"), str(tmp_path / "i.yaml"))
    assert (camera.width, camera.height, camera.fx, camera.cy) == (320, 240, 250.0, 120.0) and camera.distortion == (0.1, -0.2, 0.01, 0.02, 0.0)
    # the inverse of a quarter turn and a shift
    assert np.isclose(abs(np.dot(mount.rotation, (0, 0, -(0.5**0.5), 0.5**0.5))), 1) and np.allclose(mount.position, (-2, 1, -3))
    row = scenes.camera_table(spark, camera, mount).first()
    assert row.image_width == 320 and row.ext_pos_x == -2 and row.k2 == -0.2
    (tmp_path / "p.yaml").write_text("palette: [[1, 2, 3],\n  [4, 5, 6]]\n")
    (tmp_path / "q.yaml").write_text("palette:\n  - [1, 2, 3]\n  - [4, 5, 6]\n")
    for f in "pq":
        assert [tuple(r) for r in scenes.palette(spark, str(tmp_path / f"{f}.yaml"), ["a", "b"]).orderBy("class_id").collect()] == [(0, "a", 1, 2, 3), (1, "b", 4, 5, 6)]


def test_quaternions_of_all_kinds(spark):
    rng = np.random.default_rng(3)
    q = rng.normal(size=(40, 4))
    q[:4] = np.eye(4)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "i int, x double, y double, z double, w double")
    m = G.quaternion_matrix(*(F.col(c) for c in "xyzw"))
    rows = df.select("i", *(m[a][b].alias(f"m{a}{b}") for a in range(3) for b in range(3)), *(c.alias(n) for n, c in G.matrix_quaternion(m).items())).collect()
    for r in rows:
        matrix = [[r[f"m{a}{b}"] for b in range(3)] for a in range(3)]
        own = np.array([r.qx, r.qy, r.qz, r.qw])
        assert np.allclose(abs(own @ q[r.i]), 1) and np.allclose(own, scenes.quaternion(matrix)) and own[np.abs(own).argmax()] > 0


def test_clusters_instances_and_results(spark, tmp_path):
    (tmp_path / "a_geometric.json").write_text(json.dumps({"source": "x", "clusters": [{"cluster_id": 1, "bbox_center": [0, 0, 0], "bbox_extent": [2, 2, 2], "category": "box"}, {"cluster_id": 2, "bbox_center": [9, 9, 9], "bbox_extent": [1, 1, 1]}]}))
    (tmp_path / "other.json").write_text("{}")
    found = scenes.clusters(spark, str(tmp_path))
    assert {(r.cluster_id, r.category, r.x0, r.z1) for r in found.collect()} == {(1, "box", -1.0, 1.0), (2, "unknown", 8.5, 9.5)}
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.05, 0.0, 0.0), (2, 1.2, 0.0, 0.0), (3, 9.0, 9.0, 9.0)], "pid long, x double, y double, z double")
    assert {(r.box_id, r.pid) for r in scenes.cluster_points(found, pts, 0.1, 2).collect()} == {("a_geometric.json#1", 0), ("a_geometric.json#1", 1)}
    cloud = spark.createDataFrame([(s, i, float(i), 0.0, 0.0) for s, n in (("big_chair_inst_2", 4), ("lamp", 3), ("dot", 1)) for i in range(n)], "scene string, pid int, x double, y double, z double")
    summary = spark.createDataFrame([("lamp.pcd", "light", 7)], "file string, category string, instance_num int")
    own = scenes.instances(cloud, summary, 2)
    assert {(r.instance_id, r.category, r.source_file, r.n, r.x1) for r in own.collect()} == {(1, "big chair", "big_chair_inst_2.pcd", 4, 3.0), (7, "light", "lamp.pcd", 3, 2.0)}
    results = spark.createDataFrame([(1, "geo_1", 4), (2, "geo_2", 5), (3, "img_1", 6)], "instance_id int, source string, n int")
    points = spark.createDataFrame([(i, 0.0, 0.0, 0.0, 1, 2, 3) for i in (1, 1, 2, 9)], "instance_id int, x double, y double, z double, r int, g int, b int")
    files, report = scenes.write_fused(results, points, f"file://{tmp_path}/out")
    assert {(r.instance_id, r.points) for r in files.collect()} == {(1, 2), (2, 1)} and {(r.kind, r.instances, r.points) for r in report.collect()} == {("geo", 2, 9), ("img", 1, 6)}
    formats.register(spark)
    assert spark.read.format("pcd").load(f"file://{tmp_path}/out/instances").count() == 3


def test_flat_clusters_are_not_plausible(spark):
    rng = np.random.default_rng(1)
    flat = rng.uniform(0, 3, (300, 3)) * [1, 1, 0.01]
    round_ = rng.uniform(0, 3, (300, 3))
    rows = [("p", c, *map(float, r)) for c, x in ((0, flat), (1, round_)) for r in x] + [("p", None, 0.0, 0.0, 0.0), ("q", 3, 0.0, 0.0, 0.0)]
    pts = spark.createDataFrame(rows, "profile string, cluster int, x double, y double, z double")
    known = spark.createDataFrame([("p", 50.0, 5.0, 1.0, 0.5, 0.01)], "profile string, max_volume double, max_extent double, min_density double, planarity_threshold double, planarity_min_volume double")
    got = {r.cluster: r for r in profiles.plausible(pts, known).collect()}
    assert set(got) == {0, 1} and not got[0].plausible and got[1].plausible and got[0].planarity > 0.5 > got[1].planarity


def test_hulls(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x), float(y)) for x, y in [(0, 0), (4, 0), (4, 3), (0, 3)]] + [("a", *map(float, r)) for r in rng.uniform(0.1, 2.9, (200, 2))] + [("a", 2.0, 0.0), ("b", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 0.0, 0.0), ("c", 1.0, 1.0), ("c", 2.0, 2.0), ("a", None, 1.0)]
    got = {}
    for r in catalogs.hull(spark.createDataFrame(rows, "g string, x double, y double").repartition(3), "g", 4).orderBy("g", "place").collect():
        got.setdefault(r.g, []).append((r.x, r.y))
    assert got == {"a": [(0, 0), (4, 0), (4, 3), (0, 3)], "b": [(1, 1)], "c": [(0, 0), (2, 2)]}


def test_oriented_boxes(spark):
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    corners = np.array([[x, y, z] for x in (-5, 5) for y in (-2, 2) for z in (-1, 1)], float)
    p = corners @ turn.T + [1, 2, 3]
    got = catalogs.oriented_boxes(spark.createDataFrame([(0, *map(float, r)) for r in p], "g int, x double, y double, z double"), "g").first()
    assert np.allclose((got.cx, got.cy, got.cz), (1, 2, 3)) and np.allclose((got.d0, got.d1, got.d2), (10, 4, 2))


def test_logistic_regression_sweep(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], "id int, embedding array<double>, label int")
    got = {r.strength: r.accuracy for r in catalogs.swept(df.where("id < 200"), df.where("id >= 200"), (1e-6, 1.0), rounds=30).collect()}
    assert got[1.0] > 0.85 and set(got) == {1e-6, 1.0}


def test_named_datasets(spark, tmp_path):
    assert named.parsed("A:root=/x:y:split=val") == ("A", {"root": "/x:y", "split": "val"})
    with pytest.raises(ValueError):
        named.dataset(spark, "Nothing:root=/x")
    for p in ("n01/n01_3.JPEG", "n02/n02_11.JPEG", "n02/odd.JPEG"):
        (tmp_path / "img" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / p).write_bytes(b"x")
    (tmp_path / "labels.csv").write_text("n01,cat\nn02,dog\n")
    got = {(r.class_id, r.number, r.class_name, r.class_index) for r in named.dataset(spark, f"Folder:root={tmp_path}/img:labels={tmp_path}/labels.csv").collect()}
    assert got == {("n01", 3, "cat", 0), ("n02", 11, "dog", 1)}
    (tmp_path / "pairs.txt").write_text("a.jpg a.png\nbad\nb.jpg b.png 3\n")
    assert named.register(spark, {"pairs_of_test": f"Pairs:file={tmp_path}/pairs.txt:root=/d"}) == ["pairs_of_test"]
    assert [tuple(r) for r in spark.sql("SELECT * FROM pairs_of_test ORDER BY image").collect()] == [("/d/a.jpg", "/d/a.png"), ("/d/b.jpg", "/d/b.png")]
    for k in range(12):
        for d, s in (("im", "jpg"), ("ma", "png")):
            (tmp_path / d).mkdir(exist_ok=True)
            (tmp_path / d / f"f{k}.{s}").write_bytes(b"x")
    both = named.image_mask_pairs(spark, str(tmp_path / "im"), str(tmp_path / "ma"), "0.25", "3").collect()
    assert len(both) == 12 and sum(r.part == "val" for r in both) == 3 and all(r.left.endswith(f"{r.stem}.jpg") and r.right.endswith(f"{r.stem}.png") for r in both)


def test_annotation_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"annotations": [{"image_id": "7", "file_name": "s/a.png", "segments_info": [{"id": 1, "category_id": 30, "area": 5, "bbox": [0, 0, 1, 1], "iscrowd": 0}, {"id": 2, "category_id": 99, "area": 5, "bbox": [], "iscrowd": 1}]}]}))
    mapping = spark.createDataFrame([(30, 2, True)], "from_id int, to_id int, is_thing boolean")
    row = named.panoptic(spark, str(tmp_path / "p.json"), "im", "gt", mapping).first()
    assert (row.file_name, row.target_name) == ("im/s/a.jpg", "gt/s/a.png") and [(s.category_id, s.isthing) for s in row.segments] == [(2, True), (None, None)]
    square = [0, 0, 1, 0, 1, 1]
    doc = {
        "videos": [{"id": 1, "file_names": ["a", "b", "c"], "width": 4, "height": 3, "length": 2}],
        "categories": [{"id": 5, "name": "five"}, {"id": 3, "name": "three"}],
        "annotations": [{"id": 1, "video_id": 1, "category_id": 5, "iscrowd": 0, "bboxes": [[0, 0, 1, 1], None], "segmentations": [[square, [1, 2, 3]], None]}, {"id": 2, "video_id": 1, "category_id": 3, "iscrowd": 0, "bboxes": [[0, 0, 1, 1], [0, 0, 1, 1]], "segmentations": [[[1, 2, 3, 4]], None]}],
    }
    (tmp_path / "v.json").write_text(json.dumps(doc))
    got = {(r.frame, r.file_name, r.id, r.category, r.name, None if r.polygons is None else len(r.polygons)) for r in named.video_objects(spark, str(tmp_path / "v.json"), "root").collect()}
    assert got == {(0, "root/a", 1, 1, "five", 1), (1, "root/b", None, None, None, None)}


def test_features(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.0])], "id int, f array<double>")
    named.write_features(df, str(tmp_path / "f"))
    assert named.read_features(spark, str(tmp_path / "f")).dtypes == [("id", "int"), ("f", "array<float>")]


def test_graph_score_without_reviews(spark):
    from cairn.operators import scene

    contents = spark.createDataFrame([("Chair", "", "", ""), ("lamp", "1", "n9", ""), ("sofa", None, "", "maybe"), ("rug", "0", "n1", ""), ("", "1", "n1", ""), ("示例", "1", "n1", "")], "expected_label string, required string, matched_node_id string, matched string")
    relations = spark.createDataFrame([("r1", "chair", "near", "lamp", "1", "", ""), ("r2", "chair", "on", "lamp", "1", "", "no")], "relation_id string, source_label string, relation string, target_label string, required string, matched_edge_id string, matched string")
    empty = lambda k: spark.createDataFrame([], f"{k} string, correct string")
    found = spark.createDataFrame([("n1", "chair"), ("n2", "lamp")], "node_id string, label string")
    edges = spark.createDataFrame([("n1", "near", "n2")], "source string, relation string, target string")
    one = scene.graph_score(contents, relations, empty("node_id"), empty("edge_id"), found, edges, auto=True).first()
    assert (one.content_total, one.content_met, one.content_unresolved, one.relation_total, one.relation_met) == (3, 2, 1, 2, 1)
    assert (one.tp, one.fp, one.fn) == (3, 0, 2) and one.structured_accuracy == 0.6
    strict = scene.graph_score(contents, relations, empty("node_id"), empty("edge_id"), found, edges).first()
    assert (strict.content_met, strict.relation_met, strict.tp) == (1, 0, 1)
    none = scene.graph_score(contents.where("1 = 0"), relations.where("1 = 0"), empty("node_id"), empty("edge_id"), found, edges).first()
    assert none.completeness is None and none.structured_accuracy is None and none.tp == 0


def test_overlaps_without_zeros(spark, monkeypatch):
    from cairn.operators import spatial

    left = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.0), (2, "b", 9.0, 9.0, 9.0)], "pid int, label string, x double, y double, z double")
    right = spark.createDataFrame([(3, "c", 0.1, 0.0, 0.0)], "pid int, label string, x double, y double, z double")
    assert sorted(tuple(r) for r in spatial.overlaps(left, right, 0.5).collect()) == [("a", "c", 1, 1.0), ("b", "c", 0, 0.0)]
    assert [tuple(r) for r in spatial.overlaps(left, right, 0.5, zeros=False).collect()] == [("a", "c", 1, 1.0)]
    monkeypatch.setattr(spatial, "GROUP_PAIRS", 1)
    with pytest.raises(ValueError):
        spatial.overlaps(left, right, 0.5)


def test_graph_documents(spark, tmp_path):
    graph = {"scene": "s", "version": 3, "nodes": [{"node_id": "a", "label": "x"}, {"node_id": "b"}], "edges": [{"source": "a", "target": "b", "relation": "on"}]}
    (tmp_path / "one.json").write_text(json.dumps(graph, indent=2))
    (tmp_path / "named.json").write_text(json.dumps({"nodes": [{"node_id": "c", "label": "y"}]}))
    (tmp_path / "lines.jsonl").write_text("".join(json.dumps(graph | {"scene": f"l{i}"}) + "\n" for i in range(3)) + "\n")
    (tmp_path / "empty.json").write_text("\n")
    nodes, edges = scenes.graph_documents(spark, f"file://{tmp_path}", "node_id string, label string", "source string, target string, relation string")
    assert sorted((r.scene, r.place, r.node_id) for r in nodes.collect()) == sorted([("named", 0, "c"), *((s, i, n) for s in ("s", "l0", "l1", "l2") for i, n in enumerate("ab"))])
    assert {tuple(r) for r in edges.collect()} == {(s, 0, "a", "b", "on") for s in ("s", "l0", "l1", "l2")}
    (tmp_path / "bad.json").write_text('{"nodes": [')
    with pytest.raises(Exception, match="no JSON document in bad"):
        scenes.graph_documents(spark, f"file://{tmp_path}", "node_id string", "source string")[0].collect()


def test_loaded_clouds(spark, tmp_path):
    for name, x in (("a", [0.1, 0.3, 0.9]), ("b", [0.2, 0.2, 5.0])):
        z = np.zeros(3)
        (tmp_path / f"{name}.pcd").write_bytes(formats.pcd_bytes(np.array(x), z, z, z.astype(int), z.astype(int), z.astype(int)))
    assert scenes.cloud(spark, f"file://{tmp_path}").count() == 6
    got = {(r.scene, round(r.x, 5), r.n) for r in scenes.cloud(spark, f"file://{tmp_path}", 0.5).collect()}
    assert got == {("a", 0.2, 2), ("a", 0.9, 1), ("b", 0.2, 2), ("b", 5.0, 1)}
