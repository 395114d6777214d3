"""What keeps queries within memory and time on large tables: how rows are dealt and which joins Spark may take."""

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import colouring, losses, panoptic, scene, spatial
from cairn.plans import masks as plans
from cairn.plans.colouring import CAMERA, MOUNT, PIXEL, POSE
from cairn.plans.registry import QUERIES
from cairn.plans.views import BOX, PALETTE, POINT, view

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_exploded_views_run_in_several_tasks(spark):
    rows = view(spark, DATA, plans._DEPTHS)
    assert rows.select(F.spark_partition_id()).distinct().count() > 1


def test_pixels_of_losses_are_not_broadcast(spark):
    found = losses.gradient(view(spark, DATA, plans._DEPTHS), ["image"], valid="valid")
    assert "Broadcast" not in plan(found)


def test_pixels_of_contests_are_written_once_and_not_broadcast(spark):
    classes, pixels = view(spark, DATA, plans.CLASSES), view(spark, DATA, plans.MASKS)
    for out in panoptic.panoptic(classes, pixels, 4, (0, 2), 0.5, 0.3):
        # the only table that may be broadcast is that of queries, as it was written
        assert plan(out).count("BroadcastHashJoin") <= 1 and "Generate" not in plan(out)
    # votes are summed by pixel alone, not by pixel and class
    assert "class" not in plan(panoptic.semantic(classes, pixels, 4))


def test_pixels_of_images_stay_where_they_are_made(spark):
    classes, pixels = view(spark, DATA, plans.CLASSES), view(spark, DATA, plans.MASKS, plans.BY_IMAGE)
    assert pixels.select("image", F.spark_partition_id()).distinct().groupBy("image").count().where("count > 1").count() == 0
    found = plan(panoptic.semantic(classes, pixels, 4))
    assert "BroadcastHashJoin" not in found and "SortMergeJoin" not in found
    # of pixels only the parts that they are made of are moved, and what there is of each image
    assert found.count("Exchange") == 2


def test_contested_pixels_stay_where_they_are_made(spark):
    classes, pixels = view(spark, DATA, plans.CLASSES), view(spark, DATA, plans.MASKS, plans.BY_IMAGE)
    sure = panoptic._of_images(panoptic.best_class(classes), pixels, ["score"], "sure_of")
    part = panoptic._contested(sure, pixels)
    for found in (plan(panoptic._won(part)), plan(part.groupBy("image", "query").agg(F.count_if("own")))):
        assert found.count("Exchange") == 2 and "BroadcastHashJoin" not in found and "SortMergeJoin" not in found


def test_pixels_are_not_broadcast_to_points(spark):
    p = view(spark, DATA, POINT).withColumn("frame", 1 + F.col("pid") % 50)
    found = colouring.frame_colours(p, view(spark, DATA, POSE), view(spark, DATA, PIXEL), view(spark, DATA, PALETTE), CAMERA, MOUNT)
    at = next(line for line in plan(found).splitlines() if "Join" in line and "__px" in line)
    assert "SortMergeJoin" in at


def test_frames_of_the_same_poses_are_one_view(spark):
    pose = (0.0, 0.0, -6.0, 0.0, 0.0, 0.05, 1.0)
    other = (1.0, *pose[1:])
    # frame 4 has two poses, frame 5 one of them, frame 6 both again
    rows = [(1, *pose), (2, *pose), (3, *other), (4, *pose), (4, *other), (5, *other), (6, *other), (6, *pose)]
    members, own = colouring.shared_views(spark.createDataFrame(rows, "ts long, px double, py double, pz double, qx double, qy double, qz double, qw double"))
    assert {r.frame: r.view for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 4}
    assert sorted(r.ts for r in own.collect()) == [1, 3, 4, 4]


def test_what_is_shown_is_made_once_a_view(spark, monkeypatch):
    found = QUERIES["j01_points_by_poses"](spark, DATA)
    joined, rounded = (plan(found).index(what) for what in ("Join [view#", "round("))
    assert joined < rounded and "round(" not in plan(found)[:joined]
    # frames come in as lists, behind the join
    assert "explode(frames" in plan(found)[:joined]
    monkeypatch.setattr(colouring, "MEMBERS", 0)
    monkeypatch.setattr(colouring, "LISTED", 3)
    assert sorted(QUERIES["j01_points_by_poses"](spark, DATA).collect()) == sorted(found.collect())


def test_a_crowded_cell_is_several(spark, monkeypatch):
    p, poses, pixels = view(spark, DATA, POINT), view(spark, DATA, POSE), view(spark, DATA, PIXEL)
    one = colouring.vote_counts(p, poses, pixels, CAMERA, MOUNT).collect()
    monkeypatch.setattr(colouring, "SHARE", 50)
    assert sorted(colouring.vote_counts(p, poses, pixels, CAMERA, MOUNT).collect()) == sorted(one) and one
    each = colouring.voted(p, poses, pixels, CAMERA, MOUNT).groupBy("pid", "label").agg(F.count("*").alias("votes"))
    assert sorted(each.collect()) == sorted(one)


def test_neighbours_are_not_made_from_all_pairs_within_the_radius(spark):
    """Dense and sparse places, copies and points that aren't finite: all as by brute force, from few pairs."""
    rng = np.random.default_rng(5)
    places = np.concatenate([rng.normal(0, 0.02, (150, 3)), rng.normal(1.5, 0.4, (100, 3)), rng.uniform(-6, 6, (40, 3)), np.tile([[0.5, 0.5, 0.5]], (60, 1))])
    rows = [(i, *map(float, p)) for i, p in enumerate(places)] + [(900, float("nan"), 0.0, 0.0), (901, float("inf"), 0.0, 0.0), (902, None, 0.0, 0.0)]
    want = {}
    for i, p in enumerate(places):
        d = np.sqrt(((places - p) * (places - p)) @ np.ones(3))
        want[i] = [int(j) for j in sorted((j for j in range(len(places)) if j != i and d[j] <= 2.0), key=lambda j: (d[j], j))[:5]]
    found = spatial.knn_within(spark.createDataFrame(rows, "pid long, x double, y double, z double"), 5, 2.0)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.pid, r.place)):
        got.setdefault(r.pid, []).append(r.neighbour)
    assert got == {i: n for i, n in want.items() if n}
    # cells are looked into as far as a point's bound only
    assert "__bound" in plan(found)


def test_pairs_of_relations_on_common_ground_only(spark):
    boxes = view(spark, DATA, BOX)
    few = scene.relations(boxes, ("Brand#11",), ("Brand#11",), (), wanted=("on", "inside"))
    every = scene.relations(boxes, ("Brand#11",), ("Brand#11",), ()).where("relation in ('on', 'inside')")
    shown = ["source", "target", "relation", "confidence"]
    assert sorted(few.select(shown).collect()) == sorted(every.select(shown).collect())
    # boxes are dealt to the cells within the margin, not to those within reach of nearness
    assert f"- {scene.INSIDE_MARGIN}" in plan(few)


def _crowded(spark):
    """Boxes of many sizes, copies and flat ones among them, a few without a corner or a label."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(260):
        low, size = rng.integers(-20, 20, 3) * 0.25, rng.choice([0.0, 0.25, 0.5, 1.0, 2.0, 9.0, 30.0], 3)
        label, kind = str(rng.choice(["floor", "table", "wall", "cup"])), str(rng.choice(["region", "object"]))
        rows.append((i * 3, f"n{i}", None if i == 7 else label, None if i == 9 else kind, int(rng.integers(10, 30)), *map(float, low), *map(float, low + size)))
    rows += [(1000, "n1000", "cup", "object", 20, None, 0.0, 0.0, 1.0, 1.0, 1.0), (1001, "n1001", "cup", "object", 20, float("nan"), 0.0, 0.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "ord long, node_id string, label string, kind string, n long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")


_RULES = (("floor", "table"), ("floor",), ("wall",), (("cup", "floor"),))


def test_relations_are_counted_as_they_are_made(spark):
    boxes = _crowded(spark)
    made = scene.relations(boxes, *_RULES, carried=("ord", "label"))
    want = made.groupBy(F.col("source_ord").alias("ord"), "source_label", "relation", "target_label").agg(F.count("*").alias("n")).collect()
    assert {r.relation for r in want} == set(scene.RELATIONS)
    found = scene.relation_counts(boxes, *_RULES)
    assert sorted(map(str, found.collect())) == sorted(map(str, want))
    # pairs aren't rows: cells of boxes meet in bulk
    assert "SortMergeJoin" not in plan(found)


def test_code_of_pairs_is_compiled(spark, capsys):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    found = scene.relations(view(spark, DATA, BOX), ("Brand#11",), ("Brand#11",), ("Brand#13",)).groupBy("source").count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found.explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(part.split(";")[0]) for part in capsys.readouterr().out.split("maxMethodCodeSize:")[1:] if "SortMergeJoin" in part.split("Generated code:")[0]]
    assert sizes and max(sizes) < 8000


def test_edges_are_numbered_without_being_written(spark, monkeypatch):
    boxes, written = _crowded(spark), []
    want = {(r.source, r.target, r.relation): r.edge_id for r in scene.edge_ids(scene.relations(boxes, *_RULES)).collect()}
    keep = scene.saved
    monkeypatch.setattr(scene, "saved", lambda df, what: written.append(what) or keep(df, what))
    found = scene.numbered_relations(boxes, *_RULES)
    assert {(r.source, r.target, r.relation): r.edge_id for r in found.collect()} == want and len(want) > 1000
    assert written == ["starts"]


def test_first_edges_by_id_as_text(spark, monkeypatch):
    """Ids keep the first digits of a number only, so the smallest need not be that of the first edge."""
    monkeypatch.setattr(scene, "DIGITS", 2)
    boxes = _crowded(spark)
    every = scene.numbered_relations(boxes, *_RULES)
    label = lambda side: boxes.select(F.col("node_id").alias(side), F.col("label").alias(f"{side}_label"))
    key = ["source_label", "relation", "target_label"]
    smallest = lambda edges: {str(r[:3]): r.id for r in edges.join(label("source"), "source").join(label("target"), "target").groupBy(*key).agg(F.min("edge_id").alias("id")).collect()}
    want = smallest(every)
    assert smallest(scene.earliest_edges(boxes, *_RULES)) == want and len(want) > 40
    assert len({i for i in want.values() if i >= "edge_10"}) > 1
