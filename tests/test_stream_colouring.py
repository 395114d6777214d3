"""Colours of a cloud from a stream of poses, stopped and begun again, against those from tables."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import colouring
from cairn.streaming import colouring as streams

CAMERA = colouring.Camera(32, 24, 20.0, 20.0, 16.0, 12.0)
MOUNT = colouring.Mount((0.1, -0.2, 0.05), (0.0, 0.1, 0.0, 1.0))
POSES = "ts long, px double, py double, pz double, qx double, qy double, qz double, qw double, at timestamp"


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.normal(size=(150, 3)) * 3 + [0, 0, 8])], "pid long, x double, y double, z double")
    start = datetime.datetime(2024, 1, 1)
    poses = [(i, float(i % 3 - 1), float(i % 2), float(-i % 4), 0.02 * i, 0.01, 0.0, 1.0, start + datetime.timedelta(seconds=10 * i)) for i in range(8)]
    pixels = spark.createDataFrame([(f, y, x, int((x * 7 + y * 3 + f) % 4)) for f in range(7) for y in range(24) for x in range(32) if (x + y) % 5], "frame long, y int, x int, label int")
    return points, poses, pixels


@pytest.mark.parametrize("reach", [6.0, 12.0])
def test_poses_by_reach_see_what_all_see(spark, scene, reach):
    points, poses, _ = scene
    posed = spark.createDataFrame(poses, POSES)
    every = colouring.observed(points, posed, CAMERA, MOUNT)
    away = every.join(points, "pid").join(colouring.camera_poses(posed, MOUNT), "frame")
    near = away.where(F.sqrt((F.col("x") - F.col("t0")) ** 2 + (F.col("y") - F.col("t1")) ** 2 + (F.col("z") - F.col("t2")) ** 2) <= reach)
    want = {(r.pid, r.frame) for r in near.collect()}
    got = colouring.observed(points, posed, CAMERA, MOUNT, reach, cell=1.0)
    assert 0 < len(want) < every.count() and {(r.pid, r.frame) for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_stream_of_poses_ends_with_the_colours_of_the_table(spark, scene, tmp_path):
    points, poses, pixels = scene
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        folder, out, state = (f"file://{tmp_path}/{n}" for n in ("poses", "out", "state"))

        def arrive(some):
            spark.createDataFrame(some, POSES).coalesce(1).write.mode("append").parquet(folder)

        def run():
            stream = spark.readStream.schema(POSES).option("maxFilesPerTrigger", 1).parquet(folder)
            found = streams.coloured(points, stream, pixels, CAMERA, MOUNT, least=2, keep=10_000, idle=10_000)
            query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination(300)
            assert query.exception() is None and not query.isActive
            newest = W.partitionBy("pid").orderBy(F.col("version").desc())
            return {r.pid: (r.label, r.votes, r.total) for r in spark.read.parquet(out).withColumn("n", F.row_number().over(newest)).where("n = 1").collect()}

        def table(some):
            palette = spark.createDataFrame([(i, i, i, i) for i in range(4)], "class_id int, r int, g int, b int")
            got = colouring.coloured(points, spark.createDataFrame(some, POSES), pixels, palette, CAMERA, MOUNT, least=2)
            return {r.pid: (r.label, r.votes, r.total) for r in got.collect()}

        arrive(poses[:2])
        arrive(poses[2:4])
        first = run()
        assert {p: first.get(p, (None, 0, 0)) for p in range(150)} == table(poses[:4])
        # the query is begun again from its checkpoint; a frame that comes twice changes nothing
        arrive(poses[4:])
        arrive(poses[:1])
        again = run()
        assert {p: again.get(p, (None, 0, 0)) for p in range(150)} == table(poses)
        assert sum(v[1] > 0 for v in again.values()) > 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hidden_points_take_their_votes_back_and_idle_points_close(spark, tmp_path):
    spark_partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        streams.configured(spark)
        folder, out, state = (f"file://{tmp_path}/{n}" for n in ("rows", "out", "state"))
        schema = "pid long, frame long, yi int, xi int, depth double, label int, at timestamp"
        t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
        for rows in ([(1, 0, 3, 3, 5.0, 2, t(0)), (2, 0, 3, 4, 5.0, 2, t(0))], [(3, 0, 3, 3, 1.0, None, t(1)), (4, 0, 3, 4, 5.1, 1, t(1))], [(9, 7, 0, 0, 1.0, 1, t(5000))], [(9, 8, 0, 0, 1.0, 1, t(5001))]):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(schema).parquet(folder)
            query = streams.winners(streams.visible_votes(stream, "10 seconds", 60), 1, 600).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination(300)
            assert query.exception() is None
        got = sorted((r.pid, r.version, r.label, r.votes, r.closed) for r in spark.read.parquet(out).collect())
        assert [g for g in got if g[0] == 1] == [(1, 1, 2, 1, False), (1, 2, None, 0, False), (1, 3, None, 0, True)]
        assert [g for g in got if g[0] == 2] == [(2, 1, 2, 1, False), (2, 2, 2, 1, True)]
        assert [g for g in got if g[0] == 4] == [(4, 1, 1, 1, False), (4, 2, 1, 1, True)]
        assert not [g for g in got if g[0] == 3] and [g[3] for g in got if g[0] == 9] == [1, 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", spark_partitions)


def test_frames_of_the_same_poses_are_looked_from_once(spark, scene, tmp_path):
    points, _, pixels = scene
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        streams.configured(spark)
        folder, told, out = (f"file://{tmp_path}/{n}" for n in ("poses", "told", "out"))
        at = datetime.datetime(2024, 1, 1)
        pose, other = (0.0, 0.0, -4.0, 0.02, 0.01, 0.0, 1.0), (1.0, 0.0, -3.0, 0.0, 0.01, 0.0, 1.0)
        # frames 0 to 4 are one view; then frame 4 gets another pose, which makes it a view of its own, and 5 is as the others were
        first, second = [(f, *pose, at) for f in range(5)], [(4, *other, at), (5, *pose, at), (0, *pose, at)]

        def run(of, name):
            query = of.writeStream.format("parquet").option("path", f"{name}").option("checkpointLocation", f"{name}-state").trigger(availableNow=True).start()
            query.awaitTermination(300)
            assert query.exception() is None and not query.isActive

        for some in (first, second):
            spark.createDataFrame(some, POSES).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(POSES).parquet(folder)
            run(streams.views(stream, keep=10_000), told)
            run(streams.coloured(points, stream, pixels, CAMERA, MOUNT, least=1, keep=10_000, idle=10_000), out)
        rows = spark.read.parquet(told).collect()
        assert sorted((r.frame, r.sign, len(r.view.split(",")) // 7) for r in rows) == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, -1, 1), (4, 1, 1), (4, 1, 2), (5, 1, 1)]
        # once for the five frames, and once for each of the two views of the second micro-batch
        assert sorted(len(r.poses) for r in rows if r.poses) == [7, 7, 14]
        newest = W.partitionBy("pid").orderBy(F.col("version").desc())
        got = {r.pid: (r.label, r.votes, r.total) for r in spark.read.parquet(out).withColumn("n", F.row_number().over(newest)).where("n = 1 and total > 0").collect()}
        palette = spark.createDataFrame([(i, i, i, i) for i in range(4)], "class_id int, r int, g int, b int")
        want = colouring.coloured(points, spark.createDataFrame(first + second[:2], POSES), pixels, palette, CAMERA, MOUNT)
        assert got == {r.pid: (r.label, r.votes, r.total) for r in want.collect() if r.total} and len(got) > 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
