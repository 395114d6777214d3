import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.sources import formats, results
from cairn.streaming import votes as streams


def test_pcd(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "a.pcd").write_bytes(formats.pcd_bytes([0.5, np.nan, 2], [1, 1, 1], [0, 0, 0], [255, 1, 2], [0, 1, 2], [7, 1, 2]))
    (tmp_path / "b.pcd").write_text("VERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 1\nHEIGHT 1\nPOINTS 1\nDATA ascii\n1 2 3\n")
    got = [tuple(r) for r in spark.read.format("pcd").load(str(tmp_path)).orderBy("scene", "pid").collect()]
    assert got == [("a", 0, 0.5, 1.0, 0.0, 255, 0, 7), ("a", 1, 2.0, 1.0, 0.0, 2, 2, 2), ("b", 0, 1.0, 2.0, 3.0, 255, 255, 255)]


def test_ply(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "m.ply").write_text("ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0 1 2 3\n1 0 0 1 2 3\n1 1 0 1 2 3\n0 1 0 1 2 3\n4 0 1 2 3\n")
    assert spark.read.format("ply").load(str(tmp_path)).count() == 4
    faces = spark.read.format("ply").option("part", "faces").load(str(tmp_path)).orderBy("fid").collect()
    assert [(r.a, r.b, r.c) for r in faces] == [(0, 1, 2), (0, 2, 3)]


def test_poses_and_matrices(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1.5 1 2 3 0 0 0 1\nbad line\n2 1 2 3 0 0 0 1 extra\n")
    assert [r.ts for r in formats.poses(spark, str(tmp_path / "p.txt")).orderBy("ts").collect()] == [1, 2]
    (tmp_path / "m.txt").write_text("1 0\n0 1\n")
    (tmp_path / "n.txt").write_text("1 0\n0 inf\n")
    assert [r.m for r in formats.matrices(spark, str(tmp_path / "[mn].txt"), 2).collect()] == [[1.0, 0.0, 0.0, 1.0]]


def test_captions_and_csv(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a"}, {"id": 2, "file_name": "b"}], "annotations": [{"id": 9, "image_id": 1, "caption": "y"}, {"id": 8, "image_id": 1, "caption": "x"}]}))
    assert {r.id: r.captions for r in formats.captions(spark, str(tmp_path / "c.json")).collect()} == {1: ["x", "y"], 2: []}
    assert formats.optional_csv(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert formats.optional_csv(spark, str(tmp_path / "t.csv"), ["a", "z"]).first().asDict() == {"a": "1", "z": None}


def test_results(spark, tmp_path):
    df = spark.createDataFrame([(1, True, 0.5)], "n int, ok boolean, v float")
    out = results.stacked(df, df.select("n"))
    assert out.dtypes == [("n", "bigint"), ("ok", "string"), ("v", "double")] and out.count() == 2
    for kind in ("csv", "json", "parquet"):
        results.write(df, str(tmp_path / kind), kind)
        assert tuple(results.read(spark, str(tmp_path / kind), "n long, ok string, v double", kind).first()) == (1, "true", 0.5)
    with pytest.raises(ValueError):
        results.plain(spark.range(1).select(F.array("id").alias("a")))


def test_stream_of_votes(spark, tmp_path):
    data = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (2, None)], "pid int, label string")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = streams.running_votes(stream).writeStream.outputMode("complete").format("memory").queryName("votes_seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("votes_seen").collect())) == [(1, "A", 2), (1, "B", 1)]


def test_late_rows_are_dropped(spark, tmp_path):
    path = tmp_path / "events"
    rows = [[("2024-01-01 00:10:00", 1, "A")], [("2024-01-01 02:00:00", 1, "A")], [("2024-01-01 00:11:00", 1, "A"), ("2024-01-01 04:00:00", 1, "B")]]
    schema = "ts timestamp, pid int, label string"
    path.mkdir()
    seen = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))
    q = streams.windowed_votes(seen, "ts", "10 minutes", "1 hour").writeStream.outputMode("append").format("memory").queryName("late_seen").start()
    for i, part in enumerate(rows):
        (path / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("ts", "pid", "label"), r, strict=True))) for r in part))
        q.processAllAvailable()
    q.stop()
    assert sorted(r.votes for r in spark.table("late_seen").collect()) == [1, 1]
