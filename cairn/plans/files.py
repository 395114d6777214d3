"""Queries that write files and read them back: images, archives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cairn.functions.storage import new_path
from cairn.operators import colouring
from cairn.plans.colouring import _BUFFER, _HELD, _LOOKED, _NEAR, CAMERA, MOUNT, PIXEL, POSE, _seen_sql
from cairn.plans.registry import query
from cairn.plans.views import PALETTE, POINT, ctes, table, view
from cairn.sources import archives, formats, images, sinks

#: Depth in millimetres for every pixel of an image for each supplier.
DEPTH = {
    "spark": "SELECT s_suppkey AS frame, x, y, (x * 97 + y * 389 + s_suppkey * 13) % 65536 AS value FROM supplier LATERAL VIEW explode(sequence(0, 31)) a AS x LATERAL VIEW explode(sequence(0, 23)) b AS y",
    "sql": "SELECT s_suppkey AS frame, x.i AS x, y.i AS y, (x.i * 97 + y.i * 389 + s_suppkey * 13) % 65536 AS value FROM supplier, range(32) x(i), range(24) y(i)",
}


def _images(spark, rows, depth=8, palette=None):
    """The pixels as they come back from files, and the number of images that were written."""
    path = new_path(spark, "images")
    images.register(spark)
    written = images.write_images(rows, path, depth, palette).agg(F.count("*"), F.sum("height")).first()[0]
    return spark.read.format("png").load(path) if written else spark.createDataFrame([], images.PIXELS)


@query(ctes(d=DEPTH) + " SELECT frame, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(value AS DOUBLE) / 1000 AS depth FROM d WHERE y >= 3 AND y < 20")
def s06_depth_files(spark, d):
    """Depth images of 16 bits, written and read back: some rows, in metres."""
    got = images.depth_in_metres(_images(spark, view(spark, d, DEPTH), 16).where("y >= 3 AND y < 20"))
    return got.select(F.col("frame").cast("long").alias("frame"), "y", "x", "depth")


# of classes that share a colour the largest is meant
_FROM_FILES = dict(k=PALETTE, kk="SELECT r, g, b, max(class_id) AS label FROM k GROUP BY 1, 2, 3", u="SELECT frame, x, y, kk.label FROM g0 JOIN k ON k.class_id = g0.label JOIN kk ON kk.r = k.r AND kk.g = k.g AND kk.b = k.b")


def _label_files(spark, d):
    palette = view(spark, d, PALETTE)
    colours = palette.where("class_id between 0 and 254").collect()  # as many as a file's palette holds
    # number 0 is no label's; a pixel without a label is painted with it
    table_ = np.full((256, 3), 1, np.uint8)
    for c in colours:
        table_[c["class_id"] + 1] = (c["r"], c["g"], c["b"])
    back = _images(spark, view(spark, d, PIXEL).select("frame", "y", "x", (F.col("label") + 1).alias("value")), 8, table_)
    return images.labels_by_colour(back, palette).select(F.col("frame").cast("long").alias("frame"), "y", "x", "label")


@query(ctes(g0=PIXEL, **_FROM_FILES) + " SELECT frame, y, x, label FROM u")
def x03_label_files(spark, d):
    """Label images painted with a palette, written, read back and looked up by colour."""
    return _label_files(spark, d).where("label is not null")


@query(ctes(_HELD, g0=PIXEL, **_FROM_FILES, **(_seen_sql(CAMERA) | {"g": "SELECT * FROM u"}), b=_BUFFER, near=_NEAR, l=_LOOKED) + " SELECT pid, frame, label FROM l")
def j03_labels_from_files(spark, d):
    """What frames say about points, their label images being files."""
    return colouring.voted(view(spark, d, POINT), view(spark, d, POSE), _label_files(spark, d), CAMERA, MOUNT)


@query("SELECT p_brand || '.tar' AS archive, p_brand AS class, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey || '_' || p_name) - 1 AS number, p_partkey || '_' || p_name AS name, CAST(strlen(p_name || repeat('x', CAST(p_partkey % 1500 AS INT))) AS BIGINT) AS size, md5(p_name || repeat('x', CAST(p_partkey % 1500 AS INT))) AS digest FROM part")
def s18_tar_members(spark, d):
    """Archives of members by class, written, listed by their headers and read by their places."""
    path = new_path(spark, "archives")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("class"), F.concat(F.col("p_partkey").cast("string"), F.lit("_"), "p_name").alias("name"), F.encode(F.concat("p_name", F.repeat(F.lit("x"), (F.col("p_partkey") % 1500).cast("int"))), "utf-8").alias("content"))
    archives.write_archives(rows, path).agg(F.sum("members")).first()
    return archives.members(archives.index(spark, path), path).select("archive", "class", "number", "name", "size", F.md5("content").alias("digest"))


@query("WITH v AS (SELECT p_partkey * 3 AS vid, row_number() OVER (ORDER BY p_partkey) - 1 AS i, CAST(p_retailprice AS FLOAT) AS x FROM part), f AS (SELECT p_partkey AS fid, p_partkey * 3 + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS a, (p_partkey % 50 + 1) * 3 AS b, (p_partkey % 31 + 1) * 3 AS c FROM part) SELECT row_number() OVER (ORDER BY fid) - 1 AS fid, a.i AS a, b.i AS b, c.i AS c FROM f JOIN v a ON f.a = a.vid JOIN v b ON f.b = b.vid JOIN v c ON f.c = c.vid")
def k02_mesh(spark, d):
    """A mesh written as one file by tasks, and its faces as they come back."""
    p = table(spark, d, "part")
    vertices = p.select((F.col("p_partkey") * 3).alias("vid"), F.col("p_retailprice").cast("double").alias("x"), F.col("p_size").cast("double").alias("y"), F.lit(0.5).alias("z"), (F.col("p_size") % 256).alias("r"), F.lit(1).alias("g"), F.lit(2).alias("b"))
    key = F.col("p_partkey")
    faces = p.select(key.alias("fid"), (key * 3 + F.when(key % 11 == 0, 1).otherwise(0)).alias("a"), ((key % 50 + 1) * 3).alias("b"), ((key % 31 + 1) * 3).alias("c"))
    path = new_path(spark, "mesh") + ".ply"
    sinks.write_mesh(vertices, faces, path)
    formats.register(spark)
    return spark.read.format("ply").option("part", "faces").load(path).select("fid", "a", "b", "c")
