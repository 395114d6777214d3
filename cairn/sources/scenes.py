"""Readers of a scene's inputs: which cloud to take, calibration, palette, clusters and instances; writer of fused results."""

from __future__ import annotations

import json

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import votes
from cairn.operators.colouring import Camera, Mount
from cairn.operators.spatial import in_boxes
from cairn.sources import formats
from cairn.sources.formats import opened


def cloud_path(path: str, only: bool = False) -> str:
    """The cloud to read: the path itself if it is a file, else of the folder's clouds the first whose name ends in ``_color.pcd``,
    else the first. ``only``: an error unless there is just one of the kind that is taken."""
    fs, root = opened(path)
    info = fs.get_file_info(root)
    if info.is_file:
        return path
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.base_name.endswith(".pcd"))
    found = [n for n in names if n.endswith("_color.pcd")] or names
    if not found:
        raise FileNotFoundError(f"no clouds in {path}")
    if only and len(found) > 1:
        raise ValueError(f"{len(found)} clouds in {path}: {', '.join(found[:5])}")
    return f"{path.rstrip('/')}/{found[0]}"


def settings(spark: SparkSession, path: str) -> dict:
    """A small YAML file as Spark finds it: nested mappings by indentation, numbers, texts, lists in brackets or by dashes."""
    lines = [r[0].split(" #")[0].rstrip() for r in spark.read.text(path).coalesce(1).collect()]

    def value(word: str):
        try:
            return json.loads(word)
        except ValueError:
            return word.strip("\"'")

    # lists in brackets over several lines become one
    joined: list[str] = []
    for line in lines:
        if not line.strip() or line.lstrip().startswith(("#", "%")) or line.strip() == "---":
            continue
        if joined and joined[-1].count("[") > joined[-1].count("]"):
            joined[-1] += " " + line.strip()
        else:
            joined.append(line)
    out: dict = {}
    stack: list[tuple[int, dict | list]] = [(-1, out)]
    opened_at: tuple[dict, str] | None = None
    for line in joined:
        depth, text = len(line) - len(line.lstrip()), line.strip()
        if text.startswith("- "):
            if opened_at is None:
                raise ValueError(f"a list without a name: {text}")
            held, name = opened_at
            if not isinstance(held[name], list):
                held[name] = []
            held[name].append(value(text[2:].strip()))
            continue
        while stack[-1][0] >= depth:
            stack.pop()
        name, _, rest = text.partition(":")
        own = stack[-1][1]
        if rest.strip():
            own[name.strip()] = value(rest.strip())
        else:
            own[name.strip()] = {}
            opened_at = (own, name.strip())
            stack.append((depth, own[name.strip()]))
    return out


def mounted(rotation: list[float], position: list[float]) -> Mount:
    """Where the camera sits on the body, from the transform (nine numbers and three) that takes the body to the camera."""
    r = [rotation[3 * i : 3 * i + 3] for i in range(3)]
    back = [[r[j][i] for j in range(3)] for i in range(3)]  # a rotation's inverse
    at = tuple(-sum(back[i][k] * position[k] for k in range(3)) for i in range(3))
    return Mount(at, quaternion(back))


def quaternion(m: list[list[float]]) -> tuple[float, float, float, float]:
    """x, y, z, w of a rotation matrix, by the largest of the four components, which is taken as positive."""
    trace = m[0][0] + m[1][1] + m[2][2]
    choice = max(range(4), key=lambda k: (m[0][0], m[1][1], m[2][2], trace)[k])
    if choice == 3:
        q = [m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1], 1 + trace]
    else:
        i, j, k = choice, (choice + 1) % 3, (choice + 2) % 3
        q = [0.0] * 4
        q[i], q[j], q[k], q[3] = 1 - trace + 2 * m[i][i], m[j][i] + m[i][j], m[k][i] + m[i][k], m[k][j] - m[j][k]
    size = sum(v * v for v in q) ** 0.5
    return tuple(v / size for v in q)


def calibration(spark: SparkSession, extrinsic: str, intrinsic: str) -> tuple[Camera, Mount]:
    """Camera and mount from two files: extrin_calib with Pcl and Rcl, and scale, cam_width, cam_height, cam_fx ... cam_d3. Sizes and
    focal lengths are scaled; distortion is not."""
    outer, inner = settings(spark, extrinsic)["extrin_calib"], settings(spark, intrinsic)
    flat = [v for row in outer["Rcl"] for v in (row if isinstance(row, list) else [row])]
    scale = inner["scale"]
    fx, fy, cx, cy = (inner[f"cam_{c}"] * scale for c in ("fx", "fy", "cx", "cy"))
    camera = Camera(int(round(inner["cam_width"] * scale)), int(round(inner["cam_height"] * scale)), fx, fy, cx, cy, (inner["cam_d0"], inner["cam_d1"], inner["cam_d2"], inner["cam_d3"], 0.0))
    return camera, mounted(flat, outer["Pcl"])


def camera_table(spark: SparkSession, camera: Camera, mount: Mount) -> DataFrame:
    """One row with every number of the calibration, as a record of what was used."""
    values = {"image_width": camera.width, "image_height": camera.height, "fx": camera.fx, "fy": camera.fy, "cx": camera.cx, "cy": camera.cy}
    values |= dict(zip(("k1", "k2", "p1", "p2", "k3"), camera.distortion, strict=True)) | dict(zip(("ext_pos_x", "ext_pos_y", "ext_pos_z"), mount.position, strict=True)) | dict(zip(("ext_q_x", "ext_q_y", "ext_q_z", "ext_q_w"), mount.rotation, strict=True))
    return spark.range(1).select(*(F.lit(v).alias(n) for n, v in values.items()))


def palette(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """class_id, name, r, g, b from a file with a list ``palette`` of three numbers a class, in order of their classes."""
    rows = settings(spark, path).get("palette") or []
    if any(not isinstance(c, list) or len(c) != 3 for c in rows):
        raise ValueError(f"{path} has no palette of three numbers a class")
    return spark.createDataFrame([(i, names[i] if names else f"class_{i}", *map(int, c)) for i, c in enumerate(rows)], "class_id int, name string, r int, g int, b int")


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """source_file, cluster_id, category and box (x0 ... z1) from files ``*_geometric.json`` with a list ``clusters`` of records
    with bbox_center and bbox_extent; a record without a category is ``unknown``."""
    schema = "clusters array<struct<cluster_id: bigint, bbox_center: array<double>, bbox_extent: array<double>, category: string>>"
    doc = spark.read.option("multiLine", True).option("pathGlobFilter", "*_geometric.json").schema(schema).json(path)
    one = doc.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.explode("clusters").alias("c"))
    half = [F.col("c.bbox_extent")[i] / 2 for i in range(3)]
    return one.select("source_file", F.col("c.cluster_id").alias("cluster_id"), F.coalesce("c.category", F.lit("unknown")).alias("category"), *((F.col("c.bbox_center")[i] + s * half[i]).alias(f"{a}{k}") for k, s in ((0, -1), (1, 1)) for i, a in enumerate("xyz")))


def cluster_points(found: DataFrame, points: DataFrame, tolerance: float, least: int, cell: float = 4.0) -> DataFrame:
    """box_id (source_file and cluster_id), pid: the points within each cluster's box grown by the tolerance; clusters of fewer
    than ``least`` points go. A point may be in several."""
    boxes = found.select(F.concat_ws("#", "source_file", F.col("cluster_id").cast("string")).alias("box_id"), *(f"{a}{k}" for k in (0, 1) for a in "xyz"))
    inside = in_boxes(points, boxes, tolerance, cell)
    kept = inside.groupBy("box_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("box_id")
    return inside.join(kept, "box_id")


def instances(points: DataFrame, summary: DataFrame, least: int) -> DataFrame:
    """instance_id, category, source_file, n and box of each file's points (scene is the file's stem), with at least ``least`` points.
    summary: file, category, instance_num; a file that isn't listed has the part of its stem before ``_inst_`` (underscores as
    blanks) and the number of its place among the files that stay, from 1."""
    low, high = ([f(a).alias(f"{a}{k}") for a in "xyz"] for f, k in ((F.min, 0), (F.max, 1)))
    own = points.groupBy("scene").agg(F.count("*").alias("n"), *low, *high).where(F.col("n") >= least).withColumn("source_file", F.concat("scene", F.lit(".pcd")))
    known = summary.select(F.col("file").alias("source_file"), F.col("category").alias("__c"), F.col("instance_num").cast("long").alias("__i"))
    # files are few: one row each
    place = F.row_number().over(W.orderBy("source_file")).cast("long")
    stem = F.regexp_replace(F.regexp_replace("scene", r"^(.*)_inst_.*?$", "$1"), "_", " ")
    out = own.withColumn("__n", place).join(known, "source_file", "left")
    return out.select(F.coalesce("__i", "__n").alias("instance_id"), F.coalesce("__c", stem).alias("category"), "source_file", "n", *(f"{a}{k}" for k in (0, 1) for a in "xyz"))


def fusion_report(results: DataFrame, source: str = "source", separator: str = "_") -> DataFrame:
    """kind (what stands before the first separator of the source), instances and points of fused results."""
    return results.groupBy(F.substring_index(source, separator, 1).alias("kind")).agg(F.count("*").alias("instances"), F.sum("n").alias("points"))


def write_fused(results: DataFrame, points: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """One cloud file for each fused instance (points carry instance_id, x ... b), the instances' rows as JSON, and the report. Returns
    the files written and the report."""
    from cairn.sources.sinks import write_clouds

    files = write_clouds(points.join(results.select("instance_id"), "instance_id", "left_semi"), f"{path.rstrip('/')}/instances", ("instance_id",))
    results.write.mode("overwrite").json(f"{path.rstrip('/')}/summary")
    report = fusion_report(results)
    report.write.mode("overwrite").json(f"{path.rstrip('/')}/report")
    return files, report


def cloud(spark: SparkSession, path: str, voxel: float | None = None) -> DataFrame:
    """scene, x, y, z and n of the clouds under a path: their points (n is 1), or the mean place of the points of each voxel of each scene."""
    formats.register(spark)
    points = spark.read.format("pcd").load(path)
    if voxel is None:
        return points.select("scene", "x", "y", "z", F.lit(1).cast("long").alias("n"))
    means = votes.voxel_means(points, voxel, ("scene",))
    return means.select("scene", *(F.col(f"m{a}").alias(a) for a in "xyz"), "n")


def graph_documents(spark: SparkSession, path: str, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of scene graphs that were written as documents, one to a line or one to a file: objects with a list ``nodes`` and a list
    ``edges``, whose fields have the schemas given; what else they hold is passed over. ``scene`` is the document's field of that name, or the file's name
    without its ending; ``place`` counts a document's entries from 0. A missing list is an empty one; a text that is no document raises an error."""
    schema = f"scene string, nodes array<struct<{nodes}>>, edges array<struct<{edges}>>"
    text = spark.read.text(path, wholetext=True).select("value", F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("file"))
    # a file is either lines of documents or one document that goes over lines
    lines = F.filter(F.split("value", r"\r?\n"), lambda v: F.trim(v) != "")
    by_line = F.forall("lines", lambda v: F.try_parse_json(v).isNotNull())
    documents = text.withColumn("lines", lines).where(F.size("lines") > 0).select("file", F.explode(F.when(by_line, F.col("lines")).otherwise(F.array("value"))).alias("value"))
    bad = F.try_parse_json(F.col("value")).isNull()
    read = documents.select("file", F.when(bad, F.raise_error(F.concat(F.lit("no JSON document in "), "file"))).otherwise(F.from_json("value", schema)).alias("d"))
    named = read.select(F.coalesce("d.scene", "file").alias("scene"), "d.nodes", "d.edges")
    return tuple(named.select("scene", F.posexplode(c).alias("place", "e")).select("scene", "place", "e.*") for c in ("nodes", "edges"))
