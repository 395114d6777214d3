"""Named datasets, listings and annotation files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.catalogs import image_parts
from cairn.operators.matching import paired_by_name
from cairn.operators.sampling import split

#: Loaders of named datasets: a function of the session and the options of the name.
LOADERS: dict[str, Callable[..., DataFrame]] = {}


def loader(name: str):
    """Registers a loader of datasets."""

    def keep(f: Callable[..., DataFrame]):
        LOADERS[name] = f
        return f

    return keep


def parsed(name: str) -> tuple[str, dict[str, str]]:
    """The loader and its options of ``Name:key=value:key=value``."""
    first, *rest = name.split(":")
    # what has no sign of equality belongs to the value before (a path may hold a colon)
    options: list[str] = []
    for part in rest:
        if "=" in part:
            options.append(part)
        elif options:
            options[-1] += f":{part}"
        else:
            raise ValueError(f"{part} in {name} is no option")
    return first, dict(o.split("=", 1) for o in options)


def dataset(spark: SparkSession, name: str) -> DataFrame:
    first, options = parsed(name)
    if first not in LOADERS:
        raise ValueError(f"no dataset {first}; there are {', '.join(sorted(LOADERS))}")
    return LOADERS[first](spark, **options)


def register(spark: SparkSession, tables: dict[str, str]) -> list[str]:
    """Temporary views of named datasets (view: ``Name:key=value``), so that SQL can read them; the views' names."""
    for view, name in tables.items():
        dataset(spark, name).createOrReplaceTempView(view)
    return sorted(tables)


def listed(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """path and size of all files under a folder, in any depth, other than empty ones; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select("path", F.col("length").alias("size"))


@loader("Folder")
def image_folder(spark: SparkSession, root: str, labels: str | None = None, suffix: str = ".JPEG") -> DataFrame:
    """path, class_id, number, and class_name and class_index, of images ``<class>/<class>_<number>``. labels: a CSV file of class_id
    and class_name; classes are numbered in order of their ids, which are a dimension."""
    from cairn.operators.annotations import dense_index

    name, number = image_parts(F.col("path"))
    found = listed(spark, root, suffix).select("path", name.alias("class_id"), number.alias("number")).where("class_id is not null")
    out = found.join(dense_index(found, "class_id", "class_index"), "class_id")
    if labels is None:
        return out.select("path", "class_id", "number", F.col("class_id").alias("class_name"), "class_index")
    named = spark.read.schema("class_id string, class_name string").csv(labels)
    return out.join(named, "class_id", "left").select("path", "class_id", "number", "class_name", "class_index")


@loader("Pairs")
def listed_pairs(spark: SparkSession, file: str, root: str = "") -> DataFrame:
    """image and target of a text file of two paths a line, both below the root; in order of the image when sorted by it."""
    words = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.concat(F.lit(f"{root.rstrip('/')}/" if root else ""), F.get(words, F.lit(i)))
    return spark.read.text(file).where(F.size(words) >= 2).select(at(0).alias("image"), at(1).alias("target"))


@loader("Masks")
def image_mask_pairs(spark: SparkSession, images: str, masks: str, share: str = "0.1", seed: str = "0", mask_suffix: str = "") -> DataFrame:
    """stem, left (image), right (mask) and part (train or val) of images and masks of the same stem."""
    both = paired_by_name(listed(spark, images), listed(spark, masks), "", mask_suffix).withColumn("all", F.lit(1))
    return split(both, "all", "stem", float(share), int(seed)).drop("all")


SEGMENTS = "annotations array<struct<image_id: string, file_name: string, segments_info: array<struct<id: bigint, category_id: bigint, area: bigint, bbox: array<double>, iscrowd: int>>>>"


@loader("Panoptic")
def panoptic(spark: SparkSession, file: str, images: str = "", targets: str = "", mapping: DataFrame | None = None, image_suffix: str = ".jpg") -> DataFrame:
    """file_name, target_name, image_id and segments of a panoptic JSON file. mapping: from_id, to_id and is_thing of categories; with
    it categories are replaced, and a segment is a thing or not; without it they stay."""
    notes = spark.read.option("multiLine", True).schema(SEGMENTS).json(file).select(F.explode("annotations").alias("a")).select("a.*")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    out = notes.select(F.concat(F.lit(f"{images}/" if images else ""), stem, F.lit(image_suffix)).alias("file_name"), F.concat(F.lit(f"{targets}/" if targets else ""), F.col("file_name")).alias("target_name"), "image_id", "segments_info")
    if mapping is None:
        return out.withColumnRenamed("segments_info", "segments")
    # the mapping is a dimension: one row a category
    table = {r["from_id"]: (r["to_id"], bool(r["is_thing"])) for r in mapping.collect()}
    pick = F.create_map(*(x for k, (v, thing) in sorted(table.items()) for x in (F.lit(k), F.struct(F.lit(v).cast("long").alias("to"), F.lit(thing).alias("thing")))))
    moved = F.transform("segments_info", lambda s: s.withField("category_id", pick[s["category_id"]]["to"]).withField("isthing", pick[s["category_id"]]["thing"]))
    return out.withColumn("segments", moved).drop("segments_info")


VIDEOS = """videos array<struct<id: bigint, file_names: array<string>, width: int, height: int, length: int>>,
annotations array<struct<id: bigint, video_id: bigint, category_id: bigint, iscrowd: int, bboxes: array<array<double>>, segmentations: array<array<array<double>>>>>,
categories array<struct<id: bigint, name: string>>"""


@loader("Videos")
def video_objects(spark: SparkSession, file: str, root: str = "") -> DataFrame:
    """video_id, frame, file_name, width, height and, for every object seen in the frame, id, category (numbered from 0 in order of
    category ids), name, iscrowd, box and polygons; a frame without objects has one row of nulls. An object isn't seen in a frame
    without a box or polygons there; polygons of an odd length or fewer than three points are left out, and objects without any."""
    doc = spark.read.option("multiLine", True).schema(VIDEOS).json(file)
    frames = doc.select(F.explode("videos").alias("v")).select(F.col("v.id").alias("video_id"), "v.width", "v.height", F.posexplode("v.file_names").alias("frame", "file_name"), F.col("v.length").alias("__n")).where("frame < __n").drop("__n")
    frames = frames.withColumn("file_name", F.concat(F.lit(f"{root}/" if root else ""), "file_name"))
    kinds = doc.select(F.posexplode(F.array_sort("categories")).alias("category", "c")).select("category", F.col("c.id").alias("category_id"), F.col("c.name").alias("name"))
    notes = doc.select(F.explode("annotations").alias("a")).select("a.*")
    seen = notes.select("id", "video_id", "category_id", "iscrowd", F.posexplode(F.arrays_zip("bboxes", "segmentations")).alias("frame", "z"))
    seen = seen.where("z.bboxes is not null and size(z.bboxes) > 0 and z.segmentations is not null")
    seen = seen.select("id", "video_id", "frame", "category_id", "iscrowd", F.col("z.bboxes").alias("box"), F.filter("z.segmentations", lambda p: (F.size(p) % 2 == 0) & (F.size(p) >= 6)).alias("polygons")).where("size(polygons) > 0")
    return frames.join(seen.join(F.broadcast(kinds), "category_id").drop("category_id"), ["video_id", "frame"], "left")


def write_features(features: DataFrame, path: str) -> None:
    """Feature rows (any keys, and arrays of numbers) as Parquet with arrays of floats."""
    arrays = [f.name for f in features.schema if f.dataType.simpleString().startswith("array<")]
    features.withColumns({a: F.col(a).cast("array<float>") for a in arrays}).write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
