"""Evaluations by name: each takes tables and gives one table of scores. States of partial evaluations can be merged."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import knn, metrics
from cairn.operators.annotations import run_area, run_iou

EVALUATORS: dict[str, Callable[..., DataFrame]] = {}


def evaluator(name: str):
    """Registers an evaluation under a name."""

    def keep(f: Callable[..., DataFrame]):
        EVALUATORS[name] = f
        return f

    return keep


def evaluated(name: str, *tables: DataFrame, **options) -> DataFrame:
    if name not in EVALUATORS:
        raise ValueError(f"no evaluation {name}; there are {', '.join(sorted(EVALUATORS))}")
    return EVALUATORS[name](*tables, **options)


def merged_counts(*states: DataFrame) -> DataFrame:
    """Confusion tables (gt, pred, n) of several parts as one."""
    return reduce(DataFrame.unionByName, states).groupBy("gt", "pred").agg(F.sum("n").cast("long").alias("n"))


@evaluator("segmentation")
def segmentation(pairs: DataFrame, ignore: int | None = None) -> DataFrame:
    """Accuracy and mean scores of pairs of pixels (gt, pred)."""
    return metrics.mean_scores(metrics.class_areas(metrics.confusion(pairs, ignore=ignore)))


@evaluator("panoptic")
def panoptic(segments: DataFrame) -> DataFrame:
    return metrics.panoptic(segments)


@evaluator("depth")
def depth(pairs: DataFrame, by: str = "scene", aligned: bool = False) -> DataFrame:
    """Errors of each group, after a fit of scale and shift if ``aligned``."""
    if aligned:
        fit = metrics.alignment(pairs, by)
        pairs = pairs.join(fit, by).withColumn("pred", F.col("pred") * F.col("scale") + F.col("shift")).drop("scale", "shift")
    return metrics.depth_errors(pairs, by)


@evaluator("classification")
def classification(scores: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    return metrics.top_k_hits(scores, ks)


@evaluator("neighbours")
def neighbours(queries: DataFrame, base: DataFrame, ks: tuple[int, ...] = (10, 20)) -> DataFrame:
    """k and accuracy of labels voted for by nearest neighbours (vec_id, embedding, label on both sides)."""
    voted = knn.vote(knn.top_k(queries, base, max(ks), extra=("label",)), ks)
    truth = queries.select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth"))
    return voted.join(truth, "query_id").groupBy("k").agg(F.avg((F.col("predicted") == F.col("truth")).cast("double")).alias("accuracy"))


def over_time(masks: DataFrame, pixels: int) -> DataFrame:
    """Masks of frames (video, category, id, frame, runs) as one mask of the video each: runs of later frames start further on."""
    moved = F.transform("runs", lambda r: F.struct((r["start"] + F.col("frame") * pixels).alias("start"), r["len"].alias("len")))
    return masks.withColumn("runs", moved).groupBy("video", "category", "id").agg(F.flatten(F.collect_list("runs")).alias("runs"))


@evaluator("video")
def video(detections: DataFrame, truths: DataFrame, scores: DataFrame, pixels: int, crowds: DataFrame | None = None, frames: int = 1, **options) -> DataFrame:
    """ap, ar and the rest of ``metrics.summarised`` for masks of videos. detections and truths: video, category, id, frame, runs; scores:
    video, category, id, score; crowds: video, category, id. Sizes are mean pixels over ``frames`` frames."""
    found, known = over_time(detections, pixels), over_time(truths, pixels)
    pairs = run_iou(found, known, ("video", "category")).select("video", "category", F.col("left").alias("id"), F.col("right").alias("truth"), "iou")
    size = (run_area(F.col("runs")) / frames).cast("double").alias("size")
    dets = found.select("video", "category", "id", size).join(scores, ["video", "category", "id"])
    own = known.select("video", "category", F.col("id").alias("truth"), size)
    if crowds is None:
        own = own.withColumn("crowd", F.lit(0))
    else:
        marked = crowds.select("video", "category", F.col("id").alias("truth"), F.lit(1).alias("crowd")).distinct()
        own = own.join(marked, ["video", "category", "truth"], "left").fillna(0, ["crowd"])
    return metrics.summarised(metrics.detection_grid(pairs, dets, own, **options))


def last_written(rows: DataFrame, index: str, order: str) -> DataFrame:
    """One row for each index: that written last."""
    rest = [c for c in rows.columns if c != index]
    return rows.groupBy(index).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(index, *(f"__r.{c}" for c in rest))


def first_found(rows: DataFrame, candidates: list[DataFrame], key: str, value: str) -> DataFrame:
    """rows with ``value`` from the first of the candidate tables (key, value: one row a key) that has their key."""
    out = rows
    for i, c in enumerate(candidates):
        out = out.join(c.select(F.col(key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}")), F.col(key) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    return out.withColumn(value, F.coalesce(*(F.col(f"__v{i}") for i in range(len(candidates))))).drop(*(f"__v{i}" for i in range(len(candidates))))


def by_stem(path: str) -> list[Column]:
    """How files are put in order: by the number that their stem is, those that aren't one last, by name."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    return [stem.try_cast("double").asc_nulls_last(), stem]


def merged_reports(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two reports side by side: every key of either, the other's columns null where it is missing."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    if shared:
        raise ValueError(f"both reports have {', '.join(shared)}")
    return left.join(right, key, "full")


def other_colours(points: DataFrame, palette: DataFrame, tolerance: int, k: int = 20) -> DataFrame:
    """The k most frequent colours that no category's is near, with their share of all such points: a report."""
    from cairn.operators.colour import without

    rest = without(points, palette, tolerance).groupBy("r", "g", "b").agg(F.count("*").alias("n"))
    total = rest.agg(F.sum("n").alias("__all"))
    return rest.join(F.broadcast(total)).select("r", "g", "b", "n", (F.col("n") / F.col("__all")).alias("share")).orderBy(F.col("n").desc(), "r", "g", "b").limit(k)
