"""Deterministic sampling, sharding and batching by hashes of ids, so that every run and every engine draws the same rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffle_key(seed: int, key: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def per_class(rows: DataFrame, n: int, label: str, key: str, seed: int = 0) -> DataFrame:
    """n rows of each class; rank limits are applied before the shuffle."""
    order = W.partitionBy(label).orderBy(shuffle_key(seed, key), key)
    return rows.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= n).drop("__place")


def share_per_class(rows: DataFrame, share: float, label: str, key: str, seed: int = 0) -> DataFrame:
    """max(1, floor(share * size)) rows of each class."""
    sizes = rows.groupBy(label).agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("__n")).withColumnRenamed(label, "__l")
    return placed(rows, key, seed, by=label).join(sizes, F.col(label).eqNullSafe(F.col("__l"))).where(F.col("place") < F.col("__n")).drop("place", "__n", "__l")


def split(rows: DataFrame, label: str, key: str, share: float, seed: int = 0) -> DataFrame:
    """Every row with ``part``: train or val. ``share`` of each class is val, rounded down; classes of one row stay in train."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("__n")).withColumnRenamed(label, "__l")
    own = placed(rows, key, seed, by=label).join(sizes, F.col(label).eqNullSafe(F.col("__l")))
    val = (F.col("place") < F.floor(F.col("__n") * share)) & (F.col("__n") > 1)
    return own.withColumn("part", F.when(val, "val").otherwise("train")).drop("place", "__n", "__l")


def placed(rows: DataFrame, key: str, seed: int, buckets: int = 256, by: str | None = None) -> DataFrame:
    """rows with ``place``, from 0, in the order of a seeded hash (of each class, with ``by``). Places are counted within buckets
    of the hash and added to the sizes of the class's buckets before, so no task sees all rows of a class."""
    h = shuffle_key(seed, key)
    own = rows.withColumn("__c", F.lit(0) if by is None else F.col(by)).withColumn("__h", h).withColumn("__b", (F.conv(F.substring("__h", 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int"))
    sizes = own.groupBy("__c", "__b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("__c").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("__c").alias("__sc"), F.col("__b").alias("__sb"), before.alias("__before"))
    inside = F.row_number().over(W.partitionBy("__c", "__b").orderBy("__h", key)) - 1
    out = own.withColumn("__in", inside).join(F.broadcast(sizes) if by is None else sizes, F.col("__c").eqNullSafe(F.col("__sc")) & (F.col("__b") == F.col("__sb")))
    return out.withColumn("place", F.col("__before") + F.col("__in")).drop("__c", "__h", "__b", "__in", "__before", "__sc", "__sb")


def epoch_shard(rows: DataFrame, key: str, seed: int, start: int, step: int) -> DataFrame:
    """The rows of one of ``step`` workers in an epoch's order: places start, start + step, ..."""
    return placed(rows, key, seed).where(F.pmod("place", F.lit(step)) == start)


def even_shards(rows: DataFrame, key: str, seed: int, step: int) -> DataFrame:
    """Every row with its shard and place there, reshuffled by shard; the remainder that would make shards uneven is dropped."""
    out = placed(rows, key, seed)
    n = out.agg(F.count("*").alias("all"))
    kept = out.join(F.broadcast(n)).where(F.col("place") < F.floor(F.col("all") / step) * step).withColumn("shard", F.pmod("place", F.lit(step)).cast("long"))
    again = F.md5(F.concat(F.lit(f"{seed}:"), F.col("shard").cast("string"), F.lit(":"), F.col(key).cast("string")))
    return kept.withColumn("slot", F.row_number().over(W.partitionBy("shard").orderBy(again, key)).cast("long") - 1).drop("place", "all")


def batches(rows: DataFrame, key: str, seed: int, size: int, drop_last: bool = True) -> DataFrame:
    """Every row with its batch number; a last batch that isn't full goes if drop_last."""
    out = placed(rows, key, seed).withColumn("batch", F.floor(F.col("place") / size))
    if drop_last:
        n = out.agg(F.count("*").alias("all"))
        out = out.join(F.broadcast(n)).where(F.col("batch") < F.floor(F.col("all") / size)).drop("all")
    return out.drop("place")


def clip_frames(frames: DataFrame, reach: int, n: int, seed: int, video: str = "video_id", frame: str = "frame") -> DataFrame:
    """For each video a reference frame and n frames within ``reach`` of it (with replacement), in order: video, slot, frame. Which
    ones is decided by hashes of the video and the slot; a video's length is all that is read of it."""
    length = frames.groupBy(video).agg(F.max(frame).alias("__last"))
    draw = lambda what, size: (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(video).cast("string"), F.lit(":"), what)), 1, 8), 16, 10).cast("long") % size)
    ref = draw(F.lit("ref"), F.col("__last") + 1)
    one = length.withColumn("__ref", ref).withColumn("__lo", F.greatest(F.lit(0), F.col("__ref") - reach)).withColumn("__hi", F.least(F.col("__last"), F.col("__ref") + reach))
    slots = one.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    picked = slots.withColumn(frame, F.when(F.col("__s") == 0, F.col("__ref")).otherwise(F.col("__lo") + draw(F.col("__s").cast("string"), F.col("__hi") - F.col("__lo") + 1)))
    order = W.partitionBy(video).orderBy(frame, "__s")
    return picked.select(video, (F.row_number().over(order) - 1).alias("slot"), frame)


def mixed(sources: list[tuple[DataFrame, float]], key: str, seed: int) -> DataFrame:
    """Rows of several sources in one order, drawn by their weights until one source is used up: source, place.

    Row i of a source comes at i / weight (plus a hash below one step), so up to any place the sources stand in proportion to
    their weights; what comes after the first source's end is dropped."""
    out, ends = None, []
    for i, (rows, weight) in enumerate(sources):
        own = placed(rows.select(key), key, seed + i)
        part = own.select(F.lit(i).alias("source"), key, ((F.col("place") + F.conv(F.substring(shuffle_key(seed + i, key), 1, 8), 16, 10).cast("double") / 4294967296) / weight).alias("at"))
        ends.append(part.agg(F.max("at")).first()[0] or 0.0)
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("at") <= min(ends))


def endless(rows: DataFrame, key: str, seed: int, start: int, step: int, passes: int, advance: int = 0) -> DataFrame:
    """What one of ``step`` workers sees of ``passes`` passes, each in an order of its own: rows with ``pass`` and ``at`` (its place in
    what the worker sees, from 0). The first ``advance`` rows are left out."""
    out, before = None, 0
    n = rows.count()
    for p in range(passes):
        # a pass goes on with the stride where the last one ended
        first = (start - before) % step
        own = placed(rows, key, seed + p).where((F.pmod("place", F.lit(step)) == first))
        seen = (before + first - start) // step
        part = own.select(*rows.columns, F.lit(p).alias("pass"), (F.floor((F.col("place") - first) / step) + seen).alias("at"))
        out = part if out is None else out.unionByName(part)
        before += n
    return out.where(F.col("at") >= advance)


def enumerated(rows: DataFrame, key: str, replicas: int) -> DataFrame:
    """rows with ``index`` in order of the key, filled up with rows of nulls and index -1 to a multiple of ``replicas``."""
    from cairn.operators.running import running

    own = running(rows.withColumn("__one", F.lit(0)), ["__one"], [F.col(key)], {"index": F.lit(1).cast("long")}).drop("__one").withColumn("index", F.col("index") - 1)
    missing = -rows.count() % replicas
    fill = rows.sparkSession.range(missing).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema), F.lit(-1).cast("long").alias("index"))
    return own.unionByName(fill)


def batch_plan(total: int, workers: int, rows: int | None = None) -> dict[str, int]:
    """Rows of a worker's batch, and how many full batches some rows make; the total must divide evenly."""
    if workers < 1 or total < 1 or total % workers:
        raise ValueError(f"{total} rows don't divide among {workers} workers")
    return {"per_worker": total // workers, "batches": 0 if rows is None else rows // total}


def block_masks(images: DataFrame, height: int, width: int, share: float, seed: int, key: str = "id", aspect: tuple[float, float] = (0.3, 1 / 0.3), least: int = 4, count: str | None = None) -> DataFrame:
    """key, y, x of the masked cells of a grid: rectangles of random places, sizes and shapes (fixed by the seed and the image's
    key) until exactly round(share * height * width) cells are masked, or as many as the column ``count`` says (all at most); the last
    rectangle's surplus is left out."""
    same = round(share * height * width)
    kind = images.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            ids, ys, xs = [], [], []
            for k, wanted in zip(pdf[key], pdf["__wanted"], strict=True):
                draw = np.random.default_rng([seed, *str(k).encode()])
                mask = np.zeros((height, width), bool)
                tries = 0
                while mask.sum() < wanted:
                    left = wanted - int(mask.sum())
                    area = draw.uniform(min(least, left), max(least, left))
                    ratio = math.exp(draw.uniform(*map(math.log, aspect)))
                    h, w = min(height, max(1, round((area * ratio) ** 0.5))), min(width, max(1, round((area / ratio) ** 0.5)))
                    y, x = draw.integers(0, height - h + 1), draw.integers(0, width - w + 1)
                    fresh = np.argwhere(~mask[y : y + h, x : x + w])[:left] + [y, x]
                    tries += 1
                    if tries > 50:  # what is left is scattered
                        fresh = draw.permutation(np.argwhere(~mask))[:left]
                    mask[fresh[:, 0], fresh[:, 1]] = True
                at = np.argwhere(mask)
                ids += [k] * len(at)
                ys += at[:, 0].tolist()
                xs += at[:, 1].tolist()
            yield pd.DataFrame({key: ids, "y": ys, "x": xs}).astype({"y": "int32", "x": "int32"})

    number = F.lit(same) if count is None else F.least(F.coalesce(F.col(count).cast("int"), F.lit(0)), F.lit(height * width))
    return images.select(key, number.alias("__wanted")).mapInPandas(run, f"{key} {kind}, y int, x int")
