"""Batches put together as tables: which sample is in which batch, what is masked of it, what a part of a batch holds.

Numbers come from ranges (``running``), so no task sees a whole epoch or a whole bucket; what is done within a batch groups by batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators.running import running
from cairn.operators.sampling import block_masks


def _drawn(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def shuffled(samples: DataFrame, size: int, seed: int = 0, key: str = "id", bucket: Column | None = None, whole: bool = False) -> DataFrame:
    """samples with batch and slot, in an order that the seed and the key fix. With a ``bucket`` only samples of the same bucket share a batch, and
    ``bucket`` is a column of the result; ``whole`` leaves out batches that aren't full. Null keys go; repeated keys are samples of their own."""
    rows = samples.where(F.col(key).isNotNull()).withColumn("__h", _drawn(seed, key)).withColumn("bucket", F.lit(0) if bucket is None else bucket)
    at = running(rows, ["bucket"], [F.col("__h"), F.col(key)], {"__i": F.lit(1).cast("long")}).withColumn("__i", F.col("__i") - 1)
    out = at.withColumn("batch", F.floor(F.col("__i") / size)).withColumn("slot", (F.col("__i") % size).cast("int")).drop("__i", "__h")
    if whole:
        full = out.groupBy("bucket", "batch").agg(F.count("*").alias("__n")).where(F.col("__n") == size).select("bucket", "batch")
        out = out.join(full, ["bucket", "batch"], "left_semi")
    return out.drop("bucket") if bucket is None else out


def by_aspect(images: DataFrame, size: int, seed: int = 0, key: str = "id") -> DataFrame:
    """Images (with width and height) in batches of upright or of wide ones only, full ones only: bucket is 0 where the width is larger."""
    return shuffled(images, size, seed, key, F.when(F.col("width") > F.col("height"), 0).otherwise(1), whole=True)


def mask_sizes(samples: DataFrame, tokens: int, ratios: tuple[float, float], probability: float, seed: int = 0, key: str = "id") -> DataFrame:
    """samples (with batch, slot) and ``masked``, how many tokens of each are masked.

    int(batch's samples * probability) of a batch's samples are masked, one for each step of the ratios, which are spread evenly from the first to the
    last: the n-th has int(tokens * ratio at the end of its step). Which sample has which is drawn, so a batch's total depends on its size alone.
    """
    low, high = ratios
    place = F.row_number().over(W.partitionBy("batch").orderBy(_drawn(seed, "batch", key), key, "slot"))
    sized = samples.withColumn("__p", place).withColumn("__k", F.floor(F.count("*").over(W.partitionBy("batch")) * F.lit(probability)))
    ratio = F.lit(low) + (F.lit(high) - F.lit(low)) * F.col("__p") / F.col("__k")
    return sized.withColumn("masked", F.when(F.col("__p") <= F.col("__k"), F.floor(F.lit(tokens) * ratio)).otherwise(0).cast("int")).drop("__p", "__k")


def masked_cells(sized: DataFrame, height: int, width: int, seed: int, key: str = "id") -> DataFrame:
    """batch, slot, key, cells: the numbers of the masked cells of each sample's grid, as blocks, exactly ``masked`` of them."""
    one = F.concat_ws(":", F.col("batch").cast("string"), F.col("slot").cast("string"))
    named = sized.withColumn("__s", one)
    at = block_masks(named, height, width, 0.0, seed, "__s", count="masked")
    cells = at.groupBy("__s").agg(F.sort_array(F.collect_list(F.col("y") * width + F.col("x"))).alias("cells"))
    return named.join(cells, "__s", "left").select("batch", "slot", key, F.coalesce("cells", F.array().cast("array<int>")).alias("cells"))


def collated(masks: DataFrame, tokens: int, fill: int = -1) -> DataFrame:
    """masks (batch, slot, cells) with ``padded`` (cells filled up to the batch's most), ``places`` (cells counted through the batch's samples) and ``weight`` (of
    each masked cell, one over the sample's number of them)."""
    most = masks.groupBy("batch").agg(F.max(F.size("cells")).alias("__most"))
    out = masks.join(most, "batch")
    padded = F.concat("cells", F.array_repeat(F.lit(fill), (F.col("__most") - F.size("cells")).cast("int")))
    places = F.transform("cells", lambda c: c.cast("long") + F.col("slot") * tokens)
    return out.withColumn("padded", padded).withColumn("places", places).withColumn("weight", 1.0 / F.greatest(F.size("cells"), F.lit(1))).drop("__most")


def part_of(batch: DataFrame, size: int, divide_by: int, keep: Sequence[str] = ()) -> DataFrame:
    """The rows of the first of ``divide_by`` parts of each batch of ``size`` samples; a part is rounded up."""
    return batch.where(F.col("slot") < -(-size // divide_by)).select(*(keep or batch.columns))
