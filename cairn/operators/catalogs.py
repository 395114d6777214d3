"""Small relational steps around datasets: chains, subsets, labels, ids, reductions, reports."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import regressions


def unknown_ids(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys of rows that aren't known: empty if rows are about known things only."""
    return rows.select(key).distinct().join(known.select(key), key, "left_anti")


def chained(parts: dict[str, DataFrame], name: str = "dataset") -> DataFrame:
    """Rows of all named parts, by column name, with the part's name; an error if one of them is empty."""
    for part, rows in parts.items():
        if not rows.take(1):
            raise ValueError(f"{part} is empty")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (rows.withColumn(name, F.lit(part)) for part, rows in parts.items()))


def dense_ids(rows: DataFrame, by: str, identity: str, name: str = "dense") -> DataFrame:
    """Distinct identities of each clip, numbered from 0 in order. A clip has few."""
    one = rows.where(F.col(identity).isNotNull()).select(by, identity).distinct()
    return one.withColumn(name, (F.row_number().over(W.partitionBy(by).orderBy(identity)) - 1).cast("long"))


def targets(entries: DataFrame, hidden: str = "test", split: str = "split", label: str = "class_index") -> DataFrame:
    """entries with ``target``: their class, null in the hidden split."""
    return entries.withColumn("target", F.when(F.col(split) != hidden, F.col(label)))


def subset(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the chosen ones."""
    return rows.join(chosen.select(key).distinct(), key, "left_semi")


def zero_reduced(label: Column) -> Column:
    """Labels moved down by one, with 0 (and 255) as 255, the one that doesn't count."""
    return F.when((label == 0) | (label == 255), F.lit(255)).otherwise(label - 1)


def wrapped(label: Column) -> Column:
    """A label less one, as an unsigned byte: 0 becomes 255."""
    return F.pmod(label - 1, F.lit(256))


def inside(rows: DataFrame, top: int, bottom: int, left: int, right: int, y: str = "y", x: str = "x") -> DataFrame:
    """Pixels of a fixed rectangle; the far edges are outside."""
    return rows.where((F.col(y) >= top) & (F.col(y) < bottom) & (F.col(x) >= left) & (F.col(x) < right))


def colour_id(r: Column, g: Column, b: Column) -> Column:
    return r + 256 * g + 65536 * b


def channel(value: Column) -> Column:
    """A colour's part between 0 and 1 as a byte: rounded half to even and held within 0 and 255."""
    return F.least(F.greatest(F.rint(value * 255), F.lit(0.0)), F.lit(255.0)).cast("int")


def mapped_segments(pixels: DataFrame, segments: DataFrame, default: int = 255) -> DataFrame:
    """Pixels (image, y, x, r, g, b) with the category of the segment that their colour stands for, or the default."""
    own = pixels.withColumn("__id", colour_id(*(F.col(c).cast("long") for c in "rgb")))
    known = segments.select(F.col("image").alias("__i"), F.col("segment").cast("long").alias("__s"), F.col("category").alias("__c"))
    return own.join(known, (F.col("image") == F.col("__i")) & (F.col("__id") == F.col("__s")), "left").select("image", "y", "x", F.coalesce("__c", F.lit(default)).alias("category"))


def painted(rows: DataFrame, palette: DataFrame, default: tuple[int, int, int] = (0, 0, 0), label: str = "label") -> DataFrame:
    """rows with the colour of their label (palette: class_id, r, g, b), or the default."""
    known = palette.select(F.col("class_id").alias("__k"), *(F.col(c).alias(f"__{c}") for c in "rgb"))
    return rows.join(known, F.col(label) == F.col("__k"), "left").drop("__k").select(*rows.columns, *(F.coalesce(f"__{c}", F.lit(d)).alias(c) for c, d in zip("rgb", default, strict=True)))


def image_parts(path: Column) -> tuple[Column, Column]:
    """Class and number of an image named ``<class>/<class>_<number>.<suffix>``; null for other names."""
    name = F.regexp_extract(path, r"([^/]+)_([0-9]+)\.[^./]+$", 1)
    return F.nullif(name, F.lit("")), F.regexp_extract(path, r"_([0-9]+)\.[^./]+$", 1).try_cast("long")


def image_path(split: Column, class_id: Column, number: Column, suffix: str = "JPEG") -> Column:
    """Where an image lies: a class folder when training, a name with eight digits elsewhere."""
    return F.when(split == "train", F.concat(class_id, F.lit("/"), class_id, F.lit("_"), number.cast("string"), F.lit(f".{suffix}"))).otherwise(F.concat(F.lit("ILSVRC2012_"), split, F.lit("_"), F.lpad(number.cast("string"), 8, "0"), F.lit(f".{suffix}")))


def reduced(values: DataFrame, average: bool = True, name: str = "name", value: str = "value") -> DataFrame:
    """Named numbers of several workers as one: their means or sums."""
    return values.groupBy(name).agg((F.avg(value) if average else F.sum(value)).alias(value))


def class_names(entries: DataFrame, index: str = "class_index", order: str = "id", fields: tuple[str, ...] = ("class_id", "class_name")) -> DataFrame:
    """The classes that entries are of: each index with the fields of its last entry."""
    return entries.groupBy(index).agg(*(F.max_by(f, order).alias(f) for f in fields))


def class_members(rows: DataFrame, labels: str = "labels", index: str = "index") -> DataFrame:
    """label and index, a row for each label that a row has (rows of several labels come several times)."""
    return rows.select(F.explode(labels).alias("label"), index)


def best_queries(scores: DataFrame, k: int, classes: int, image: str = "image", place: str = "place", score: str = "score") -> DataFrame:
    """The k best (query, class) of each image. Scores come flat: place is query * classes + class; ties to the smaller place."""
    order = W.partitionBy(image).orderBy(F.col(score).desc(), place)
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(image, "rank", F.floor(F.col(place) / classes).alias("query"), (F.col(place) % classes).alias("class"), score)


def largest_shares(counts: DataFrame, k: int, name: str = "category", n: str = "n") -> DataFrame:
    """The k names with the largest shares of all, largest first; those without any are left out."""
    total = counts.agg(F.sum(n).alias("__all"))
    return counts.join(F.broadcast(total)).where(F.col(n) > 0).select(name, n, (F.col(n) / F.col("__all")).alias("share")).orderBy(F.col(n).desc(), name).limit(k)


def instance_labels(pixels: DataFrame, things: DataFrame) -> DataFrame:
    """Pixels (frame, y, x, label, instance) with the label of their instance: what most of its labelled pixels (0 or more) say, ties
    to the smaller, if that is a thing (label); else, and for pixels of no instance, their own."""
    counts = pixels.where((F.col("label") >= 0) & F.col("instance").isNotNull()).groupBy("frame", "instance", "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("frame", "instance").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("__l"))
    named = most.join(F.broadcast(things.select(F.col("label").alias("__l")).distinct()), "__l", "left_semi")
    return pixels.join(named, ["frame", "instance"], "left").select(*(F.coalesce("__l", "label").alias("label") if c == "label" else F.col(c) for c in pixels.columns))


def window_report(rows: DataFrame, every: int, order: str = "iteration", values: tuple[str, ...] = ("loss",)) -> DataFrame:
    """Median, mean and largest of each measure over every so many iterations."""
    slot = F.floor(F.col(order) / every)
    return rows.groupBy(slot.alias("window")).agg(F.count("*").alias("n"), *(c for v in values for c in (F.percentile(v, F.lit(0.5)).alias(f"{v}_median"), F.avg(v).alias(f"{v}_mean"), F.max(v).alias(f"{v}_max"))))


def hull(points: DataFrame, by: str, parts: int = 32, key: str = "pid") -> DataFrame:
    """by, place, x, y: the corners of the convex hull of each group in the plane, anticlockwise from the leftmost (then lowest). Parts
    of a group give out their own hulls first, so that only corners meet."""
    kind = points.schema[by].dataType.simpleString()

    def corners(pdf: pd.DataFrame) -> np.ndarray:
        p = np.unique(pdf[["x", "y"]].to_numpy(np.float64), axis=0)
        if len(p) < 3:
            return p
        chains = []
        for order in (p, p[::-1]):
            chain: list = []
            for q in order:
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (q[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (q[0] - chain[-2][0]) <= 0:
                    chain.pop()
                chain.append(q)
            chains.append(chain[:-1])
        return np.array(chains[0] + chains[1])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = corners(pdf)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(c), "place": np.arange(len(c)), "x": c[:, 0], "y": c[:, 1]})

    schema = f"{by} {kind}, place long, x double, y double"
    dealt = points.select(by, "x", "y").dropna().withColumn("__part", F.pmod(F.xxhash64("x", "y"), F.lit(parts)))
    return dealt.groupBy(by, "__part").applyInPandas(run, schema).groupBy(by).applyInPandas(run, schema)


def oriented_boxes(points: DataFrame, by: str) -> DataFrame:
    """by, centre (cx, cy, cz), extents (d0 >= d1 >= d2) along the principal axes, and the axes (a00 ... a22) of each group."""
    kind = points.schema[by].dataType.simpleString()
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    c = points.groupBy(by).agg(*(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs))

    def run(frames):
        for pdf in frames:
            m = np.zeros((len(pdf), 3, 3))
            for i, a in enumerate("xyz"):
                for j, b in enumerate("xyz"):
                    m[:, i, j] = pdf[f"c{min(a, b)}{max(a, b)}"]
            v = np.linalg.eigh(m)[1][:, :, ::-1].transpose(0, 2, 1) if len(pdf) else np.zeros((0, 3, 3))
            # the largest part of an axis is positive
            at = np.abs(v).argmax(axis=2)
            v = v * np.sign(np.take_along_axis(v, at[:, :, None], 2))
            yield pd.DataFrame({by: pdf[by]} | {f"a{i}{j}": v[:, i, j] for i in range(3) for j in range(3)})

    axes = c.mapInPandas(run, f"{by} {kind}, " + ", ".join(f"a{i}{j} double" for i in range(3) for j in range(3)))
    along = [F.col(f"a{i}0") * F.col("x") + F.col(f"a{i}1") * F.col("y") + F.col(f"a{i}2") * F.col("z") for i in range(3)]
    box = points.join(axes, by).groupBy(by, *(f"a{i}{j}" for i in range(3) for j in range(3))).agg(*(f(v).alias(f"{n}{i}") for i, v in enumerate(along) for f, n in ((F.min, "lo"), (F.max, "hi"))))
    middle = [(F.col(f"lo{i}") + F.col(f"hi{i}")) / 2 for i in range(3)]
    centre = [sum((middle[i] * F.col(f"a{i}{j}") for i in range(1, 3)), middle[0] * F.col(f"a0{j}")) for j in range(3)]
    return box.select(by, *(m.alias(f"c{a}") for a, m in zip("xyz", centre, strict=True)), *((F.col(f"hi{i}") - F.col(f"lo{i}")).alias(f"d{i}") for i in range(3)), *(f"a{i}{j}" for i in range(3) for j in range(3)))


def swept(train: DataFrame, test: DataFrame, strengths: tuple[float, ...], features: str = "embedding", label: str = "label", rounds: int = 100) -> DataFrame:
    """strength, accuracy: logistic regressions fitted at once for all inverse strengths of regularisation and judged on the test
    rows in one pass; the first of the best is ``metrics.best_of``'s."""
    models = regressions.fitted(train, strengths, features, label, rounds)
    told = regressions.predicted(models, test.select(F.col(label).alias("truth"), features), features, ("truth",))
    return told.groupBy("strength").agg(F.avg((F.col("prediction") == F.col("truth")).cast("double")).alias("accuracy"))
