"""Quality measures, each a grouping over pairs of truth and prediction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.storage import saved
from cairn.operators.matching import detections_matched
from cairn.operators.running import running, running_ahead


def confusion(pairs: DataFrame, truth: str = "gt", predicted: str = "pred", ignore: int | None = None) -> DataFrame:
    """Counts of (gt, pred); rows with a null or ignored truth or a null prediction don't count."""
    kept = pairs.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    if ignore is not None:
        kept = kept.where(F.col(truth) != ignore)
    return kept.groupBy(F.col(truth).alias("gt"), F.col(predicted).alias("pred")).agg(F.count("*").alias("n"))


def class_areas(counts: DataFrame) -> DataFrame:
    """For each class: intersection, area in the truth, area in the prediction, union; from a confusion table."""
    one = counts.select(F.explode(F.array(F.struct(F.col("gt").alias("c"), F.col("n").alias("label"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("both")), F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("label"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("both")))).alias("e"))
    out = one.groupBy(F.col("e.c").alias("c")).agg(F.sum("e.label").alias("label"), F.sum("e.predicted").alias("predicted"), F.sum("e.both").alias("both"))
    return out.withColumn("union", F.col("label") + F.col("predicted") - F.col("both"))


def class_scores(areas: DataFrame, beta: float = 1.0) -> DataFrame:
    """IoU, accuracy, dice, precision, recall and F of each class; null where undefined."""
    precision, recall = F.try_divide(F.col("both"), F.col("predicted")), F.try_divide(F.col("both"), F.col("label"))
    f = F.try_divide((1 + beta * beta) * precision * recall, beta * beta * precision + recall)
    return areas.select("c", F.try_divide(F.col("both"), F.col("union")).alias("iou"), recall.alias("recall"), F.try_divide(2 * F.col("both"), F.col("label") + F.col("predicted")).alias("dice"), precision.alias("precision"), f.alias("f"))


def mean_scores(areas: DataFrame) -> DataFrame:
    """One row: accuracy, mean IoU, mean accuracy and frequency-weighted IoU; undefined classes are left out of means."""
    iou, recall = F.try_divide(F.col("both"), F.col("union")), F.try_divide(F.col("both"), F.col("label"))
    return areas.agg(F.try_divide(F.sum("both"), F.sum("label")).alias("accuracy"), F.avg(iou).alias("miou"), F.avg(recall).alias("macc"), F.try_divide(F.sum(F.col("label") * iou), F.sum("label")).alias("fwiou"), F.count_if(F.col("union") > 0).alias("classes"))


def panoptic(segments: DataFrame, truth: str = "gt", predicted: str = "pred") -> DataFrame:
    """Panoptic, segmentation and recognition quality of each class. segments: image, gt, pred (class of each pixel or item, one
    segment a class and image), null for void. A pair matches if its IoU is over a half with void taken from the union; a
    prediction that is void by more than half is no false positive."""
    n = segments.groupBy("image", F.col(truth).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    gt = n.where("g is not null").groupBy("image", F.col("g").alias("c")).agg(F.sum("n").alias("ng"))
    pd = n.where("p is not null").groupBy("image", F.col("p").alias("c")).agg(F.sum("n").alias("np"), F.sum(F.when(F.col("g").isNull(), F.col("n")).otherwise(0)).alias("void"))
    both = n.where("g = p").select("image", F.col("g").alias("c"), F.col("n").alias("both"))
    each = gt.join(pd, ["image", "c"], "full").join(both, ["image", "c"], "left").fillna(0, ["ng", "np", "void", "both"])
    iou = F.try_divide(F.col("both"), F.col("ng") + F.col("np") - F.col("both") - F.col("void"))
    hit = F.coalesce(iou > 0.5, F.lit(False))
    sums = each.groupBy("c").agg(
        F.sum(F.when(hit, iou).otherwise(0.0)).alias("iou"), F.count_if(hit).alias("tp"), F.count_if(~hit & (F.col("ng") > 0)).alias("fn"),
        F.count_if(~hit & (F.col("np") > 0) & (F.col("void") * 2 <= F.col("np"))).alias("fp"),
    )
    rq = F.try_divide(F.col("tp"), F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn"))
    sq = F.coalesce(F.try_divide(F.col("iou"), F.col("tp")), F.lit(0.0))
    return sums.select("c", "tp", "fp", "fn", sq.alias("sq"), rq.alias("rq"), (sq * rq).alias("pq"))


def depth_errors(pairs: DataFrame, by: str, truth: str = "gt", predicted: str = "pred", low: float = 1e-3, high: float = 1e9) -> DataFrame:
    """Ten error measures of each group: shares within 1.25, 1.25^2, 1.25^3, abs_rel, sq_rel, rmse, rmse_log, silog, log10, mae.
    Predictions are held within low and high; only truths within count."""
    kept = pairs.where((F.col(truth) > low) & (F.col(truth) < high)).withColumn("p", F.least(F.greatest(F.col(predicted), F.lit(low)), F.lit(high))).withColumn("g", F.col(truth))
    worse = F.greatest(F.col("g") / F.col("p"), F.col("p") / F.col("g"))
    d, logs = F.col("g") - F.col("p"), F.log("p") - F.log("g")
    out = kept.groupBy(by).agg(
        *(F.avg((worse < 1.25**k).cast("double")).alias(f"a{k}") for k in (1, 2, 3)),
        F.avg(F.abs(d) / F.col("g")).alias("abs_rel"), F.avg(d * d / F.col("g")).alias("sq_rel"), F.sqrt(F.avg(d * d)).alias("rmse"), F.sqrt(F.avg(logs * logs)).alias("rmse_log"),
        F.avg(logs * logs).alias("__l2"), F.avg(logs).alias("__l1"), F.avg(F.abs(F.log10("g") - F.log10("p"))).alias("log10"), F.avg(F.abs(d)).alias("mae"),
    )
    silog = F.sqrt(F.greatest(F.col("__l2") - F.col("__l1") * F.col("__l1"), F.lit(0.0))) * 100
    return out.withColumn("silog", silog).drop("__l1", "__l2")


def alignment(pairs: DataFrame, by: str, truth: str = "gt", predicted: str = "pred") -> DataFrame:
    """Scale and shift that fit predictions to truths of each group by least squares."""
    return pairs.groupBy(by).agg(F.regr_slope(truth, predicted).alias("scale"), F.regr_intercept(truth, predicted).alias("shift"))


def top_k_hits(scores: DataFrame, ks: tuple[int, ...], item: str = "id", label: str = "label", score: str = "score", truth: str = "gt") -> DataFrame:
    """One row: the share of items whose true label is among the k best scored (ties to the smaller label)."""
    order = W.partitionBy(item).orderBy(F.col(score).desc(), label)
    place = scores.withColumn("place", F.row_number().over(order)).groupBy(item).agg(F.min(F.when(F.col(label) == F.col(truth), F.col("place"))).alias("place"))
    return place.agg(*(F.avg(F.coalesce((F.col("place") <= k), F.lit(False)).cast("double")).alias(f"top{k}") for k in ks))


def mean_reciprocal_rank(scores: DataFrame, classes: int, item: str = "id", label: str = "label", score: str = "score", truth: str = "gt") -> DataFrame:
    """One row: the mean over all ``classes`` of each class's mean reciprocal rank; ties count against, empty classes are 0."""
    own = scores.where(F.col(label) == F.col(truth)).select(F.col(item).alias("__i"), F.col(score).alias("own"), F.col(truth).alias("c"))
    rank = scores.join(own, F.col(item) == F.col("__i")).groupBy("__i", "c").agg(F.count_if(F.col(score) >= F.col("own")).alias("rank"))
    per = rank.groupBy("c").agg((F.sum(1 / F.col("rank")) / (F.count("*") + 1e-6)).alias("rr"))
    return per.agg((F.coalesce(F.sum("rr"), F.lit(0.0)) / classes).alias("mrr"))


def any_match(rows: DataFrame, by: str, predicted: str = "pred", targets: str = "targets") -> DataFrame:
    """Share of rows of each group whose prediction is among their targets; rows without targets don't count."""
    return rows.where(F.size(targets) > 0).groupBy(by).agg(F.avg(F.array_contains(F.col(targets), F.col(predicted)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def precision_recall(detections: DataFrame, by: str, positives: DataFrame, score: str = "score", hit: str = "tp", tie: str = "id") -> DataFrame:
    """Detections in order of falling score with cumulated precision, recall and the envelope (the largest precision at the same
    or a larger recall). positives: by, n. A category's detections are spread over tasks; see ``running``."""
    order = [-F.col(score), F.col(tie)]
    precision = F.col("tps") / F.col("all")
    totals = {"tps": F.col(hit).cast("long"), "all": F.lit(1).cast("long")}
    out = running_ahead(detections.join(positives, by), [by], order, totals, precision, "envelope")
    return out.withColumn("precision", precision).withColumn("recall", F.try_divide(F.col("tps"), F.col("n")))


def average_precision(curve: DataFrame, by: str, points: int = 101) -> DataFrame:
    """Mean of the envelope at ``points`` evenly spaced recalls from 0 to 1; 0 where a recall isn't reached."""
    # a step counts for the last of the points that it reaches, by the same comparison as for each of them, so a step is one row
    last = points - 1
    near = F.floor(F.col("recall") * last)
    reached = F.when((near + 1) / last <= F.col("recall"), near + 1).when(near / last > F.col("recall"), near - 1).otherwise(near)
    steps = curve.select(by, F.least(reached, F.lit(last)).cast("long").alias("i"), "envelope").where(F.col("i") >= 0).groupBy(by, "i").agg(F.max("envelope").alias("p"))
    order = W.partitionBy(by).orderBy("i")
    best = F.max("p").over(order.rowsBetween(0, W.unboundedFollowing))
    at = steps.select(by, (best * (F.col("i") - F.coalesce(F.lag("i").over(order), F.lit(-1)))).alias("p"))
    return curve.select(by).distinct().join(at.groupBy(by).agg((F.sum("p") / points).alias("ap")), by, "left").select(by, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def relative_errors(rows: DataFrame, reference: DataFrame, kind: str = "kind", accuracy: str = "accuracy") -> DataFrame:
    """For each kind the mean error over the mean reference error. reference: kind, error."""
    own = rows.groupBy(kind).agg(F.avg(1 - F.col(accuracy)).alias("error"))
    ref = reference.groupBy(kind).agg(F.avg("error").alias("reference"))
    return own.join(ref, kind).select(kind, "error", F.try_divide(F.col("error"), F.col("reference")).alias("relative"))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, median (the upper of two middles) and 95th percentile (nearest rank, half to even) of each group. The ranks
    come from counts of distinct values, so a large group of few values costs little."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("k"))
    up = W.partitionBy(by).orderBy(value)
    placed = counts.withColumn("until", F.sum("k").over(up.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(W.partitionBy(by)))
    at = lambda rank: F.min(F.when(F.col("until") > rank, F.col(value)))
    return placed.groupBy(by).agg(F.max("n").alias("n"), (F.sum(F.col(value) * F.col("k")) / F.max("n")).alias("mean"), at(F.floor(F.col("n") / 2)).alias("p50"), at(F.rint((F.col("n") - 1) * 0.95)).alias("p95"))


def image_miou(pairs: DataFrame, image: str = "image", truth: str = "gt", predicted: str = "pred", ignore: int = 0) -> DataFrame:
    """Mean IoU of each image over the classes with a union, the ignored class left out; 0 where there is none."""
    n = pairs.groupBy(image, F.col(truth).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    one = n.select(image, "n", "g", "p", F.explode(F.array_distinct(F.array("g", "p"))).alias("c")).where(F.col("c") != ignore)
    iou = one.groupBy(image, "c").agg((F.sum(F.when((F.col("g") == F.col("c")) & (F.col("p") == F.col("c")), F.col("n")).otherwise(0)) / F.sum("n")).alias("iou"))
    return pairs.select(image).distinct().join(iou.groupBy(image).agg(F.avg("iou").alias("miou")), image, "left").select(image, F.coalesce("miou", F.lit(0.0)).alias("miou"))


def tries(results: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Mean and sample deviation of each measure over several tries."""
    return results.agg(*(F.avg(n).alias(f"{n}_mean") for n in names), *(F.stddev_samp(n).alias(f"{n}_std") for n in names))


def best_of(results: DataFrame, by: str, value: str, name: str, larger: bool = True) -> DataFrame:
    """For each ``by`` the name with the best value, ties to the first name."""
    return results.where(F.col(value).isNotNull()).groupBy(by).agg(F.min_by(F.struct(name, value), F.struct(-F.col(value) if larger else F.col(value), F.col(name))).alias("b")).select(by, f"b.{name}", f"b.{value}")


def dice_loss(pairs: DataFrame, by: tuple[str, ...], logit: str = "logit", target: str = "target") -> DataFrame:
    """1 - (2 sum p t + 1) / (sum p + sum t + 1) of each group, with p the logistic of the logit."""
    p = 1 / (1 + F.exp(-F.col(logit)))
    return pairs.groupBy(*by).agg((1 - (2 * F.sum(p * F.col(target)) + 1) / (F.sum(p) + F.sum(target) + 1)).alias("dice_loss"))


def logistic_loss(pairs: DataFrame, by: tuple[str, ...], logit: str = "logit", target: str = "target") -> DataFrame:
    """Mean cross entropy of logits against targets of each group, in the form that doesn't overflow."""
    x = F.col(logit)
    return pairs.groupBy(*by).agg(F.avg(F.greatest(x, F.lit(0.0)) - x * F.col(target) + F.log1p(F.exp(-F.abs(x)))).alias("bce"))


def macro_recall(counts: DataFrame) -> DataFrame:
    """One row from a confusion table: micro and macro accuracy."""
    per = counts.groupBy("gt").agg((F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("r"), F.sum("n").alias("n"))
    return per.agg((F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("micro"), F.avg("r").alias("macro"))


def f1_scores(counts: DataFrame) -> DataFrame:
    """One row from a confusion table: micro and macro F1; a class that is neither true nor predicted isn't counted."""
    areas = class_areas(counts)
    f = F.try_divide(2 * F.col("both"), F.col("label") + F.col("predicted"))
    return areas.agg((2 * F.sum("both") / (F.sum("label") + F.sum("predicted"))).alias("micro_f1"), F.avg(f).alias("macro_f1"))


def auroc(rows: DataFrame, by: str, score: str = "score", positive: str = "positive") -> DataFrame:
    """Area under the curve of true against false positives of each group: the chance that a positive scores over a negative, ties
    counting half; null without both kinds. Equal scores are one row before they are put in order."""
    n = rows.groupBy(by, score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    placed = running(n, [by], [F.col(score)], {"until": F.col("q")})
    won = F.sum(F.col("p") * (F.col("until") - F.col("q") / 2))
    return placed.groupBy(by).agg(F.try_divide(won, F.sum("p") * F.sum("q").cast("double")).alias("auroc"))


def label_average_precision(rows: DataFrame, by: str, score: str = "score", positive: str = "positive") -> DataFrame:
    """Average precision of each label: the sum over distinct scores of the gain in recall times the precision there. The mean over
    labels is the multi-label measure; null for a label without positives."""
    n = rows.groupBy(by, score).agg(F.count_if(positive).alias("p"), F.count("*").alias("k"))
    placed = running(n, [by], [-F.col(score)], {"tps": F.col("p"), "all": F.col("k")})
    return placed.groupBy(by).agg(F.try_divide(F.sum(F.col("p") * F.col("tps") / F.col("all")), F.sum("p")).alias("ap"))


def gram_error(tokens: DataFrame, by: str, out: str = "output", target: str = "target", clip: bool = True) -> DataFrame:
    """Mean squared difference of the Gram matrices of unit vectors of each group (an image's tokens: a group that fits a task by
    its nature), negative products as 0 if clipped. tokens: by, and two arrays of numbers."""
    kind = tokens.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = []
        for name in (out, target):
            x = np.array(pdf[name].tolist(), np.float64)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            g = x @ x.T
            grams.append(np.maximum(g, 0) if clip else g)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "error": [float(((grams[0] - grams[1]) ** 2).mean())]})

    return tokens.select(by, out, target).groupBy(by).applyInPandas(run, f"{by} {kind}, error double")


# Thresholds of overlap, areas and numbers of detections that the averages are taken over.
OVERLAPS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
AREAS = {"all": (0.0, 1e10), "small": (0.0, 128.0**2), "medium": (128.0**2, 256.0**2), "large": (256.0**2, 1e10)}
MOST = (1, 10, 100)


def detection_grid(pairs: DataFrame, detections: DataFrame, truths: DataFrame, thresholds: tuple[float, ...] = OVERLAPS, areas: dict[str, tuple[float, float]] | None = None, most: tuple[int, ...] = MOST, points: int = 101) -> DataFrame:
    """category, area, threshold, most, ap, ar: average precision and recall for every range of areas, overlap threshold and number
    of detections of an image or video; -1 where no truth counts.

    pairs: video, category, id, truth, iou. detections: video, category, id, score, size. truths: video, category, truth, crowd,
    size. A crowd, and what lies outside the area's range, is ignored; so is a detection outside it that takes no truth.
    """
    ranges = F.explode(F.array(*(F.struct(F.lit(n).alias("area"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, (lo, hi) in (areas or AREAS).items())))
    spread = lambda rows: rows.select("*", ranges.alias("__r")).select(*rows.columns, "__r.area", ((F.col("size") < F.col("__r.lo")) | (F.col("size") > F.col("__r.hi"))).alias("outside"))
    known, found = spread(truths), spread(detections)
    known = known.withColumn("ignore", F.when(F.col("outside") | (F.coalesce(F.col("crowd"), F.lit(0)) == 1), 1).otherwise(0))
    by = ("area", "video", "category")
    every = pairs.withColumn("area", F.explode(F.array(*map(F.lit, areas or AREAS))))
    matched = detections_matched(every.select(*by, "id", "truth", "iou"), found.select(*by, "id", "score"), known.select(*by, "truth", "ignore"), by, thresholds, max(most))
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    place = found.select(*by, "id", "outside", F.row_number().over(order).alias("place"))
    judged = matched.join(place, [*by, "id"]).where(~(F.col("ignored") | (F.col("outside") & F.col("truth").isNull())))
    wide = judged.select("*", F.explode(F.array(*map(F.lit, most))).alias("most")).where(F.col("place") <= F.col("most"))
    key = F.struct("category", "area", "threshold", "most")
    positives = known.groupBy("category", "area").agg(F.count_if(F.col("ignore") == 0).alias("n"))
    one = wide.join(positives.where("n > 0"), ["category", "area"]).select(key.alias("k"), "n", "score", F.struct("video", "place").alias("tie"), F.col("truth").isNotNull().alias("tp"))
    one = saved(one, "judged")  # it is read several times, and matching isn't cheap
    # the struct is a key like any other; positives come along
    curve = precision_recall(one.drop("n"), "k", one.groupBy("k").agg(F.max("n").alias("n")), tie="tie")
    curve = saved(curve.select("k", "recall", "envelope"), "curve")
    precision, recall = average_precision(curve, "k", points), curve.groupBy("k").agg(F.max("recall").alias("ar"))
    cells = positives.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).select("*", F.explode(F.array(*map(F.lit, most))).alias("most"))
    told = precision.join(recall, "k").select("k.*", "ap", "ar")
    rest = F.when(F.col("n") > 0, F.lit(0.0)).otherwise(F.lit(-1.0))
    return cells.join(told, ["category", "area", "threshold", "most"], "left").select("category", "area", "threshold", "most", F.coalesce("ap", rest).alias("ap"), F.coalesce("ar", rest).alias("ar"))


def summarised(grid: DataFrame) -> DataFrame:
    """One row a (area, most): means of ap and ar over the categories and thresholds that count, and of ap at 0.5 and 0.75; -1 if none do."""
    mean = lambda c, cond=F.lit(True): F.coalesce(F.avg(F.when((F.col(c) > -1) & cond, F.col(c))), F.lit(-1.0))
    at = lambda t: F.abs(F.col("threshold") - t) < 1e-9
    return grid.groupBy("area", "most").agg(mean("ap").alias("ap"), mean("ap", at(0.5)).alias("ap50"), mean("ap", at(0.75)).alias("ap75"), mean("ar").alias("ar"))
