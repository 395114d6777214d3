"""Masks as runs: from polygons by scanlines, to and from counts and their compressed strings, united, measured, decoded.

A mask is an array of runs (structs start, len; places from 0, in order, neither touching nor overlapping). Places count down the
columns of the image, as in the compressed form, or along its rows. A mask fits a row; the work of many masks is spread by edges,
lines and runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.storage import spread
from cairn.operators.annotations import run_area

__all__ = ["compressed", "counts", "decompressed", "from_counts", "pixels", "polygon_runs", "run_area", "run_box", "united"]


def _swept(intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, runs of intervals (by, s, e: e not included): what overlaps or touches becomes one run."""
    order = W.partitionBy(*by).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    begun = intervals.withColumn("__new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    islands = begun.withColumn("__island", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = islands.groupBy(*by, "__island").agg(F.min("s").alias("start"), (F.max("e") - F.min("s")).alias("len"))
    return merged.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start", "len"))).alias("runs"))


_NONE = "array<struct<start:bigint,len:bigint>>"


def polygon_runs(polygons: DataFrame, by: Sequence[str], by_columns: bool = True) -> DataFrame:
    """by, height, width, runs: one mask for each ``by``, the union of its polygons.

    polygons: by, coords (x0, y0, x1, y1 ..), height, width; a row for each part of a mask. A pixel belongs to a polygon if its centre
    does, by the even-odd rule; edges cover the lines of pixels between their ends, and what lies between two of a line's crossings becomes
    a run. Polygons of fewer than three corners, or with a coordinate that is null or not finite, have no pixels; a mask without pixels has
    no runs. Several rows of a mask must agree on its size; the largest counts. Null keys are a mask of their own.
    """
    # lines and crossings are many times as many as polygons: these are dealt over tasks first
    parts = spread(polygons.select(*by, "coords", "height", "width"), *by).select(*by, F.col("coords").cast("array<double>").alias("coords"), F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"))
    masks = parts.groupBy(*by).agg(F.max("height").alias("height"), F.max("width").alias("width"))
    good = (F.size("coords") >= 6) & F.forall("coords", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    parts = parts.withColumn("__part", F.monotonically_increasing_id()).where(good)
    corners = F.floor(F.size("coords") / 2).cast("int")
    edges = parts.withColumn("__n", corners).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    line, along = (0, 1) if by_columns else (1, 0)
    lines, length = ("width", "height") if by_columns else ("height", "width")
    at = lambda i, axis: F.get("coords", (2 * i + axis).cast("int"))
    nxt = (F.col("__i") + 1) % F.col("__n")
    edges = edges.select(*by, "__part", F.col(lines).alias("__lines"), F.col(length).alias("__length"), at(F.col("__i"), line).alias("l0"), at(F.col("__i"), along).alias("a0"), at(nxt, line).alias("l1"), at(nxt, along).alias("a1"))
    # lines whose middle the edge crosses
    first = F.greatest(F.ceil(F.least("l0", "l1") - 0.5), F.lit(0).cast("long"))
    last = F.least(F.ceil(F.greatest("l0", "l1") - 0.5), F.col("__lines")) - 1
    crossed = edges.withColumn("__f", first).withColumn("__t", last).where(F.col("__f") <= F.col("__t")).withColumn("__line", F.explode(F.sequence("__f", "__t")))
    crossing = F.col("a0") + (F.col("__line") + 0.5 - F.col("l0")) * (F.col("a1") - F.col("a0")) / (F.col("l1") - F.col("l0"))
    sorted_ = crossed.groupBy(*by, "__part", "__line", "__length").agg(F.sort_array(F.collect_list(crossing)).alias("__c"))
    place = lambda c: F.least(F.greatest(F.ceil(c - 0.5), F.lit(0).cast("long")), F.col("__length"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("__c") / 2).cast("int") - 1), lambda i: F.struct(place(F.get("__c", 2 * i)).alias("s"), place(F.get("__c", 2 * i + 1)).alias("e")))
    inside = sorted_.select(*by, "__line", "__length", F.inline(pairs)).where("s < e")
    runs = _swept(inside.select(*by, (F.col("__line") * F.col("__length") + F.col("s")).alias("s"), (F.col("__line") * F.col("__length") + F.col("e")).alias("e")), by)
    return _beside(masks, runs, by).select(*by, "height", "width", F.coalesce("runs", F.array().cast(_NONE)).alias("runs"))


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    named = right.select(*(F.col(c).alias(f"__r_{c}") for c in by), *(c for c in right.columns if c not in by))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    # both have a row a mask, of which there may be many more than the tables they are made of let Spark expect
    return left.join(named.hint("merge"), same, "left")


def united(masks: DataFrame, by: Sequence[str], runs: str = "runs") -> DataFrame:
    """by, runs: the union of all masks of a ``by``; without any run it is empty."""
    each = masks.select(*by, F.inline(runs)).where("len > 0").select(*by, F.col("start").cast("long").alias("s"), (F.col("start") + F.col("len")).cast("long").alias("e"))
    return _beside(masks.select(*by).distinct(), _swept(each, by), by).select(*by, F.coalesce("runs", F.array().cast(_NONE)).alias("runs"))


def run_box(runs: Column, height: Column) -> Column:
    """x, y, width, height of the box around runs that count down columns; all zero without runs."""
    last = lambda r: r["start"] + r["len"] - 1
    column = lambda p: F.floor(p / height)
    x0, x1 = F.array_min(F.transform(runs, lambda r: column(r["start"]))), F.array_max(F.transform(runs, lambda r: column(last(r))))
    # a run that goes on in the next column touches the lower and the upper edge
    several = lambda r: column(r["start"]) < column(last(r))
    y0 = F.array_min(F.transform(runs, lambda r: F.when(several(r), 0).otherwise(r["start"] % height)))
    y1 = F.array_max(F.transform(runs, lambda r: F.when(several(r), height - 1).otherwise(last(r) % height)))
    zero = F.lit(0).cast("long")
    none = F.size(runs) == 0
    out = lambda v: F.when(none, zero).otherwise(v.cast("long"))
    return F.struct(out(x0).alias("x"), out(y0).alias("y"), out(x1 - x0 + 1).alias("width"), out(y1 - y0 + 1).alias("height"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once a row. (An expression that a lambda refers to is made anew for each element.)"""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def counts(runs: Column, size: Column) -> Column:
    """How many pixels are out, in, out .. of a mask of ``size`` pixels, beginning with those out."""
    end = lambda r: r["start"] + r["len"]

    def told(before: Column) -> Column:
        pairs = F.flatten(F.transform(runs, lambda r, i: F.array(r["start"] - F.get(before, i), r["len"])))
        rest = size.cast("long") - F.element_at(before, -1)
        return F.concat(pairs, F.when((rest > 0) | (F.size(runs) == 0), F.array(rest)).otherwise(F.array().cast("array<bigint>")))

    return _let(F.concat(F.array(F.lit(0).cast("long")), F.transform(runs, end)), told)


def from_counts(values: Column) -> Column:
    """Runs of such counts; empty runs are passed over, and what touches is one run."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("inside"), F.array().cast(_NONE).alias("runs"))

    def step(s: Column, n: Column) -> Column:
        touches = (F.size(s["runs"]) > 0) & (F.element_at(s["runs"], -1)["start"] + F.element_at(s["runs"], -1)["len"] == s["at"])
        own = F.array(F.struct(s["at"].alias("start"), n.alias("len")))
        longer = F.concat(F.slice(s["runs"], F.lit(1), F.size(s["runs"]) - 1), F.array(F.struct(F.element_at(s["runs"], -1)["start"].alias("start"), (F.element_at(s["runs"], -1)["len"] + n).alias("len"))))
        runs = F.when(~s["inside"] | (n == 0), s["runs"]).when(touches, longer).otherwise(F.concat(s["runs"], own))
        return F.struct((s["at"] + n).alias("at"), (~s["inside"]).alias("inside"), runs.alias("runs"))

    return F.aggregate(F.transform(values, lambda v: v.cast("long")), start, step, lambda s: s["runs"])


# Fixed values of the compressed form: five bits a character, a sixth says that more follow, characters from "0" on, and
# counts from the fourth on are told as what they differ from the count two before.
_BITS, _FIRST = 5, 48


def compressed(values: Column) -> Column:
    """The compressed string of counts."""
    told = _let(values, lambda held: F.transform(held, lambda v, i: F.when(i > 2, v - F.get(held, i - 2)).otherwise(v)))
    most = 7
    # as few groups of bits as hold the number with its sign
    groups = lambda v: F.coalesce(*(F.when((v >= -(1 << (_BITS * n - 1))) & (v < 1 << (_BITS * n - 1)), F.lit(n)) for n in range(1, most)), F.lit(most))
    bits = lambda v, i: F.try_mod(F.floor(v / F.pow(F.lit(2.0), i * _BITS)).cast("long"), F.lit(1 << _BITS))
    low = lambda v, i: F.when(bits(v, i) < 0, bits(v, i) + (1 << _BITS)).otherwise(bits(v, i))
    sign = lambda v, i, n: F.char(low(v, i) + F.when(i < n - 1, 1 << _BITS).otherwise(0) + _FIRST)
    text = lambda v: F.array_join(F.transform(F.sequence(F.lit(0), groups(v) - 1), lambda i: sign(v, i, groups(v))), "")
    return F.array_join(F.transform(told, text), "")


def decompressed(text: Column) -> Column:
    """The counts of a compressed string."""
    # characters with the sixth bit go on, others end a number
    numbers = F.regexp_extract_all(text, F.lit("([P-o]*[0-O])"))
    code = lambda s, i: F.ascii(F.substring(s, i + 1, F.lit(1))) - _FIRST
    digits = lambda s: F.aggregate(F.sequence(F.lit(0), F.length(s) - 1), F.lit(0).cast("long"), lambda t, i: t + F.try_mod(code(s, i), F.lit(1 << _BITS)).cast("long") * F.pow(F.lit(2.0), i * _BITS).cast("long"))
    negative = lambda s: F.try_mod(F.floor((F.ascii(F.substring(s, F.length(s), F.lit(1))) - _FIRST) / 16), F.lit(2)) == 1
    signed = F.transform(numbers, lambda s: digits(s) - F.when(negative(s), F.pow(F.lit(2.0), F.length(s) * _BITS).cast("long")).otherwise(0))
    return F.aggregate(signed, F.array().cast("array<bigint>"), lambda out, v: F.concat(out, F.array(v + F.when(F.size(out) > 2, F.get(out, F.size(out) - 2)).otherwise(0))))


def pixels(masks: DataFrame, by: Sequence[str], height: str = "height", runs: str = "runs") -> DataFrame:
    """by, y, x of every pixel of masks whose runs count down columns."""
    each = masks.select(*by, F.col(height).alias("__h"), F.inline(runs)).where("len > 0")
    return each.withColumn("__p", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1))).select(*by, (F.col("__p") % F.col("__h")).alias("y"), F.floor(F.col("__p") / F.col("__h")).alias("x"))


def eroded(masks: DataFrame, by: Sequence[str], share: float = 0.05, least_area: int = 20) -> DataFrame:
    """by, height, width, runs: each mask without the pixels around which an ellipse isn't all mask. Runs go along rows.

    The ellipse's radius is ``share`` of the root of the mask's area, in whole pixels, 1 at least; what would lie outside the image counts as mask.
    Masks of fewer than ``least_area`` pixels, and those of which nothing would be left, stay as they are. A row of the ellipse is as wide as the
    circle there, rounded half to even; runs are shortened by that on both sides, and a pixel stays if such a run covers it from every row
    around it, which a sweep over the ends of runs finds.
    """
    own = masks.select(*by, "height", "width", "runs", run_area(F.col("runs")).alias("__area"))
    large = own.where(F.col("__area") >= least_area).withColumn("__r", F.greatest(F.floor(F.sqrt("__area") * share), F.lit(1)))
    each = large.select(*by, "height", "width", "__r", F.inline("runs")).where("len > 0")
    rows = each.withColumn("__row", F.explode(F.sequence(F.floor(F.col("start") / F.col("width")), F.floor((F.col("start") + F.col("len") - 1) / F.col("width")))))
    begin = F.greatest(F.col("start") - F.col("__row") * F.col("width"), F.lit(0).cast("long"))
    end = F.least(F.col("start") + F.col("len") - F.col("__row") * F.col("width"), F.col("width"))
    rows = rows.select(*by, "height", "width", "__r", "__row", begin.alias("s"), end.alias("e")).withColumn("__dy", F.explode(F.sequence(-F.col("__r"), F.col("__r"))))
    half = F.rint(F.sqrt(F.col("__r") * F.col("__r") - F.col("__dy") * F.col("__dy"))).cast("long")
    short = rows.select(*by, "height", "width", "__r", (F.col("__row") - F.col("__dy")).alias("__y"), F.when(F.col("s") == 0, F.col("s")).otherwise(F.col("s") + half).alias("s"), F.when(F.col("e") == F.col("width"), F.col("e")).otherwise(F.col("e") - half).alias("e"))
    short = short.where("s < e and __y >= 0 and __y < height")
    needed = F.least(F.col("__y") + F.col("__r"), F.col("height") - 1) - F.greatest(F.col("__y") - F.col("__r"), F.lit(0)) + 1
    ends = short.select(*by, "width", "__y", needed.alias("__needed"), F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    ends = ends.groupBy(*by, "width", "__y", "__needed", F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    line = W.partitionBy(*by, "__y").orderBy("at")
    swept = ends.withColumn("__n", F.sum("d").over(line.rowsBetween(W.unboundedPreceding, 0))).withColumn("__next", F.lead("at").over(line)).where(F.col("__n") == F.col("__needed"))
    left = _swept(swept.select(*by, (F.col("__y") * F.col("width") + F.col("at")).alias("s"), (F.col("__y") * F.col("width") + F.col("__next")).alias("e")), by).withColumnRenamed("runs", "__left")
    return _beside(own, left, by).select(*by, "height", "width", F.coalesce("__left", "runs").alias("runs"))
