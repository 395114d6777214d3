"""From class scores and masks of queries to segments: masks of an image compete for its pixels.

Tables: ``classes`` (image, query, class, logit: the last class means no object) and ``masks`` (image, query, y, x, logit). A pixel is
contested by as many queries as an image has, and everything is a grouping or an equi-join, so images and pixels spread freely. What there
is of each query is written before pixels meet it, one row an image, so that tables of pixels are never broadcast, and move between tasks once at
most: by their image, and not at all where Spark knows that they are dealt by it already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.storage import saved


#: Classes whose votes are summed side by side; more are rows of their own.
WIDE = 64


def _sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def class_shares(classes: DataFrame) -> DataFrame:
    """classes with share, the softmax of a query's logits."""
    query = W.partitionBy("image", "query")
    shifted = classes.withColumn("__e", F.exp(F.col("logit") - F.max("logit").over(query)))
    return shifted.withColumn("share", F.col("__e") / F.sum("__e").over(query)).drop("__e")


def best_class(classes: DataFrame) -> DataFrame:
    """image, query, category, score: each query's most likely class, the smaller of equals."""
    best = F.max_by(F.struct("class", "share"), F.struct("share", (-F.col("class")).alias("c"))).alias("b")
    return class_shares(classes).groupBy("image", "query").agg(best).select("image", "query", F.col("b.class").alias("category"), F.col("b.share").alias("score"))


def _of_images(queries: DataFrame, masks: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    """image, of: a map from each query of an image to the columns, as a written table. It is the hashed side of joins, so that pixels aren't sorted."""
    kind = masks.schema["query"].dataType
    entry = F.struct(F.col("query").cast(kind).alias("query"), F.struct(*columns).alias("of"))
    rows = queries.where("image is not null and query is not null").groupBy("image").agg(F.map_from_entries(F.collect_list(entry)).alias("of"))
    return saved(rows, what).hint("shuffle_hash")


def _contested(sure: DataFrame, masks: DataFrame) -> DataFrame:
    """masks with the score of their query, if it is sure, and its value and whether its own mask holds the pixel."""
    part = masks.join(sure, "image", "left").withColumn("score", F.col("of")[F.col("query")]["score"]).drop("of")
    return part.withColumn("value", _sigmoid(F.col("logit"))).withColumn("own", F.col("value") >= 0.5)


def _won(part: DataFrame) -> DataFrame:
    """image, y, x, query, own: who wins a pixel. One that no sure query has keeps its row, without a winner."""
    rank = F.when(F.col("score").isNotNull(), F.struct((F.col("score") * F.col("value")).alias("p"), (-F.col("query")).alias("q")))
    return part.groupBy("image", "y", "x").agg(F.max_by(F.struct("query", "own"), rank).alias("w")).select("image", "y", "x", "w.query", "w.own")


def panoptic(classes: DataFrame, masks: DataFrame, no_object: int, things: Sequence[int], least_score: float = 0.8, least_overlap: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pixels: image, y, x, segment; segments: image, segment, category, thing, area).

    Queries whose class is no object, or that aren't surer than ``least_score``, take no part. A pixel is won by the query with the largest score
    times mask value (the smaller query of equals). A query becomes a segment if it wins a pixel that its own mask holds (a value of 0.5 or
    more) and if what it wins is at least ``least_overlap`` of its mask; it keeps the won pixels that its mask holds. Queries of a
    class that is no thing share one segment. Segments are numbered from 1 by their first query; other pixels are 0.
    """
    sure = saved(best_class(classes).where((F.col("category") != no_object) & (F.col("score") > least_score)), "sure")
    part = _contested(_of_images(sure, masks, ["score"], "sure_of"), masks)
    won = saved(_won(part), "won")
    whole = part.where("score is not null").groupBy("image", "query").agg(F.count_if("own").alias("__whole"))
    held = won.where("query is not null").groupBy("image", "query").agg(F.count("*").alias("__won"), F.count_if("own").alias("__kept"))
    kept = held.join(whole.hint("merge"), ["image", "query"]).where((F.col("__kept") > 0) & (F.col("__won") / F.col("__whole") >= least_overlap)).join(sure, ["image", "query"])
    thing = F.col("category").isin(*things)
    # things are segments of their own, other classes one each
    grouped = kept.withColumn("thing", thing).withColumn("first", F.when(thing, F.col("query")).otherwise(F.min("query").over(W.partitionBy("image", "category", thing))))
    numbered = saved(grouped.withColumn("segment", F.dense_rank().over(W.partitionBy("image").orderBy("first"))), "numbered")
    of_query = numbered.select("image", "query", F.lit(True).alias("own"), "segment")
    out = won.join(of_query, ["image", "query", "own"], "left").select("image", "y", "x", F.coalesce("segment", F.lit(0)).alias("segment"))
    segments = numbered.groupBy("image", "segment").agg(F.min("category").alias("category"), F.first("thing").alias("thing"), F.sum("__kept").alias("area"))
    return out, segments


def semantic(classes: DataFrame, masks: DataFrame, no_object: int) -> DataFrame:
    """image, y, x, category: the class with the largest sum of class share times mask value over all queries, the smaller of equals."""
    shares = saved(class_shares(classes).where(F.col("class") != no_object).select("image", "query", "class", "share"), "shares")
    names = [r[0] for r in shares.select("class").distinct().limit(WIDE + 1).collect()]
    if len(names) > WIDE:
        votes = masks.join(shares, ["image", "query"]).groupBy("image", "y", "x", "class").agg(F.sum(F.col("share") * _sigmoid(F.col("logit"))).alias("vote"))
        return votes.groupBy("image", "y", "x").agg(F.max_by("class", F.struct("vote", (-F.col("class")).alias("c"))).alias("category"))
    # a column for each class: a pixel's rows are as many as its queries, whatever the number of classes
    wide = shares.groupBy("image", "query").agg(*(F.sum(F.when(F.col("class") == c, F.col("share"))).alias(f"__s{i}") for i, c in enumerate(names)))
    columns = [f"__s{i}" for i in range(len(names))] or [F.lit(True).alias("__none")]
    part = masks.join(_of_images(wide, masks, columns, "wide"), "image").withColumn("__of", F.col("of")[F.col("query")]).where("__of is not null")
    part = part.select("image", "y", "x", _sigmoid(F.col("logit")).alias("__v"), "__of.*")
    sums = part.groupBy("image", "y", "x").agg(*(f(c).alias(f"__{n}{i}") for i in range(len(names)) for n, f, c in (("t", F.sum, F.col(f"__s{i}") * F.col("__v")), ("k", F.max, F.col(f"__s{i}")))))
    kind = classes.schema["class"].dataType
    best = [F.when(F.col(f"__k{i}").isNotNull(), F.struct(F.col(f"__t{i}").alias("vote"), F.lit(-c).alias("c"))) for i, c in enumerate(names)]
    won = F.greatest(*best) if len(best) > 1 else best[0] if best else F.lit(None).cast("struct<vote: double, c: int>")
    return sums.select("image", "y", "x", (-won["c"]).cast(kind).alias("category")).where("category is not null")


def instances(classes: DataFrame, masks: DataFrame, no_object: int, k: int = 100, things: Sequence[int] | None = None) -> DataFrame:
    """image, query, category, score, area, mask_score, final: an image's k best (query, class), of which things stay if they are named.

    A mask is where its logit is over 0; ``mask_score`` is the mean value within it (0 without pixels), ``final`` is score times mask_score.
    """
    order = W.partitionBy("image").orderBy(F.col("share").desc(), "query", "class")
    best = class_shares(classes).where(F.col("class") != no_object).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
    if things is not None:
        best = best.where(F.col("class").isin(*things))
    own = F.col("logit") > 0
    sizes = masks.groupBy("image", "query").agg(F.count_if(own).alias("area"), F.sum(F.when(own, _sigmoid(F.col("logit")))).alias("__sum"))
    score = F.coalesce("__sum", F.lit(0.0)) / (F.coalesce("area", F.lit(0)) + 1e-6)
    out = best.select("image", "query", F.col("class").alias("category"), F.col("share").alias("score")).join(sizes, ["image", "query"], "left")
    return out.select("image", "query", "category", "score", F.coalesce("area", F.lit(0)).alias("area"), score.alias("mask_score"), (F.col("score") * score).alias("final"))
