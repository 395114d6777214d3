"""Queries over measures: confusion, IoU, panoptic quality, depth, ranking, neighbours, latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.storage import saved
from cairn.operators import knn, metrics
from cairn.operators.colouring import bound
from cairn.plans.registry import query
from cairn.plans.views import EVENT, PAIR, ctes, table, view


def _rounded(df, n, *names):
    return df.select(*(F.round(c, n).alias(c) if c in names else c for c in df.columns))


_AREAS = dict(p=PAIR, c="SELECT gt, pred, count(*) AS n FROM p GROUP BY 1, 2", a="SELECT c, CAST(sum(l) AS BIGINT) AS label, CAST(sum(q) AS BIGINT) AS predicted, CAST(sum(b) AS BIGINT) AS hit, CAST(sum(l) + sum(q) - sum(b) AS BIGINT) AS uni FROM (SELECT gt AS c, n AS l, 0 AS q, CASE WHEN gt = pred THEN n ELSE 0 END AS b FROM c UNION ALL SELECT pred, 0, n, 0 FROM c) GROUP BY 1")


@query(ctes(p=PAIR) + " SELECT gt, pred, count(*) AS n FROM p GROUP BY 1, 2")
def a16_confusion(spark, d):
    return metrics.confusion(view(spark, d, PAIR))


@query(ctes(**_AREAS) + ' SELECT c, label, predicted, hit AS "both", uni AS "union" FROM a')
def a17_areas(spark, d):
    return metrics.class_areas(metrics.confusion(view(spark, d, PAIR)))


@query(ctes(**_AREAS) + " SELECT round(sum(hit) / sum(label), 8) AS accuracy, round(avg(hit / uni), 8) AS miou, round(avg(hit / label), 8) AS macc, round(sum(label * (hit / uni)) / sum(label), 8) AS fwiou, count(*) FILTER (WHERE uni > 0) AS classes FROM a")
def m01_iou(spark, d):
    return _rounded(metrics.mean_scores(metrics.class_areas(metrics.confusion(view(spark, d, PAIR)))), 8, "accuracy", "miou", "macc", "fwiou")


@query(ctes(**_AREAS) + " SELECT c, round(hit / uni, 8) AS iou, round(hit / label, 8) AS recall, round(2 * hit / (label + predicted), 8) AS dice, round(hit / predicted, 8) AS precision, round(2 * (hit / predicted) * (hit / label) / (hit / predicted + hit / label), 8) AS f FROM a")
def m02_dice_f(spark, d):
    return _rounded(metrics.class_scores(metrics.class_areas(metrics.confusion(view(spark, d, PAIR)))), 8, "iou", "recall", "dice", "precision", "f")


_PQ = "SELECT o_orderkey % 400 AS image, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 400 % 3 AS INT) END AS gt, CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey % 5 AS INT) ELSE CAST(o_orderkey % 400 % 3 AS INT) END AS pred FROM orders"


@query(
    ctes(
        s=_PQ,
        n="SELECT image, gt, pred, count(*) AS n FROM s GROUP BY ALL",
        g="SELECT image, gt AS c, sum(n) AS ng FROM n WHERE gt IS NOT NULL GROUP BY ALL",
        q="SELECT image, pred AS c, sum(n) AS np, sum(CASE WHEN gt IS NULL THEN n ELSE 0 END) AS void FROM n WHERE pred IS NOT NULL GROUP BY ALL",
        b="SELECT image, gt AS c, n AS hit FROM n WHERE gt = pred",
        e="SELECT coalesce(g.c, q.c) AS c, coalesce(ng, 0) AS ng, coalesce(np, 0) AS np, coalesce(void, 0) AS void, coalesce(hit, 0) AS hit FROM g FULL JOIN q ON g.image = q.image AND g.c = q.c LEFT JOIN b ON b.image = coalesce(g.image, q.image) AND b.c = coalesce(g.c, q.c)",
        h="SELECT *, hit / nullif(ng + np - hit - void, 0) AS iou FROM e",
        k="SELECT c, sum(CASE WHEN iou > 0.5 THEN iou ELSE 0 END) AS iou, count(*) FILTER (WHERE coalesce(iou > 0.5, false)) AS tp, count(*) FILTER (WHERE NOT coalesce(iou > 0.5, false) AND np > 0 AND void * 2 <= np) AS fp, count(*) FILTER (WHERE NOT coalesce(iou > 0.5, false) AND ng > 0) AS fn FROM h GROUP BY 1",
    )
    + " SELECT c, tp, fp, fn, round(coalesce(iou / nullif(tp, 0), 0), 8) AS sq, round(tp / nullif(tp + 0.5 * fp + 0.5 * fn, 0), 8) AS rq, round(coalesce(iou / nullif(tp, 0), 0) * (tp / nullif(tp + 0.5 * fp + 0.5 * fn, 0)), 8) AS pq FROM k"
)
def m04_pq(spark, d):
    return _rounded(metrics.panoptic(view(spark, d, _PQ)), 8, "sq", "rq", "pq")


_DEPTH = "SELECT l_suppkey AS scene, l_extendedprice AS gt, l_extendedprice * (0.8 + l_discount * 5 + l_linenumber * 0.02) AS pred FROM lineitem"


@query(
    ctes(p=_DEPTH, q="SELECT *, greatest(gt / pred, pred / gt) AS w, ln(pred) - ln(gt) AS l FROM p WHERE gt > 0.001")
    + """ SELECT scene, round(avg(CAST(w < 1.25 AS DOUBLE)), 6) AS a1, round(avg(CAST(w < 1.5625 AS DOUBLE)), 6) AS a2, round(avg(CAST(w < 1.953125 AS DOUBLE)), 6) AS a3, round(avg(abs(gt - pred) / gt), 6) AS abs_rel, round(avg((gt - pred)**2 / gt), 3) AS sq_rel,
    round(sqrt(avg((gt - pred)**2)), 3) AS rmse, round(sqrt(avg(l * l)), 6) AS rmse_log, round(100 * sqrt(greatest(avg(l * l) - avg(l) * avg(l), 0)), 6) AS silog, round(avg(abs(log10(gt) - log10(pred))), 6) AS log10, round(avg(abs(gt - pred)), 3) AS mae FROM q GROUP BY 1"""
)
def m05_depth(spark, d):
    out = metrics.depth_errors(view(spark, d, _DEPTH), "scene")
    return _rounded(_rounded(out, 6, "a1", "a2", "a3", "abs_rel", "rmse_log", "silog", "log10"), 3, "sq_rel", "rmse", "mae")


@query(ctes(p=_DEPTH) + " SELECT scene, round(regr_slope(gt, pred), 6) AS scale, round(regr_intercept(gt, pred), 3) AS shift FROM p GROUP BY 1")
def a24_alignment(spark, d):
    return metrics.alignment(view(spark, d, _DEPTH), "scene").select("scene", F.round("scale", 6).alias("scale"), F.round("shift", 3).alias("shift"))


_SCORES = "SELECT l_orderkey AS id, l_linenumber % 4 AS label, max(l_quantity) AS score, CAST(l_orderkey % 4 AS INT) AS gt FROM lineitem GROUP BY 1, 2, 4"


@query(ctes(s=_SCORES) + ", k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS p FROM s), m AS (SELECT id, min(CASE WHEN label = gt THEN p END) AS p FROM k GROUP BY 1) SELECT round(avg(CAST(coalesce(p <= 1, false) AS DOUBLE)), 8) AS top1, round(avg(CAST(coalesce(p <= 2, false) AS DOUBLE)), 8) AS top2 FROM m")
def o04_topk_accuracy(spark, d):
    return _rounded(metrics.top_k_hits(view(spark, d, _SCORES), (1, 2)), 8, "top1", "top2")


@query(ctes(s=_SCORES) + ", o AS (SELECT id, gt, score AS own FROM s WHERE label = gt), r AS (SELECT s.id, o.gt AS c, count(*) FILTER (WHERE s.score >= o.own) AS r FROM s JOIN o ON s.id = o.id GROUP BY 1, 2) SELECT round(sum(rr) / 6, 8) AS mrr FROM (SELECT sum(1 / r) / (count(*) + 1e-6) AS rr FROM r GROUP BY c)")
def m08_mrr(spark, d):
    return _rounded(metrics.mean_reciprocal_rank(view(spark, d, _SCORES), 6), 8, "mrr")


@query("WITH r AS (SELECT lang, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS has, quality, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT lang, round(avg(CAST(CAST(n_chars % 2 AS INT) IN (quality, 1) AS DOUBLE)), 8) AS accuracy, count(*) AS n FROM r WHERE has = 1 GROUP BY 1")
def m07_any_match(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.array("quality", F.lit(1)).alias("targets"))
    rows = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") % 2).cast("int").alias("pred")).join(labels, "doc_id", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<int>")))
    return _rounded(metrics.any_match(rows, "lang"), 8, "accuracy")


_DET = "SELECT d.doc_id AS id, lang, n_chars % 1000 / 1000 AS score, quality = 1 AS tp FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
_CURVE = f"WITH t AS ({_DET}), p AS (SELECT lang, count(*) FILTER (WHERE tp) AS n FROM t GROUP BY 1), c AS (SELECT t.lang, t.id, sum(CAST(tp AS INT)) OVER w / count(*) OVER w AS precision, sum(CAST(tp AS INT)) OVER w / nullif(n, 0) AS recall, row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, id) AS k FROM t JOIN p ON t.lang = p.lang WINDOW w AS (PARTITION BY t.lang ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)), e AS (SELECT *, max(precision) OVER (PARTITION BY lang ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM c)"


def _curve(spark, d):
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("tp"))
    t = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") % 1000 / 1000).alias("score")).join(labels, "doc_id").withColumnRenamed("doc_id", "id")
    return metrics.precision_recall(t, "lang", t.groupBy("lang").agg(F.count_if("tp").alias("n")))


@query(_CURVE + " SELECT lang, id, round(precision, 8) AS precision, round(recall, 8) AS recall, round(envelope, 8) AS envelope FROM e")
def w08_precision_envelope(spark, d):
    return _rounded(_curve(spark, d).select("lang", "id", "precision", "recall", "envelope"), 8, "precision", "recall", "envelope")


def _ap_sql(points: int) -> str:
    return _CURVE + f", g AS (SELECT i / {points - 1} AS r FROM range({points}) t(i)), a AS (SELECT lang, r, max(envelope) AS p FROM e JOIN g ON recall >= r GROUP BY 1, 2) SELECT lang, round(sum(p) / {points}, 8) AS ap FROM a GROUP BY 1"


@query(_ap_sql(101))
def m09_ap(spark, d):
    return _rounded(metrics.average_precision(_curve(spark, d), "lang"), 8, "ap")


@query(_ap_sql(11))
def w09_ap_11_points(spark, d):
    return _rounded(metrics.average_precision(_curve(spark, d), "lang", 11), 8, "ap")


@query(ctes(e=EVENT, a="SELECT event_type AS kind, value / 1000 AS accuracy, user_id FROM e", o="SELECT kind, avg(1 - accuracy) AS error FROM a GROUP BY 1", r="SELECT kind, avg(1 - accuracy) AS reference FROM a WHERE user_id % 2 = 0 GROUP BY 1") + " SELECT o.kind, round(error, 6) AS error, round(error / reference, 6) AS relative FROM o JOIN r ON o.kind = r.kind")
def m10_mce(spark, d):
    a = view(spark, d, EVENT).select(F.col("event_type").alias("kind"), (F.col("value") / 1000).alias("accuracy"), "user_id")
    return _rounded(metrics.relative_errors(a, a.where("user_id % 2 = 0").select("kind", (1 - F.col("accuracy")).alias("error"))), 6, "error", "relative")


@query(
    ctes(e=EVENT, k="SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM e WHERE value IS NOT NULL")
    + " SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, max(value) FILTER (WHERE i = n // 2) AS p50, max(value) FILTER (WHERE i = round_even(0.95 * (n - 1), 0)) AS p95 FROM k GROUP BY 1"
)
def a22_latency(spark, d):
    return _rounded(metrics.latency(view(spark, d, EVENT), "event_type", "value"), 6, "mean")


_UNIT = "SELECT vec_id, label, embedding AS v FROM embeddings"
_TOP = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, b.vec_id AS neighbour, b.label, round(list_dot_product(q.v, b.v), 9) AS score FROM e q, e b WHERE {where}), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour) AS rank FROM s)"


@query(_TOP.format(where="q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id") + " SELECT query_id, CAST(rank AS INT) AS rank, neighbour, score FROM k WHERE rank <= 20")
def j15_topk_similarity(spark, d):
    """A stated set of queries, every 20th vector, against all others."""
    e = table(spark, d, "embeddings")
    return knn.top_k(e.where("vec_id % 20 = 0"), e, 20)


@query()
def j15_topk_similarity_whole(spark, d):
    """Every vector as a query: exact, so its work is that of all pairs."""
    e = table(spark, d, "embeddings")
    return knn.top_k(e, e, 20)


@query(
    _TOP.format(where="q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id")
    + ", t AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query_id)) / 0.07) AS x FROM k WHERE rank <= 20), w AS (SELECT *, x / sum(x) OVER (PARTITION BY query_id) AS w FROM t), g AS (SELECT query_id, c.k, label, round(sum(w), 9) AS w FROM w, (VALUES (5), (10), (20)) c(k) WHERE rank <= c.k GROUP BY 1, 2, 3) SELECT query_id, CAST(k AS INT) AS k, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY w DESC, label) AS p FROM g) WHERE p = 1"
)
def m11_knn(spark, d):
    e = table(spark, d, "embeddings")
    return knn.vote(knn.top_k(e.where("vec_id % 20 = 0"), e, 20, extra=("label",)), (5, 10, 20))


def _koleo(e):
    # the norm is bound to a column, else each element's division would make it anew; the unit vectors are read once a block
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = bound(e.select("vec_id", "embedding"), {"__norm": norm})
    unit = saved(unit.select("vec_id", F.transform("embedding", lambda x: x.cast("double") / F.col("__norm")).alias("embedding")), "unit")
    return _rounded(knn.nearest_entropy(knn.top_k(unit, unit, 1)), 6, "koleo")


@query("WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings), s AS (SELECT q.vec_id, max(round(list_dot_product(q.v, b.v), 9)) AS score FROM e q, e b WHERE q.vec_id <> b.vec_id GROUP BY 1) SELECT round(-avg(ln(sqrt(greatest(2 - 2 * score, 0)) + 1e-8)), 6) AS koleo FROM s")
def m15_koleo(spark, d):
    return _koleo(table(spark, d, "embeddings"))


@query(ctes(p="SELECT o_orderkey % 50 AS image, CAST(substring(o_orderpriority, 1, 1) AS INT) - 1 AS gt, CAST(o_custkey % 5 AS INT) AS pred FROM orders", n="SELECT image, gt, pred, count(*) AS n FROM p GROUP BY 1, 2, 3", c="SELECT * FROM (VALUES (1), (2), (3), (4)) t(c)", i="SELECT image, c, sum(CASE WHEN gt = c AND pred = c THEN n ELSE 0 END) / sum(n) AS iou FROM n JOIN c ON gt = c OR pred = c GROUP BY 1, 2") + " SELECT image, round(avg(iou), 8) AS miou FROM i GROUP BY 1")
def m03_image_miou(spark, d):
    return _rounded(metrics.image_miou(view(spark, d, PAIR)), 8, "miou")


@query(ctes(p=PAIR, c="SELECT gt, count(*) AS n, sum(CASE WHEN gt = pred THEN 1 ELSE 0 END) AS t FROM p GROUP BY 1") + " SELECT round(sum(t) / sum(n), 8) AS micro, round(avg(t / n), 8) AS macro FROM c")
def m06_micro_macro(spark, d):
    return _rounded(metrics.macro_recall(metrics.confusion(view(spark, d, PAIR))), 8, "micro", "macro")


_LOGIT = "SELECT l_suppkey AS g, l_discount * 40 - 2 AS logit, CASE WHEN l_quantity > 25 THEN 1.0D ELSE 0.0D END AS target FROM lineitem"
_LOGIT_SQL = _LOGIT.replace("1.0D", "CAST(1 AS DOUBLE)").replace("0.0D", "CAST(0 AS DOUBLE)")


@query(ctes(l=_LOGIT_SQL) + " SELECT g, round(1 - (2 * sum(target / (1 + exp(-logit))) + 1) / (sum(1 / (1 + exp(-logit))) + sum(target) + 1), 8) AS dice_loss FROM l GROUP BY 1")
def x24_dice_loss(spark, d):
    return _rounded(metrics.dice_loss(view(spark, d, _LOGIT), ("g",)), 8, "dice_loss")


@query(ctes(l=_LOGIT_SQL) + " SELECT g, round(avg(greatest(logit, 0) - logit * target + ln(1 + exp(-abs(logit)))), 8) AS bce FROM l GROUP BY 1")
def x29_logistic_loss(spark, d):
    return _rounded(metrics.logistic_loss(view(spark, d, _LOGIT), ("g",)), 8, "bce")


@query("SELECT event_type, arg_min(user_id, (-m, user_id)) AS user_id, max(m) AS value FROM (SELECT event_type, user_id, max(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def m18_best(spark, d):
    best = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.max("value").alias("value"))
    return metrics.best_of(best, "event_type", "value", "user_id").select("event_type", "user_id", "value")


@query("SELECT round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std FROM events")
def a19_tries(spark, d):
    return _rounded(metrics.tries(table(spark, d, "events"), ("value",)), 6, "value_mean", "value_std")
