"""Queries over masks: polygons to runs, masks of videos, panoptic contests of pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import annotations, batches, losses, masks, panoptic
from cairn.operators.colouring import bound
from cairn.plans.registry import query
from cairn.plans.views import ctes, view

WIDTH, HEIGHT = 24, 16
_COORDS = (
    "p_partkey % 29 - 2", "p_partkey % 17 - 1", "p_partkey * 7 % 29 - 2", "p_partkey * 5 % 19 - 1", "p_partkey * 13 % 31 - 2.75", "p_partkey * 11 % 18", "p_partkey * 3 % 27", "p_partkey * 17 % 20 - 2",
)
_MORE = ("p_size % 20", "p_size * 3 % 14", "p_size % 20 + 5.5", "p_size * 3 % 14", "p_size % 20 + 2", "p_size * 3 % 14 + 4.5")


def _coords(which) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE)" for c in which)


#: A polygon for each part, which may cross itself and leave the image, and a second one for a third of them.
POLYGON = {
    "spark": f"SELECT p_partkey AS id, array({_coords(_COORDS)}) AS coords, {HEIGHT} AS height, {WIDTH} AS width FROM part UNION ALL SELECT p_partkey, array({_coords(_MORE)}), {HEIGHT}, {WIDTH} FROM part WHERE p_partkey % 3 = 0",
    "sql": f"SELECT p_partkey AS id, 0 AS k, [{_coords(_COORDS)}] AS coords FROM part UNION ALL SELECT p_partkey, 1, [{_coords(_MORE)}] FROM part WHERE p_partkey % 3 = 0",
}
#: Every pixel whose centre lies in a polygon: an odd number of its edges pass to the right of it.
_IN_POLYGON = dict(
    g=POLYGON,
    e="SELECT id, k, coords[2 * i + 2] AS a0, coords[2 * i + 1] AS l0, coords[2 * ((i + 1) % n) + 2] AS a1, coords[2 * ((i + 1) % n) + 1] AS l1 FROM (SELECT *, len(coords) // 2 AS n FROM g) z, range(4) r(i) WHERE i < n",
    x=f"SELECT id, k, c.i AS x, r.i AS y, count(*) AS n FROM e, range({WIDTH}) c(i), range({HEIGHT}) r(i) WHERE (l0 > c.i + 0.5) <> (l1 > c.i + 0.5) AND r.i + 0.5 < a0 + (c.i + 0.5 - l0) * (a1 - a0) / (l1 - l0) GROUP BY 1, 2, 3, 4",
    px="SELECT DISTINCT id, x, y FROM x WHERE n % 2 = 1",
)


@query(
    ctes(**_IN_POLYGON, o=f"SELECT *, x * {HEIGHT} + y AS place, lag(x * {HEIGHT} + y) OVER (PARTITION BY id ORDER BY x, y) AS before FROM px", s="SELECT id, count(*) AS area, sum(CASE WHEN before = place - 1 THEN 0 ELSE 1 END) AS n_runs, min(place) AS first, min(x) AS box_x, min(y) AS box_y, max(x) - min(x) + 1 AS box_w, max(y) - min(y) + 1 AS box_h, md5(string_agg(CAST(place AS VARCHAR), ',' ORDER BY place)) AS places FROM o GROUP BY id")
    + " SELECT p_partkey AS id, coalesce(area, 0) AS area, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, first, CAST(coalesce(box_x, 0) AS BIGINT) AS box_x, CAST(coalesce(box_y, 0) AS BIGINT) AS box_y, CAST(coalesce(box_w, 0) AS BIGINT) AS box_w, CAST(coalesce(box_h, 0) AS BIGINT) AS box_h, coalesce(places, md5('')) AS places FROM part LEFT JOIN s ON p_partkey = id"
)
def x13_polygons(spark, d):
    """Masks of polygons: pixels, runs and boxes, after a way through the compressed form."""
    runs = masks.polygon_runs(view(spark, d, POLYGON), ["id"])
    size = F.col("height") * F.col("width")
    # each is made once, however often it is referred to
    text = bound(runs, {"text": masks.compressed(masks.counts(F.col("runs"), size))}).drop("runs")
    back = bound(text, {"runs": masks.from_counts(masks.decompressed(F.col("text")))}).withColumn("box", masks.run_box(F.col("runs"), F.col("height")))
    places = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["len"] - 1)))
    return back.select("id", masks.run_area(F.col("runs")).alias("area"), F.size("runs").cast("long").alias("n_runs"), F.get("runs", F.lit(0))["start"].alias("first"), F.col("box.x").alias("box_x"), F.col("box.y").alias("box_y"), F.col("box.width").alias("box_w"), F.col("box.height").alias("box_h"), F.md5(F.array_join(places.cast("array<string>"), ",")).alias("places"))


@query(
    ctes(**_IN_POLYGON, v="SELECT id // 40 AS video, id // 8 % 5 AS frame, id % 8 AS track, x, y FROM px", i="SELECT a.video, a.track AS left, b.track AS right, count(*) AS n FROM v a JOIN v b ON a.video = b.video AND a.frame = b.frame AND a.x = b.x AND a.y = b.y AND a.track < 4 AND b.track >= 4 GROUP BY 1, 2, 3", z="SELECT video, track, count(*) AS n FROM v GROUP BY 1, 2")
    + " SELECT i.video, i.left, i.right, round(CAST(i.n AS DOUBLE) / (a.n + b.n - i.n), 9) AS iou FROM i JOIN z a ON a.video = i.video AND a.track = i.left JOIN z b ON b.video = i.video AND b.track = i.right"
)
def m20_video_overlaps(spark, d):
    """Tracks of masks over the frames of videos, from polygons: the overlap of each found and known track that meet."""
    from cairn.operators import evaluators

    runs = masks.polygon_runs(view(spark, d, POLYGON), ["id"])
    video = runs.select(F.floor(F.col("id") / 40).alias("video"), F.lit(0).alias("category"), (F.col("id") % 8).alias("id"), (F.floor(F.col("id") / 8) % 5).alias("frame"), "runs")
    tracks = evaluators.over_time(video, WIDTH * HEIGHT)
    found = annotations.run_iou(tracks.where("id < 4"), tracks.where("id >= 4"), ("video",))
    return found.select("video", "left", "right", F.round("iou", 9).alias("iou"))


# eight queries an image: a disk each, and logits of four classes and of none
_LOGITS = " UNION ALL ".join(f"SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS image, p_partkey % 8 AS query, {c} AS class, CAST(p_partkey * {7 + 3 * c} % 13 AS DOUBLE) / {2.0 if c < 4 else 4.0} + CAST(p_partkey % {97 + c} AS DOUBLE) / 100 AS logit FROM part" for c in range(5))
_DISK = "CAST(36 - (px - p_partkey * 5 % {w}) * (px - p_partkey * 5 % {w}) - (py - p_partkey * 3 % {h}) * (py - p_partkey * 3 % {h}) + p_size % 11 AS DOUBLE) / 10"
CLASSES = _LOGITS
MASKS = {
    "spark": f"SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS image, p_partkey % 8 AS query, py AS y, px AS x, {_DISK.format(w=WIDTH, h=HEIGHT)} AS logit FROM part LATERAL VIEW explode(sequence(0, {WIDTH - 1})) a AS px LATERAL VIEW explode(sequence(0, {HEIGHT - 1})) b AS py",
    "sql": f"SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS image, p_partkey % 8 AS query, py, px, py AS y, px AS x, {_DISK.format(w=WIDTH, h=HEIGHT)} AS logit FROM part, range({WIDTH}) a(px), range({HEIGHT}) b(py)",
}
#: What the masks are dealt over tasks by: all of an image are in one.
BY_IMAGE = "CAST(floor(p_partkey / 8) AS BIGINT)"
_THINGS = (0, 2)
_SHARES = dict(
    c=CLASSES, m=MASKS,
    h="SELECT *, exp(logit - max(logit) OVER (PARTITION BY image, query)) AS ex FROM c",
    f="SELECT *, ex / sum(ex) OVER (PARTITION BY image, query) AS share FROM h",
)
_SURE = dict(
    **_SHARES,
    b="SELECT image, query, class AS category, share AS score FROM (SELECT *, row_number() OVER (PARTITION BY image, query ORDER BY share DESC, class) AS n FROM f) z WHERE n = 1",
    k="SELECT * FROM b WHERE category <> 4 AND score > 0.5",
    p="SELECT m.image, m.query, y, x, score, 1 / (1 + exp(-logit)) AS value FROM m JOIN k ON m.image = k.image AND m.query = k.query",
    w="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, y, x ORDER BY score * value DESC, query) AS n FROM p) z WHERE n = 1",
    t="SELECT image, query, count(*) FILTER (value >= 0.5) AS whole FROM p GROUP BY 1, 2",
    q="SELECT image, query, count(*) AS won, count(*) FILTER (value >= 0.5) AS kept FROM w GROUP BY 1, 2",
    j="SELECT q.image, q.query, kept, category, category IN (0, 2) AS thing FROM q JOIN t ON q.image = t.image AND q.query = t.query JOIN k ON q.image = k.image AND q.query = k.query WHERE kept > 0 AND CAST(won AS DOUBLE) / whole >= 0.3",
    o="SELECT *, CASE WHEN thing THEN query ELSE min(query) OVER (PARTITION BY image, category, thing) END AS first FROM j",
    s="SELECT *, dense_rank() OVER (PARTITION BY image ORDER BY first) AS segment FROM o",
)


@query(ctes(**_SURE) + " SELECT i.image, i.y, i.x, CAST(coalesce(s.segment, 0) AS INT) AS segment FROM (SELECT DISTINCT image, y, x FROM m) i LEFT JOIN w ON w.image = i.image AND w.y = i.y AND w.x = i.x AND w.value >= 0.5 LEFT JOIN s ON s.image = w.image AND s.query = w.query")
def f05_panoptic(spark, d):
    """Pixels with the segment that won them."""
    return panoptic.panoptic(view(spark, d, CLASSES), view(spark, d, MASKS, BY_IMAGE), 4, _THINGS, 0.5, 0.3)[0]


@query(ctes(**_SURE) + " SELECT image, CAST(segment AS INT) AS segment, CAST(min(category) AS INT) AS category, any_value(thing) AS thing, CAST(sum(kept) AS BIGINT) AS area FROM s GROUP BY 1, 2")
def f05_segments(spark, d):
    """Segments of images: class, kind and pixels."""
    return panoptic.panoptic(view(spark, d, CLASSES), view(spark, d, MASKS, BY_IMAGE), 4, _THINGS, 0.5, 0.3)[1]


@query(ctes(**_SHARES, u="SELECT m.image, y, x, class, round(sum(share / (1 + exp(-m.logit))), 9) AS vote FROM m JOIN f ON m.image = f.image AND m.query = f.query WHERE class <> 4 GROUP BY 1, 2, 3, 4") + " SELECT image, y, x, CAST(class AS INT) AS category FROM (SELECT *, row_number() OVER (PARTITION BY image, y, x ORDER BY vote DESC, class) AS n FROM u) z WHERE n = 1")
def f05_semantic(spark, d):
    """The class of every pixel by all queries' shares."""
    return panoptic.semantic(view(spark, d, CLASSES), view(spark, d, MASKS, BY_IMAGE), 4)


@query(ctes(**_SHARES, n="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY share DESC, query, class) AS n FROM f WHERE class <> 4) z WHERE n <= 5", a="SELECT image, query, count(*) FILTER (logit > 0) AS area, coalesce(sum(CASE WHEN logit > 0 THEN 1 / (1 + exp(-logit)) END), 0) AS total FROM m GROUP BY 1, 2") + " SELECT n.image, n.query, CAST(class AS INT) AS category, round(share, 9) AS score, area, round(total / (area + 1e-6), 9) AS mask_score, round(share * (total / (area + 1e-6)), 9) AS final FROM n JOIN a ON n.image = a.image AND n.query = a.query WHERE class IN (0, 2)")
def f05_instances(spark, d):
    """The best (query, class) of each image with the mean value within their masks."""
    found = panoptic.instances(view(spark, d, CLASSES), view(spark, d, MASKS, BY_IMAGE), 4, 5, _THINGS)
    return found.select("image", "query", "category", F.round("score", 9).alias("score"), "area", F.round("mask_score", 9).alias("mask_score"), F.round("final", 9).alias("final"))


# masks along rows, and for each the radius of its ellipse and the offsets within
_SHRUNK = dict(
    g=POLYGON,
    e=_IN_POLYGON["e"],
    x=f"SELECT id, k, c.i AS x, r.i AS y, count(*) AS n FROM e, range({WIDTH}) c(i), range({HEIGHT}) r(i) WHERE (a0 > r.i + 0.5) <> (a1 > r.i + 0.5) AND c.i + 0.5 < l0 + (r.i + 0.5 - a0) * (l1 - l0) / (a1 - a0) GROUP BY 1, 2, 3, 4",
    px=_IN_POLYGON["px"],
    ar="SELECT id, count(*) AS area, greatest(1, CAST(floor(sqrt(count(*)) * 0.2) AS BIGINT)) AS r FROM px GROUP BY 1",
    o="SELECT r.i AS r, y.i - 8 AS dy, x.i - 8 AS dx FROM range(1, 8) r(i), range(17) y(i), range(17) x(i) WHERE abs(y.i - 8) <= r.i AND abs(x.i - 8) <= round_even(sqrt(r.i * r.i - (y.i - 8) * (y.i - 8)), 0)",
    t=f"SELECT p.id, p.x, p.y, count(*) AS asked, count(q.id) AS met FROM px p JOIN ar ON ar.id = p.id AND area >= 20 JOIN o ON o.r = ar.r AND p.x + dx >= 0 AND p.x + dx < {WIDTH} AND p.y + dy >= 0 AND p.y + dy < {HEIGHT} LEFT JOIN px q ON q.id = p.id AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY 1, 2, 3",
    k="SELECT id, x, y FROM t WHERE asked = met",
    f="SELECT id, x, y FROM k UNION ALL SELECT id, x, y FROM px WHERE id NOT IN (SELECT id FROM k)",
)


@query(ctes(("px", "t", "k"), **_SHRUNK) + f" SELECT id, count(*) AS area, md5(string_agg(CAST(y * {WIDTH} + x AS VARCHAR), ',' ORDER BY y, x)) AS places FROM f GROUP BY id")
def p13_ellipse(spark, d):
    """Masks shrunk by an ellipse that grows with them."""
    runs = masks.polygon_runs(view(spark, d, POLYGON), ["id"], by_columns=False)
    out = masks.eroded(runs, ["id"], 0.2)
    places = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["len"] - 1)))
    return out.where(F.size("runs") > 0).select("id", masks.run_area(F.col("runs")).alias("area"), F.md5(F.array_join(places.cast("array<string>"), ",")).alias("places"))


# depths of a small image for each supplier, some of them not valid
_DEPTHS = {
    "spark": "SELECT s_suppkey AS image, y, x, 1 + CAST((x * 7 + y * 11 + s_suppkey) % 17 AS DOUBLE) / 4 AS gt, 1 + CAST((x * 5 + y * 13 + s_suppkey * 3) % 19 AS DOUBLE) / 4 AS pred, (x + y + s_suppkey) % 7 > 0 AS valid, CAST((x * 3 + y * 5 + s_suppkey) % 23 - 11 AS DOUBLE) / 4 AS logit FROM supplier LATERAL VIEW explode(sequence(0, 15)) a AS x LATERAL VIEW explode(sequence(0, 12)) b AS y",
    "sql": "SELECT s_suppkey AS image, y, x, 1 + CAST((x * 7 + y * 11 + s_suppkey) % 17 AS DOUBLE) / 4 AS gt, 1 + CAST((x * 5 + y * 13 + s_suppkey * 3) % 19 AS DOUBLE) / 4 AS pred, (x + y + s_suppkey) % 7 > 0 AS valid, CAST((x * 3 + y * 5 + s_suppkey) % 23 - 11 AS DOUBLE) / 4 AS logit FROM supplier, range(16) a(x), range(13) b(y)",
}


@query(ctes(d=_DEPTHS) + " SELECT image, round(sqrt(0.15 * avg(ln(pred + 0.001) - ln(gt + 0.001)) * avg(ln(pred + 0.001) - ln(gt + 0.001)) + var_samp(ln(pred + 0.001) - ln(gt + 0.001))), 8) AS loss FROM d WHERE valid GROUP BY 1")
def x29_scale_invariant(spark, d):
    return losses.scale_invariant(view(spark, d, _DEPTHS), ["image"], valid="valid").withColumn("loss", F.round("loss", 8))


@query(ctes(d=_DEPTHS, k="SELECT unnest([1, 2, 4, 6]) AS k", g="SELECT image, k, y // k AS y, x // k AS x, pred - gt AS d FROM d, k WHERE valid AND y % k = 0 AND x % k = 0", c="SELECT a.image, a.k, sum(abs(a.d - b.d)) AS s FROM g a JOIN g b ON a.image = b.image AND a.k = b.k AND ((a.x = b.x AND a.y + 2 = b.y) OR (a.y = b.y AND a.x + 2 = b.x)) GROUP BY 1, 2", n="SELECT image, k, count(*) AS n FROM g GROUP BY 1, 2") + " SELECT image, round(sum(coalesce(s, 0) / n), 8) AS loss FROM n LEFT JOIN c USING (image, k) GROUP BY 1")
def x29_gradient(spark, d):
    return losses.gradient(view(spark, d, _DEPTHS), ["image"], valid="valid").withColumn("loss", F.round("loss", 8))


@query(ctes(d=_DEPTHS, h="SELECT image, y, x, logit, md5('5:' || image || ':' || y || ':' || x) AS h FROM d", r="SELECT *, row_number() OVER (PARTITION BY image ORDER BY h, y, x) AS n FROM h", c="SELECT *, row_number() OVER (PARTITION BY image, n <= 60 ORDER BY abs(logit), h, y, x) AS c FROM r WHERE n <= 65") + " SELECT image, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CASE WHEN n > 60 THEN 'random' ELSE 'uncertain' END AS kind FROM c WHERE n > 60 OR c <= 15")
def x29_uncertain_points(spark, d):
    return losses.uncertain_points(view(spark, d, _DEPTHS).select("image", "y", "x", "logit"), ["image"], 20, seed=5).select("image", "y", "x", "kind")


@query("WITH i AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 > o_orderkey % 5 THEN 0 ELSE 1 END AS bucket FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('3:' || id), id) - 1 AS i FROM i), b AS (SELECT id, bucket, i // 16 AS batch, i % 16 AS slot FROM n), f AS (SELECT bucket, batch FROM b GROUP BY 1, 2 HAVING count(*) = 16) SELECT b.id, b.bucket, b.batch, CAST(slot AS INT) AS slot FROM b JOIN f USING (bucket, batch)")
def t16_aspect_batches(spark, d):
    """Batches of upright and of wide images."""
    images = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("width"), (F.col("o_orderkey") % 5).alias("height"))
    return batches.by_aspect(images, 16, 3).select("id", "bucket", "batch", "slot")


@query("WITH n AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY md5('3:' || o_orderkey), o_orderkey) - 1 AS i FROM orders), b AS (SELECT id, i // 32 AS batch, i % 32 AS slot FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY md5('4:' || batch || ':' || id), id, slot) AS p, floor(count(*) OVER (PARTITION BY batch) * 0.5) AS k FROM b) SELECT id, batch, CAST(slot AS INT) AS slot, CAST(CASE WHEN p <= k THEN floor(196 * (0.1::DOUBLE + (0.5::DOUBLE - 0.1::DOUBLE) * p / k)) ELSE 0 END AS INT) AS masked FROM p")
def t13_mask_sizes(spark, d):
    """How many tokens of each sample of a batch are masked."""
    rows = batches.shuffled(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id")), 32, 3)
    return batches.mask_sizes(rows, 196, (0.1, 0.5), 0.5, 4).select("id", "batch", "slot", "masked")
