"""Queries over samples, series, annotations, images, results and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import annotations, images, sampling, series
from cairn.plans.registry import query
from cairn.plans.views import EVENT, OBS, ctes, table, view
from cairn.sources import results
from cairn.streaming import votes as streams


def _rounded(df, n, *names):
    return df.select(*(F.round(c, n).alias(c) if c in names else c for c in df.columns))


@query(
    ctes(e=EVENT)
    + """, k AS (SELECT id, user_id, value, round(avg(value) OVER w, 10) AS recent_mean, list(value) OVER w AS vs, round(avg(value) OVER g, 10) AS global_mean FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING))
    SELECT id, user_id, recent_mean, list_sort(vs)[(len(vs) + 1) // 2] AS recent_median, global_mean FROM k"""
)
def w06_smoothed(spark, d):
    out = series.smoothed(view(spark, d, EVENT), "user_id", ("ts", "id"), "value").select("id", "user_id", "recent_mean", "recent_median", "global_mean")
    return _rounded(out, 10, "recent_mean", "global_mean")


@query(ctes(e=EVENT) + " SELECT * FROM (SELECT id, user_id, id * 512 AS start_offset, lead(id) OVER (PARTITION BY user_id ORDER BY ts, id) * 512 AS end_offset FROM e) WHERE end_offset IS NOT NULL")
def w07_lead_pairs(spark, d):
    return annotations.next_pairs(view(spark, d, EVENT), "user_id", ("ts", "id"), "id", 512).select("id", "user_id", "start_offset", "end_offset")


@query("SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 3")
def u04_intersect(spark, d):
    return annotations.having_all(table(spark, d, "orders"), "o_custkey", "o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM"))


@query("SELECT o_orderkey AS vid, 'orders' AS part FROM orders UNION ALL SELECT p_partkey + (SELECT count(*) FROM orders), 'part' FROM part")
def u01_concat_offset(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("vid"), F.lit("orders").alias("part"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("vid"), F.lit("part").alias("part"))
    faces = [x.select(F.col("vid").alias("a"), F.col("vid").alias("b"), F.col("vid").alias("c")) for x in (o, p)]
    return annotations.offset_union([(o, faces[0]), (p, faces[1])])[0]


@query("WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position FROM conversations) SELECT conv_id, CAST(position AS INT) AS position, turn, role, length(text) AS chars FROM c")
def s19_captions(spark, d):
    turns = table(spark, d, "conversations")
    return annotations.flattened(annotations.collected(turns, "conv_id", ("turn", "role", "text"), ("turn", "role", "text"))).select("conv_id", "position", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || ',\"type\":\"' || event_type || '\"}' AS again FROM events")
def x28_json(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    return e.select("event_id", "p.k", F.to_json(F.struct("p.k", F.col("event_type").alias("type"))).alias("again"))


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 25")
def t09_stratified(spark, d):
    return sampling.per_class(table(spark, d, "documents").select("doc_id", "lang"), 25, "lang", "doc_id", 3)


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('4:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE k <= greatest(1, floor(n * 0.1))")
def t09_percent(spark, d):
    return sampling.share_per_class(table(spark, d, "documents").select("doc_id", "lang"), 0.1, "lang", "doc_id", 4)


@query("SELECT doc_id, CASE WHEN k <= floor(n * 0.1) AND n > 1 THEN 'val' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('5:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def t09_split(spark, d):
    return sampling.split(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 0.1, 5).select("doc_id", "part")


@query("SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS place FROM documents) WHERE place % 4 = 1")
def t03_epoch_shard(spark, d):
    return sampling.epoch_shard(table(spark, d, "documents").select("doc_id"), "doc_id", 7, 1, 4).select("doc_id", "place")


@query("WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('9:' || doc_id), doc_id) - 1 AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, place % 6 AS shard, row_number() OVER (PARTITION BY place % 6 ORDER BY md5('9:' || (place % 6) || ':' || doc_id), doc_id) - 1 AS slot FROM p WHERE place < floor(n / 6) * 6")
def t05_shards(spark, d):
    return sampling.even_shards(table(spark, d, "documents").select("doc_id"), "doc_id", 9, 6).select("doc_id", "shard", "slot")


@query("WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('2:' || doc_id), doc_id) - 1 AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, CAST(floor(place / 64) AS BIGINT) AS batch FROM p WHERE floor(place / 64) < floor(n / 64)")
def t06_batches(spark, d):
    return sampling.batches(table(spark, d, "documents").select("doc_id"), "doc_id", 2, 64).select("doc_id", "batch")


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(NULL AS DOUBLE) AS balance FROM nation UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def k07_results(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return results.stacked(n, s)


@query("SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS index FROM (SELECT DISTINCT event_type FROM events)")
def a31_class_index(spark, d):
    return annotations.dense_index(table(spark, d, "events"), "event_type")


_PIXEL = "SELECT l_suppkey AS image, l_partkey % 5 AS instance, CAST(l_linenumber AS INT) AS x, CAST(l_quantity AS INT) AS y, CAST(l_partkey % 5 AS INT) AS category FROM lineitem"


@query(ctes(p=_PIXEL) + ' SELECT image, instance, count(*) AS area, min(x) AS bx, min(y) AS "by", max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh, min(category) = max(category) AS one_category FROM p GROUP BY 1, 2')
def a21_instance_areas(spark, d):
    return annotations.instance_areas(view(spark, d, _PIXEL))


@query("WITH m AS (SELECT n_nationkey AS f, n_regionkey * 10 AS t FROM nation WHERE n_nationkey % 5 <> 0) SELECT c_custkey, CAST(coalesce(t, -1) AS INT) AS c_nationkey FROM customer LEFT JOIN m ON c_nationkey = f")
def j07_remap(spark, d):
    m = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("from_id"), (F.col("n_regionkey") * 10).alias("to_id"))
    return annotations.remapped(table(spark, d, "customer").select("c_custkey", "c_nationkey"), m, "c_nationkey", default=-1)


_GRID = "SELECT frame, y, x, min(label) AS label FROM (SELECT l_suppkey % 8 AS frame, CAST(l_partkey % 16 AS INT) AS y, CAST(l_orderkey % 16 AS INT) AS x, CAST(l_suppkey % 3 AS INT) AS label FROM lineitem) GROUP BY 1, 2, 3"


@query(ctes(g=_GRID) + ", a AS (SELECT p.frame, p.y, p.x, min(q.label) AS lo, max(q.label) AS hi FROM g p JOIN g q ON p.frame = q.frame AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY 1, 2, 3) SELECT g.frame, g.y, g.x, CASE WHEN lo = hi THEN label END AS label FROM g JOIN a ON g.frame = a.frame AND g.y = a.y AND g.x = a.x")
def p12_boundary_ignore(spark, d):
    return images.boundary_ignored(_grid(spark, d))


@query(ctes(g=_GRID) + " SELECT g.frame, n.y, m.x, label FROM g JOIN (SELECT CAST(i AS INT) AS y, CAST(i * 16 // 24 AS INT) AS o FROM range(24) t(i)) n ON g.y = n.o JOIN (SELECT CAST(i AS INT) AS x, CAST(i * 16 // 10 AS INT) AS o FROM range(10) t(i)) m ON g.x = m.o")
def x19_resize(spark, d):
    return images.resized(_grid(spark, d), (16, 16), (24, 10))


def _grid(spark, d):
    return view(spark, d, _GRID)


@query(ctes(o=OBS) + " SELECT frame, py AS y, px AS x, round((px - 3.5) * (depth / 12000) / 500, 12) AS a, round((py - 50) * (depth / 12000) / 500, 12) AS b, depth / 12000 AS pz FROM o WHERE depth > 0 AND depth / 12000 < 5")
def p05_backproject(spark, d):
    pixels = view(spark, d, OBS).select("frame", F.col("py").alias("y"), F.col("px").alias("x"), (F.col("depth") / 12000).alias("depth"))
    return images.backprojected(pixels, 500, 500, 3.5, 50, 5.0).select("frame", "y", "x", F.round("px", 12).alias("a"), F.round("py", 12).alias("b"), "pz")


@query(ctes(o=OBS) + ", n AS (SELECT py % 10 AS frame, px AS y, label AS x, count(*) AS n FROM o GROUP BY 1, 2, 3) SELECT frame, y, x, n, round(n / max(n) OVER (PARTITION BY frame), 8) AS share FROM n")
def a29_density(spark, d):
    points = view(spark, d, OBS).select((F.col("py") % 10).alias("frame"), F.col("px").alias("y"), F.col("label").alias("x"))
    return _rounded(images.density(points), 8, "share")


@query(ctes(e=EVENT) + ", k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM e) SELECT event_type, round(sum(pow(0.9, CAST(n - i AS DOUBLE)) * 0.1 * value), 6) AS state FROM k GROUP BY 1")
def c11_ema(spark, d):
    from pyspark.sql import Window as W

    e = view(spark, d, EVENT).withColumn("i", F.row_number().over(W.partitionBy("event_type").orderBy("ts", "id")))
    return _rounded(series.exponential_mean(e, "event_type", "i", "value", 0.9), 6, "state")


def _sinkhorn_sql() -> str:
    steps, last = [], "q0"
    for i in range(3):
        steps.append(f"c{i} AS (SELECT r, c, q / sum(q) OVER (PARTITION BY c) / (SELECT count(DISTINCT c) FROM q0) AS q FROM {last})")
        steps.append(f"q{i + 1} AS (SELECT r, c, q / sum(q) OVER (PARTITION BY r) / (SELECT count(DISTINCT r) FROM q0) AS q FROM c{i})")
        last = f"q{i + 1}"
    return f"WITH s AS (SELECT l_returnflag AS r, l_linenumber AS c, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), q0 AS (SELECT r, c, exp((v - (SELECT max(v) FROM s)) / 2.0) AS q FROM s), {', '.join(steps)} SELECT r, c, round(q / sum(q) OVER (PARTITION BY r), 8) AS q FROM {last}"


@query(_sinkhorn_sql())
def c10_sinkhorn(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("r"), F.col("l_linenumber").alias("c")).agg(F.avg("l_quantity").alias("v"))
    return _rounded(series.sinkhorn(s, "r", "c", "v", 2.0).select("r", "c", "q"), 8, "q")


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return streams.tumbling(e, "at", "6 hours", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 8 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT min(ts) AS start, max(ts) + INTERVAL 8 HOURS AS finish, user_id, count(*) AS n FROM g GROUP BY user_id, g"
)
def ext_session(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return streams.sessions(e, "at", "8 hours", "user_id").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "finish")})
