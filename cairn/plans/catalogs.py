"""Queries over datasets' small steps: chains, subsets, labels, ids, profiles, hulls, curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.operators import catalogs, evaluators, metrics, profiles, sampling
from cairn.plans.registry import query
from cairn.plans.views import EVENT, PAIR, PALETTE, POINT, RGB, ctes, table, view


@query("SELECT DISTINCT c_custkey AS o_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u05_unknown_ids(spark, d):
    """Customers without orders: keys of the one table that the other doesn't know."""
    return catalogs.unknown_ids(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), table(spark, d, "orders").select("o_custkey").distinct(), "o_custkey")


@query("SELECT CAST(c_custkey AS BIGINT) AS key, 'customer' AS dataset FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def u07_chained(spark, d):
    return catalogs.chained({t: table(spark, d, t).select(F.col(k).cast("long").alias("key")) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"))})


@query("SELECT o_custkey, o_clerk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_clerk) - 1 AS dense FROM (SELECT DISTINCT o_custkey, o_orderkey % 17 AS o_clerk FROM orders)")
def u09_dense_ids(spark, d):
    return catalogs.dense_ids(table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 17).alias("o_clerk")), "o_custkey", "o_clerk")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 > 0 THEN p_size END AS target FROM part")
def p23_targets(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("class_index"), F.when(F.col("p_size") % 3 == 0, "test").otherwise("train").alias("split"))
    return catalogs.targets(rows).select("id", "target")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def p24_subset(spark, d):
    chosen = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return catalogs.subset(table(spark, d, "orders").select("o_orderkey", "o_custkey"), chosen, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey AS frame, l_linenumber AS x, l_partkey % 256 AS label, CASE WHEN l_partkey % 256 IN (0, 255) THEN 255 ELSE l_partkey % 256 - 1 END AS reduced, (l_partkey % 256 + 255) % 256 AS wrapped FROM lineitem WHERE l_linenumber >= 2 AND l_linenumber < 5 AND l_quantity >= 10 AND l_quantity < 30")
def p25_labels_inside(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("y"), (F.col("l_partkey") % 256).alias("label"))
    kept = catalogs.inside(rows, 10, 30, 2, 5)
    return kept.select("frame", "x", "label", catalogs.zero_reduced(F.col("label")).alias("reduced"), catalogs.wrapped(F.col("label")).alias("wrapped"))


@query("WITH s AS (SELECT n_nationkey % 5 AS image, n_nationkey * 3 + 256 * (n_nationkey % 7) AS segment, n_regionkey AS category FROM nation), p AS (SELECT p_partkey AS y, p_size AS x, p_partkey % 5 AS image, p_partkey % 25 * 3 AS r, p_partkey % 25 % 7 AS g, 0 AS b FROM part) SELECT p.image, y, x, coalesce(category, 255) AS category FROM p LEFT JOIN s ON p.image = s.image AND r + 256 * g + 65536 * b = segment")
def x27_segments(spark, d):
    s = table(spark, d, "nation").select((F.col("n_nationkey") % 5).alias("image"), (F.col("n_nationkey") * 3 + 256 * (F.col("n_nationkey") % 7)).alias("segment"), F.col("n_regionkey").alias("category"))
    n = F.col("p_partkey") % 25
    p = table(spark, d, "part").select((F.col("p_partkey") % 5).alias("image"), F.col("p_partkey").alias("y"), F.col("p_size").alias("x"), (n * 3).alias("r"), (n % 7).alias("g"), F.lit(0).alias("b"))
    return catalogs.mapped_segments(p, s)


@query(ctes(q=PALETTE) + " SELECT o_orderkey AS id, CAST(o_custkey % 40 AS INT) AS label, coalesce(r, 1) AS r, coalesce(g, 2) AS g, coalesce(b, 3) AS b FROM orders LEFT JOIN q ON o_custkey % 40 = class_id")
def p20_painted(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).cast("int").alias("label"))
    return catalogs.painted(rows, view(spark, d, PALETTE), (1, 2, 3))


@query("SELECT p_partkey AS id, CAST(least(greatest(round_even(p_size / 40.0 * 255, 0), 0), 255) AS INT) AS byte FROM part")
def x04_channel(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), catalogs.channel(F.col("p_size") / F.lit(40.0)).alias("byte"))


@query("SELECT p_partkey AS id, 'n' || lpad(CAST(p_size AS VARCHAR), 4, '0') AS class_id, p_partkey AS number, CASE WHEN p_partkey % 2 = 0 THEN 'n' || lpad(CAST(p_size AS VARCHAR), 4, '0') || '/n' || lpad(CAST(p_size AS VARCHAR), 4, '0') || '_' || p_partkey || '.JPEG' ELSE 'ILSVRC2012_val_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.JPEG' END AS path FROM part")
def x21_image_paths(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("n"), F.lpad(F.col("p_size").cast("string"), 4, "0")).alias("c"), F.when(F.col("p_partkey") % 2 == 0, "train").otherwise("val").alias("split"))
    path = catalogs.image_path(F.col("split"), F.col("c"), F.col("id"))
    name, number = catalogs.image_parts(F.concat("c", F.lit("/"), "c", F.lit("_"), F.col("id").cast("string"), F.lit(".JPEG")))
    return p.select("id", name.alias("class_id"), number.alias("number"), path.alias("path"))


@query("SELECT event_type AS name, round(avg(value), 6) AS value FROM events GROUP BY 1")
def a20_reduced(spark, d):
    return catalogs.reduced(table(spark, d, "events").select(F.col("event_type").alias("name"), "value")).withColumn("value", F.round("value", 6))


@query("SELECT p_size AS class_index, arg_max(p_brand, p_partkey) AS class_id, arg_max(p_name, p_partkey) AS class_name FROM part GROUP BY 1")
def a30_class_names(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("class_index"), F.col("p_brand").alias("class_id"), F.col("p_name").alias("class_name"))
    return catalogs.class_names(rows)


@query("SELECT label, p_partkey AS index FROM part, unnest([p_size % 3, 3 + p_size % 2]) t(label)")
def a18_class_members(spark, d):
    rows = table(spark, d, "part").select(F.array(F.col("p_size") % 3, 3 + F.col("p_size") % 2).alias("labels"), F.col("p_partkey").alias("index"))
    return catalogs.class_members(rows)


_FLAT = "SELECT l_orderkey % 500 AS image, l_partkey % 600 AS place, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2"


@query(ctes(f=_FLAT) + " SELECT image, CAST(rank AS INT) AS rank, CAST(place // 6 AS BIGINT) AS query, place % 6 AS class, score FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, place) AS rank FROM f) WHERE rank <= 10")
def o05_best_queries(spark, d):
    return catalogs.best_queries(view(spark, d, _FLAT), 10, 6)


@query("WITH c AS (SELECT p_brand AS category, CAST(sum(p_size % 4) AS BIGINT) AS n FROM part GROUP BY 1) SELECT category, n, round(n / (SELECT sum(n) FROM c), 8) AS share FROM c WHERE n > 0 ORDER BY n DESC, category LIMIT 15")
def o07_largest_shares(spark, d):
    """The fifteen largest: a report."""
    counts = table(spark, d, "part").groupBy(F.col("p_brand").alias("category")).agg(F.sum(F.col("p_size") % 4).cast("long").alias("n"))
    return catalogs.largest_shares(counts, 15).withColumn("share", F.round("share", 8))


_SEG = "SELECT l_suppkey % 20 AS frame, CAST(l_linenumber AS INT) AS y, l_orderkey AS x, CAST(l_partkey % 9 - 1 AS INT) AS label, CASE WHEN l_quantity > 20 THEN l_partkey % 30 END AS instance FROM lineitem"


@query(ctes(s=_SEG, k="SELECT frame, instance, label, count(*) AS n FROM s WHERE label >= 0 AND instance IS NOT NULL GROUP BY ALL", m="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, instance ORDER BY n DESC, label) AS r FROM k) WHERE r = 1 AND label IN (1, 2, 5, 6)") + " SELECT s.frame, y, x, coalesce(m.label, s.label) AS label, s.instance FROM s LEFT JOIN m ON s.frame = m.frame AND s.instance = m.instance")
def j13_instance_labels(spark, d):
    things = spark.createDataFrame([(k,) for k in (1, 2, 5, 6)], "label int")
    return catalogs.instance_labels(view(spark, d, _SEG), things)


@query(ctes(e=EVENT) + " SELECT CAST(floor(id / 100) AS BIGINT) AS window, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS value_median, round(avg(value), 6) AS value_mean, max(value) AS value_max FROM e GROUP BY 1")
def k11_window_report(spark, d):
    out = catalogs.window_report(view(spark, d, EVENT), 100, "id", ("value",))
    return out.select("window", "n", F.round("value_median", 6).alias("value_median"), F.round("value_mean", 6).alias("value_mean"), "value_max")


@query("WITH g AS (SELECT * FROM (VALUES ('brand_1', 'small'), ('brand_2', 'large')) t(k, p)) SELECT p_partkey AS id, coalesce(g.p, 'default') AS profile FROM part LEFT JOIN g ON g.k = 'brand_' || (p_size % 4)")
def x06_profiles(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit(" Brand "), (F.col("p_size") % 4).cast("string"), F.lit("_"), F.col("p_partkey").cast("string")).alias("category"))
    groups = spark.createDataFrame([("brand 1", "small"), ("Brand_2", "large")], "category string, profile string")
    return profiles.with_profile(rows, groups).select("id", "profile")


@query(
    ctes(p=POINT, c="SELECT label % 2 AS g, CAST(pid % 40 AS INT) AS cluster, count(*) AS n, greatest(max(x)-min(x), 1e-6) * greatest(max(y)-min(y), 1e-6) * greatest(max(z)-min(z), 1e-6) AS volume, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS extent FROM p GROUP BY 1, 2")
    + " SELECT CASE g WHEN 0 THEN 'a' ELSE 'b' END AS profile, cluster, n, round(volume, 6) AS volume, round(extent, 6) AS extent, volume <= 30 AND extent <= CASE g WHEN 0 THEN 4.5 ELSE 4.0 END AND n / volume >= 0.1 AS plausible FROM c"
)
def p09_plausible(spark, d):
    p = view(spark, d, POINT).select(F.when(F.col("label") % 2 == 0, "a").otherwise("b").alias("profile"), (F.col("pid") % 40).cast("int").alias("cluster"), "x", "y", "z")
    known = spark.createDataFrame([("a", 30.0, 4.5, 0.1, 0.0, 1.0), ("b", 30.0, 4.0, 0.1, 0.0, 1.0)], "profile string, max_volume double, max_extent double, min_density double, planarity_threshold double, planarity_min_volume double")
    return profiles.plausible(p, known).select("profile", "cluster", "n", F.round("volume", 6).alias("volume"), F.round("extent", 6).alias("extent"), "plausible")


@query("SELECT s_suppkey, round(x / n, 8) AS qx, round(y / n, 8) AS qy, round(z / n, 8) AS qz, round(1 / n, 8) AS qw FROM (SELECT *, sqrt(x * x + y * y + z * z + 1) AS n FROM (SELECT s_suppkey, (s_suppkey % 7 - 3) / 4 AS x, (s_suppkey % 5 - 2) / 4 AS y, (s_suppkey % 3 - 1) / 4 AS z FROM supplier))")
def x01_matrix_to_quaternion(spark, d):
    """A quaternion's matrix and back again (its sign by the largest part, which is made that of w here)."""
    s = table(spark, d, "supplier").select("s_suppkey", *(((F.col("s_suppkey") % m - k) / 4).alias(n) for n, m, k in (("x", 7, 3), ("y", 5, 2), ("z", 3, 1))))
    back = G.matrix_quaternion(G.quaternion_matrix(F.col("x"), F.col("y"), F.col("z"), F.lit(1.0)))
    q = s.select("s_suppkey", *(c.alias(n) for n, c in back.items()))
    return q.select("s_suppkey", *((F.round(F.col(n) * F.signum("qw"), 8) + 0.0).alias(n) for n in ("qx", "qy", "qz", "qw")))


@query(ctes(p=PAIR, c="SELECT c, sum(l) AS l, sum(q) AS q, sum(b) AS b FROM (SELECT gt AS c, 1 AS l, 0 AS q, CASE WHEN gt = pred THEN 1 ELSE 0 END AS b FROM p UNION ALL SELECT pred, 0, 1, 0 FROM p) GROUP BY 1") + " SELECT round(2 * sum(b) / (sum(l) + sum(q)), 8) AS micro_f1, round(avg(2 * b / (l + q)), 8) AS macro_f1 FROM c")
def m06_f1(spark, d):
    out = metrics.f1_scores(metrics.confusion(view(spark, d, PAIR)))
    return out.select(F.round("micro_f1", 8).alias("micro_f1"), F.round("macro_f1", 8).alias("macro_f1"))


_RANKED = "SELECT o_custkey % 6 AS label, CAST(floor(o_totalprice / 5000) AS BIGINT) AS score, o_orderkey % 3 = 0 AS positive FROM orders"


@query(ctes(r=_RANKED, n="SELECT label, score, sum(CAST(positive AS INT)) AS p, sum(CAST(NOT positive AS INT)) AS q FROM r GROUP BY 1, 2", w="SELECT *, sum(q) OVER (PARTITION BY label ORDER BY score) - q / 2 AS below FROM n") + " SELECT label, round(sum(p * below) / (sum(p) * sum(q)), 8) AS auroc FROM w GROUP BY 1")
def m06_auroc(spark, d):
    return metrics.auroc(view(spark, d, _RANKED), "label").withColumn("auroc", F.round("auroc", 8))


@query(ctes(r=_RANKED, n="SELECT label, score, sum(CAST(positive AS INT)) AS p, count(*) AS k FROM r GROUP BY 1, 2", w="SELECT *, sum(p) OVER v AS tps, sum(k) OVER v AS n FROM n WINDOW v AS (PARTITION BY label ORDER BY score DESC)") + " SELECT label, round(sum(p * tps / n) / sum(p), 8) AS ap FROM w GROUP BY 1")
def m06_label_ap(spark, d):
    return metrics.label_average_precision(view(spark, d, _RANKED), "label").withColumn("ap", F.round("ap", 8))


_HALVES = {"spark": "SELECT vec_id % 100 AS image, slice(embedding, 1, 32) AS output, slice(embedding, 33, 32) AS target FROM embeddings", "sql": "SELECT vec_id, vec_id % 100 AS image, CAST(embedding[1:32] AS DOUBLE[]) AS o, CAST(embedding[33:64] AS DOUBLE[]) AS t FROM embeddings"}


@query(ctes(h=_HALVES, u="SELECT vec_id, image, list_transform(o, lambda v: v / sqrt(list_dot_product(o, o))) AS o, list_transform(t, lambda v: v / sqrt(list_dot_product(t, t))) AS t FROM h") + " SELECT a.image, round(avg((greatest(list_dot_product(a.o, b.o), 0) - greatest(list_dot_product(a.t, b.t), 0)) ** 2), 8) AS error FROM u a JOIN u b ON a.image = b.image GROUP BY 1")
def m15_gram(spark, d):
    return metrics.gram_error(view(spark, d, _HALVES), "image").withColumn("error", F.round("error", 8))


@query("WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('11:' || doc_id), doc_id) - 1 AS place, 0 AS pass, count(*) OVER () AS n FROM documents UNION ALL SELECT doc_id, n + row_number() OVER (ORDER BY md5('12:' || doc_id), doc_id) - 1, 1, n FROM (SELECT *, count(*) OVER () AS n FROM documents)) SELECT doc_id, CAST(pass AS INT) AS pass, CAST((place - 1) // 3 AS BIGINT) AS at FROM p WHERE place % 3 = 1 AND (place - 1) // 3 >= 50")
def t04_endless(spark, d):
    """The second of three workers over two passes, from its fifty-first row on."""
    return sampling.endless(table(spark, d, "documents").select("doc_id"), "doc_id", 11, 1, 3, 2, advance=50).select("doc_id", "pass", "at")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS index FROM nation UNION ALL SELECT NULL, -1 FROM range(3)")
def t08_enumerated(spark, d):
    return sampling.enumerated(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", 7)


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def t14_last_written(spark, d):
    return evaluators.last_written(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id").select("user_id", "event_id", "value")


@query("SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey % 2 = 0 THEN 'a' || p_partkey END, CASE WHEN p_partkey % 3 = 0 THEN 'b' || p_partkey END) AS image FROM part")
def j24_first_found(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    made = [p.where(F.col("id") % k == 0).withColumn("image", F.concat(F.lit(n), F.col("id").cast("string"))) for k, n in ((2, "a"), (3, "b"))]
    return evaluators.first_found(p, made, "id", "image").select("id", "image")


@query("SELECT coalesce(c.k, s.k) AS nation, customers, suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) s ON c.k = s.k")
def k08_merged_reports(spark, d):
    left = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    right = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return evaluators.merged_reports(left, right, "nation").select("nation", "customers", "suppliers")


@query(ctes(c=RGB, q=PALETTE, o="SELECT r, g, b, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM q WHERE greatest(abs(c.r - q.r), abs(c.g - q.g), abs(c.b - q.b)) <= 40) GROUP BY 1, 2, 3") + " SELECT r, g, b, n, round(n / (SELECT sum(n) FROM o), 8) AS share FROM o ORDER BY n DESC, r, g, b LIMIT 20")
def o02_other_colours(spark, d):
    """The twenty most frequent: a report."""
    return evaluators.other_colours(view(spark, d, RGB), view(spark, d, PALETTE), 40).withColumn("share", F.round("share", 8))


@query(ctes(p=PAIR, c="SELECT gt, pred, count(*) AS n FROM p GROUP BY 1, 2") + " SELECT gt, pred, n FROM c")
def f03_merged_states(spark, d):
    """Confusion tables of three parts of the rows, merged."""
    p = view(spark, d, PAIR)
    return evaluators.merged_counts(*(metrics.confusion(p.where(F.pmod("id", F.lit(3)) == k)) for k in range(3)))


@query("WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS q, q.label AS truth, b.label, b.vec_id, round(list_dot_product(q.v, b.v), 9) AS score FROM e q JOIN e b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS r FROM s), t AS (SELECT *, exp((score - max(score) OVER (PARTITION BY q)) / 0.07) AS x FROM k WHERE r <= 20), w AS (SELECT *, x / sum(x) OVER (PARTITION BY q) AS w FROM t), g AS (SELECT q, truth, c.k, label, round(sum(w), 9) AS w FROM w, (VALUES (10), (20)) c(k) WHERE r <= c.k GROUP BY 1, 2, 3, 4), o AS (SELECT *, row_number() OVER (PARTITION BY q, k ORDER BY w DESC, label) AS p FROM g) SELECT CAST(k AS INT) AS k, round(avg(CAST(label = truth AS DOUBLE)), 8) AS accuracy FROM o WHERE p = 1 GROUP BY 1")
def f06_neighbour_accuracy(spark, d):
    """A stated set of queries, every 20th vector, against all others."""
    e = table(spark, d, "embeddings")
    return evaluators.evaluated("neighbours", e.where("vec_id % 20 = 0"), e).withColumn("accuracy", F.round("accuracy", 8))


@query(
    ctes(
        p=POINT,
        e="SELECT a.pid AS a, b.pid AS b FROM p a, p b WHERE a.label % 3 = b.label % 3 AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 1.0",
        c="SELECT a AS pid FROM e GROUP BY 1 HAVING count(*) >= 4",
        l="SELECT e.a, e.b FROM e JOIN c x ON e.a = x.pid JOIN c y ON e.b = y.pid",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, r AS (SELECT pid AS node, pid AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node), k AS (SELECT node, min(root) AS cluster FROM r GROUP BY 1),
    n AS (SELECT e.a AS pid, min(k.cluster) AS near FROM e JOIN k ON e.b = k.node GROUP BY 1), o AS (SELECT p.*, coalesce(k.cluster, n.near) AS cluster FROM p LEFT JOIN k ON p.pid = k.node LEFT JOIN n ON p.pid = n.pid)
    SELECT label % 3 AS scene, cluster, count(*) AS n, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM o WHERE cluster IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 4"""
)
def f09_scene_instances(spark, d):
    """Instances of three scenes at once."""
    return profiles.scene_instances(view(spark, d, POINT).withColumn("scene", F.col("label") % 3), 1.0, 4)


@query(
    ctes(p=POINT, e="SELECT a.label, a.pid, a.x, a.y FROM p a JOIN p b ON a.label = b.label AND a.pid <> b.pid JOIN p c ON a.label = c.label GROUP BY a.label, a.pid, a.x, a.y, b.pid HAVING max((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) <= 1e-12")
    + " SELECT DISTINCT label, round(x, 8) AS x, round(y, 8) AS y FROM e"
)
def c08_hulls(spark, d):
    """Corners of each label's hull in the plane."""
    return catalogs.hull(view(spark, d, POINT), "label").select("label", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


@query()
def t13_block_masks(spark, d):
    """Masked cells of a grid for every image of the nations' table."""
    return sampling.block_masks(table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), 14, 14, 0.4, 1)


# eigenvalues of a symmetric matrix in closed form, and each axis as the largest product of two rows of the matrix less its eigenvalue
@query(
    ctes(
        p=POINT,
        m="SELECT label, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM p GROUP BY 1",
        q="SELECT *, (xx + yy + zz) / 3 AS t FROM m",
        h="SELECT *, sqrt(((xx - t) * (xx - t) + (yy - t) * (yy - t) + (zz - t) * (zz - t) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS s FROM q",
        g="SELECT *, acos(least(greatest(((xx - t) * ((yy - t) * (zz - t) - yz * yz) - xy * (xy * (zz - t) - yz * xz) + xz * (xy * yz - (yy - t) * xz)) / (2 * s * s * s), -1), 1)) / 3 AS phi FROM h",
        v="SELECT *, w, t + 2 * s * cos(phi + CASE w WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END * 2.0943951023931953) AS ev FROM g, range(3) w(w)",
        c1="SELECT *, xx - ev AS aa, yy - ev AS bb, zz - ev AS cc FROM v",
        c2="SELECT label, w, xy * yz - xz * bb AS x0, xz * xy - aa * yz AS y0, aa * bb - xy * xy AS z0, xy * cc - xz * yz AS x1, xz * xz - aa * cc AS y1, aa * yz - xy * xz AS z1, bb * cc - yz * yz AS x2, yz * xz - xy * cc AS y2, xy * yz - bb * xz AS z2 FROM c1",
        c3="SELECT *, x0 * x0 + y0 * y0 + z0 * z0 AS n0, x1 * x1 + y1 * y1 + z1 * z1 AS n1, x2 * x2 + y2 * y2 + z2 * z2 AS n2 FROM c2",
        a="SELECT label, w, CASE WHEN n0 >= n1 AND n0 >= n2 THEN [x0, y0, z0] WHEN n1 >= n2 THEN [x1, y1, z1] ELSE [x2, y2, z2] END AS ax, sqrt(greatest(n0, n1, n2)) AS norm FROM c3",
        o="SELECT p.label, w, ax[1] / norm AS a0, ax[2] / norm AS a1, ax[3] / norm AS a2, min((x * ax[1] + y * ax[2] + z * ax[3]) / norm) AS lo, max((x * ax[1] + y * ax[2] + z * ax[3]) / norm) AS hi FROM p JOIN a ON p.label = a.label GROUP BY 1, 2, 3, 4, 5",
    )
    + " SELECT label, round(sum((lo + hi) / 2 * a0), 6) AS cx, round(sum((lo + hi) / 2 * a1), 6) AS cy, round(sum((lo + hi) / 2 * a2), 6) AS cz, round(max(hi - lo) FILTER (w = 0), 6) AS d0, round(max(hi - lo) FILTER (w = 1), 6) AS d1, round(max(hi - lo) FILTER (w = 2), 6) AS d2 FROM o GROUP BY 1"
)
def a25_oriented_boxes(spark, d):
    out = catalogs.oriented_boxes(view(spark, d, POINT), "label")
    return out.select("label", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "cz", "d0", "d1", "d2")))


# matching goes through a group's detections by their place, with the truths that are taken so far
_GRID = ctes(
    ("o", "r", "ga"),
    e=EVENT,
    d="SELECT user_id AS video, event_type AS category, id, value / 1000 AS score, value * 300 AS size FROM e WHERE id % 2 = 0",
    g="SELECT user_id AS video, event_type AS category, id AS truth, id % 11 = 1 AS crowd, value * 300 AS size FROM e WHERE id % 2 = 1",
    p="SELECT d.video, d.category, d.id, g.truth, 1 - abs(d.id - g.truth) / 400 AS iou FROM d JOIN g ON d.video = g.video AND d.category = g.category AND d.id // 400 = g.truth // 400",
    b="SELECT * FROM (VALUES ('all', 0, 1e10), ('small', 0, 16384), ('medium', 16384, 65536), ('large', 65536, 1e10)) t(area, lo, hi)",
    ga="SELECT g.*, area, crowd OR size < lo OR size > hi AS ignore FROM g, b",
    o="SELECT d.*, area, size < lo OR size > hi AS outside, row_number() OVER (PARTITION BY area, video, category ORDER BY score DESC, id) AS place FROM d, b",
    c="SELECT p.video, p.category, p.id, ga.area, list({'truth': p.truth, 'ignore': ignore, 'iou': iou} ORDER BY ignore, iou DESC, p.truth) AS found FROM p JOIN ga ON p.video = ga.video AND p.category = ga.category AND p.truth = ga.truth GROUP BY 1, 2, 3, 4",
    k="SELECT o.*, found FROM o LEFT JOIN c ON o.video = c.video AND o.category = c.category AND o.id = c.id AND o.area = c.area WHERE place <= 10",
    t="SELECT unnest([0.5::DOUBLE, 0.75::DOUBLE]) AS t",
    r="""SELECT area, video, category, t, place, score, outside, list_filter(found, lambda f: f.iou >= t)[1] AS hit, CASE WHEN len(list_filter(found, lambda f: f.iou >= t)) > 0 THEN [list_filter(found, lambda f: f.iou >= t)[1].truth] ELSE []::BIGINT[] END AS taken FROM k, t WHERE place = 1
    UNION ALL SELECT r.area, r.video, r.category, r.t, k.place, k.score, k.outside, list_filter(k.found, lambda f: f.iou >= r.t AND (f.ignore OR NOT list_contains(r.taken, f.truth)))[1],
    CASE WHEN len(list_filter(k.found, lambda f: f.iou >= r.t AND (f.ignore OR NOT list_contains(r.taken, f.truth)))) > 0 THEN list_append(r.taken, list_filter(k.found, lambda f: f.iou >= r.t AND (f.ignore OR NOT list_contains(r.taken, f.truth)))[1].truth) ELSE r.taken END
    FROM r JOIN k ON k.area = r.area AND k.video = r.video AND k.category = r.category AND k.place = r.place + 1""",
    j="SELECT area, video, category, t, place, score, hit IS NOT NULL AS tp FROM r WHERE NOT (coalesce(hit.ignore, false) OR (outside AND hit IS NULL))",
    n="SELECT category, area, count(*) FILTER (NOT ignore) AS n FROM ga GROUP BY 1, 2",
    w="SELECT j.*, most, n FROM j JOIN (SELECT unnest([1, 10]) AS most) x ON place <= most JOIN n ON n.category = j.category AND n.area = j.area WHERE n > 0",
    s="SELECT *, sum(CASE WHEN tp THEN 1 ELSE 0 END) OVER z AS tps, count(*) OVER z AS every FROM w WINDOW z AS (PARTITION BY category, area, t, most ORDER BY score DESC, video, place ROWS UNBOUNDED PRECEDING)",
    u="SELECT category, area, t, most, CAST(tps AS DOUBLE) / n AS recall, max(CAST(tps AS DOUBLE) / every) OVER (PARTITION BY category, area, t, most ORDER BY score DESC, video, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM s",
    y="SELECT category, area, t, most, i, max(envelope) AS p FROM u JOIN range(101) x(i) ON recall >= i / 100 GROUP BY 1, 2, 3, 4, 5",
    ap="SELECT category, area, t, most, sum(p) / 101 AS ap FROM y GROUP BY 1, 2, 3, 4",
    ar="SELECT category, area, t, most, max(recall) AS ar FROM u GROUP BY 1, 2, 3, 4",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_GRID + " SELECT n.category, n.area, t.t AS threshold, m.most, round(coalesce(ap, CASE WHEN n > 0 THEN 0 ELSE -1 END), 8) AS ap, round(coalesce(ar, CASE WHEN n > 0 THEN 0 ELSE -1 END), 8) AS ar FROM n CROSS JOIN t CROSS JOIN (SELECT unnest([1, 10]) AS most) m LEFT JOIN ap ON ap.category = n.category AND ap.area = n.area AND ap.t = t.t AND ap.most = m.most LEFT JOIN ar ON ar.category = n.category AND ar.area = n.area AND ar.t = t.t AND ar.most = m.most")
def m19_detection_grid(spark, d):
    """Events as detections (even ids) and truths (odd ones) of a user and a kind; overlap falls with the distance of their ids."""
    e = view(spark, d, EVENT).select(F.col("user_id").alias("video"), F.col("event_type").alias("category"), "id", "value")
    size = (F.col("value") * 300).alias("size")
    dets = e.where("id % 2 = 0").select("video", "category", "id", (F.col("value") / 1000).alias("score"), size)
    truths = e.where("id % 2 = 1").select("video", "category", F.col("id").alias("truth"), F.when(F.col("id") % 11 == 1, 1).otherwise(0).alias("crowd"), size)
    near = F.floor(F.col("id") / 400)
    left, right = dets.select("video", "category", "id", near.alias("b")), truths.select("video", "category", "truth", F.floor(F.col("truth") / 400).alias("b"))
    pairs = left.join(right, ["video", "category", "b"]).select("video", "category", "id", "truth", (1 - F.abs(F.col("id") - F.col("truth")) / 400).alias("iou"))
    grid = metrics.detection_grid(pairs, dets, truths, thresholds=(0.5, 0.75), most=(1, 10))
    return grid.withColumns({c: F.round(c, 8) for c in ("ap", "ar")})


@query()
def c14_sweep(spark, d):
    """Regressions of labels on vectors for seven strengths, fitted at once on four rows in five and judged on the fifth."""
    e = table(spark, d, "embeddings")
    return catalogs.swept(e.where("vec_id % 5 > 0"), e.where("vec_id % 5 = 0"), tuple(10.0**i for i in range(-4, 3)), rounds=40).withColumn("accuracy", F.round("accuracy", 6))
