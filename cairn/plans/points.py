"""Queries over points: votes, occlusion, voxels, colours, distances, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.operators import colour, spatial, votes
from cairn.operators.colouring import bound
from cairn.plans.registry import query
from cairn.plans.views import EVENT, OBS, PALETTE, POINT, RGB, ctes, view


@query(ctes(o=OBS) + " SELECT pid, label, count(*) AS votes FROM o GROUP BY ALL")
def a01_votes(spark, d):
    return votes.vote_counts(view(spark, d, OBS))


@query(ctes(o=OBS, c="SELECT pid, label, count(*) AS votes FROM o GROUP BY ALL") + " SELECT pid, label AS winner, votes, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY votes DESC, label) AS k, sum(votes) OVER (PARTITION BY pid) AS total FROM c) WHERE k = 1 AND total >= 5")
def a02_majority(spark, d):
    return votes.majority(view(spark, d, OBS))


@query(
    ctes(o=OBS, c="SELECT pid, label, count(*) AS votes FROM o GROUP BY ALL", k="SELECT *, row_number() OVER (PARTITION BY pid ORDER BY votes DESC, label) AS place FROM c")
    + """ SELECT pid, max(CASE WHEN place = 1 THEN label END) AS winner, max(CASE WHEN place = 1 THEN votes END) AS first, coalesce(max(CASE WHEN place = 2 THEN votes END), 0) AS second,
    CAST(sum(votes) AS BIGINT) AS total, max(CASE WHEN place = 1 THEN votes END) / sum(votes) >= 0.6 AND max(CASE WHEN place = 1 THEN votes END) - coalesce(max(CASE WHEN place = 2 THEN votes END), 0) >= 2 AS accepted FROM k GROUP BY pid"""
)
def w02_vote_confidence(spark, d):
    return votes.confident(view(spark, d, OBS))


@query(ctes(o=OBS) + " SELECT frame, py, px, pid, label, depth FROM (SELECT *, min(depth) OVER (PARTITION BY py, px) AS m FROM o) WHERE depth <= m + 150")
def w01_zbuffer(spark, d):
    return votes.visible(view(spark, d, OBS), 150.0, ("py", "px")).select("frame", "py", "px", "pid", "label", "depth")


_POSE = (0.1, -0.2, 0.3, 0.9)


@query(
    ctes(
        p=POINT,
        q="SELECT sqrt(0.1*0.1 + -0.2*-0.2 + 0.3*0.3 + 0.9*0.9) AS n",
        u="SELECT 0.1/n AS qx, -0.2/n AS qy, 0.3/n AS qz, 0.9/n AS qw FROM q",
        t="""SELECT pid, (1-2*(qy*qy+qz*qz))*x + 2*(qx*qy-qz*qw)*y + 2*(qx*qz+qy*qw)*z + 0.5 AS cx, 2*(qx*qy+qz*qw)*x + (1-2*(qx*qx+qz*qz))*y + 2*(qy*qz-qx*qw)*z - 0.25 AS cy,
        2*(qx*qz-qy*qw)*x + 2*(qy*qz+qx*qw)*y + (1-2*(qx*qx+qy*qy))*z + 4 AS cz FROM p, u""",
        i="SELECT pid, cz, 500*(cx/cz)*(1 + 0.01*(cx/cz*cx/cz + cy/cz*cy/cz)) + 320 AS u, 500*(cy/cz)*(1 + 0.01*(cx/cz*cx/cz + cy/cz*cy/cz)) + 240 AS v FROM t WHERE cz > 0",
    )
    + " SELECT pid, round(u, 4) AS u, round(v, 4) AS v, round(cz, 6) AS depth FROM i WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480"
)
def p02_project(spark, d):
    q = [F.lit(v) for v in _POSE]
    x, y, z = G.rotate(G.quaternion_matrix(*q), G.triple("x", "y", "z"))
    seen = bound(view(spark, d, POINT), {"cx": x + 0.5, "cy": y - 0.25, "cz": z + 4}).where("cz > 0")
    u, v = G.pinhole(G.triple("cx", "cy", "cz"), 500, 500, 320, 240, (0.01, 0.0, 0.0, 0.0, 0.0))
    return seen.select("pid", u.alias("u"), v.alias("v"), "cz").where("u >= 0 and u < 640 and v >= 0 and v < 480").select("pid", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"), F.round("cz", 6).alias("depth"))


@query(ctes(o=OBS) + """, p AS (SELECT pid, frame, px + 0.4 AS u, py % 100 + 0.3 AS v FROM o), g AS (SELECT frame, CAST(px AS INT) AS x, CAST(py % 100 AS INT) AS y, min(label) AS label FROM o GROUP BY ALL)
SELECT p.pid, p.frame, u, v, g.label FROM p LEFT JOIN g ON p.frame = g.frame AND g.x = CAST(round_even(u, 0) AS INT) AND g.y = CAST(round_even(v, 0) AS INT) AND round_even(u, 0) < 6 AND round_even(v, 0) < 80""")
def j02_label_lookup(spark, d):
    o = view(spark, d, OBS)
    p = o.select("pid", "frame", (F.col("px") + F.lit(0.4)).alias("u"), (F.col("py") % 100 + F.lit(0.3)).alias("v"))
    g = o.groupBy("frame", F.col("px").cast("int").alias("x"), (F.col("py") % 100).cast("int").alias("y")).agg(F.min("label").alias("label"))
    return votes.looked_up(p, g, 6, 80)


@query(
    ctes(p=POINT, c="SELECT floor(x / 1.0) AS vx, floor(y / 1.0) AS vy, floor(z / 1.0) AS vz, label, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM p GROUP BY ALL")
    + """ SELECT CAST(vx AS BIGINT) AS vx, CAST(vy AS BIGINT) AS vy, CAST(vz AS BIGINT) AS vz, label AS winner, n AS votes, CAST(total AS BIGINT) AS total, round(tx / total, 6) AS mx, round(ty / total, 6) AS my, round(tz / total, 6) AS mz FROM
    (SELECT *, row_number() OVER w AS k, sum(n) OVER v AS total, sum(sx) OVER v AS tx, sum(sy) OVER v AS ty, sum(sz) OVER v AS tz FROM c WINDOW w AS (PARTITION BY vx, vy, vz ORDER BY n DESC, label), v AS (PARTITION BY vx, vy, vz)) WHERE k = 1 AND total >= 3"""
)
def a03_voxel_vote(spark, d):
    out = votes.voxel_majority(view(spark, d, POINT), 1.0)
    return out.select("vx", "vy", "vz", "winner", "votes", "total", *(F.round(f"m{a}", 6).alias(f"m{a}") for a in "xyz"))


@query(ctes(p=POINT) + " SELECT label, CAST(floor(x / 0.5) AS BIGINT) AS vx, CAST(floor(y / 0.5) AS BIGINT) AS vy, CAST(floor(z / 0.5) AS BIGINT) AS vz, count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(z), 6) AS mz FROM p GROUP BY 1, 2, 3, 4")
def a07_voxel_down(spark, d):
    return votes.voxel_means(view(spark, d, POINT), 0.5).select("label", "vx", "vy", "vz", "n", *(F.round(f"m{a}", 6).alias(f"m{a}") for a in "xyz"))


@query(
    ctes(p=POINT, o="SELECT min(x) - 0.25 AS ox, min(y) - 0.25 AS oy, min(z) - 0.25 AS oz FROM p")
    + " SELECT CAST(floor((x - ox) / 0.5) AS BIGINT) AS vx, CAST(floor((y - oy) / 0.5) AS BIGINT) AS vy, CAST(floor((z - oz) / 0.5) AS BIGINT) AS vz, count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(z), 6) AS mz FROM p, o GROUP BY 1, 2, 3"
)
def a08_voxel_lib(spark, d):
    return votes.bound_voxel_means(view(spark, d, POINT), 0.5).select("vx", "vy", "vz", "n", *(F.round(f"m{a}", 6).alias(f"m{a}") for a in "xyz"))


_PAIRED = """, m AS (SELECT c.r, c.g, c.b, p.class_id, p.name, greatest(abs(c.r - p.r), abs(c.g - p.g), abs(c.b - p.b)) AS linf, abs(c.r - p.r) + abs(c.g - p.g) + abs(c.b - p.b) AS l1,
  (c.r - p.r) * (c.r - p.r) + (c.g - p.g) * (c.g - p.g) + (c.b - p.b) * (c.b - p.b) AS l2 FROM (SELECT DISTINCT r, g, b FROM c) c, p)"""


def _colour_sql(where: str, order: str, more: str = "name") -> str:
    return ctes(c=RGB, p=PALETTE) + _PAIRED + f", k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, g, b ORDER BY {order}) AS k FROM m WHERE {where}) WHERE k = 1) SELECT c.pid, c.r, c.g, c.b, k.class_id, {more} FROM c LEFT JOIN k ON c.r = k.r AND c.g = k.g AND c.b = k.b"


@query(_colour_sql("linf <= 40 AND r + g + b > 0", "l1, class_id"))
def x02a_color_box(spark, d):
    return colour.nearest_in_box(view(spark, d, RGB), view(spark, d, PALETTE), 40).select("pid", "r", "g", "b", "class_id", "name")


@query(_colour_sql("l2 <= 4800", "l2, class_id"))
def x02b_color_ball(spark, d):
    return colour.nearest_in_ball(view(spark, d, RGB), view(spark, d, PALETTE), 40).select("pid", "r", "g", "b", "class_id", "name")


@query(_colour_sql("linf <= 40", "l1, class_id", "coalesce(name, 'unknown_' || lpad(CAST(c.r AS VARCHAR), 3, '0') || '_' || lpad(CAST(c.g AS VARCHAR), 3, '0') || '_' || lpad(CAST(c.b AS VARCHAR), 3, '0')) AS name"))
def x02c_color_named(spark, d):
    return colour.named_or_unknown(view(spark, d, RGB), view(spark, d, PALETTE), 40).select("pid", "r", "g", "b", "class_id", "name")


@query(_colour_sql("linf <= 45", "class_id DESC"))
def x02d_color_last(spark, d):
    return colour.last_in_box(view(spark, d, RGB), view(spark, d, PALETTE), 45).select("pid", "r", "g", "b", "class_id", "name")


@query(ctes(c=RGB, p=PALETTE) + " SELECT c.pid, c.r, c.g, c.b FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE greatest(abs(c.r - p.r), abs(c.g - p.g), abs(c.b - p.b)) <= 40)")
def p06_unstructured(spark, d):
    return colour.without(view(spark, d, RGB), view(spark, d, PALETTE), 40).select("pid", "r", "g", "b")


@query("WITH x AS (" + _colour_sql("l2 <= 4800", "l2, class_id") + "), k AS (SELECT CASE WHEN r + g + b = 0 THEN 'black' ELSE coalesce(name, 'unclassified') END AS category, count(*) AS n FROM x GROUP BY 1) SELECT category, n, round(n / (SELECT sum(n) FROM k), 8) AS share FROM k")
def a09_category_hist(spark, d):
    return colour.histogram(view(spark, d, RGB), view(spark, d, PALETTE), 40).withColumn("share", F.round("share", 8))


@query(ctes(c=RGB) + " SELECT r, b, g, count(*) AS n FROM (SELECT r // 50 * 50 AS r, g // 50 * 50 AS g, b // 50 * 50 AS b FROM c) GROUP BY r, g, b HAVING count(*) >= 20")
def a10_split_color(spark, d):
    rough = view(spark, d, RGB).select(*((F.floor(F.col(c) / 50) * 50).cast("int").alias(c) for c in "rgb"))
    return colour.colour_groups(rough, 20)


@query(ctes(p=POINT) + " SELECT a.pid, b.pid AS r_pid, round(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2), 6) AS distance FROM p a, p b WHERE a.pid < b.pid AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 0.5")
def j08_range_join(spark, d):
    p = view(spark, d, POINT)
    return spatial.within(p, p, 0.5).where("pid < r_pid").select("pid", "r_pid", F.round("distance", 6).alias("distance"))


def _box_join(p, centres):
    b = centres.selectExpr("pid AS box_id", *(f"{a} - {w} AS {a}0" for a, w in (("x", 0.4), ("y", 0.4), ("z", 1.0))), *(f"{a} + {w} AS {a}1" for a, w in (("x", 0.4), ("y", 0.4), ("z", 1.0))))
    b = b.select("box_id", *(F.col(f"{a}{k}").cast("double").alias(f"{a}{k}") for a in "xyz" for k in "01"))
    return spatial.in_boxes(p, b, 0.1, cell=1.0)


@query(
    ctes(p=POINT, b="SELECT pid AS box_id, x - 0.4 AS x0, x + 0.4 AS x1, y - 0.4 AS y0, y + 0.4 AS y1, z - 1.0 AS z0, z + 1.0 AS z1 FROM p")
    + " SELECT pid, box_id FROM p, b WHERE x > x0 - 0.1 AND x < x1 + 0.1 AND y > y0 - 0.1 AND y < y1 + 0.1 AND z > z0 - 0.1 AND z < z1 + 0.1"
)
def j09_box_join(spark, d):
    p = view(spark, d, POINT)
    return _box_join(p, p)


@query(
    ctes(p=POINT, l="SELECT * FROM p WHERE label < 5", r="SELECT * FROM p WHERE label >= 5", h="SELECT l.label AS a, r.label AS b, count(DISTINCT l.pid) AS near FROM l, r WHERE sqrt((l.x-r.x)**2 + (l.y-r.y)**2 + (l.z-r.z)**2) < 1.0 GROUP BY ALL", na="SELECT label AS a, count(*) AS n_a FROM l GROUP BY 1", nb="SELECT label AS b, count(*) AS n_b FROM r GROUP BY 1")
    + " SELECT a, b, coalesce(near, 0) AS near, round(coalesce(near, 0) / least(n_a, n_b), 8) AS overlap FROM na CROSS JOIN nb LEFT JOIN h USING (a, b)"
)
def j10_overlap(spark, d):
    p = view(spark, d, POINT)
    return spatial.overlaps(p.where("label < 5"), p.where("label >= 5"), 1.0).withColumn("overlap", F.round("overlap", 8))


@query(
    ctes(p=POINT, n="SELECT * FROM p WHERE pid % 4 = 0", k="SELECT * FROM p WHERE pid % 4 <> 0", h="SELECT n.pid, k.label, row_number() OVER (PARTITION BY n.pid ORDER BY sqrt((n.x-k.x)**2 + (n.y-k.y)**2 + (n.z-k.z)**2), k.pid) AS place FROM n, k WHERE sqrt((n.x-k.x)**2 + (n.y-k.y)**2 + (n.z-k.z)**2) <= 1.0")
    + " SELECT p.pid, CASE WHEN p.pid % 4 = 0 THEN h.label ELSE p.label END AS cluster FROM p LEFT JOIN h ON p.pid = h.pid AND h.place = 1"
)
def c04_absorb(spark, d):
    p = view(spark, d, POINT).withColumn("cluster", F.when(F.col("pid") % 4 != 0, F.col("label")))
    return spatial.absorbed(p, 1.0).select("pid", "cluster")


@query(
    ctes(
        p=POINT,
        k="SELECT a.pid, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d, row_number() OVER (PARTITION BY a.pid ORDER BY sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2), b.pid) AS place FROM p a, p b WHERE a.pid <> b.pid AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 2.0",
        m="SELECT pid, avg(d) AS m FROM k WHERE place <= 8 GROUP BY 1",
        t="SELECT avg(m) + 1.5 * stddev_pop(m) AS t FROM m",
    )
    + " SELECT p.pid, round(m, 6) AS mean_distance, coalesce(m > t, true) AS outlier FROM p LEFT JOIN m USING (pid), t"
)
def c06_outlier(spark, d):
    return spatial.outliers(view(spark, d, POINT), 8, 1.5, 2.0).withColumn("mean_distance", F.round("mean_distance", 6))


@query(
    ctes(
        p=POINT,
        e="SELECT a.pid AS a, b.pid AS b FROM p a, p b WHERE sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 0.8",
        c="SELECT a AS pid FROM e GROUP BY 1 HAVING count(*) >= 5",
        l="SELECT e.a, e.b FROM e JOIN c x ON e.a = x.pid JOIN c y ON e.b = y.pid",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, r AS (SELECT pid AS node, pid AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node), k AS (SELECT node, min(root) AS cluster FROM r GROUP BY 1),
    n AS (SELECT e.a AS pid, min(k.cluster) AS near FROM e JOIN k ON e.b = k.node GROUP BY 1)
    SELECT p.pid, k.cluster IS NOT NULL AS core, coalesce(k.cluster, n.near) AS cluster FROM p LEFT JOIN k ON p.pid = k.node LEFT JOIN n ON p.pid = n.pid"""
)
def c01_dbscan(spark, d):
    return spatial.dbscan(view(spark, d, POINT), 0.8, 5)


@query(
    "WITH s AS (SELECT DISTINCT n FROM (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) UNION SELECT 2), k AS (SELECT n, lead(n) OVER (ORDER BY n) AS m FROM s) SELECT CAST(least(greatest(coalesce(min(n) FILTER (WHERE ln(1 + m) - ln(1 + n) >= 1) + 1, 10), 10), 50) AS BIGINT) AS cut FROM k"
)
def w03_log_gap(spark, d):
    sizes = spark.read.parquet(f"{d}/lineitem.parquet").where("l_returnflag = 'A'").groupBy("l_suppkey").agg(F.count("*").alias("n")).select("n")
    return spatial.log_gap(sizes.union(spark.range(1).selectExpr("2L AS n")))


@query(
    ctes(p=POINT, k="SELECT a.pid, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d, row_number() OVER (PARTITION BY a.pid ORDER BY sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2), b.pid) AS place FROM p a, p b WHERE a.pid <> b.pid AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 3.0")
    + " SELECT count(*) AS n, round(quantile_cont(d, 0.5), 6) AS epsilon FROM k WHERE place = 5"
)
def w04_epsilon(spark, d):
    k = spatial.knn_within(view(spark, d, POINT), 5, 3.0).where("place = 5")
    return k.agg(F.count("*").alias("n"), F.round(F.percentile("distance", F.lit(0.5)), 6).alias("epsilon"))


@query(ctes(p=POINT) + " SELECT label, count(*) AS n, round(covar_samp(x, x), 6) AS cxx, round(covar_samp(x, y), 6) AS cxy, round(covar_samp(x, z), 6) AS cxz, round(covar_samp(y, y), 6) AS cyy, round(covar_samp(y, z), 6) AS cyz, round(covar_samp(z, z), 6) AS czz FROM p GROUP BY 1")
def a23_covariance(spark, d):
    c = spatial.covariance(view(spark, d, POINT))
    return c.select("label", "n", *(F.round(k, 6).alias(k) for k in c.columns[2:]))


@query(ctes(e=EVENT) + " SELECT id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS smoothed FROM e")
def w05_temporal_mean(spark, d):
    return votes.temporal_mean(view(spark, d, EVENT), 5, "user_id", ("ts", "id"), "value").select("id", "user_id", F.round("smoothed", 6).alias("smoothed"))
