"""Queries over boxes, normals, planes, hierarchies and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.operators import series, shapes
from cairn.plans.registry import query
from cairn.plans.views import BOX, POINT, ctes, table, view


@query(ctes(b=BOX, k="SELECT CAST(i AS INT) AS corner FROM range(8) t(i)") + " SELECT node_id, corner, CASE WHEN corner & 1 = 1 THEN x1 ELSE x0 END AS x, CASE WHEN corner & 2 = 2 THEN y1 ELSE y0 END AS y, CASE WHEN corner & 4 = 4 THEN z1 ELSE z0 END AS z FROM b, k")
def x11_corners(spark, d):
    return shapes.corners(view(spark, d, BOX), ("node_id",))


@query(ctes(b=BOX) + """, c AS (SELECT a.node_id, (a.x0+a.x1)/2 AS ax, (a.y0+a.y1)/2 AS ay, a.x1-a.x0 AS aw, a.y1-a.y0 AS ah, (b.x0+b.x1)/2 AS bx, (b.y0+b.y1)/2 AS by_, b.x1-b.x0 AS bw, b.y1-b.y0 AS bh FROM b a JOIN b ON b.ord = a.ord + 1)
SELECT node_id, round((bx-ax)/aw, 8) AS dx, round((by_-ay)/ah, 8) AS dy, round(ln(bw/aw), 8) AS dw, round(ln(bh/ah), 8) AS dh FROM c""")
def x12_box_delta(spark, d):
    b = view(spark, d, BOX)
    pair = b.alias("a").join(b.alias("b"), F.col("b.ord") == F.col("a.ord") + 1)
    own, other = (shapes.to_centre(*(F.col(f"{s}.{c}") for c in ("x0", "y0", "x1", "y1"))) for s in "ab")
    return pair.select("a.node_id", *(F.round(v, 8).alias(n) for n, v in zip(("dx", "dy", "dw", "dh"), shapes.box_delta(own, other), strict=True)))


@query("SELECT p_partkey AS id, greatest(0, least(p_partkey % 640 - 64, 640 - 128)) AS x0, greatest(0, least(p_size * 10 - 64, 480 - 128)) AS y0, least(greatest(0, least(p_partkey % 640 - 64, 640 - 128)) + 128, 640) AS x1, least(greatest(0, least(p_size * 10 - 64, 480 - 128)) + 128, 480) AS y1 FROM part")
def x23_crop(spark, d):
    x0, y0, x1, y1 = shapes.crop(F.lit(640).cast("long"), F.lit(480), F.col("p_partkey") % 640, F.col("p_size") * 10, 128)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


@query(ctes(b=BOX, a="SELECT node_id, x0, y0, x1, y1, greatest(0, x1-x0-0.3) * greatest(0, y1-y0-0.2) AS i FROM b") + " SELECT node_id, round(i / (2 * (x1-x0) * (y1-y0) - i), 8) AS iou FROM a")
def j18_box_iou(spark, d):
    """Each box against itself moved by (0.3, 0.2)."""
    b = view(spark, d, BOX)
    own = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    moved = (own[0] + 0.3, own[1] + 0.2, own[2] + 0.3, own[3] + 0.2)
    return b.select("node_id", F.round(G.box_iou(own, moved), 8).alias("iou"))


@query("SELECT event_id, round(0.001 + (1.0 - 0.001) / 2 * (cos(pi() * (event_id % 100 / 100)) + 1), 10) AS cosine, round((0.001 - 1.0) * (event_id % 100 / 100) + 1.0, 10) AS linear FROM events")
def x30_schedules(spark, d):
    share = F.col("event_id") % 100 / 100
    return table(spark, d, "events").select("event_id", F.round(series.cosine_step(1.0, 0.001, share), 10).alias("cosine"), F.round(series.linear_step(1.0, 0.001, share), 10).alias("linear"))


@query(ctes(p=POINT) + ", c AS (SELECT a.pid, count(*) AS n FROM p a JOIN p b ON a.pid <> b.pid AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 0.7 GROUP BY 1) SELECT p.pid, coalesce(n, 0) AS neighbours FROM p LEFT JOIN c USING (pid)")
def c06_radius_counts(spark, d):
    return shapes.neighbours_of(view(spark, d, POINT), 0.7)


@query(ctes(p=POINT) + ", s AS (SELECT label % 2 AS g, pid % 7 AS cluster, count(*) AS n FROM p GROUP BY 1, 2), k AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY g) AS m FROM s) WHERE n >= greatest(m * 0.95, 10)) SELECT pid, label % 2 AS g, k.cluster FROM p LEFT JOIN k ON label % 2 = k.g AND pid % 7 = k.cluster")
def p10_fragments(spark, d):
    p = view(spark, d, POINT).select("pid", (F.col("label") % 2).alias("g"), (F.col("pid") % 7).alias("cluster"))
    return shapes.fragments_dropped(p, "g", share=0.95, least=10)


@query()
def p11_normals(spark, d):
    return shapes.normals(view(spark, d, POINT), 10, 2.0)


@query()
def c05_ground_plane(spark, d):
    return shapes.ground_plane(view(spark, d, POINT), 0.3).select("pid", "ground")


@query()
def c02_density_clusters(spark, d):
    return shapes.density_clusters(view(spark, d, POINT), "label", 5)


@query(
    """WITH RECURSIVE f AS (SELECT l_orderkey * 10 + l_linenumber AS fid, l_partkey AS a, l_suppkey + 1000000000 AS b, l_orderkey AS c FROM lineitem),
    e AS (SELECT fid, least(a, b) AS p, greatest(a, b) AS q FROM f UNION ALL SELECT fid, least(b, c), greatest(b, c) FROM f UNION ALL SELECT fid, least(a, c), greatest(a, c) FROM f),
    m AS (SELECT p, q, min(fid) AS first FROM e GROUP BY 1, 2),
    l AS (SELECT DISTINCT fid AS a, first AS b FROM e JOIN m USING (p, q) WHERE fid <> first),
    s AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT fid AS node, fid AS root FROM f UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node WHERE r.root < s.b)
    SELECT fid, component FROM f JOIN (SELECT node, min(root) AS component FROM r GROUP BY 1) n ON fid = node"""
)
def c09_mesh_components(spark, d):
    faces = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fid"), F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000_000).alias("b"), F.col("l_orderkey").alias("c"))
    return shapes.mesh_components(faces)
