"""Queries over clouds coloured from posed frames."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.storage import new_path
from cairn.operators import colouring
from cairn.plans.registry import query
from cairn.plans.views import PALETTE, POINT, ctes, view
from cairn.streaming import colouring as streams

POSE = "SELECT s_suppkey AS ts, CAST(s_suppkey % 7 AS DOUBLE) - 3.0 AS px, CAST(s_suppkey % 5 AS DOUBLE) - 2.0 AS py, CAST(s_suppkey % 3 AS DOUBLE) - 6.0 AS pz, CAST(s_suppkey % 4 AS DOUBLE) / 10 AS qx, CAST(s_suppkey % 3 AS DOUBLE) / 10 AS qy, CAST(0.05 AS DOUBLE) AS qz, CAST(1 AS DOUBLE) AS qw FROM supplier"
#: A label for some pixels of the frames of two suppliers in three.
PIXEL = {
    "spark": "SELECT s_suppkey AS frame, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST((x * 7 + y * 3 + s_suppkey) % 6 AS INT) AS label FROM supplier LATERAL VIEW explode(sequence(0, 31)) a AS x LATERAL VIEW explode(sequence(0, 23)) b AS y WHERE s_suppkey % 3 > 0 AND (x + y) % 5 > 0",
    "sql": "SELECT s_suppkey AS frame, CAST(x.i AS INT) AS x, CAST(y.i AS INT) AS y, CAST((x.i * 7 + y.i * 3 + s_suppkey) % 6 AS INT) AS label FROM supplier, range(32) x(i), range(24) y(i) WHERE s_suppkey % 3 > 0 AND (x.i + y.i) % 5 > 0",
}
CAMERA = colouring.Camera(32, 24, 20.0, 20.0, 16.0, 12.0)
BENT = CAMERA._replace(distortion=(0.02, 0.001, 0.003, -0.002, 0.0))
MOUNT = colouring.Mount((0.1, -0.2, 0.05), (0.0, 0.1, 0.0, 1.0))


def _matrix(q: str) -> dict[str, str]:
    x, y, z, w = (f"{q}{c}" for c in "xyzw")
    return {"00": f"1-2*({y}*{y}+{z}*{z})", "01": f"2*({x}*{y}-{z}*{w})", "02": f"2*({x}*{z}+{y}*{w})", "10": f"2*({x}*{y}+{z}*{w})", "11": f"1-2*({x}*{x}+{z}*{z})", "12": f"2*({y}*{z}-{x}*{w})", "20": f"2*({x}*{z}-{y}*{w})", "21": f"2*({y}*{z}+{x}*{w})", "22": f"1-2*({x}*{x}+{y}*{y})"}


def _seen_sql(camera: colouring.Camera, meets: str = "true") -> dict:
    k1, k2, p1, p2, k3 = camera.distortion
    body, own, at = _matrix("n"), _matrix("m"), MOUNT.position
    product = ", ".join(f"({body[f'{i}0']})*({own[f'0{j}']}) + ({body[f'{i}1']})*({own[f'1{j}']}) + ({body[f'{i}2']})*({own[f'2{j}']}) AS r{i}{j}" for i in range(3) for j in range(3))
    moved = ", ".join(f"{p} + ({body[f'{i}0']})*{at[0]} + ({body[f'{i}1']})*({at[1]}) + ({body[f'{i}2']})*{at[2]} AS t{i}" for i, p in enumerate(("px", "py", "pz")))
    turned = ", ".join(f"r0{j}*(x-t0) + r1{j}*(y-t1) + r2{j}*(z-t2) AS c{a}" for j, a in enumerate("xyz"))
    return dict(
        p=POINT, o=POSE, g=PIXEL,
        n=f"SELECT *, qx/l AS nx, qy/l AS ny, qz/l AS nz, qw/l AS nw, {MOUNT.rotation[0]}/k AS mx, {MOUNT.rotation[1]}/k AS my, {MOUNT.rotation[2]}/k AS mz, {MOUNT.rotation[3]}/k AS mw FROM (SELECT *, sqrt(qx*qx+qy*qy+qz*qz+qw*qw) AS l, sqrt({'+'.join(f'{v}*{v}' for v in MOUNT.rotation)}) AS k FROM o)",
        m=f"SELECT ts AS frame, {product}, {moved} FROM n",
        c=f"SELECT pid, frame, {turned} FROM p JOIN m ON {meets}",
        d="SELECT *, cx/cz AS a, cy/cz AS b, (cx/cz)*(cx/cz) + (cy/cz)*(cy/cz) AS r2 FROM c WHERE cz > 0",
        e=f"SELECT pid, frame, cz AS depth, {camera.fx}*(a*(1+{k1}*r2+{k2}*r2*r2+{k3}*r2*r2*r2) + 2*{p1}*a*b + ({p2})*(r2+2*a*a)) + {camera.cx} AS u, {camera.fy}*(b*(1+{k1}*r2+{k2}*r2*r2+{k3}*r2*r2*r2) + {p1}*(r2+2*b*b) + 2*({p2})*a*b) + {camera.cy} AS v FROM d",
        s=f"SELECT * FROM e WHERE u >= 0 AND u < {camera.width} AND v >= 0 AND v < {camera.height}",
    )


_BUFFER = f"SELECT *, CAST(least(greatest(round_even(u, 0), 0), {CAMERA.width - 1}) AS INT) AS xi, CAST(least(greatest(round_even(v, 0), 0), {CAMERA.height - 1}) AS INT) AS yi FROM s WHERE frame IN (SELECT frame FROM g)"
_NEAR = "SELECT * FROM (SELECT *, min(depth) OVER (PARTITION BY frame, yi, xi) AS nearest FROM b) WHERE depth <= nearest + 0.15"
_LOOKED = "SELECT n2.pid, n2.frame, g.label FROM near n2 JOIN g ON n2.frame = g.frame AND g.x = CAST(round_even(u, 0) AS INT) AND g.y = CAST(round_even(v, 0) AS INT)"


@query(ctes(**_seen_sql(BENT)) + " SELECT pid, frame, round(u, 4) AS u, round(v, 4) AS v, round(depth, 6) AS depth FROM s")
def j01_points_by_poses(spark, d):
    shown = {c: F.round(c, digits) for c, digits in (("u", 4), ("v", 4), ("depth", 6))}
    return colouring.observed(view(spark, d, POINT), view(spark, d, POSE), BENT, MOUNT, shown=shown)


_HELD = ("p", "g", "m", "s", "near")


@query(ctes(_HELD, **_seen_sql(CAMERA), b=_BUFFER, near=_NEAR, l=_LOOKED) + " SELECT pid, frame, label FROM l")
def j03_frame_labels(spark, d):
    return colouring.voted(view(spark, d, POINT), view(spark, d, POSE), view(spark, d, PIXEL), CAMERA, MOUNT)


@query(
    ctes(_HELD, **_seen_sql(CAMERA), b=_BUFFER, near=_NEAR, l=_LOOKED, k="SELECT pid, label, count(*) AS votes FROM l GROUP BY 1, 2", w="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY votes DESC, label) AS place, sum(votes) OVER (PARTITION BY pid) AS total FROM k) WHERE place = 1 AND total >= 3", q=PALETTE)
    + " SELECT p.pid, w.label, coalesce(w.votes, 0) AS votes, CAST(coalesce(w.total, 0) AS BIGINT) AS total, coalesce(q.r, 0) AS r, coalesce(q.g, 0) AS g, coalesce(q.b, 0) AS b FROM p LEFT JOIN w ON p.pid = w.pid LEFT JOIN q ON q.class_id = w.label"
)
def j25_coloured_cloud(spark, d):
    """Points, poses and label pixels to votes and colours: the whole chain."""
    return colouring.coloured(view(spark, d, POINT), view(spark, d, POSE), view(spark, d, PIXEL), view(spark, d, PALETTE), CAMERA, MOUNT, least=3)


@query(
    ctes(("p", "g", "m", "own"), **_seen_sql(CAMERA, "m.frame = 1 + p.pid % 50"), own="SELECT e.pid, e.frame, e.u, e.v FROM e WHERE e.frame IN (SELECT frame FROM g)", every="SELECT p.pid, 1 + p.pid % 50 AS frame FROM p WHERE 1 + p.pid % 50 IN (SELECT ts FROM o) AND 1 + p.pid % 50 IN (SELECT frame FROM g)", q=PALETTE)
    + " SELECT v.pid, v.frame, g.label, coalesce(q.r, 0) AS r, coalesce(q.g, 0) AS g, coalesce(q.b, 0) AS b FROM every v LEFT JOIN own ON own.pid = v.pid LEFT JOIN g ON g.frame = v.frame AND round_even(u, 0) = g.x AND round_even(own.v, 0) = g.y LEFT JOIN q ON q.class_id = g.label"
)
def t02_frame_colours(spark, d):
    """Clouds of one frame each, without votes."""
    p = view(spark, d, POINT).withColumn("frame", 1 + F.col("pid") % 50)
    return colouring.frame_colours(p, view(spark, d, POSE), view(spark, d, PIXEL), view(spark, d, PALETTE), CAMERA, MOUNT)


@query(
    ctes(_HELD, **_seen_sql(CAMERA), b=_BUFFER, near=_NEAR, l=_LOOKED, k="SELECT pid, label, count(*) AS votes FROM l GROUP BY 1, 2", w="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY votes DESC, label) AS place, sum(votes) OVER (PARTITION BY pid) AS total FROM k) WHERE place = 1")
    + " SELECT pid, CASE WHEN total >= 3 THEN label END AS label, CASE WHEN total >= 3 THEN votes ELSE 0 END AS votes, CAST(CASE WHEN total >= 3 THEN total ELSE 0 END AS BIGINT) AS total FROM w"
)
def t01_stream_votes(spark, d):
    """The labels of points as a stream of poses leaves them: what the table of poses says of the points that have a vote."""
    poses = view(spark, d, POSE).withColumn("at", F.timestamp_seconds("ts"))
    arrived = new_path(spark, "poses")
    poses.write.parquet(arrived)
    posed = spark.readStream.schema(poses.schema).parquet(arrived)
    found = streams.coloured(view(spark, d, POINT), posed, view(spark, d, PIXEL), CAMERA, MOUNT, least=3)
    out = new_path(spark, "stream")
    done = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start()
    done.awaitTermination()
    last = W.partitionBy("pid").orderBy(F.col("version").desc())
    rows = spark.read.schema(found.schema).parquet(out).withColumn("n", F.row_number().over(last)).where("n = 1")
    return rows.select("pid", "label", "votes", "total")
