"""Labels and colours of a whole cloud from posed, segmented frames: points meet poses, pixels, and each other.

A point is looked at by every frame that it can be seen from. Which frames these are is first decided for cells of points, so
that points meet only the frames of their cell, in an equi-join; poses are broadcast in blocks of a bounded number.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.functions.storage import saved
from cairn.operators import votes

#: Poses that are broadcast at once, and blocks of them in one plan.
POSES, BLOCKS = 10_000, 4
# Fixed value: how much farther than a pixel's nearest point another one may be and still count as seen, in metres.
TOLERANCE = 0.15


class Camera(NamedTuple):
    """Image size, focal lengths, centre and distortion (k1, k2, p1, p2, k3)."""

    width: int
    height: int
    fx: float
    fy: float
    cx: float
    cy: float
    distortion: tuple[float, float, float, float, float] = (0.0, 0.0, 0.0, 0.0, 0.0)


class Mount(NamedTuple):
    """Place (x, y, z) and rotation (quaternion x, y, z, w) of the camera on the body that the poses are of."""

    position: tuple[float, float, float] = (0.0, 0.0, 0.0)
    rotation: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 1.0)


def bound(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with further columns that are computed once: what uses them refers to their values. (Projections on projections are
    put into one, with each use of a column replaced by its expression; a generator keeps them apart.)"""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def camera_poses(poses: DataFrame, mount: Mount, frame: str = "ts", keep: tuple[str, ...] = ()) -> DataFrame:
    """kept columns, frame, r00 ... r22 (camera to world) and t0, t1, t2 of each pose (px, py, pz, qx, qy, qz, qw); null rotations go."""
    cell = lambda m, name: {f"{name}{i}{j}": m[i][j] for i in range(3) for j in range(3)}
    poses = bound(poses, cell(G.quaternion_matrix(*(F.col(c) for c in ("qx", "qy", "qz", "qw"))), "b") | cell(G.quaternion_matrix(*map(F.lit, mount.rotation)), "m"))
    body, own = ([[F.col(f"{name}{i}{j}") for j in range(3)] for i in range(3)] for name in "bm")
    at = G.rotate(body, tuple(map(F.lit, mount.position)))
    cells = [sum((body[i][k] * own[k][j] for k in range(1, 3)), body[i][0] * own[0][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)]
    return poses.select(*keep, F.col(frame).alias("frame"), *cells, *((F.col(p) + a).alias(f"t{i}") for i, (p, a) in enumerate(zip(("px", "py", "pz"), at, strict=True)))).dropna()


def _in_camera(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    away = (x - F.col("t0"), y - F.col("t1"), z - F.col("t2"))
    return tuple(sum((F.col(f"r{i}{j}") * away[i] for i in range(1, 3)), F.col(f"r0{j}") * away[0]) for j in range(3))


def _meets(camera: Camera, reach: float | None, cell: float) -> Column:
    """Whether a cell (cx, cy, cz) may hold a point that a pose sees: not if it lies behind the camera as a whole, beyond ``reach`` (if given),
    or, without distortion, outside the cone of the image. Each test allows for the cell's size, so no visible point is lost."""
    round_cell = cell * 3**0.5 / 2
    x, y, z = _in_camera(*((F.col(f"c{a}") + 0.5) * cell for a in "xyz"))
    meets = z > -round_cell
    if reach is not None:
        meets = meets & (F.sqrt(x * x + y * y + z * z) <= reach + round_cell)
    if not any(camera.distortion):
        for v, low, high in ((x, -camera.cx / camera.fx, (camera.width - camera.cx) / camera.fx), (y, -camera.cy / camera.fy, (camera.height - camera.cy) / camera.fy)):
            meets = meets & (v - high * z <= round_cell * (1 + high * high) ** 0.5) & (low * z - v <= round_cell * (1 + low * low) ** 0.5)
    return meets


def _projected(placed: DataFrame, camera: Camera, reach: float | None, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, frame, u, v, depth of points beside the poses that may see them: those in front of the camera, in reach and inside the image."""
    in_camera = _in_camera(F.col("x"), F.col("y"), F.col("z"))
    front = bound(placed, {f"p{a}": c for a, c in zip("xyz", in_camera, strict=True)}).select(*keep, key, "frame", "px", "py", "pz").where("pz > 0")
    if reach is not None:
        front = front.where(F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz")) <= reach)
    u, v = G.pinhole(G.triple("px", "py", "pz"), camera.fx, camera.fy, camera.cx, camera.cy, camera.distortion)
    return front.select(*keep, key, "frame", u.alias("u"), v.alias("v"), F.col("pz").alias("depth")).where((F.col("u") >= 0) & (F.col("u") < camera.width) & (F.col("v") >= 0) & (F.col("v") < camera.height))


def _in_cells(points: DataFrame, cell: float, key: str) -> DataFrame:
    own = points.select(F.col(key), *(F.col(a).cast("double").alias(a) for a in "xyz")).dropna()
    return own.select("*", *(F.floor(F.col(a) / cell).alias(f"c{a}") for a in "xyz"))


#: Side of the blocks that poses of a bounded reach are dealt to, as a share of the reach.
SHARE_OF_REACH = 0.5


def _near_cells(cells: DataFrame, turned: DataFrame, camera: Camera, reach: float, cell: float) -> DataFrame:
    """Cells beside the poses that may see them: poses are dealt to the blocks of space in their reach and meet cells by the block."""
    side = max(cell, reach * SHARE_OF_REACH)
    grown = reach + cell * 3**0.5
    spans = [F.sequence(F.floor((F.col(f"t{i}") - grown) / side), F.floor((F.col(f"t{i}") + grown) / side)) for i in range(3)]
    dealt = turned.withColumn("bx", F.explode(spans[0])).withColumn("by", F.explode(spans[1])).withColumn("bz", F.explode(spans[2]))
    blocks = [F.floor((F.col(f"c{a}") + 0.5) * cell / side).alias(f"b{a}") for a in "xyz"]
    return cells.select("*", *blocks).join(dealt, ["bx", "by", "bz"]).where(_meets(camera, reach, cell)).drop("bx", "by", "bz")


#: Points of a share of a cell, about.
SHARE = 8192


def _dealt(rows: DataFrame, at: list[str]) -> DataFrame:
    """rows dealt over tasks, by cell and frame where cells are given: few rows from few files, but each meets all points of its cell."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *at, "frame") if at else rows.repartition(parts)


_POSE = ("px", "py", "pz", "qx", "qy", "qz", "qw")


def shared_views(poses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: view, frame; the poses of views). Frames with the same poses see the same, so they are one view, named by its smallest frame:
    what is seen is worked out once a view, and its frames come in where they differ."""
    same = poses.groupBy("ts").agg(F.sort_array(F.collect_list(F.struct(*_POSE))).alias("__same"))
    first = same.groupBy("__same").agg(F.min("ts").alias("view"))
    members = saved(same.join(first, "__same").select("view", F.col("ts").alias("frame")), "members")
    return members, poses.join(members.where("view = frame").select("view"), F.col("ts") == F.col("view"), "left_semi")


#: Frames up to which they are broadcast to what their views see (more meet it in a shuffle), and frames of a row, about.
MEMBERS, LISTED = 500_000, 8192


def observed(points: DataFrame, poses: DataFrame, camera: Camera, mount: Mount = Mount(), reach: float | None = None, cell: float = 4.0, key: str = "pid", shown: dict[str, Column] | None = None) -> DataFrame:
    """key, frame, u, v, depth of every point in front of the camera and inside the image of a pose; see ``_observed``. Frames with the same
    poses are worked out together. ``shown`` are other columns in place of u, v and depth, made of these once a view, before its frames come in."""
    members, own = shared_views(poses)
    made = shown or {c: F.col(c) for c in ("u", "v", "depth")}
    seen = _observed(points, own, camera, mount, reach, cell, key).select(key, F.col("frame").alias("view"), *(c.alias(n) for n, c in made.items()))
    # lists of frames come out behind the join: the code of a join with many matches would hold all of the above, more than the JVM compiles
    n = members.count()
    lists = members.groupBy("view", F.pmod(F.xxhash64("frame"), F.lit(-(-n // LISTED) or 1))).agg(F.collect_list("frame").alias("frames")).select("view", "frames")
    return seen.join(F.broadcast(lists) if n <= MEMBERS else lists, "view").select(key, F.explode("frames").alias("frame"), *made)


def _observed(points: DataFrame, poses: DataFrame, camera: Camera, mount: Mount, reach: float | None, cell: float, key: str) -> DataFrame:
    """key, frame, u, v, depth of every point in front of the camera and inside the image of a pose.

    Cells of points are tested before points are; see ``_meets``. With a ``reach`` cells meet only the poses near them, in an equi-join; without one any
    pose may see any cell, and poses are broadcast in blocks. Points without coordinates see nothing.
    """
    own = _in_cells(points, cell, key)
    # a crowded cell is several, by a hash of its points, so that it isn't one task's
    shares = max(1, -(-own.count() // SHARE))
    own = own.withColumn("share", F.pmod(F.xxhash64(key), F.lit(shares)))
    at = ["cx", "cy", "cz", "share"]
    cells = saved(own.select(*at).distinct(), "cells")
    turned = saved(camera_poses(poses, mount), "poses")
    if reach is not None:
        seen_by = saved(_near_cells(cells, turned, camera, reach, cell), "seen_by")
        return _projected(own.join(_dealt(seen_by, at), at), camera, reach, key)
    n = turned.count()
    blocks = max(1, -(-n // POSES))
    out, written = None, None
    for b in range(blocks):
        some = F.broadcast(turned.where(F.pmod(F.xxhash64("frame"), F.lit(blocks)) == b))
        part = _projected(own.join(_dealt(_dealt(cells, at[:0]).join(some, _meets(camera, None, cell)), at), at), camera, None, key)
        out = part if out is None else out.unionByName(part)
        if b % BLOCKS == BLOCKS - 1 and b + 1 < blocks:
            written = saved(out, "seen") if written is None else written.unionByName(saved(out, "seen"))
            out = None
    return out if written is None else written if out is None else written.unionByName(out)


def seen_from(points: DataFrame, poses: DataFrame, camera: Camera, mount: Mount = Mount(), reach: float | None = None, cell: float = 4.0, key: str = "pid", keep: tuple[str, ...] = ()) -> DataFrame:
    """The same rows with further columns of the poses, in one plan without written tables: poses may be a stream."""
    own = _in_cells(points, cell, key)
    cells, turned = own.select("cx", "cy", "cz").distinct(), camera_poses(poses, mount, keep=keep)
    seen_by = turned.join(cells, _meets(camera, None, cell)) if reach is None else _near_cells(cells, turned, camera, reach, cell)
    return _projected(_dealt(seen_by, ["cx", "cy", "cz"]).join(own, ["cx", "cy", "cz"]), camera, reach, key, keep)


def _visible(points: DataFrame, poses: DataFrame, pixels: DataFrame, camera: Camera, mount: Mount, tolerance: float, reach: float | None, key: str, cell: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(key, view, __x, __y: the pixels that visible points of a view are looked up at; view, frame, __x, __y, label: labelled pixels of its frames)."""
    frames = pixels.select(F.col("frame").alias("__f")).distinct()
    members, own = shared_views(poses.join(frames, F.col("ts") == F.col("__f"), "left_semi"))
    seen = _observed(points, own, camera, mount, reach, cell, key)
    clip = lambda c, size: F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(float(size - 1))).cast("int")
    seen = saved(seen.withColumn("xi", clip("u", camera.width)).withColumn("yi", clip("v", camera.height)), "observed")
    near = votes.visible(seen, tolerance, ("frame", "yi", "xi"))
    # a place that rounds to the image's far border has no pixel
    placed = near.select(key, F.col("frame").alias("view"), F.rint("u").cast("int").alias("__x"), F.rint("v").cast("int").alias("__y")).where((F.col("__x") < camera.width) & (F.col("__y") < camera.height))
    labelled = pixels.where("label is not null").join(members, "frame").select("view", "frame", F.col("x").alias("__x"), F.col("y").alias("__y"), "label")
    return placed, labelled


def voted(points: DataFrame, poses: DataFrame, pixels: DataFrame, camera: Camera, mount: Mount = Mount(), tolerance: float = TOLERANCE, reach: float | None = None, key: str = "pid") -> DataFrame:
    """key, frame, label: what each frame says about each of its visible points. pixels: frame, x, y, label; frames without
    pixels, and pixels without a label, say nothing."""
    placed, labelled = _visible(points, poses, pixels, camera, mount, tolerance, reach, key)
    return placed.join(labelled.hint("merge"), ["view", "__x", "__y"]).select(key, "frame", "label")


def vote_counts(points: DataFrame, poses: DataFrame, pixels: DataFrame, camera: Camera, mount: Mount = Mount(), tolerance: float = TOLERANCE, reach: float | None = None, key: str = "pid") -> DataFrame:
    """key, label, votes: how many frames say so. Labels are counted for the pixels of a view before points meet them."""
    placed, labelled = _visible(points, poses, pixels, camera, mount, tolerance, reach, key)
    of_pixel = labelled.groupBy("view", "__x", "__y", "label").agg(F.count("*").alias("n"))
    return placed.join(of_pixel.hint("merge"), ["view", "__x", "__y"]).groupBy(key, "label").agg(F.sum("n").alias("votes"))


def coloured(points: DataFrame, poses: DataFrame, pixels: DataFrame, palette: DataFrame, camera: Camera, mount: Mount = Mount(), least: int = 1, tolerance: float = TOLERANCE, reach: float | None = None, key: str = "pid") -> DataFrame:
    """Every point with its winning label (ties to the smallest), its votes, how many frames saw it, and the label's colour in
    the palette (class_id, r, g, b); points with fewer than ``least`` observations are black and have no label."""
    won = votes.majority_of(vote_counts(points, poses, pixels, camera, mount, tolerance, reach, key), least, key)
    named = won.join(palette.select(F.col("class_id").alias("winner"), "r", "g", "b"), "winner", "left")
    black = [F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"]
    return points.select(key).join(named, key, "left").select(key, F.col("winner").alias("label"), F.coalesce("votes", F.lit(0)).cast("long").alias("votes"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), *black)


def frame_colours(points: DataFrame, poses: DataFrame, pixels: DataFrame, palette: DataFrame, camera: Camera, mount: Mount = Mount(), key: str = "pid") -> DataFrame:
    """Colours of clouds of one frame each (points have their frame): no votes and no occlusion, one look-up a point. Clouds whose
    frame has no pose or no pixels are left out. Rows are handled one by one, so it also runs on a stream of points."""
    turned = camera_poses(poses, mount)
    placed = bound(points.join(turned, "frame"), {f"p{a}": c for a, c in zip("xyz", _in_camera(*(F.col(a).cast("double") for a in "xyz")), strict=True)})
    u, v = G.pinhole(G.triple("px", "py", "pz"), camera.fx, camera.fy, camera.cx, camera.cy, camera.distortion)
    seen = placed.select(key, "frame", F.when(F.col("pz") > 0, u).alias("u"), F.when(F.col("pz") > 0, v).alias("v"))
    known = seen.join(pixels.select("frame").distinct(), "frame", "left_semi")
    found = votes.looked_up(known, pixels, camera.width, camera.height)
    return found.join(F.broadcast(palette.select(F.col("class_id").alias("label"), "r", "g", "b")), "label", "left").select(key, "frame", "label", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"))
