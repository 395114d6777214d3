"""Writers of point clouds, meshes and scene graphs."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.storage import saved
from cairn.operators.running import running
from cairn.sources.formats import opened, pcd_bytes


def write_clouds(points: DataFrame, path: str, by: tuple[str, ...] = ("scene",)) -> DataFrame:
    """One binary PCD file for each group of points (columns x, y, z, r, g, b), written by the task that holds the group under a
    hidden name and then renamed, so a repeated task leaves no half-written file. Returns the files and their counts. A group is one
    scene's or one category's points, which a PCD file holds whole."""
    schema = ", ".join([*(f"{c} {points.schema[c].dataType.simpleString()}" for c in by), "file string, points long"])

    def run(key, table):
        fs, root = opened(path)
        name = "_".join(str(k.as_py()) for k in key).replace("/", "_")
        columns = {c: table.column(c).to_numpy() for c in "xyzrgb"}
        folder = root.rstrip("/")
        fs.create_dir(folder, recursive=True)
        hidden, final = f"{folder}/.{name}-{uuid.uuid4().hex}", f"{folder}/{name}.pcd"
        with fs.open_output_stream(hidden) as f:
            f.write(pcd_bytes(*(columns[c] for c in "xyzrgb")))
        fs.move(hidden, final)
        return pa.table({**{c: pa.array([k.as_py()], k.type) for c, k in zip(by, key, strict=True)}, "file": [final], "points": [table.num_rows]})

    return points.select(*by, *"xyzrgb").groupBy(*by).applyInArrow(run, schema)


def box_wires(boxes: DataFrame, thickness: float, keep: tuple[str, ...] = ("box_id",)) -> DataFrame:
    """Each of the twelve edges of boxes (x0 ... z1) as two thin triangles: keep, edge, triangle, and nine coordinates."""
    ends = [(a, b) for a in range(8) for b in range(a + 1, 8) if (a ^ b) in (1, 2, 4)]

    def at(k: int, axis: int, moved: int | None):
        c = F.col(f"{'xyz'[axis]}{(k >> axis) & 1}")
        return c + thickness if axis == moved else c

    rows = []
    for e, (a, b) in enumerate(ends):
        side = 2 if (a ^ b) != 4 else 0  # the axis across which the wire has its width
        for t, corner in enumerate((((a, None), (b, None), (b, side)), ((a, None), (b, side), (a, side)))):
            rows.append(F.struct(F.lit(e).alias("edge"), F.lit(t).alias("triangle"), *(at(k, i, m).alias(f"{'abc'[n]}{'xyz'[i]}") for n, (k, m) in enumerate(corner) for i in range(3))))
    return boxes.select(*keep, F.explode(F.array(*rows)).alias("w")).select(*keep, "w.*")


def edge_quads(vertices: DataFrame, edges: DataFrame, width: float) -> tuple[DataFrame, DataFrame]:
    """Edges as thin rectangles: (vertices: vid, x, y, z, r, g, b; faces: fid, a, b, c, r, g, blue) to be put behind other ones.

    vertices: vid, x, y, z. edges: eid, a, b (vids), r, g, blue. A rectangle lies across the vertical, or across the second axis where the edge is nearly
    vertical. Edges of no length, or with an unknown end, are left out. New ids are four for each edge, from its own: put them behind by adding
    to them."""
    ends = edges
    for n in "ab":
        ends = ends.join(vertices.select(F.col("vid").alias(n), *(F.col(c).alias(f"{n}{c}") for c in "xyz")), n)
    d = [F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    upright = F.abs(d[2] / F.col("__l")) > 0.9
    # the direction times the axis that it isn't close to
    side = [F.when(upright, -d[2]).otherwise(d[1]), F.when(upright, F.lit(0.0)).otherwise(-d[0]), F.when(upright, d[0]).otherwise(F.lit(0.0))]
    sized = ends.withColumn("__l", length).where(F.col("__l") >= 1e-12).select("eid", "r", "g", "blue", *(f"{n}{c}" for n in "ab" for c in "xyz"), *(v.alias(f"__s{i}") for i, v in enumerate(side)))
    norm = F.sqrt(F.col("__s0") * F.col("__s0") + F.col("__s1") * F.col("__s1") + F.col("__s2") * F.col("__s2")) + 1e-12
    half = [F.col(f"__s{i}") / norm * (width / 2) for i in range(3)]
    corner = lambda k, n, sign: F.struct((F.col("eid") * 4 + k).alias("vid"), *((F.col(f"{n}{c}") + sign * half[i]).alias(c) for i, c in enumerate("xyz")))
    corners = F.array(*(corner(k, n, sign) for k, (n, sign) in enumerate((("a", -1), ("a", 1), ("b", 1), ("b", -1)))))
    points = sized.select("r", "g", "blue", F.explode(corners).alias("v")).select("v.vid", "v.x", "v.y", "v.z", "r", "g", F.col("blue").alias("b"))
    first = F.col("eid") * 4
    faces = sized.select("eid", "r", "g", "blue", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (first + p).alias("a"), (first + q).alias("c")) for i, (p, q) in enumerate(((1, 2), (2, 3)))))).alias("f"))
    return points, faces.select((F.col("eid") * 2 + F.col("f.i")).alias("fid"), first.alias("a"), F.col("f.a").alias("b"), F.col("f.c").alias("c"), "r", "g", "blue")


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str) -> DataFrame:
    """An ASCII PLY file of vertices (vid, x, y, z, r, g, b) and faces (fid, a, b, c: vids; r, g and blue are written if they are there). Faces with an
    unknown corner are left out; vertices and faces stand in the order of their ids.

    Tasks write the lines of their range of ids as parts beside the file, with places in the file instead of ids; only the parts' names and counts
    reach the driver. One task then puts header and parts behind one another, a block at a time, under a hidden name that is changed
    at the end, and removes the parts. Returns one row: file, vertices, faces, bytes; the file is written when this is called."""
    spark = vertices.sparkSession
    folder = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"
    coloured = "blue" in faces.columns
    place = lambda rows, key: running(rows, [], [F.col(key)], {"i": F.lit(1).cast("long")}).withColumn("i", F.col("i") - 1)
    numbered = saved(place(vertices.select("vid", "x", "y", "z", "r", "g", "b"), "vid"), "vertices")
    at = numbered.select("vid", "i")
    out = faces.select("fid", "a", "b", "c", *(["r", "g", "blue"] if coloured else []))
    for c in "abc":
        out = out.join(at.select(F.col("vid").alias(c), F.col("i").alias(f"{c}i")), c)
    out = place(out.drop("a", "b", "c"), "fid")
    number = lambda c: F.col(c).cast("float").cast("string")
    texts = {
        "v": numbered.select("i", F.concat_ws(" ", number("x"), number("y"), number("z"), "r", "g", "b").alias("line")),
        "w": out.select("i", F.concat_ws(" ", F.lit("3"), "ai", "bi", "ci", *(["r", "g", "blue"] if coloured else [])).alias("line")),
    }

    def part(kind):
        def run(batches):
            fs, root = opened(folder)
            fs.create_dir(root, recursive=True)
            number, name, n, f = TaskContext.get().partitionId(), None, 0, None
            for batch in batches:
                if batch.num_rows and f is None:
                    name = f"{root}/{kind}-{number:06d}-{uuid.uuid4().hex}"
                    f = fs.open_output_stream(name)
                if batch.num_rows:
                    f.write("".join(f"{x}\n" for x in batch.column("line").to_pylist()).encode())
                    n += batch.num_rows
            if f is not None:
                f.close()
                yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([number], pa.int32()), pa.array([name]), pa.array([n], pa.int64())], names=["kind", "number", "name", "n"])

        return run

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    written = [saved(df.repartitionByRange(parts, "i").sortWithinPartitions("i").mapInArrow(part(kind), "kind string, number int, name string, n long"), "parts") for kind, df in texts.items()]
    names = written[0].unionByName(written[1]).orderBy("kind", "number").collect()  # a row for each task
    n, m = (sum(r["n"] for r in names if r["kind"] == k) for k in "vw")
    colour = "".join(f"property uchar {c}\n" for c in ("red", "green", "blue"))
    head = f"ply\nformat ascii 1.0\nelement vertex {n}\n" + "".join(f"property float {c}\n" for c in "xyz") + colour + f"element face {m}\nproperty list uchar int vertex_indices\n" + (colour if coloured else "") + "end_header\n"
    order = [r["name"] for r in names]

    def together(batches):
        for _ in batches:
            fs, final = opened(path)
            hidden, size = f"{final.rpartition('/')[0]}/.{final.rpartition('/')[2]}-{uuid.uuid4().hex}", len(head)
            with fs.open_output_stream(hidden) as f:
                f.write(head.encode())
                for name in order:
                    with fs.open_input_stream(name) as g:
                        while some := g.read(1 << 20):
                            f.write(some)
                            size += len(some)
            fs.move(hidden, final)
            yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64()), pa.array([m], pa.int64()), pa.array([size], pa.int64())], names=["file", "vertices", "faces", "bytes"])

    done = saved(spark.range(0, 1, 1, 1).mapInArrow(together, "file string, vertices long, faces long, bytes long"), "mesh")
    fs, root = opened(folder)
    if names:
        fs.delete_dir(root)
    return done


def graph_documents(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as JSON lines; null fields are left out, so evidence has only its relation's keys."""
    return tuple(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value")) for df in (nodes, edges))


def review_templates(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables for reviewers: the nodes and edges with empty columns for their answers."""
    blank = lambda *names: [F.lit("").alias(n) for n in names]
    return (
        nodes.select("node_id", "label", "kind", F.col("n").alias("point_count"), *blank("correct", "gt_label", "note")),
        edges.select("edge_id", "source", "relation", "target", "confidence", *blank("correct", "gt_relation", "note")),
    )


def category_report(histogram: DataFrame) -> DataFrame:
    """Lines of a report, most points first; categories without points are left out."""
    return histogram.where("n > 0").sort(F.col("n").desc(), "category").select(F.format_string("%-32s %12d %8.4f%%", "category", "n", F.col("share") * 100).alias("value"))
