"""Readers of point-cloud and mesh files, poses and matrices.

``pcd`` and ``ply`` are Python data sources: a partition for each file, rows as Arrow batches, files found and opened through
pyarrow's file systems. The same records are faster from Parquet; these are the way in.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.functions.labels import stripped

POINTS = "scene string, pid long, x double, y double, z double, r int, g int, b int"
FACES = "scene string, fid long, a long, b long, c long"
BATCH = 65_536


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _FileReader(DataSourceReader):
    suffix = ""

    def __init__(self, options):
        self.options, self.root = options, options["path"]

    def partitions(self) -> list[OneFile]:
        fs, root = opened(self.root)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            return []
        found = [root] if info.is_file else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(self.suffix))
        return [OneFile(p) for p in found]

    def read(self, partition: OneFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, _ = opened(self.root)
        with fs.open_input_stream(partition.path) as f:
            yield from self.rows(f.read(), partition.path.rpartition("/")[2].rpartition(".")[0])

    def rows(self, data: bytes, scene: str) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


def _batches(scene: str, columns: dict[str, np.ndarray], kinds: dict[str, pa.DataType], number: str, start: int = 0) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for a in range(0, n, BATCH):
        b = min(a + BATCH, n)
        arrays = [pa.array([scene] * (b - a)), pa.array(np.arange(start + a, start + b, dtype=np.int64)), *(pa.array(v[a:b]).cast(kinds[k]) for k, v in columns.items())]
        yield pa.RecordBatch.from_arrays(arrays, names=["scene", number, *columns])


_XYZ = {"x": pa.float64(), "y": pa.float64(), "z": pa.float64(), "r": pa.int32(), "g": pa.int32(), "b": pa.int32()}


def parse_pcd(data: bytes) -> dict[str, np.ndarray]:
    """x, y, z, r, g, b of a PCD file (ascii or binary); points with a coordinate that isn't finite go; no colour is 255."""
    head: dict[str, list[str]] = {}
    at = 0
    while True:
        end = data.index(b"\n", at)
        line = data[at:end].decode("ascii", "replace").split()
        at = end + 1
        if line and not line[0].startswith("#"):
            head[line[0].upper()] = line[1:]
            if line[0].upper() == "DATA":
                break
    names, sizes, types = head["FIELDS"], list(map(int, head["SIZE"])), head["TYPE"]
    counts = list(map(int, head.get("COUNT", ["1"] * len(names))))
    kind = np.dtype([(n, f"<{ {'F': 'f', 'I': 'i', 'U': 'u'}[t] }{s}".replace(" ", ""), (c,)) if c > 1 else (n, f"<{ {'F': 'f', 'I': 'i', 'U': 'u'}[t] }{s}".replace(" ", "")) for n, s, t, c in zip(names, sizes, types, counts, strict=True)])
    if head["DATA"][0] == "binary":
        rows = np.frombuffer(data[at : at + kind.itemsize * int(head["POINTS"][0])], kind)
        get = {n: rows[n] for n in names}
    elif head["DATA"][0] == "ascii":
        table = np.array([line.split() for line in data[at:].decode("ascii").splitlines() if line.strip()], dtype=object).reshape(-1, sum(counts))
        get, k = {}, 0
        for n, t, s, c in zip(names, types, sizes, counts, strict=True):
            own = table[:, k].astype(np.float64) if t == "F" else table[:, k].astype(np.int64)
            if n in ("rgb", "rgba"):
                own = own.astype(np.float32).view(np.uint32) if t == "F" else own.astype(np.uint32)
            get[n], k = own, k + c
    else:
        raise ValueError(f"PCD data of kind {head['DATA'][0]} isn't read")
    out = {a: np.asarray(get[a], np.float64) for a in "xyz"}
    packed = next((get[n] for n in ("rgb", "rgba") if n in get), None)
    if packed is not None:
        bits = packed if packed.dtype == np.uint32 else np.ascontiguousarray(packed).view(np.uint32)
        out |= {c: ((bits >> s) & 255).astype(np.int32) for c, s in (("r", 16), ("g", 8), ("b", 0))}
    else:
        out |= {c: np.full(len(out["x"]), 255, np.int32) for c in "rgb"}
    finite = np.isfinite(out["x"]) & np.isfinite(out["y"]) & np.isfinite(out["z"])
    return {k: v[finite] for k, v in out.items()}


def _lines(f) -> Iterator[bytes]:
    rest = b""
    while some := f.read(1 << 20):
        *whole, rest = (rest + some).split(b"\n")
        yield from whole
    if rest:
        yield rest


def ply_blocks(f, part: str) -> Iterator[dict[str, np.ndarray] | np.ndarray]:
    """The vertices (x, y, z, r, g, b) or the faces of an open ASCII PLY file, from blocks of BATCH lines; a face of more corners becomes a fan
    of triangles."""
    elements: list[tuple[str, int, list[str]]] = []
    lines = _lines(f)
    for line in lines:
        if b"end_header" in line:
            break
        word = line.decode("ascii", "replace").split()
        if word[:1] == ["format"] and word[1] != "ascii":
            raise ValueError("only ASCII PLY is read")
        if word[:1] == ["element"]:
            elements.append((word[1], int(word[2]), []))
        elif word[:1] == ["property"]:
            elements[-1][2].append(word[-1])
    for name, n, properties in elements:
        for start in range(0, max(n, 1), BATCH):
            rows = list(islice(lines, min(BATCH, n - start)))
            if len(rows) < min(BATCH, n - start):
                raise ValueError(f"the file ends before its {n} lines of {name}")
            if name == part == "vertex":
                table = np.array([row.decode("ascii").split() for row in rows], np.float64).reshape(len(rows), len(properties))
                at = {p: i for i, p in enumerate(properties)}
                yield {a: table[:, at[a]] for a in "xyz"} | {c[0]: table[:, at[c]].astype(np.int32) if c in at else np.full(len(rows), 255, np.int32) for c in ("red", "green", "blue")}
            elif name == part == "face":
                faces = []
                for row in rows:
                    count, *rest = map(int, (words := row.split())[: 1 + int(words[0])])
                    faces += [(rest[0], rest[k], rest[k + 1]) for k in range(1, count - 1)]
                yield np.array(faces, np.int64).reshape(-1, 3)


def parse_ply(data: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Vertices (x, y, z, r, g, b) and triangles of an ASCII PLY file."""
    vertices, faces = list(ply_blocks(io.BytesIO(data), "vertex")), list(ply_blocks(io.BytesIO(data), "face"))
    return {c: np.concatenate([v[c] for v in vertices]) for c in (vertices[0] if vertices else ())}, np.concatenate(faces or [np.zeros((0, 3), np.int64)])


class PcdSource(DataSource):
    """format("pcd"): points of all files under the path."""

    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema):
        return _PcdReader(self.options)


class _PcdReader(_FileReader):
    suffix = ".pcd"

    def rows(self, data, scene):
        yield from _batches(scene, parse_pcd(data), _XYZ, "pid")


class PlySource(DataSource):
    """format("ply"): vertices, or triangles with option part = faces."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return FACES if self.options.get("part") == "faces" else POINTS

    def reader(self, schema):
        return _PlyReader(self.options)


class _PlyReader(_FileReader):
    suffix = ".ply"

    def read(self, partition):
        """A block at a time: a large file is never held whole."""
        if partition is None:
            return
        fs, _ = opened(self.root)
        scene, start, faces = partition.path.rpartition("/")[2].rpartition(".")[0], 0, self.options.get("part") == "faces"
        with fs.open_input_stream(partition.path) as f:
            for block in ply_blocks(f, "face" if faces else "vertex"):
                columns = {c: block[:, i] for i, c in enumerate("abc")} if faces else block
                yield from _batches(scene, columns, dict.fromkeys("abc", pa.int64()) if faces else _XYZ, "fid" if faces else "pid", start)
                start += len(next(iter(columns.values())))


def register(spark: SparkSession) -> None:
    for source in (PcdSource, PlySource):
        spark.dataSource.register(source)


def pcd_bytes(x, y, z, r, g, b) -> bytes:
    """A binary PCD file of coloured points."""
    n = len(x)
    rows = np.zeros(n, np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("rgb", "<u4")]))
    rows["x"], rows["y"], rows["z"] = x, y, z
    rows["rgb"] = (np.asarray(r, np.uint32) << 16) | (np.asarray(g, np.uint32) << 8) | np.asarray(b, np.uint32)
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
    return head.encode() + rows.tobytes()


def poses(spark: SparkSession, path: str) -> DataFrame:
    """ts, px, py, pz, qx, qy, qz, qw of text files of one pose a line (eight numbers or more); other lines are passed over."""
    word = F.split(stripped(F.col("value")), r"\s+")
    names = ("px", "py", "pz", "qx", "qy", "qz", "qw")
    rows = spark.read.text(path).select(word.alias("w")).where(F.size("w") >= 8)
    out = rows.select(F.get("w", F.lit(0)).try_cast("double").try_cast("bigint").alias("ts"), *(F.get("w", F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)))
    return out.dropna()


def matrices(spark: SparkSession, path: str, rows: int = 4) -> DataFrame:
    """file, m (array of numbers, row by row) of text files of one matrix each; those with other than finite numbers, or of
    another size, go."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(stripped(F.col("value")), r"\s+").alias("w"))
    number = F.transform("w", lambda v: F.when(F.lower(v).rlike("^[+-]?[0-9.]+(e[+-]?[0-9]+)?$"), v.try_cast("double")))
    good = (F.size("w") == rows * rows) & F.forall("m", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return text.withColumn("m", number).where(good).select("file", "m")



def captions(spark: SparkSession, path: str) -> DataFrame:
    """id, image, captions of a JSON file with lists ``images`` (id, file_name) and ``annotations`` (image_id, id, caption)."""
    doc = spark.read.option("multiLine", True).json(path)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("id"), F.col("i.file_name").alias("image"))
    notes = doc.select(F.explode("annotations").alias("a")).groupBy(F.col("a.image_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("a.id", "a.caption"))).alias("c"))
    return images.join(notes, "id", "left").select("id", "image", F.coalesce(F.transform("c", lambda x: x["caption"]), F.array().cast("array<string>")).alias("captions"))


def optional_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, all columns as text; an empty table if it isn't there."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    fs, root = opened(path)
    if fs.get_file_info(root).type == pafs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    found = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    clean = found.toDF(*(c.lstrip("﻿") for c in found.columns))
    return clean.select(*(F.col(c).cast("string") if c in clean.columns else F.lit(None).cast("string").alias(c) for c in columns))
