"""Label and depth images as tables of pixels: PNG files in and out.

``png`` is a Python data source. Files are planned as partitions of about equal bytes; what is asked of frames is answered by their
names before anything is opened, and what is asked of rows by inflating a file no further than its last wanted row. ``decoded`` does the
same to the files that Spark's own binary reader gives, for stores that only Spark reads.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from cairn.sources.formats import opened

PIXELS = "frame string, y int, x int, value int, r int, g int, b int, a int"
#: Bytes of files that share a partition, rows of an image that are unfiltered at once, and pixels of a batch at least.
PART_BYTES, SLAB, BATCH = 16 << 20, 64, 1 << 16
# Fixed values of the format: the signature, and samples of a pixel by colour type.
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class Header:
    """What a file says of itself before its pixels; ``data`` are the places of its compressed parts."""

    def __init__(self, raw: bytes):
        if raw[:8] != _SIGNATURE:
            raise ValueError("not a PNG file")
        at, self.palette, self.clear, self.data = 8, None, b"", []
        while at + 8 <= len(raw):
            size, kind = struct.unpack(">I4s", raw[at : at + 8])
            body = slice(at + 8, at + 8 + size)
            if kind == b"IHDR":
                self.width, self.height, self.depth, self.colour, _, _, laced = struct.unpack(">IIBBBBB", raw[body])
                if laced:
                    raise ValueError("interlaced PNG files aren't read")
            elif kind == b"PLTE":
                self.palette = np.frombuffer(raw[body], np.uint8).reshape(-1, 3)
            elif kind == b"tRNS":
                self.clear = raw[body]
            elif kind == b"IDAT":
                self.data.append(body)
            elif kind == b"IEND":
                break
            at = body.stop + 4
        self.samples = _SAMPLES[self.colour]
        self.row = (self.width * self.samples * self.depth + 7) // 8
        self.step = max(1, self.samples * self.depth // 8)


def _average(line: bytearray, above: bytes, step: int) -> None:
    for i in range(len(line)):
        line[i] = (line[i] + ((line[i - step] if i >= step else 0) + above[i]) // 2) & 255


def _paeth(line: bytearray, above: bytes, step: int) -> None:
    for i in range(len(line)):
        a, b, c = (line[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        line[i] = (line[i] + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255


def unfiltered(kind: int, line: bytes, above: np.ndarray, step: int) -> np.ndarray:
    """A row's bytes from what its filter left of them and from the row above."""
    own = np.frombuffer(line, np.uint8)
    if kind == 0:
        return own
    if kind == 1:
        padded = np.zeros(-(-len(own) // step) * step, np.uint8)
        padded[: len(own)] = own
        return np.add.accumulate(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(own)]
    if kind == 2:
        return own + above
    if kind not in (3, 4):
        raise ValueError(f"PNG filter {kind} isn't known")
    out = bytearray(line)
    (_average if kind == 3 else _paeth)(out, above.tobytes(), step)
    return np.frombuffer(bytes(out), np.uint8)


def lines(raw: bytes, head: Header, last: int) -> Iterator[np.ndarray]:
    """Rows of bytes from the first to ``last``; what comes behind is not inflated."""
    unpack, held, above = zlib.decompressobj(), b"", np.zeros(head.row, np.uint8)
    parts, done, size = iter(head.data), 0, head.row + 1
    last = min(last, head.height - 1)
    pending = b""
    while done <= last:
        if len(held) < size:
            pending = pending or raw[next(parts, slice(0, 0))]
            if not pending:
                raise ValueError("a PNG file ends before its last row")
            held += unpack.decompress(pending, size * SLAB)
            pending = unpack.unconsumed_tail
            continue
        for at in range(0, len(held) - size + 1, size):
            above = unfiltered(held[at], held[at + 1 : at + size], above, head.step)
            yield above
            done += 1
            if done > last:
                return
        held = held[len(held) - len(held) % size :]


def samples(line: np.ndarray, head: Header) -> np.ndarray:
    """A row's samples, a row of numbers for each pixel."""
    if head.depth == 16:
        out = line.view(">u2").astype(np.int32)
    elif head.depth == 8:
        out = line.astype(np.int32)
    else:
        bits = np.unpackbits(line).reshape(-1, head.depth)
        out = (bits << np.arange(head.depth - 1, -1, -1)).sum(axis=1, dtype=np.int32)[: head.width * head.samples]
    return out.reshape(head.width, head.samples)


def _colours(s: np.ndarray, head: Header) -> dict[str, np.ndarray]:
    """value, r, g, b, a of rows of samples. The colour's channels are bytes; value is the sample of grey images, the number in the
    palette, or red, green and blue in 24 bits."""
    full = np.full(len(s), 255, np.int32)
    byte = (lambda v: v >> 8) if head.depth == 16 else (lambda v: v * 255 // ((1 << head.depth) - 1))
    if head.colour == 3:
        rgb = head.palette[s[:, 0]].astype(np.int32)
        alpha = np.full(len(head.palette), 255, np.int32)
        alpha[: len(head.clear)] = np.frombuffer(head.clear, np.uint8)[: len(alpha)]
        return {"value": s[:, 0], "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2], "a": alpha[s[:, 0]]}
    if head.colour in (0, 4):
        grey = byte(s[:, 0])
        alpha = byte(s[:, 1]) if head.colour == 4 else np.where(s[:, 0] == struct.unpack(">H", head.clear[:2])[0], 0, full) if head.clear else full
        return {"value": s[:, 0], "r": grey, "g": grey, "b": grey, "a": alpha}
    r, g, b = (byte(s[:, i]) for i in range(3))
    alpha = byte(s[:, 3]) if head.colour == 6 else np.where((s[:, :3] == struct.unpack(">HHH", head.clear[:6])).all(axis=1), 0, full) if head.clear else full
    return {"value": (r << 16) | (g << 8) | b, "r": r, "g": g, "b": b, "a": alpha}


_KINDS = [("frame", pa.string()), *((c, pa.int32()) for c in ("y", "x", "value", "r", "g", "b", "a"))]


def pixels(raw: bytes, frame: str, first: int = 0, last: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of the pixels of an image's rows from ``first`` to ``last``."""
    head = Header(raw)
    last = head.height - 1 if last is None else last
    held: list[np.ndarray] = []

    def batch(until: int) -> pa.RecordBatch:
        s, n = np.concatenate(held), len(held)
        places = {"y": np.repeat(np.arange(until - n, until, dtype=np.int32), head.width), "x": np.tile(np.arange(head.width, dtype=np.int32), n)}
        columns = places | _colours(s, head)
        return pa.RecordBatch.from_arrays([pa.array([frame] * len(s)), *(pa.array(columns[c].astype(np.int32)) for c, _ in _KINDS[1:])], names=[c for c, _ in _KINDS])

    y = 0
    for y, line in enumerate(lines(raw, head, last)):
        if y >= first:
            held.append(samples(line, head))
        if held and len(held) * head.width >= BATCH:
            yield batch(y + 1)
            held.clear()
    if held:
        yield batch(y + 1)


def encoded(values: np.ndarray, depth: int = 8, palette: np.ndarray | None = None, kind: int | None = None) -> bytes:
    """A PNG file of (height, width) grey samples or numbers in a palette, or of (height, width, 3) bytes of colour. kind: the filter of all
    rows; by default rows are told by what they differ from the row above."""
    grey = values.ndim == 2
    height, width = values.shape[:2]
    colour = 3 if palette is not None else 0 if grey else 2
    raw = values.astype(">u2" if depth == 16 else np.uint8).tobytes()
    rows = np.frombuffer(raw, np.uint8).reshape(height, -1)
    step = (1 if grey else 3) * depth // 8
    kind = 2 if kind is None else kind
    above = np.concatenate((np.zeros((1, rows.shape[1]), np.uint8), rows[:-1]))
    left = np.pad(rows, ((0, 0), (step, 0)))[:, : rows.shape[1]]
    corner = np.pad(above, ((0, 0), (step, 0)))[:, : rows.shape[1]]
    if kind == 4:
        a, b, c = (x.astype(int) for x in (left, above, corner))
        da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)).astype(np.uint8)
    else:
        guess = (0, left, above, ((left.astype(int) + above) // 2).astype(np.uint8))[kind]
    body = np.concatenate((np.full((height, 1), kind, np.uint8), rows - guess), axis=1).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    told = chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b""
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + told + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def _stem(path: str) -> str:
    return path.rpartition("/")[2].removesuffix(".png")


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PngSource(DataSource):
    """format("png"): the pixels of all .png files under the path; frame is a file's name without its ending."""

    @classmethod
    def name(cls) -> str:
        return "png"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema):
        return _PngReader(self.options)


class _PngReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.frames: set[str] | None = None
        self.first, self.last = 0, None

    def pushFilters(self, filters):  # noqa: N802
        """Frames by name and rows by number; whatever else there is, Spark tests."""
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if column == "frame" and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.frames = names if self.frames is None else self.frames & names
            elif column == "y" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                low = f.value + isinstance(f, GreaterThan) if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual) else None
                high = f.value - isinstance(f, LessThan) if isinstance(f, EqualTo | LessThan | LessThanOrEqual) else None
                self.first = self.first if low is None else max(self.first, low)
                self.last = self.last if high is None else high if self.last is None else min(self.last, high)
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = opened(self.root)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            return [Files([])]
        found = [info] if info.is_file else sorted((f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".png")), key=lambda f: f.path)
        out, size = [Files([])], 0
        for f in found:
            if self.frames is not None and _stem(f.path) not in self.frames:
                continue
            if size and size + f.size > PART_BYTES:
                out, size = [*out, Files([])], 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.root)
        for path in partition.paths:
            with fs.open_input_stream(path) as f:
                yield from pixels(f.read(), _stem(path), self.first, self.last)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PngSource)


def decoded(files: DataFrame) -> DataFrame:
    """Pixels of files as ``spark.read.format("binaryFile")`` gives them (path, content)."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                yield from pixels(content.as_py(), _stem(path.as_py()))

    return files.select("path", "content").mapInArrow(run, PIXELS)


def write_images(rows: DataFrame, path: str, depth: int = 8, palette: np.ndarray | None = None) -> DataFrame:
    """One PNG file for each frame of rows (frame, y, x, value), written by the task that holds the frame under a hidden name and then renamed; an
    image is one group by its nature. Pixels that aren't there are 0. With a palette (up to 256 rows of three bytes) values are numbers in
    it. Returns frame, file, height and width; the files are written when this is read."""

    def run(key, table):
        fs, root = opened(path)
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "value"))
        image = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.int64)
        image[y, x] = v
        folder, name = root.rstrip("/"), str(key[0].as_py()).replace("/", "_")
        fs.create_dir(folder, recursive=True)
        hidden, final = f"{folder}/.{name}-{uuid.uuid4().hex}", f"{folder}/{name}.png"
        with fs.open_output_stream(hidden) as f:
            f.write(encoded(image, depth, palette))
        fs.move(hidden, final)
        return pa.table({"frame": [name], "file": [final], "height": pa.array([image.shape[0]], pa.int32()), "width": pa.array([image.shape[1]], pa.int32())})

    plain = rows.select(F.col("frame").cast("string").alias("frame"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("int").alias("value"))
    return plain.groupBy("frame").applyInArrow(run, "frame string, file string, height int, width int")


def depth_in_metres(rows: DataFrame, unit: float = 1000.0) -> DataFrame:
    """frame, y, x, depth: samples in thousandths of a metre as metres; 0 stands for none and stays 0."""
    return rows.select("frame", "y", "x", (F.col("value").cast("double") / unit).alias("depth"))


def labels_by_colour(rows: DataFrame, palette: DataFrame, default: int | None = None) -> DataFrame:
    """frame, y, x, label: the class (class_id) of the palette whose colour a pixel has exactly, the largest of those that share it; the
    default for other colours."""
    one = palette.groupBy("r", "g", "b").agg(F.max("class_id").alias("label"))
    return rows.join(one, ["r", "g", "b"], "left").select("frame", "y", "x", F.coalesce("label", F.lit(default)).alias("label") if default is not None else "label")
