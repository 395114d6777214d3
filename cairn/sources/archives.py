"""Tar archives as tables: an index of members without their bytes, and members read by their places.

``tar`` is a Python data source that walks from header to header and steps over what lies between; archives are partitions, and files that
aren't archives give nothing. The index is a table (archive, name, class, offset, size) to be kept as Parquet; ``members`` reads the bytes of
chosen rows, a range of the archive for each.
"""

from __future__ import annotations

import io
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from cairn.operators.annotations import next_pairs
from cairn.sources.formats import opened

INDEX = "archive string, number long, name string, size long, offset long"
#: Bytes of a block of the format; rows of a batch.
BLOCK, BATCH = 512, 4096


def _number(field: bytes) -> int:
    """A number in octal digits, or in the binary form of large ones (first bit set)."""
    if field[:1] >= b"\x80":
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    return int(field.strip(b" \0") or b"0", 8)


def _text(field: bytes) -> str:
    return field.partition(b"\0")[0].decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode()


def _sound(head: bytes) -> bool:
    """The header's sum of bytes is what it says, with its own field as blanks."""
    try:
        return len(head) == BLOCK and _number(head[148:156]) == sum(head[:148]) + 256 + sum(head[156:])
    except ValueError:
        return False


def _extended(body: bytes) -> dict[str, str]:
    """Records of an extended header: a length, a blank, name=value and a newline each."""
    out, at = {}, 0
    while at < len(body):
        size = int(body[at : body.index(b" ", at)])
        key, _, value = body[body.index(b" ", at) + 1 : at + size - 1].partition(b"=")
        out[key.decode()] = value.decode("utf-8", "replace")
        at += size
    return out


def walked(f, size: int) -> Iterator[tuple[str, int, int]]:
    """(name, size, offset) of the ordinary members of an open archive; long names (both ways to tell them) are put together."""
    at, name, more = 0, None, {}
    while at + BLOCK <= size:
        f.seek(at)
        head = f.read(BLOCK)
        if not head.strip(b"\0"):
            return
        if not _sound(head):
            raise ValueError(f"no tar header at {at}")
        own, kind, body = _number(head[124:136]), head[156:157], at + BLOCK
        if kind in b"Lxg":
            data = f.read(own)
            if kind == b"L":
                name = _text(data)
            elif kind == b"x":
                more = _extended(data)
        else:
            own = int(more.get("size", own))
            if kind in (b"0", b"\0", b"7"):
                prefix = _text(head[345:500]) if head[257:262] == b"ustar" else ""
                plain = _text(head[:100])
                yield more.get("path") or name or (f"{prefix}/{plain}" if prefix else plain), own, body
            name, more = None, {}
        at = body + -(-own // BLOCK) * BLOCK


class Archive(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


class TarSource(DataSource):
    """format("tar"): archive (its name), number (from 0), name, size and offset of the members of all .tar files under the path."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema):
        return _TarReader(self.options)


class _TarReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.archives: set[str] | None = None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("archive",) and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.archives = names if self.archives is None else self.archives & names
            else:
                yield f

    def partitions(self) -> list[Archive]:
        fs, root = opened(self.root)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            return [Archive("", 0)]
        found = [info] if info.is_file else sorted((f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".tar")), key=lambda f: f.path)
        return [Archive(f.path, f.size) for f in found if self.archives is None or f.path.rpartition("/")[2] in self.archives] or [Archive("", 0)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = opened(self.root)
        archive, rows = partition.path.rpartition("/")[2], []

        def batch() -> pa.RecordBatch:
            names, sizes, offsets = (list(c) for c in zip(*(r[1:] for r in rows), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([archive] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array(names), pa.array(sizes, pa.int64()), pa.array(offsets, pa.int64())], names=["archive", "number", "name", "size", "offset"])

        with fs.open_input_file(partition.path) as f:
            if not _sound(f.read(BLOCK)):
                return  # another kind of file, or an empty one
            for i, found in enumerate(walked(f, partition.size)):
                rows.append((i, *found))
                if len(rows) == BATCH:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarSource)


def index(spark: SparkSession, path: str) -> DataFrame:
    """archive, class (the archive's name without its ending), number, name, size, offset."""
    register(spark)
    return spark.read.format("tar").load(path).select("archive", F.regexp_replace("archive", r"\.tar$", "").alias("class"), "number", "name", "size", "offset")


def _plain(content: bytes) -> bytes:
    return zlib.decompressobj(31).decompress(content) if content[:2] == b"\x1f\x8b" else content


def members(rows: DataFrame, path: str, unpack: bool = True) -> DataFrame:
    """rows (archive, offset, size and others) with ``content``, read where the rows are: of each archive only the ranges that are asked for, in
    the order of their places. A null archive, size or offset has no content; content that begins like a gzip file is unpacked if ``unpack``."""
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])

    def run(batches):
        fs, root = opened(path)
        known, f = None, None
        try:
            for batch in batches:
                out = []
                for archive, offset, size in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "size")), strict=True):
                    if archive is None or offset is None or size is None:
                        out.append(None)
                        continue
                    if archive != known:
                        if f is not None:
                            f.close()
                        known, f = archive, fs.open_input_file(f"{root.rstrip('/')}/{archive}")
                    content = f.read_at(size, offset)
                    out.append(_plain(content) if unpack else content)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)
        finally:
            if f is not None:
                f.close()

    return rows.sortWithinPartitions("archive", "offset").mapInArrow(run, schema)


def block_logs(spark: SparkSession, path: str) -> DataFrame:
    """class, line, block, name of all .log files under the path, each line ``block N: name``; a class is a file's name without its ending.
    The listing of an archive fits a row; the name of the line that closes it is null."""
    text = spark.read.option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true").text(path, wholetext=True)
    lines = text.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.log$", 1).alias("class"), F.posexplode(F.split("value", "\n")).alias("line", "v"))
    told = lines.where(F.col("v").rlike(r"^block [0-9]+: "))
    name = F.rtrim(F.regexp_replace("v", r"^block [0-9]+: ", ""))
    return told.select("class", F.col("line").cast("long").alias("line"), F.regexp_extract("v", r"^block ([0-9]+): ", 1).cast("long").alias("block"), F.when(name != "** Block of NULs **", name).alias("name"))


def entry_ranges(log: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """archive, class, name, offset, size, in bytes, from such listings: an entry ends where the next line of its archive begins and its first block is
    its header, so what follows the content up to a whole block comes along. The last line of an archive is no entry; entries named in ``without``
    are left out."""
    found = next_pairs(log, "class", ["line"], "block", BLOCK).where(F.col("name").isNotNull() & ~F.col("name").isin(*without))
    return found.select(F.concat("class", F.lit(".tar")).alias("archive"), "class", "name", (F.col("start_offset") + BLOCK).alias("offset"), (F.col("end_offset") - F.col("start_offset") - BLOCK).alias("size"))


def write_archives(rows: DataFrame, path: str) -> DataFrame:
    """One archive for each class of rows (class, name, content), members in order of their names, written by the task that holds the class as its
    rows stream by, under a hidden name that is changed when the archive is whole. Rows without a class or name are left out; a null content
    is empty. Returns archive, members, size; the files are written when this is read."""

    def run(batches):
        fs, root = opened(path)
        folder = root.rstrip("/")
        fs.create_dir(folder, recursive=True)
        own, n, f, tar, hidden = None, 0, None, None, ""

        def closed():
            tar.close()
            size = f.tell()
            f.close()
            fs.move(hidden, f"{folder}/{own}.tar")
            return pa.RecordBatch.from_arrays([pa.array([f"{own}.tar"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["archive", "members", "size"])

        for batch in batches:
            for which, name, content in zip(*(batch.column(c) for c in ("class", "name", "content")), strict=True):
                if which.as_py() != own:
                    if own is not None:
                        yield closed()
                    own, n = which.as_py(), 0
                    hidden = f"{folder}/.{own}-{uuid.uuid4().hex}"
                    f = fs.open_output_stream(hidden)
                    tar = tarfile.open(fileobj=f, mode="w|")
                data = content.as_py() or b""
                head = tarfile.TarInfo(name.as_py())
                head.size = len(data)
                tar.addfile(head, io.BytesIO(data))
                n += 1
        if own is not None:
            yield closed()

    plain = rows.select(F.replace(F.col("class").cast("string"), F.lit("/"), F.lit("_")).alias("class"), F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).dropna(subset=["class", "name"])
    return plain.repartition("class").sortWithinPartitions("class", "name").mapInArrow(run, "archive string, members long, size long")
