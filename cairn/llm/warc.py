"""WARC archives as a Spark data source, written with payload deduplication and read with pushed-down header predicates (operator 9).

Writing: each task writes files of bounded size, one record a row; a record that repeats a payload is a revisit without one.
A record is two gzip members, its headers and its payload, each with its compressed and plain length in an extra field of the
member's header; any reader of .warc.gz reads them as one stream.
Reading plans one partition for each file (.warc.gz or .warc). Predicates on record type, target address, record id, date and
payload digest are pushed down and tested on the parsed headers; the payload of a record that fails, or whose payload isn't
asked for, is stepped over without being read or decoded, by the lengths (without them, members are decoded to find their end).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from cairn.llm.shared import new_path

#: Columns of a record. http_length is what the HTTP header says of the payload, also in revisits, which carry none.
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_length long, http_length long, payload binary"
#: Bytes of a file before the next is begun, and of a payload that are read at once.
FILE_BYTES, READ_BYTES = 64 << 20, 8 << 20
_HEADERS = {"record_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_PUSHED = tuple(_HEADERS)


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Piece(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


class WarcSource(DataSource):
    """format("warc"). Options: path; payload ("false" leaves all payloads out)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Takes equality, membership, prefix and presence on header columns; leaves the others to Spark."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in _PUSHED and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in _PUSHED and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in _PUSHED and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif column in _PUSHED and isinstance(f, IsNotNull):
                self.tests.append((column, "present", None))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        fs, root = _place(self.path)
        if fs.get_file_info(root).type == pafs.FileType.NotFound:
            return []
        files = [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith((".warc", ".warc.gz"))]
        return [Piece(f.path, f.size) for f in sorted(files, key=lambda f: f.path)]

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            has = row[column]
            if has is None or (kind == "in" and has not in value) or (kind == "starts" and not has.startswith(value)):
                return False
        return True

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, _ = _place(self.path)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])
        rows, held = [], 0
        with fs.open_input_file(partition.path) as f:
            parse = members if partition.path.endswith(".gz") else records
            for row, size in parse(f, partition.size, self._wanted, self.payload):
                rows.append(row)
                held += size
                if held >= READ_BYTES or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=schema)


class _Window:
    """Reads a file forward in blocks, and steps over what isn't needed."""

    def __init__(self, f, size: int, block: int = 1 << 18):
        self.f, self.size, self.block, self.at, self.data = f, size, block, 0, b""

    def until(self, mark: bytes, start: int) -> bytes:
        """What lies from start to the end of the mark."""
        self.seek(start)
        while (found := self.data.find(mark, start - self.at)) < 0:
            end = self.at + len(self.data)
            if end >= self.size:
                raise ValueError(f"a record's header at {start} has no end")
            self.f.seek(end)
            self.data += self.f.read(min(self.block, self.size - end))
        return self.data[start - self.at : found + len(mark)]

    def exactly(self, start: int, n: int) -> bytes:
        """n bytes from start, fewer at the end of the file."""
        if not (self.at <= start and start + n <= self.at + len(self.data)):
            self.f.seek(start)
            if n > self.block:
                return self.f.read(n)
            self.at, self.data = start, self.f.read(min(self.block, self.size - start))
        return self.data[start - self.at : start - self.at + n]

    def seek(self, start: int) -> None:
        if not self.at <= start < self.at + len(self.data):
            self.at, self.data = start, b""
        elif start - self.at > self.block:
            self.data, self.at = self.data[start - self.at :], start


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _row(fields: dict[str, str]) -> dict:
    return {column: fields.get(name) for column, name in _HEADERS.items()} | {"content_length": int(fields["content-length"]), "http_length": None, "payload": None}


def _http_length(http: bytes) -> int | None:
    return next((int(line[15:]) for line in http.split(b"\r\n") if line[:15].lower() == b"content-length:"), None)


def records(f, size: int, wanted, payload: bool):
    """(row, bytes held) of the records that ``wanted`` keeps, headers first; f is a plain WARC file."""
    window, at = _Window(f, size), 0
    while at < size:
        head = window.until(b"\r\n\r\n", at)
        fields = _fields(head[:-4])
        row = _row(fields)
        body, length = at + len(head), row["content_length"]
        at = body + length + 4
        if not wanted(row):
            continue
        http = window.until(b"\r\n\r\n", body) if fields.get("content-type", "").startswith("application/http") else b""
        row["http_length"] = _http_length(http)
        if payload and row["record_type"] != "revisit":
            row["payload"] = window.exactly(body + len(http), length - len(http))
        yield row, len(row["payload"] or b"") + 400


_GZIP = struct.Struct("<4sIBBHccHII")


def gzip_member(data: bytes, level: int = 3) -> bytes:
    """One gzip member with its compressed and plain lengths in the extra field SL."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = _GZIP.size + len(body) + 8
    return _GZIP.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"S", b"L", 8, total, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _lengths(window: _Window, at: int) -> tuple[int, int] | None:
    """(compressed, plain) lengths that the member at this place says of itself."""
    head = window.exactly(at, _GZIP.size)
    if len(head) == _GZIP.size and head[:4] == b"\x1f\x8b\x08\x04" and head[10:16] == b"\x0c\x00SL\x08\x00":
        return struct.unpack("<II", head[16:24])
    return None


def _member(window: _Window, at: int) -> tuple[bytes, int]:
    """The plain bytes of the member at this place, and the next member's place."""
    known = _lengths(window, at)
    if known:
        return zlib.decompress(window.exactly(at, known[0]), 31), at + known[0]
    out, unpacker = [], zlib.decompressobj(31)
    while not unpacker.eof:
        some = window.exactly(at, window.block)
        if not some:
            raise ValueError("a gzip member has no end")
        out.append(unpacker.decompress(some))
        at += len(some) - len(unpacker.unused_data)
    return b"".join(out), at


def members(f, size: int, wanted, payload: bool):
    """As records, of a WARC file of gzip members: a record begins with a member and may go on in more."""
    window, at = _Window(f, size), 0
    while at < size:
        data, at = _member(window, at)
        end = data.index(b"\r\n\r\n") + 4
        fields = _fields(data[: end - 4])
        row = _row(fields)
        rest, parts = row["content_length"] + 4 - (len(data) - end), []
        while rest > 0 and at < size:
            known = _lengths(window, at)
            if known:
                parts.append(at)
                rest, at = rest - known[1], at + known[0]
            else:
                plain, at = _member(window, at)
                parts.append(plain)
                rest -= len(plain)
        if not wanted(row):
            continue
        take = payload and row["record_type"] != "revisit"
        block = data[end:] + b"".join(p if isinstance(p, bytes) else _member(window, p)[0] for p in (parts if take else ()))
        http = block.index(b"\r\n\r\n") + 4 if fields.get("content-type", "").startswith("application/http") else 0
        row["http_length"] = _http_length(block[:http])
        if take:
            row["payload"] = block[http : row["content_length"]]
        yield row, len(row["payload"] or b"") + 400


def record(row: dict) -> bytes:
    """A record of WARC 1.1, packed, with an HTTP response as its block; a revisit has the response's header alone."""
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["http_length"]
    payload = b"" if revisit else row["payload"] or b""
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row['date']}", f"WARC-Payload-Digest: {row['payload_digest']}",
        *([f"WARC-Target-URI: {clean(row['target_uri'])}"] if row["target_uri"] is not None else []),
        *([f"WARC-Refers-To: {row['refers_to']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}",
    ]
    first = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + http
    return gzip_member(first) + gzip_member(payload + b"\r\n\r\n") if payload else gzip_member(first + b"\r\n\r\n")


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Tasks write hidden files; those of tasks that ended well are renamed at commit, the others are removed."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _place(self.path)
        fs.create_dir(root, recursive=True)
        files, out = [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        files.append(f"{root}/.part-{uuid.uuid4().hex}.warc.gz.tmp")
                        out = fs.open_output_stream(files[-1])
                    out.write(record(row))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, _ = _place(self.path)
        for m in messages:
            for name in m.files if m else ():
                folder, _, last = name.rpartition("/")
                fs.move(name, f"{folder}/{last[1:].removesuffix('.tmp')}")

    def abort(self, messages) -> None:
        fs, _ = _place(self.path)
        for m in messages:
            for name in m.files if m else ():
                fs.delete_file(name)


def to_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The records of a table of pages: of equal payloads of ``least`` bytes or more, that with the largest id is the response
    and the others revisit it; all smaller ones are responses.

    A null payload is empty; a null address is left out. Rows with the largest id that repeat are all responses; rows with a
    null id revisit, or are responses where no row of the payload has an id. Record ids come from the ids, so a null id's is
    that of ``null``. Native: equal payloads meet as digests with their largest id, pre-aggregated.
    """
    rows = pages.select(pages[id_col].cast("long").alias("page"), pages[uri_col].cast("string").alias("target_uri"), F.encode(F.coalesce(pages[html_col], F.lit("")), "utf-8").alias("payload"))
    rows = rows.select("page", "target_uri", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("http_length"))
    largest = rows.where(F.col("http_length") >= least).groupBy("digest", "http_length").agg(F.max("page").alias("origin"), F.count("*").alias("n")).where("n > 1 and origin is not null").select(F.col("digest").alias("d"), F.col("http_length").alias("l"), "origin")
    marked = rows.join(largest, (F.col("digest") == F.col("d")) & (F.col("http_length") == F.col("l")), "left")
    revisit = F.coalesce(F.col("origin").isNotNull() & ~F.col("page").eqNullSafe(F.col("origin")), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return marked.select(
        urn(F.col("page")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("date"), F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(revisit, urn(F.col("origin"))).alias("refers_to"), F.lit(None).cast("long").alias("content_length"), "http_length", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def written(records_df: DataFrame, path: str) -> None:
    register(records_df.sparkSession)
    records_df.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages as archives and reads them back: page_id, payload_bytes, payload_digest (of the payload as read, for
    revisits as their header says), record_type, refers_to. Payloads of responses are decoded and hashed anew; revisits are
    read by a pushed-down predicate, without payloads."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    written(to_records(pages), path)
    page = lambda c: F.regexp_extract(c, "([0-9-]+)>$", 1).try_cast("long")
    responses = read(spark, path).where("record_type = 'response'")
    revisits = read(spark, path, payload=False).where("record_type = 'revisit'")
    return (
        responses.select(page(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
        .unionByName(revisits.select(page(F.col("record_id")).alias("page_id"), F.col("http_length").alias("payload_bytes"), F.substring("payload_digest", 6, 40).alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to")))
    )


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS origin FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> origin THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> origin THEN origin END AS refers_to
FROM m
"""
