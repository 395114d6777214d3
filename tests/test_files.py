"""Images and archives as files: every kind of PNG that is read, what isn't inflated or opened, tar headers, members by place."""

import gzip
import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.sources import archives, images


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("shape,depth", [((7, 9), 8), ((5, 130), 16), ((6, 11, 3), 8), ((1, 1), 8), ((200, 3), 16)])
def test_filters_and_depths(kind, shape, depth):
    rng = np.random.default_rng(kind + shape[0])
    image = rng.integers(0, 1 << depth, shape)
    raw = images.encoded(image, depth, kind=kind)
    out = list(images.pixels(raw, "f"))
    value = np.concatenate([b.column("value").to_numpy() for b in out]).reshape(shape[:2])
    want = image if image.ndim == 2 else (image[..., 0] << 16) | (image[..., 1] << 8) | image[..., 2]
    assert np.array_equal(value, want)
    red = np.concatenate([b.column("r").to_numpy() for b in out]).reshape(shape[:2])
    assert np.array_equal(red, image[..., 0] if image.ndim == 3 else image >> (depth - 8))
    y = np.concatenate([b.column("y").to_numpy() for b in out])
    assert np.array_equal(y, np.repeat(np.arange(shape[0]), shape[1]))
    some = list(images.pixels(raw, "f", 1, 2))
    assert sorted({v for b in some for v in b.column("y").to_pylist()}) == [v for v in (1, 2) if v < shape[0]]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_few_bits_a_pixel(depth):
    import struct
    import zlib

    rng = np.random.default_rng(depth)
    image = rng.integers(0, 1 << depth, (5, 13))
    bits = ((image[..., None] >> np.arange(depth - 1, -1, -1)) & 1).astype(np.uint8).reshape(5, -1)
    rows = np.packbits(bits, axis=1)
    body = b"".join(b"\0" + r.tobytes() for r in rows)

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    packed = zlib.compress(body)
    raw = images._SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 13, 5, depth, 0, 0, 0, 0)) + chunk(b"IDAT", packed[:7]) + chunk(b"tEXt", b"x") + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")
    out = next(images.pixels(raw, "f"))
    assert np.array_equal(out.column("value").to_numpy().reshape(5, 13), image)
    assert set(out.column("g").to_pylist()) <= {v * 255 // ((1 << depth) - 1) for v in range(1 << depth)}


def test_transparency():
    import struct
    import zlib

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    def built(colour, row, *more):
        return images._SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, colour, 0, 0, 0)) + b"".join(more) + chunk(b"IDAT", zlib.compress(b"\0" + row)) + chunk(b"IEND", b"")

    alpha = lambda raw: next(images.pixels(raw, "f")).column("a").to_pylist()
    assert alpha(built(6, bytes([1, 2, 3, 9, 4, 5, 6, 250]))) == [9, 250]
    assert alpha(built(4, bytes([1, 7, 2, 8]))) == [7, 8]
    assert alpha(built(3, bytes([0, 1]), chunk(b"PLTE", bytes(6)), chunk(b"tRNS", b"\x05"))) == [5, 255]
    assert alpha(built(2, bytes([1, 2, 3, 3, 2, 1]), chunk(b"tRNS", struct.pack(">HHH", 3, 2, 1)))) == [255, 0]
    assert alpha(built(0, bytes([1, 4]), chunk(b"tRNS", struct.pack(">H", 4)))) == [255, 0]
    with pytest.raises(ValueError):
        list(images.pixels(b"GIF89a" + bytes(50), "f"))
    raw = built(0, bytes([1, 4]))
    with pytest.raises(Exception, match="ends before|unpack|incomplete"):
        list(images.pixels(raw[: raw.index(b"IDAT") - 4], "f"))


def test_rows_behind_the_last_wanted_are_not_inflated():
    image = np.random.default_rng(1).integers(0, 256, (4000, 50))
    raw = bytearray(images.encoded(image, 8))
    raw[len(raw) // 2 :] = b"\xff" * (len(raw) - len(raw) // 2)  # what lies behind can't be read
    out = next(images.pixels(bytes(raw), "f", 3, 5))
    assert np.array_equal(out.column("value").to_numpy().reshape(3, 50), image[3:6])


def test_png_source(spark, tmp_path):
    rng = np.random.default_rng(2)
    made = {f"f{i}": rng.integers(0, 65536, (6, 5)) for i in range(9)}
    rows = spark.createDataFrame([(k, y, x, int(v[y, x])) for k, v in made.items() for y in range(6) for x in range(5)], "frame string, y int, x int, value int").repartition(4)
    path = f"file://{tmp_path}/png"
    assert images.write_images(rows, path, 16).count() == 9
    images.register(spark)
    df = spark.read.format("png").load(path)
    got = {k: np.zeros((6, 5), int) for k in made}
    for r in df.collect():
        got[r.frame][r.y, r.x] = r.value
    assert all(np.array_equal(got[k], v) for k, v in made.items())
    (tmp_path / "png" / "broken.png").write_bytes(b"no image")
    some = df.where("frame in ('f1', 'f4') and y > 1 and y <= 3 and value >= 0")
    assert {(r.frame, r.y) for r in some.select("frame", "y").collect()} == {(f, y) for f in ("f1", "f4") for y in (2, 3)}
    assert df.where("frame = 'none'").count() == 0
    files = spark.read.format("binaryFile").load(f"{path}/f3.png")
    assert {(r.y, r.x, r.value) for r in images.decoded(files).collect()} == {(y, x, int(made["f3"][y, x])) for y in range(6) for x in range(5)}
    assert spark.read.format("png").load(f"file://{tmp_path}/nothing").count() == 0
    metres = images.depth_in_metres(df.where("frame = 'f3' and y = 0 and x = 0")).first()
    assert metres.depth == int(made["f3"][0, 0]) / 1000


def test_tar_source(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = {}
    for kind, style in (("a", tarfile.USTAR_FORMAT), ("b", tarfile.GNU_FORMAT), ("c", tarfile.PAX_FORMAT)):
        with tarfile.open(tmp_path / f"{kind}.tar", "w", format=style) as tar:
            folder = tarfile.TarInfo("folder")
            folder.type = tarfile.DIRTYPE
            tar.addfile(folder)
            for i in range(30):
                data = rng.bytes(int(rng.choice([0, 1, 511, 512, 513, 3000])))
                data = gzip.compress(data) if i % 7 == 0 else data
                name = f"folder/{'long' * (30 if i % 5 == 0 and style != tarfile.USTAR_FORMAT else 1)}é{i}"
                head = tarfile.TarInfo(name)
                head.size = len(data)
                tar.addfile(head, io.BytesIO(data))
                want[kind, name] = data
    (tmp_path / "empty.tar").write_bytes(b"")
    (tmp_path / "text.tar").write_bytes(b"plain text" * 100)
    found = archives.index(spark, f"file://{tmp_path}")
    rows = archives.members(found.repartition(5), f"file://{tmp_path}", unpack=False).collect()
    assert {(r["class"], r.name): bytes(r.content) for r in rows} == want
    plain = archives.members(found, f"file://{tmp_path}").collect()
    assert all(bytes(r.content) == (gzip.decompress(want[r["class"], r.name]) if want[r["class"], r.name][:2] == b"\x1f\x8b" else want[r["class"], r.name]) for r in plain)
    (tmp_path / "bad.tar").write_bytes((tmp_path / "a.tar").read_bytes()[:512] + b"x" * 2048)
    assert found.where("archive = 'b.tar'").count() == 30  # nothing else is opened
    with pytest.raises(Exception, match="no tar header"):
        found.where("archive = 'bad.tar'").count()


def test_members_by_listings_of_blocks(spark, tmp_path):
    files, at = {}, 0
    (tmp_path / "blocks").mkdir()
    lines = []
    with tarfile.open(tmp_path / "n1.tar", "w", format=tarfile.USTAR_FORMAT) as tar:
        for i, n in enumerate((10, 512, 700, 3)):
            lines.append(f"block {at // 512}: n1_{i}.JPEG")
            data = bytes([i + 1]) * n
            head = tarfile.TarInfo(f"n1_{i}.JPEG")
            head.size = n
            tar.addfile(head, io.BytesIO(data))
            files[f"n1_{i}.JPEG"] = data
            at += 512 + -(-n // 512) * 512
    (tmp_path / "blocks" / "n1.log").write_text("\n".join([*lines, f"block {at // 512}: ** Block of NULs **"]) + "\n")
    ranges = archives.entry_ranges(archives.block_logs(spark, f"file://{tmp_path}/blocks"), ("n1_3.JPEG",))
    got = {r.name: bytes(r.content) for r in archives.members(ranges, f"file://{tmp_path}").collect()}
    assert {k: v.rstrip(b"\0") for k, v in got.items()} == {k: v for k, v in files.items() if k != "n1_3.JPEG"}


def test_archives_are_written_as_rows_stream_by(spark, tmp_path):
    rows = [(f"c{i % 3}", f"m{i:03d}", f"text {i}".encode() * (i % 50)) for i in range(200)] + [("c1", "null", None), (None, "x", b""), ("c1", None, b"")]
    df = spark.createDataFrame(rows, "class string, name string, content binary").repartition(6)
    made = archives.write_archives(df, f"file://{tmp_path}/out").collect()
    assert {r.archive: r.members for r in made} == {"c0.tar": 67, "c1.tar": 68, "c2.tar": 66}
    with tarfile.open(tmp_path / "out" / "c1.tar") as tar:
        names = tar.getnames()
        assert names == sorted(names) and tar.extractfile("m004").read() == b"text 4" * 4 and tar.extractfile("null").read() == b""
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".c")]
    assert archives.members(archives.index(spark, f"file://{tmp_path}/out"), f"file://{tmp_path}/out").where(F.col("content").isNotNull()).count() == 201
