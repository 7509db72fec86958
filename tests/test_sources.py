"""Scans, pictures, metadata and caches, on files made here."""

import struct
import zlib

import numpy as np
import pytest

from framesieve.functions import kernels
from framesieve.sources import cache, images, scan


def png(pixels):
    h, w = pixels.shape[:2]

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture(seed, side=64):
    x, y = np.meshgrid(np.arange(side), np.arange(side))
    return np.stack([(seed + 3 * x) % 256, (seed + 5 * y) % 256, (seed + 2 * (x + y)) % 256], -1).astype(np.uint8)


@pytest.fixture
def library(tmp_path):
    for name, content in {"a/IMG_1.CR2": b"raw", "a/img_1.jpg": b"x", "a/IMG_1.XMP": b"s", "a/IMG_2.heic": b"h", "a/IMG_2.png": png(picture(5)), "a/IMG_3.xmp": b"s", "b/IMG_1.png": png(picture(9)), "b/notes.txt": b"t", "winners/IMG_9.jpg": b"w", "b/bad.png": b"no picture"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_scan_and_pairs(spark, library):
    files = scan.list_files(spark, str(library))
    rows = {r["primary"].removeprefix(f"{library}/"): r for r in scan.pair_files(files).collect()}
    assert set(rows) == {"a/IMG_1.CR2", "a/IMG_2.png", "b/IMG_1.png", "b/bad.png"}
    raw = rows["a/IMG_1.CR2"]
    assert raw["companions"] == [f"{library}/a/img_1.jpg", f"{library}/a/IMG_1.XMP"] and raw["analysis"].endswith("img_1.jpg") and raw["size"] == 3
    assert rows["a/IMG_2.png"]["companions"] == [] and rows["a/IMG_2.png"]["kind"] == "image"


def test_pictures(spark, library):
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.described(images.decoded(spark, str(library / "b"))).collect()}
    good, bad = rows["IMG_1.png"], rows["bad.png"]
    assert bad["failure"] == images.DECODE_FAILURE and bad["phash"] is None
    want = kernels.hashes(kernels.luma(picture(9)))
    assert {k: good[k] for k in want} == want and good["failure"] is None and good["width"] == 64 and len(good["color_hist"]) == 432
    assert good["mean"] == pytest.approx(float(kernels.luma(picture(9)).mean()))


def test_previews(spark):
    inner = b"\xff\xd8abc\xff\xd9"
    assert images.jpeg_segments(b"head" + inner + b"mid\xff\xd8longer one\xff\xd9tail\xff\xd8open") == [inner, b"\xff\xd8longer one\xff\xd9"]
    files = spark.createDataFrame([("x.cr2", b"head" + inner + b"\xff\xd8longer one\xff\xd9"), ("y.cr2", b"none")], "path string, content binary")
    assert [(r["path"], r["place"], bytes(r["preview"])) for r in images.raw_previews(files).orderBy("place").collect()] == [("x.cr2", 0, b"\xff\xd8longer one\xff\xd9"), ("x.cr2", 1, inner)]


def exif_bytes(end):
    entries = [(0x010F, 2, 6, b"Canon\0"), (0x0112, 3, 1, struct.pack(end + "H", 6)), (0x829D, 5, 1, struct.pack(end + "II", 28, 10)), (0x8827, 3, 1, struct.pack(end + "H", 400))]
    body, tail, at = b"", b"", 8 + 2 + 12 * len(entries) + 4
    for tag, kind, n, value in entries:
        if len(value) > 4:
            body += struct.pack(end + "HHII", tag, kind, n, at + len(tail))
            tail += value
        else:
            body += struct.pack(end + "HHI", tag, kind, n) + value.ljust(4, b"\0")
    tiff = (b"II*\0" if end == "<" else b"MM\0*") + struct.pack(end + "I", 8) + struct.pack(end + "H", len(entries)) + body + b"\0\0\0\0" + tail
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"


def test_metadata(spark):
    want = {"make": "Canon", "orientation": "6", "aperture": "2.8", "iso": "400"}
    assert images.exif(exif_bytes("<")) == images.exif(exif_bytes(">")) == want
    assert images.exif(b"") == {} and images.exif(exif_bytes("<")[:40]) is not None
    rows = images.metadata(spark.createDataFrame([("a", exif_bytes("<"))], "path string, content binary")).collect()
    assert rows[0]["exif"] == want


def test_cache(spark, tmp_path):
    now = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 10.0), ("c", 1, None), ("d", 2, 10.0), ("e", 1, 10.0)], "path string, size long, mtime double")
    old = spark.createDataFrame([("a", 1, 11.9, "A"), ("b", 1, 12.0, "B"), ("c", 1, None, "C"), ("d", 1, 10.0, "D")], "path string, size long, mtime double, record string")
    cache.save(old, str(tmp_path / "c"))
    reused, fresh = cache.split_reuse(now, cache.load(spark, str(tmp_path / "c")))
    assert {(r["path"], r["record"]) for r in reused.collect()} == {("a", "A"), ("c", "C")}
    assert sorted(r["path"] for r in fresh.collect()) == ["b", "d", "e"]
    assert cache.load(spark, str(tmp_path / "none")) is None
