"""Pictures: decoded by Spark's own source, described by NumPy kernels. A file that fails becomes a row with its reason."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.quality import SIGNALS
from ..functions.text import parse_aperture, parse_focal

_FEATURES = ["phash string", "dhash string", "whash string", "ahash string", *[f"{s} double" for s in ("blur", *SIGNALS) if s != "size"], "color_hist array<float>", "failure string"]
HEIC_FAILURE, DECODE_FAILURE = "HEIC can't be decoded here", "the picture can't be decoded"


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels, data) of all pictures below folder; width is -1 where decoding failed."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(folder).select("image.*")
    return rows.select(F.regexp_replace("origin", "^[a-z]+:/*/", "/").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data")


def to_rgb(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """RGB of Spark's BGR, BGRA or grey bytes."""
    p = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(p, 3, axis=2) if channels == 1 else np.ascontiguousarray(p[..., 2::-1])


def described(images: DataFrame) -> DataFrame:
    """(path, hashes, signals, color_hist, failure) of decoded pictures; large ones are scaled down first.

    Pictures are turned as their ``orientation`` (1 to 8 as text), if images has that column, says.
    """
    images = images if "orientation" in images.columns else images.withColumn("orientation", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in _FEATURES]
        for batch in batches:
            out = []
            for path, width, height, channels, data, turn in batch[["path", "width", "height", "channels", "data", "orientation"]].itertuples(index=False):
                row: dict = dict.fromkeys(names)
                try:
                    if width <= 0:
                        raise ValueError(HEIC_FAILURE if path.lower().endswith((".heic", ".heif")) else DECODE_FAILURE)
                    rgb = kernels.oriented(to_rgb(data, width, height, channels), int(turn) if isinstance(turn, str) and turn.isdigit() else 1)
                    rgb = kernels.thumbnail(rgb, kernels.ANALYSIS_SIDE)
                    row |= kernels.hashes(kernels.luma(rgb)) | kernels.signals(rgb)
                    hist = kernels.color_histogram(rgb)
                    row["color_hist"] = None if hist is None else hist.tolist()
                except (ValueError, IndexError) as e:
                    row["failure"] = str(e)
                out.append({"path": path, **row})
            yield pd.DataFrame(out, columns=["path", *names])

    return images.mapInPandas(run, ", ".join(["path string", *_FEATURES]))


def jpeg_segments(data: bytes) -> list[bytes]:
    """Runs from a JPEG's start mark to the first end mark after it."""
    out, at = [], 0
    while (start := data.find(b"\xff\xd8", at)) >= 0:
        end = data.find(b"\xff\xd9", start + 2)
        if end < 0:
            break
        out.append(data[start : end + 2])
        at = end + 2
    return out


def raw_previews(files: DataFrame) -> DataFrame:
    """(path, place, preview) from binary files (path, content): JPEG segments of RAW files, the longest first.

    The longest that decodes is the preview; files without a segment give none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, k, s) for path, data in batch[["path", "content"]].itertuples(index=False) for k, s in enumerate(sorted(jpeg_segments(bytes(data)), key=len, reverse=True))]
            yield pd.DataFrame(rows, columns=["path", "place", "preview"])

    return files.select("path", "content").mapInPandas(run, "path string, place long, preview binary")


#: The metadata fields read, by tag.
_TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x829A: "exposure", 0x829D: "aperture", 0x8827: "iso", 0x9003: "datetime", 0x920A: "focal", 0xA434: "lens"}


_PLACE_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}


def exif(data: bytes) -> dict[str, str]:
    """Known fields of a JPEG's or TIFF's metadata as texts; whatever can't be read is left out."""
    at = data.find(b"Exif\0\0", 0, 1 << 16)
    tiff = data[at + 6 :] if at >= 0 else data if data[:4] in (b"II*\0", b"MM\0*") else b""
    if tiff[:2] not in (b"II", b"MM"):
        return {}
    end, out, todo, seen, places = "<" if tiff[:2] == b"II" else ">", {}, [], set(), set()
    widths = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
    try:
        todo.append(struct.unpack_from(end + "I", tiff, 4)[0])
        while todo:
            base = todo.pop()
            if base in seen:
                continue
            seen.add(base)
            known = _PLACE_TAGS if base in places else _TAGS
            for k in range(struct.unpack_from(end + "H", tiff, base)[0]):
                tag, kind, n = struct.unpack_from(end + "HHI", tiff, base + 2 + 12 * k)
                place = base + 10 + 12 * k
                if widths.get(kind, 1) * n > 4:
                    place = struct.unpack_from(end + "I", tiff, place)[0]
                if tag in (0x8769, 0x8825) and known is _TAGS:
                    todo.append(struct.unpack_from(end + "I", tiff, place)[0])
                    if tag == 0x8825:
                        places.add(todo[-1])
                elif known is _PLACE_TAGS and tag in (2, 4) and kind == 5 and n == 3:
                    d = struct.unpack_from(end + "6I", tiff, place)
                    if d[1] and d[3] and d[5]:
                        out[known[tag]] = repr(d[0] / d[1] + d[2] / d[3] / 60 + d[4] / d[5] / 3600)
                elif tag in known:
                    out[known[tag]] = _exif_text(tiff, end, kind, n, place)
    except struct.error:
        return out
    return out


def _exif_text(tiff: bytes, end: str, kind: int, n: int, place: int) -> str:
    if kind == 2:
        return tiff[place : place + n].split(b"\0")[0].decode("utf-8", "replace").strip()
    if kind in (5, 10):
        a, b = struct.unpack_from(end + ("II" if kind == 5 else "ii"), tiff, place)
        return f"{a / b:g}" if b else ""
    return str(struct.unpack_from(end + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind], tiff, place)[0])


def exif_columns(exif: Column) -> dict[str, Column]:
    """The engine's columns from a map of metadata texts: camera, lens, focal, aperture, lat, lon and taken (ISO text)."""
    def signed(name: str, below: str) -> Column:
        return exif[name].try_cast("double") * F.when(exif[f"{name}_ref"] == below, -1.0).otherwise(1.0)

    return {
        "camera": F.nullif(F.trim(F.concat_ws(" ", exif["make"], exif["model"])), F.lit("")), "lens": F.nullif(F.trim(exif["lens"]), F.lit("")), "focal": parse_focal(exif["focal"]), "aperture": parse_aperture(exif["aperture"]),
        "lat": signed("lat", "S"), "lon": signed("lon", "W"), "taken": F.regexp_replace(exif["datetime"], "^([0-9]{4}):([0-9]{2}):([0-9]{2}) ", "$1-$2-$3T"),
    }


def metadata(files: DataFrame) -> DataFrame:
    """(path, exif) of binary files (path, content); exif is a map of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "exif": [exif(bytes(c)) for c in batch["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, exif map<string,string>")
