"""Folder scans: listing without contents, and pairing of files by folder and stem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: Folders that a scan leaves out.
DERIVED = ("winners", "losers", "_pic_selecter")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, mtime) of all files of known kinds below folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    out = files.select(F.regexp_replace("path", "^[a-z]+:/*/", "/").alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))
    return known_files(out)


def known_files(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("path").rlike("(^|/)(" + "|".join(DERIVED) + ")/") & (text.format_kind(text.extension(F.col("path"))) != "other"))


def _of_kind(files: Column, kind: str) -> Column:
    return F.transform(F.filter(files, lambda f: f["kind"] == kind), lambda f: f["path"])


def pair_files(files: DataFrame) -> DataFrame:
    """(primary, companions, analysis, kind, size, mtime): one row for the files of one folder and stem.

    The primary is a RAW file, else an image, else HEIC, the first by path of its kind. Companions are the
    others of its kind, images beside RAW, and sidecars. What is analysed is the image beside a RAW file. Sidecars alone give no row.
    """
    f = known_files(files)
    kind = text.format_kind(text.extension(F.col("path")))
    f = f.select("path", "size", "mtime", text.directory(F.col("path")).alias("d"), F.lower(text.stem(F.col("path"))).alias("s"), kind.alias("kind"))
    groups = f.groupBy("d", "s").agg(F.sort_array(F.collect_list(F.struct("path", "kind", "size", "mtime"))).alias("files"))
    raw, image, heic, side = (_of_kind(F.col("files"), k) for k in ("raw", "image", "heic", "sidecar"))
    groups = groups.select("files", raw.alias("raw"), image.alias("image"), heic.alias("heic"), side.alias("side"))

    def rest(name: str) -> Column:
        return F.slice(name, 2, F.greatest(F.size(name), F.lit(1)))

    has = {k: F.size(k) > 0 for k in ("raw", "image", "heic")}
    first = {k: F.try_element_at(F.col(k), F.lit(1)) for k in has}
    out = groups.filter(has["raw"] | has["image"] | has["heic"]).select(
        "files", F.when(has["raw"], first["raw"]).when(has["image"], first["image"]).otherwise(first["heic"]).alias("primary"),
        F.when(has["raw"], F.concat(rest("raw"), "image", "side")).when(has["image"], F.concat(rest("image"), "side")).otherwise(F.concat(rest("heic"), "side")).alias("companions"),
        F.when(has["raw"], F.coalesce(first["image"], first["raw"])).when(has["image"], first["image"]).otherwise(first["heic"]).alias("analysis"),
        F.when(has["raw"], "raw").when(has["image"], "image").otherwise("heic").alias("kind"),
    )
    own = F.element_at(F.filter("files", lambda x: x["path"] == F.col("primary")), 1)
    return out.select("primary", "companions", "analysis", "kind", own["size"].alias("size"), own["mtime"].alias("mtime"))
