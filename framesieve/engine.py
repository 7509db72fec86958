"""The engine in one place: scan, describe, judge, group, select, archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import quality, similarity, text
from .functions.hashes import HASH_WEIGHTS
from .operators import archive, knockout, linkage, pairs, runs
from .sources import cache, images, scan


class MediaEngine:
    """Steps over one library; each takes and gives tables, nothing runs before a table is read or written."""

    def __init__(self, spark: SparkSession, strength: str = "standard", near_level: int = 10, far_level: int = 6, near_seconds: float = 300.0):
        self.spark, self.profile = spark, quality.profile(strength)
        self.options = similarity.slider_options(near_level, far_level, near_seconds)

    def scan(self, folder: str) -> DataFrame:
        return scan.pair_files(scan.list_files(self.spark, folder))

    def describe(self, folder: str, pairs_of: DataFrame) -> DataFrame:
        """A row for each pair with its picture's hashes, signals, verdict and name parts; failures keep their reason."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", "^[a-z]+:/*/", "/").alias("path"), "content")
        meta = images.metadata(files.join(pairs_of.select(F.col("analysis").alias("path")).distinct(), "path", "left_semi"))
        pictures = images.decoded(self.spark, folder).join(meta.select("path", F.col("exif")["orientation"].alias("orientation")), "path", "left")
        rows = images.described(pictures).withColumnRenamed("path", "analysis")
        out = pairs_of.drop("kind").join(rows, "analysis", "left").join(meta.withColumnRenamed("path", "analysis"), "analysis", "left")
        signals = {k: F.col(k).cast("double") for k in quality.SIGNALS}
        out = out.withColumns(quality.verdict(signals, self.profile))
        stem = text.stem(F.col("primary"))
        place = F.xxhash64("primary").bitwiseAND((1 << 62) - 1)
        known = images.exif_columns(F.col("exif"))
        more = {"id": place, "path": F.col("primary"), "ts": text.effective_time(known["taken"], F.lit(None).cast("double"), F.col("mtime")), "prefix": text.name_prefix(stem), "number": text.number_suffix(stem).cast("long"), "rejected": F.coalesce("auto_reject", F.lit(False))}
        return out.withColumns(more | {c: known[c] for c in ("camera", "lens", "focal", "aperture", "lat", "lon")}).drop("exif")

    def describe_new(self, folder: str, pairs_of: DataFrame, cached: DataFrame | None) -> DataFrame:
        """As describe, but rows whose cached description is still good aren't decoded again."""
        if cached is None:
            return self.describe(folder, pairs_of)
        reused, fresh = cache.split_reuse(pairs_of.withColumn("path", F.col("primary")), cached)
        return self.describe(folder, fresh.drop("path")).unionByName(reused, allowMissingColumns=True)

    def group(self, infos: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
        """(group_id, member_pos, id): sessions, bursts, pairs within sessions, linkage."""
        rows = runs.sessions(infos.withColumn("score", F.coalesce("score", F.lit(50.0))))
        own = rows.select("id", "ts", *HASH_WEIGHTS, "camera", "lens", "focal", "aperture", "prefix", "number", "lat", "lon", "rejected", "score", "color_hist", "segment_id")
        found = pairs.fast_pairs(own, ["segment_id"], evidence, self.options["half_life"], color="color_hist")
        tied = runs.forced_groups(rows, runs.burst_runs(rows, time="ts")).select("id", F.concat_ws(":", "segment_id", "prefix", "run_id").alias("run"))
        return linkage.groups(rows.withColumn("t", F.col("ts")), found, tied, self.options["threshold"], int(self.options["group_size"]))

    def select(self, groups: DataFrame, infos: DataFrame, decisions: DataFrame) -> DataFrame:
        """States after decisions; rejected members don't take part."""
        live = groups.join(infos.filter(~F.col("rejected")).select("id", "path"), "id")
        return knockout.replay(live.select("group_id", F.col("member_pos").alias("pos"), "path"), decisions)

    def archive(self, states: DataFrame, pairs_of: DataFrame, existing: DataFrame) -> DataFrame:
        side = pairs_of.select("primary", F.explode("companions").alias("companion"))
        return archive.transfer_plan(states, side, existing)
