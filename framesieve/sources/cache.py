"""Cached records and their reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Seconds within which a file's time counts as unchanged.
SAME_TIME = 2.0


def split_reuse(scanned: DataFrame, cached: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(reused, to_process): scanned rows with their cached record, and those without a good one.

    A record is good if its size is equal and its time within 2 s, or both are null; of several, the one nearest in time is taken.
    """
    extra = [c for c in cached.columns if c not in scanned.columns]
    old = cached.select(F.col(path).alias("__p__"), F.col("size").alias("__s__"), F.col("mtime").alias("__m__"), F.struct(F.xxhash64(*extra), *extra).alias("__r__"))
    apart = F.abs(F.col("mtime") - F.col("__m__"))
    near = (apart < SAME_TIME) | (F.col("mtime").isNull() & F.col("__m__").isNull())
    good = (F.col(path) == F.col("__p__")) & F.col("size").eqNullSafe(F.col("__s__")) & near
    # Of a file's good records the nearest in time is taken, and taken whole.
    place = [F.col(path), F.col("size"), F.col("mtime")]
    found = scanned.select(*place).distinct().join(old, good).groupBy(*place).agg(F.min_by("__r__", F.struct(F.coalesce(apart, F.lit(0.0)), "__m__", "__r__")).alias("__r__"))
    found = found.select(F.col(path).alias("__p__"), F.col("size").alias("__s__"), F.col("mtime").alias("__m__"), "__r__")
    same = (F.col(path) == F.col("__p__")) & F.col("size").eqNullSafe(F.col("__s__")) & F.col("mtime").eqNullSafe(F.col("__m__"))
    reused = scanned.join(found, same).select(*scanned.columns, *[F.col(f"__r__.`{c}`").alias(c) for c in extra])
    return reused, scanned.join(found, same, "left_anti")


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The cached table, or None where there is none that can be read."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    except AnalysisException:
        return None


def save(records: DataFrame, path: str) -> None:
    """Replaces the cached table."""
    records.write.mode("overwrite").parquet(path)
