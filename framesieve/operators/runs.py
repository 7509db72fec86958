"""Runs of neighbouring rows: sessions by time gaps, bursts by numbered names, and bounded feeds.

A window without a partition would put all rows in one task. Sessions are therefore found in time slices: slices are
ordered among themselves by their first and last times alone, of which there is one row a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import hamming

SESSION_GAP, EXPERT_GAP = 1800.0, 2700.0
#: What neighbours in a burst may differ by.
BURST_NUMBERS, BURST_SECONDS, BURST_BITS = 3, 1.2, 18
#: Seconds in a slice of sessions, numbers in one of bursts.
SLICE, BURST_SLICE = 86_400.0, 4_096


def sessions(rows: DataFrame, time: str = "ts", key: str = "id", gap: float = SESSION_GAP, out: str = "segment_id", slice_seconds: float = SLICE) -> DataFrame:
    """rows with ``out``, numbered from 0 in order of time (null as 0): a new one starts where both times are known and more than gap apart."""
    t = F.coalesce(F.col(time), F.lit(0.0))
    rows = rows.withColumns({"__t__": t, "__known__": F.col(time).isNotNull(), "__slice__": F.floor(t / slice_seconds)})
    order = [F.col("__t__"), F.col(key)]
    within = Window.partitionBy("__slice__").orderBy(*order)
    before = F.lag(F.struct("__t__", "__known__")).over(within)
    starts = F.coalesce((F.col("__t__") - before["__t__"] > gap) & F.col("__known__") & before["__known__"], F.lit(False))
    rows = rows.withColumn("__n__", F.sum(starts.cast("long")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    edges = rows.groupBy("__slice__").agg(
        F.min(F.struct("__t__", key, "__known__")).alias("first"), F.max(F.struct("__t__", key, "__known__")).alias("last"), F.max("__n__").alias("inner")
    )
    across = Window.orderBy("__slice__")
    last = F.lag("last").over(across)
    opens = F.coalesce((F.col("first.__t__") - last["__t__"] > gap) & F.col("first.__known__") & last["__known__"], F.lit(False)).cast("long")
    edges = edges.select("__slice__", "inner", opens.alias("opens"))
    total = F.sum(F.col("opens") + F.col("inner")).over(across.rowsBetween(Window.unboundedPreceding, 0))
    edges = edges.select(F.col("__slice__").alias("__s__"), (total - F.col("inner")).alias("__base__"))
    joined = rows.join(edges, F.col("__slice__") == F.col("__s__"))
    return joined.withColumn(out, F.col("__base__") + F.col("__n__")).drop("__t__", "__known__", "__slice__", "__n__", "__s__", "__base__")


def burst_runs(rows: DataFrame, prefix: str = "prefix", number: str = "number", time: str = "t", phash: str = "phash", key: str = "id") -> DataFrame:
    """rows with run_id (the run's smallest place within its prefix) and run_size; rows without a number are left out.

    Neighbours by number are in one run unless their numbers differ by more than 3, the later is over 1.2 s
    later, or their hashes differ in more than 18 bits. What isn't known doesn't part them.
    """
    own = rows.filter(F.col(number).isNotNull()).withColumn("__slice__", F.floor(F.col(number) / BURST_SLICE))
    here = F.struct(F.col(number).alias("n"), F.col(time).alias("t"), F.col(phash).alias("h"))

    def apart(now: Column, before: Column) -> Column:
        return (now["n"] - before["n"] > BURST_NUMBERS) | F.coalesce(now["t"] - before["t"] > BURST_SECONDS, F.lit(False)) | F.coalesce(hamming(now["h"], before["h"]) > BURST_BITS, F.lit(False))

    # One name may be that of most rows: its rows are ordered within slices of numbers, and slices by their edges alone.
    order = Window.partitionBy(prefix, "__slice__").orderBy(F.col(number), F.col(key))
    own = own.withColumn("__here__", here).withColumn("__start__", F.coalesce(apart(F.col("__here__"), F.lag("__here__").over(order)), F.lit(False)).cast("long"))
    own = own.withColumn("__n__", F.sum("__start__").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct(F.col(number).alias("n"), F.col(key).alias("k"))
    edges = own.groupBy(F.col(prefix).alias("__p__"), F.col("__slice__").alias("__s__")).agg(F.min_by("__here__", place).alias("first"), F.max_by("__here__", place).alias("last"), F.max("__n__").alias("inner"))
    across = Window.partitionBy("__p__").orderBy("__s__")
    opens = F.coalesce(apart(F.col("first"), F.lag("last").over(across)), F.lit(True)).cast("long")
    edges = edges.select("__p__", "__s__", "inner", opens.alias("opens"))
    total = F.sum(F.col("opens") + F.col("inner")).over(across.rowsBetween(Window.unboundedPreceding, 0))
    edges = edges.select("__p__", "__s__", (total - F.col("inner")).alias("__base__"))
    own = own.join(edges, F.col(prefix).eqNullSafe(F.col("__p__")) & (F.col("__slice__") == F.col("__s__"))).withColumn("run_id", F.col("__base__") + F.col("__n__"))
    sizes = own.groupBy(F.col(prefix).alias("__q__"), F.col("run_id").alias("__run__")).agg(F.count(F.lit(1)).alias("run_size"))
    return own.join(sizes, F.col(prefix).eqNullSafe(F.col("__q__")) & (F.col("run_id") == F.col("__run__"))).select(*rows.columns, "run_id", "run_size")


def forced_groups(rows: DataFrame, runs: DataFrame, segment: str = "segment_id", key: str = "id", prefix: str = "prefix") -> DataFrame:
    """(key, segment, prefix, run_id) of the runs that have two rows at least within a segment."""
    both = rows.select(key, segment).join(runs.filter("run_size >= 2").select(key, prefix, "run_id"), key)
    return both.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(segment, prefix, "run_id"))).filter("n >= 2").drop("n")


def largest_gap_split(rows: DataFrame, group: str, time: str, key: str, cap: int) -> DataFrame:
    """rows with part (0 or 1): groups over cap are cut once, at the first of their largest gaps."""
    order = Window.partitionBy(group).orderBy(F.coalesce(F.col(time), F.lit(0.0)), F.col(key))
    everyone = Window.partitionBy(group)
    t = F.coalesce(F.col(time), F.lit(0.0))
    rows = rows.withColumns({"__k__": F.row_number().over(order), "__gap__": t - F.lag(t).over(order), "__n__": F.count(F.lit(1)).over(everyone)})
    cut = F.max_by("__k__", F.struct(F.col("__gap__"), -F.col("__k__"))).over(everyone)
    return rows.withColumn("part", F.when((F.col("__n__") > cap) & (F.col("__k__") >= cut), 1).otherwise(0)).drop("__k__", "__gap__", "__n__")


def newest(feed: DataFrame, seq: str = "seq", n: int = 200) -> DataFrame:
    """The last n rows of a feed. Each task keeps n at most."""
    return feed.orderBy(F.col(seq).desc()).limit(n)


def since(feed: DataFrame, cursor: int, seq: str = "seq") -> DataFrame:
    return feed.filter(F.col(seq) > cursor)


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Remaining seconds at the rate so far; null before 5 are done or a second has passed."""
    return F.when((done >= 5) & (elapsed > 1), (total - done) / (done / elapsed))
