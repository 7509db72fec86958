"""Summaries of groups, sessions and members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SCORE = 50.0


def best_members(members: DataFrame, group: str, score: str, pos: str, path: str = "path") -> DataFrame:
    """(group, best): the path with the highest score (50 where unknown); the last of equals."""
    best = F.max(F.struct(F.coalesce(F.col(score), F.lit(DEFAULT_SCORE)).alias("s"), F.col(pos).alias("p"), F.col(path).alias("path")))
    return members.groupBy(group).agg(best["path"].alias("best"))


def preview_cards(members: DataFrame, group: str, score: str, pos: str, mtime: str, datetime: str, path: str = "path", multi_only: bool = False) -> DataFrame:
    """(group, size, samples, best, earliest, span): the first four paths, the best one, the least datetime text, seconds between file times."""
    best = F.max(F.struct(F.coalesce(F.col(score), F.lit(DEFAULT_SCORE)).alias("s"), F.col(pos).alias("p"), F.col(path).alias("path")))
    # A group is bounded by the clustering's cap; its samples are the four first places.
    samples = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(path).alias("path")))), 1, 4), lambda x: x["path"])
    span = F.when(F.count(mtime) >= 2, F.max(mtime) - F.min(mtime)).otherwise(0.0)
    cards = members.groupBy(group).agg(F.count(F.lit(1)).alias("size"), samples.alias("samples"), best["path"].alias("best"), F.min(datetime).alias("earliest"), span.alias("span"))
    return cards.filter("size > 1") if multi_only else cards


def grouping_totals(members: DataFrame, group: str) -> DataFrame:
    """(total, multi): groups, and those of two members at least."""
    return members.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") > 1).alias("multi"))


def reason_histogram(rows: DataFrame, reason: str = "reason", unnamed: str = "其他", everything: str = "all") -> DataFrame:
    """(reason, n) by descending count, and a row for all."""
    named = rows.select(F.coalesce(F.col(reason), F.lit(unnamed)).alias("reason"))
    counts = named.rollup("reason").agg(F.count(F.lit(1)).alias("n"), F.grouping("reason").alias("g"))
    return counts.select(F.when(F.col("g") == 1, everything).otherwise(F.col("reason")).alias("reason"), "n").orderBy(F.col("n").desc(), "reason")


def prescreen_stats(rows: DataFrame, rejected: str, restored: str) -> DataFrame:
    """(rejected, restored, pending)."""
    out = rows.agg(F.count_if(F.col(rejected)).alias("rejected"), F.count_if(F.col(rejected) & F.col(restored)).alias("restored"))
    return out.withColumn("pending", F.col("rejected") - F.col("restored"))


def chapters(rows: DataFrame, labels: list[str], pos: str) -> DataFrame:
    """(labels..., n, first): groups by label, in the order in which they first come."""
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))


def album(rows: DataFrame, datetime: str) -> DataFrame:
    """rows in order of their datetime texts, those without one last."""
    return rows.orderBy(F.coalesce(F.col(datetime), F.lit("z")))


def skipped_tail(rows: DataFrame, seq: str, n: int = 50) -> DataFrame:
    """The last n rows that were skipped, the last first."""
    return rows.orderBy(F.col(seq).desc()).limit(n)


def rejected_members(members: DataFrame, rejected: DataFrame, group: str, path: str = "path", by: tuple[str, ...] = ()) -> DataFrame:
    """(group, path, reason) of each rejected picture (path, reason) that is in a group; one that is in none is left out.

    by: columns of both that tell pictures of one path apart.
    """
    return members.select(group, path, *by).distinct().join(rejected, [path, *by]).select(group, path, "reason")


def ordered_groups(members: DataFrame, group: str, time: str, key: str) -> DataFrame:
    """(group, first, members): members by time (null as 0), then key; first is the time by which groups are ordered."""
    each = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(time), F.lit(0.0)).alias("t"), F.col(key).alias("k"))))
    out = members.groupBy(group).agg(each.alias("m"))
    return out.select(group, F.element_at("m", 1)["t"].alias("first"), F.transform("m", lambda x: x["k"]).alias("members"))


def preference(rows: DataFrame, trait: str, chosen: str) -> DataFrame:
    """(trait, n, ratio, enabled): how often members with the trait were chosen rather than passed; 0 below four decisions, enabled from eight."""
    out = rows.groupBy(trait).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(chosen)).alias("c"))
    ratio = F.when(F.col("n") >= 4, (2 * F.col("c") - F.col("n")) / F.col("n")).otherwise(0.0)
    return out.select(trait, "n", ratio.alias("ratio"), (F.col("n") >= 8).alias("enabled"))


def session_status(groups: DataFrame) -> DataFrame:
    """One row of totals from group states (images, winner, extra_winners, losers, finished, rejected, restored arrays)."""
    multi = F.size("images") > 1
    out = groups.agg(
        F.count(F.lit(1)).alias("total_groups"), F.count_if(multi).alias("multi_groups"), F.count_if(F.col("finished")).alias("finished_groups"),
        F.count_if(F.col("finished") & multi).alias("finished_multi"), F.coalesce(F.sum(F.size("images")), F.lit(0)).alias("images"),
        F.coalesce(F.sum(F.col("winner").isNotNull().cast("long") + F.size("extra_winners")), F.lit(0)).alias("winners"), F.coalesce(F.sum(F.size("losers")), F.lit(0)).alias("losers"),
    )
    return out.withColumn("unfinished_groups", F.col("total_groups") - F.col("finished_groups"))


def entropy(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, entropy): bits of the distribution of rounded values."""
    bins = rows.groupBy(group, F.floor(F.col(value) + 0.5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    return bins.withColumn("p", p).groupBy(group).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def index_range(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, range): between the sorted values at floor(0.05 n) and floor(0.95 (n - 1)); null below 100 values."""
    s = F.sort_array(F.collect_list(value))
    out = rows.groupBy(group).agg(s.alias("s"))
    n = F.size("s")
    wide = F.element_at("s", F.floor((n - 1) * 0.95).cast("int") + 1) - F.element_at("s", F.floor(n * 0.05).cast("int") + 1)
    return out.select(group, F.when(n >= 100, wide).alias("range"))


def exposure_grid(rows: DataFrame, group: str, x: str, y: str, value: str, width: int, height: int) -> DataFrame:
    """(group, worst_dark, worst_bright): over 3 x 3 cells, the largest shares of values up to 8 and from 247."""
    cell = [F.least(F.lit(2), F.floor(F.col(c) * 3 / n)).alias(k) for c, n, k in ((x, width, "cx"), (y, height, "cy"))]
    cells = rows.groupBy(group, *cell).agg(F.avg((F.col(value) <= 8).cast("double")).alias("d"), F.avg((F.col(value) >= 247).cast("double")).alias("b"))
    return cells.groupBy(group).agg(F.max("d").alias("worst_dark"), F.max("b").alias("worst_bright"))
