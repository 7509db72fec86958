"""Mixing sources to target weights: hash-threshold histograms, without a sort of documents.

Every document gets a hash of its id. Of each source, the mix takes all documents a whole number of
times, and once more those whose hash is at most a threshold. Thresholds come from sums of sizes by
source and hash bucket; only the bucket in which a source's budget ends is refined, by the next bits.
Only DataFrame functions run here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_join, fresh, maybe_broadcast, stored

WORDS = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, and bits by which each pass refines it.
HASH_BITS, STEP_BITS = 60, 12
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def id_hash(key: Column) -> Column:
    """60 bits of a hash of key; a null key has the hash of an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """From (source, source_size), one row a source: (source, source_size, target).

    Sources in order, null last, get the weights in turn. A target stops at ``repeats`` times its
    source's size; the level that all others reach by weight is found in one ordered pass.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_w", F.sum("w").over(everything))
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0))))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    level = F.min_by(fits, F.when(fits.isNotNull(), F.col("cap") / F.col("w"))).over(everything)
    return s.withColumn("target", F.coalesce(F.least(F.col("cap"), level * F.col("w")), F.col("cap"))).select("source", "source_size", "target")


def _boundaries(slim: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """Moves state one step on: adds the next bits of each source's threshold, and what lies below it."""
    step = F.shiftright(F.col("hash"), shift).bitwiseAND((1 << STEP_BITS) - 1)
    at = F.shiftright(F.col("hash"), shift + STEP_BITS) if shift + STEP_BITS < HASH_BITS else F.lit(0).cast("long")
    own = slim.join(maybe_broadcast(state.filter("open").select(F.col("source").alias("s"), "prefix")), F.col("source").eqNullSafe(F.col("s")) & (at == F.col("prefix")))
    sums = own.groupBy("source", step.alias("step")).agg(F.sum("size").alias("n"))
    run = Window.partitionBy("source").orderBy("step")
    sums = sums.withColumn("upto", F.sum("n").over(run)).withColumnRenamed("source", "s")
    hit = sums.join(maybe_broadcast(state.filter("open").select("source", "rest")), F.col("s").eqNullSafe(F.col("source"))).filter("upto > rest")
    hit = hit.groupBy("s").agg(F.min_by(F.struct("step", (F.col("upto") - F.col("n")).alias("below"), "n"), "step").alias("hit"))
    new = state.join(hit, F.col("source").eqNullSafe(F.col("s")), "left")
    found = F.col("open") & F.col("hit").isNotNull()
    # Where nothing crosses the budget, which only rounding can bring about, all hashes are below the threshold.
    return new.select(
        "source", "source_size", "target", "full",
        F.when(found, F.col("rest") - F.col("hit.below")).otherwise(F.col("rest")).alias("rest"),
        F.when(found, F.shiftleft(F.col("prefix"), STEP_BITS) + F.col("hit.step")).when(F.col("open"), F.lit(1 << HASH_BITS)).otherwise(F.col("prefix")).cast("long").alias("prefix"),
        F.coalesce(F.col("hit.n"), F.lit(0)).cast("long").alias("n"),
        found.alias("open"),
    )


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Sequence[float] = WEIGHTS, repeats: int = MOST_REPEATS) -> tuple[DataFrame, DataFrame]:
    """(slim, thresholds) of docs, both written to the shared folder.

    slim has (key, source, size, hash) of every row; thresholds has (source, source_size, target,
    full, threshold): a document is taken ``full`` times, and once more if its hash is at most the threshold
    (-1: none). Thresholds end where the taken size comes nearest to the target.
    """
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size"), id_hash(F.col(f"`{key}`")).alias("hash"))
    slim = stored(slim, "mix")
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeats))).otherwise(0).cast("long")
    state = targets.withColumn("full", whole)
    state = state.select("source", "source_size", "target", "full", (F.col("target") - F.col("full") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("n"))
    some = (F.col("full") < repeats) & (F.col("source_size") > 0)
    state = state.withColumn("prefix", F.when(some, 0).otherwise(-1).cast("long")).withColumn("open", some).checkpoint()
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        state = _boundaries(slim, state, shift).checkpoint()
    # What is left open has its whole hash; the documents with that hash go in if that comes nearer.
    nearer = F.col("n") - F.col("rest") < F.col("rest")
    last = F.when(~F.col("open"), F.col("prefix")).when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1)
    return slim, state.select("source", "source_size", "target", "full", last.cast("long").alias("threshold")).checkpoint()


def mixed(slim: DataFrame, thresholds: DataFrame) -> DataFrame:
    """slim with its source's columns and ``copies``, the number of times the mix takes the row."""
    t = thresholds.withColumnRenamed("source", "s")
    joined = dealt_join(slim, t, F.col("source").eqNullSafe(F.col("s")), F.col("hash")).drop("s")
    return joined.withColumn("copies", F.col("full") + (F.col("hash") <= F.col("threshold")).cast("long"))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Sequence[float] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """(key, size, source_size, target, taken): the words that the mix takes of each row, repeats counted.

    Null texts have size 0, a null source is a source of its own and comes last, rows with one key go
    together (so do all rows whose key is null), an empty table gives an empty result. Other columns are ignored.
    """
    out = mixed(*mix_plan(docs, text, source, key, weights, repeats))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Sequence[float] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with docs' columns only, whatever their names.

    A null text has no words; a row of a source without words isn't taken. Copies of a row are alike in all columns.
    """
    _, thresholds = mix_plan(docs, text, source, key, weights, repeats)
    own, again = fresh(docs, "__mix__"), fresh(docs, "__copy__")
    t = thresholds.select(F.struct("source", "full", "threshold").alias(own))
    joined = dealt_join(docs, t, F.col(f"`{source}`").eqNullSafe(F.col(f"{own}.source")), F.col(f"`{key}`"))
    copies = F.col(f"{own}.full") + (id_hash(F.col(f"`{key}`")) <= F.col(f"{own}.threshold")).cast("long")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return joined.filter(copies > 0).withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*names)
