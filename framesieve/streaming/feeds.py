"""Streams: arriving files, sessions by event time, and the knockout as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.knockout import STATE, Knockout

_FOLD_STATE = "images array<string>, log array<string>"


def arriving_files(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """(path, size, mtime) of files as they come; a file seen with the same time and size comes once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    rows = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return rows.withWatermark("mtime", late).dropDuplicatesWithinWatermark(["path", "mtime", "size"])


def session_counts(captures: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "2 hours", by: list[str] | None = None) -> DataFrame:
    """(by..., start, end, n): sessions of captures, closed once the watermark has passed them."""
    window = F.session_window(F.col(time), gap)
    out = captures.withWatermark(time, late).groupBy(window, *(by or [])).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*(by or []), F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def to_table(counts: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of whole results over what its source has by now; gives the last result, written as Parquet below folder by the workers."""
    last = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result-{number}")
        last[:] = [number]

    query = counts.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = counts.sparkSession
    return spark.read.schema(counts.schema).parquet(f"{folder}/result-{last[0]}") if last else spark.createDataFrame([], counts.schema)


def windowed_counts(captures: DataFrame, time: str, width: str, slide: str | None, by: str, late: str = "10 minutes") -> DataFrame:
    """(by, start, n) in tumbling or sliding windows of event time."""
    window = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    return captures.withWatermark(time, late).groupBy(window, by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("window.start").alias("start"), "n")


def live_knockout(events: DataFrame) -> DataFrame:
    """States of groups after each batch of events (group_id, seq, action, arg).

    The action "image" adds a member, all others are decisions; a batch's events count in order of seq. State keeps
    members and decisions, and the fold is run on them anew, so that undo and reopen stay exact.
    """
    columns = [x.strip().split(" ")[0] for x in STATE.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        images, log = ([*x] for x in state.get) if state.exists else ([], [])
        for _, action, arg in sorted(pd.concat(list(batches))[["seq", "action", "arg"]].itertuples(index=False), key=lambda r: r[0]):
            if action == "image":
                images.append(arg)
            else:
                log.append(f"{action}\t{arg or ''}")
        state.update((images, log))
        fold = Knockout(images)
        for entry in log:
            fold.apply(*entry.split("\t"))
        yield pd.DataFrame([fold.row(key[0])], columns=columns)

    return events.groupBy("group_id").applyInPandasWithState(step, STATE, _FOLD_STATE, "update", GroupStateTimeout.NoTimeout)
