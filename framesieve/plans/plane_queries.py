"""Hashes and signals of planes made from texts and vectors, sessions as a stream, and overlay manifests."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, text
from ..operators.components import shared_folder
from ..operators.faces import suppressed
from ..streaming import feeds
from . import views


#: Planes in a batch of results.
PLANES = 4096


def planes32(text: str) -> np.ndarray:
    """The codes of all characters (modulo 256) as 32 x 32 planes in order, the last filled with zeros; an empty text is one plane."""
    codes = (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") % 256).astype(np.uint8)
    return np.pad(codes, (0, -len(codes) % 1024 if len(codes) else 1024)).reshape(-1, 32, 32)


def _of_planes(docs: DataFrame, each: Callable[[np.ndarray], tuple], columns: str) -> DataFrame:
    """(doc_id, plane, and what each gives) of every plane of every text; a null text has none."""
    schema = f"doc_id long, plane long, {columns}"
    names = ["doc_id", "plane", *[c.split()[0] for c in columns.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for b in batches:
            for doc_id, t in zip(b["doc_id"], b["text"], strict=True):
                for k, p in enumerate(planes32(t)):
                    out.append((doc_id, k, *each(p)))
                    if len(out) == PLANES:
                        yield pd.DataFrame(out, columns=names)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return docs.filter(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(run, schema)


def phash_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual and wavelet hashes of all 32 x 32 planes of each text."""
    return _of_planes(views.table(spark, sf_dir, "documents"), lambda p: (kernels.perceptual_hash(p.astype(np.int64)), kernels.wavelet_hash(p.astype(np.int64))), "phash string, whash string")


def whash_luma8(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "whash": [kernels.wavelet_hash(np.array(p).reshape(8, 8)) for p in b["px"]]})

    return views.luma8(spark, sf_dir).mapInPandas(run, "id long, whash string")


def plane_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of grey pictures of 32 x 32 pixels: all planes of each document."""
    names = ["mean", "contrast", "entropy", "blur_combined", "aniso", "noise", "range", "worst_dark"]

    def each(plane: np.ndarray) -> tuple:
        s = kernels.signals(np.repeat(plane.reshape(32, 32, 1), 3, axis=2))
        return tuple(None if s[k] is None else float(np.floor(s[k] * 1e6 + 0.5) / 1e6) for k in names)

    return _of_planes(views.table(spark, sf_dir, "documents"), each, ", ".join(f"{k} double" for k in names))


def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = views.table(spark, sf_dir, "lineitem")  # noqa: E741
    x, y, side = F.col("l_partkey") % 20, F.col("l_suppkey") % 20, F.col("l_quantity") + 5
    boxes = l.select(F.col("l_orderkey").alias("image"), x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + side).alias("x2"), (y + side).alias("y2"), F.col("l_extendedprice").alias("score"))
    return suppressed(boxes)


def streaming_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each event type, run as a stream over the table to its end."""
    source = spark.readStream.schema(views.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").load(sf_dir)
    events = source.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    folder = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    out = feeds.to_table(feeds.session_counts(events, by=["event_type"]), folder)
    return out.select("event_type", F.unix_micros("start").alias("start"), "n")


def overlay_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an overlay export would draw: template family, logo and one line of parameters for each capture."""
    c = views.captures(spark, sf_dir)
    template = F.element_at(F.array(*[F.lit(x) for x in ("A_classic", "B_clean", "C_wide", "X_new")]), (F.col("id") % 4 + 1).cast("int"))
    make = F.when(F.col("user_id") % 2 == 0, "Canon").otherwise("unknown maker")
    line = text.joined_line(F.concat(F.floor("focal").cast("string"), F.lit("mm")), F.coalesce("lens", F.lit("")), F.col("camera"))
    return c.select("id", text.template_family(template).alias("family"), text.logo_of(make).alias("logo"), F.when(text.shows_parameters(template), line).alias("line"))


QUERIES = {f.__name__: f for f in (phash_docs, whash_luma8, plane_signals, box_suppression, streaming_sessions, overlay_manifest)}
_HEX = "list_aggregate(list_transform(range(0, 16), lambda k: substr('0123456789abcdef', (8 * b[k * 4 + 1] + 4 * b[k * 4 + 2] + 2 * b[k * 4 + 3] + b[k * 4 + 4] + 1)::INTEGER, 1)), 'string_agg', '')"
ORACLES = {
    "whash_luma8": f"WITH {views.LUMA8}, m AS (SELECT id, list_transform(px, lambda x: x / 255.0::DOUBLE - list_sum(px) / 64 / 255.0::DOUBLE) AS v FROM luma8), k AS (SELECT id, px, (list_sort(px)[32] + list_sort(px)[33]) / 2 AS med FROM luma8), b AS (SELECT id, list_transform(px, lambda x: CASE WHEN x > med THEN 1 ELSE 0 END) AS b FROM k) SELECT id, {_HEX} AS whash FROM b",
    "streaming_sessions": "WITH e AS (SELECT event_type, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), n AS (SELECT event_type, ts, sum(s) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT event_type, epoch_us(min(ts)) AS start, count(*) AS n FROM n GROUP BY event_type, k",
    "overlay_manifest": f"WITH {views.CAPTURES} SELECT id, CASE id % 4 WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'A' END AS family, CASE WHEN user_id % 2 = 0 THEN 'canon.png' ELSE 'default.png' END AS logo, CASE WHEN id % 4 <> 1 THEN floor(focal)::BIGINT::VARCHAR || 'mm' || CASE WHEN lens IS NULL THEN '' ELSE '  ' || lens END || '  ' || camera END AS line FROM captures",
}
