"""The tables of the engine, laid out from the test tables; each is a DataFrame and, for the oracle, DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import SIGNALS
from ..functions.text import name_prefix, number_suffix, stem


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(ts: str = "ts") -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture for each event: times in seconds, hashes by type and user, a path with the event's number."""
    e = table(spark, sf_dir, "events")
    kind, user = F.md5("event_type"), F.md5((F.col("user_id") % 8).cast("string"))
    return e.select(
        F.col("event_id").alias("id"), _seconds().alias("ts"), F.concat(F.lit("/lib/"), F.upper("event_type"), F.lit("_"), F.lpad(F.col("event_id").cast("string"), 6, "0"), F.lit(".jpg")).alias("path"),
        F.substring(kind, 1, 16).alias("phash"), F.substring(user, 1, 16).alias("dhash"), F.substring(user, 17, 16).alias("whash"), F.when(F.col("user_id") % 11 != 0, F.substring(kind, 17, 16)).alias("ahash"),
        F.upper("event_type").alias("prefix"), F.col("event_id").alias("number"), F.col("value").alias("score"), F.col("user_id"),
        F.concat(F.lit("cam"), (F.col("user_id") % 5).cast("string")).alias("camera"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("lens"), (F.col("user_id") % 3).cast("string"))).alias("lens"),
        ((F.col("user_id") % 4) * 25.0 + 24.0).cast("double").alias("focal"), ((F.col("user_id") % 3) * 1.4 + 1.8).cast("double").alias("aperture"),
        F.when(F.col("user_id") % 2 == 0, 31.0 + (F.col("user_id") % 10) * 0.0002).alias("lat"), F.when(F.col("user_id") % 2 == 0, 121.0 + (F.col("user_id") % 6) * 0.0003).alias("lon"),
        (F.col("event_id") % 9 == 0).alias("rejected"), (_seconds() + F.col("event_id") % 5).alias("mtime"), (10_000 + F.col("event_id") * 7919 % 3_000_000).alias("size"),
    )


CAPTURES = """captures AS (
  SELECT event_id AS id, epoch_us(ts) / 1e6 AS ts, '/lib/' || upper(event_type) || '_' || lpad(event_id::VARCHAR, 6, '0') || '.jpg' AS path,
         substr(md5(event_type), 1, 16) AS phash, substr(md5((user_id % 8)::VARCHAR), 1, 16) AS dhash, substr(md5((user_id % 8)::VARCHAR), 17, 16) AS whash,
         CASE WHEN user_id % 11 <> 0 THEN substr(md5(event_type), 17, 16) END AS ahash,
         upper(event_type) AS prefix, event_id AS number, value AS score, user_id, 'cam' || (user_id % 5)::VARCHAR AS camera,
         CASE WHEN user_id % 3 > 0 THEN 'lens' || (user_id % 3)::VARCHAR END AS lens, ((user_id % 4) * 25.0 + 24.0)::DOUBLE AS focal, ((user_id % 3) * 1.4 + 1.8)::DOUBLE AS aperture,
         CASE WHEN user_id % 2 = 0 THEN 31.0::DOUBLE + (user_id % 10)::DOUBLE * 0.0002::DOUBLE END AS lat, CASE WHEN user_id % 2 = 0 THEN 121.0::DOUBLE + (user_id % 6)::DOUBLE * 0.0003::DOUBLE END AS lon,
         event_id % 9 = 0 AS rejected, epoch_us(ts) / 1e6 + event_id % 5 AS mtime, 10000 + event_id * 7919 % 3000000 AS size
  FROM events)"""


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as numbered captures of five cameras: dense numbers within a type, times three hundred times as close."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    number = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("event_id").alias("id"), F.concat(F.upper("event_type"), F.lit("_")).alias("prefix"), number.alias("number"), (_seconds() / 300).alias("t"), F.substring(F.md5((F.col("user_id") % 2).cast("string")), 1, 16).alias("phash"))


BURSTS = """bursts AS (
  SELECT event_id AS id, upper(event_type) || '_' AS prefix, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS number,
         epoch_us(ts) / 1e6 / 300 AS t, substr(md5((user_id % 2)::VARCHAR), 1, 16) AS phash FROM events)"""

#: Each signal as (name, SQL over lineitem); both engines read it alike.
_SIGNAL_SQL = {
    "width": "cast(200 + (l_partkey * 37) % 1900 as bigint)", "height": "cast(200 + (l_suppkey * 53) % 1500 as bigint)", "size": "cast((l_orderkey * 977) % 400000 as bigint)",
    "mean": "cast((l_orderkey * 13 + l_linenumber * 29) % 256 as double)", "contrast": "cast((l_partkey * 7) % 70 as double)", "over": "l_discount * 9.0", "under": "l_tax * 11.0",
    "entropy": "cast((l_partkey * 11) % 80 as double) / 10.0", "blur_combined": "l_quantity / 50.0", "aniso": "cast((l_suppkey * 3) % 100 as double) / 100.0", "worst_dark": "l_tax * 12.0",
    "worst_bright": "l_discount * 9.5", "noise": "cast((l_orderkey * 17) % 100 as double) / 100.0", "cast": "cast((l_partkey * 5) % 40 as double)", "range": "cast((l_suppkey * 19) % 200 as double)",
    "salient": "case when l_linenumber <> 6 then cast((l_orderkey * 31) % 3000 as double) end", "edge": "case when l_linenumber > 3 then cast((l_partkey * 3) % 12 as double) end",
    "focus": "case when l_linenumber <> 2 then cast((l_suppkey * 7) % 12 as double) end", "horizon": "case when l_linenumber > 4 then cast((l_partkey * 13) % 20 as double) end",
    "composition": "case when l_linenumber <> 5 then cast((l_orderkey * 3) % 100 as double) / 100.0 end",
}
assert tuple(_SIGNAL_SQL) == SIGNALS


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality signals of one picture for each order line."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as ok", "l_linenumber as ln", *[f"{x} as `{k}`" for k, x in _SIGNAL_SQL.items()])


SIGNALS_SQL = "signals AS (SELECT l_orderkey AS ok, l_linenumber AS ln, " + ", ".join(f'({x.replace("0.0", "0.0::DOUBLE") if "/ 1" in x or "/ 5" in x else x})::{"BIGINT" if k in ("width", "height", "size") else "DOUBLE"} AS "{k}"' for k, x in _SIGNAL_SQL.items()) + " FROM lineitem)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each event: three to a stem, in seven folders, with six extensions."""
    e = table(spark, sf_dir, "events")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".CR2", ".JPG", ".jpg", ".HEIC", ".XMP", ".txt")]), (F.col("event_id") % 6 + 1).cast("int"))
    folder = F.when(F.col("user_id") % 50 == 0, "/winners/").otherwise(F.concat(F.lit("/d"), (F.col("user_id") % 7).cast("string"), F.lit("/")))
    return e.select(F.col("event_id").alias("id"), F.concat(folder, F.lit("IMG_"), F.floor(F.col("event_id") / 3).cast("string"), ext).alias("path"))


PATHS = """paths AS (
  SELECT event_id AS id, CASE WHEN user_id % 50 = 0 THEN '/winners/' ELSE '/d' || (user_id % 7)::VARCHAR || '/' END || 'IMG_' || (event_id // 3)::VARCHAR ||
         (['.CR2', '.JPG', '.jpg', '.HEIC', '.XMP', '.txt'])[(event_id % 6 + 1)::INTEGER] AS path FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


VECTORS = "vectors AS (SELECT vec_id AS id, embedding, label FROM embeddings)"


def luma8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as planes of 8 x 8 whole numbers."""
    return vectors(spark, sf_dir).select("id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("double")).alias("px"))


LUMA8 = "luma8 AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5::DOUBLE)) AS px FROM embeddings)"


def pixels8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, v): the planes of luma8, a row for each pixel."""
    p = luma8(spark, sf_dir).select("id", F.posexplode("px").alias("k", "v"))
    return p.select("id", (F.col("k") % 8).alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"), "v")


PIXELS8 = LUMA8 + ", pixels8 AS (SELECT id, (k - 1) % 8 AS x, (k - 1) // 8 AS y, v FROM (SELECT id, unnest(px) AS v, generate_subscripts(px, 1) AS k FROM luma8))"


def decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(images, decisions) of the knockout: a group for each conversation, an image for each turn, a decision for each but the last."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    images = c.select(F.col("conv_id").alias("group_id"), F.col("turn").alias("pos"), F.concat(F.lit("g"), F.col("conv_id").cast("string"), F.lit("/IMG_"), F.col("turn").cast("string"), F.lit(".jpg")).alias("path"))
    code = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 1), 16, 10).cast("int") % 4
    arg = F.element_at(F.array(*[F.lit(x) for x in ("left", "right", "both", "neither")]), code + 1)
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    made = c.withColumn("last", last).filter("turn < last").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("seq"), F.lit("choose").alias("action"), arg.alias("arg"))
    return images.distinct(), made


def parts_of(path: str = "path") -> dict[str, F.Column]:
    s = stem(F.col(path))
    return {"stem": s, "prefix": name_prefix(s), "number": number_suffix(s)}
