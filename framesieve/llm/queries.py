"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser_ney, licenses, mixing, pii, simhash, telephony, tokens, topk, toxicity, wfst


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.laid_out(_table(spark, sf_dir, "documents")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wfst.encoded(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), check="decodes")
    return out.select("doc_id", "ids", F.size("ids").alias("n_ids"), "decodes")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.media_digests(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").filter("quality = 1")
    return kneser_ney.quality(_table(spark, sf_dir, "documents"), trusted)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenized(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


#: Of this repository's runs; a corpus of real people's data gets a key that is kept apart.
PII_KEY = "framesieve-2024"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymised(_table(spark, sf_dir, "documents"), PII_KEY, found="kinds")
    return done.select("doc_id", "text", "kinds", F.size("kinds").alias("n_replaced"))


QUERIES = {"op1_simhash": op1_simhash, "op2_toxicity": op2_toxicity, "op3_licenses": op3_licenses, "op4_sentencepiece": op4_sentencepiece, "op5_media": op5_media, "op6_quality": op6_quality, "op7_topk": op7_topk, "op8_mixing": op8_mixing, "op9_token_ids": op9_token_ids, "op10_pii": op10_pii}

_OP8 = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             (3 * source_size)::DOUBLE AS cap FROM a),
l AS (SELECT *, ((SELECT sum(source_size) FROM w)::DOUBLE - coalesce(sum(cap) OVER p, 0.0::DOUBLE)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER p, 0.0::DOUBLE)) AS level
      FROM w WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, (SELECT level FROM f) * w) AS target FROM l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS n_full FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS n FROM s GROUP BY source, h),
c AS (SELECT g.source, g.h, g.n, sum(g.n) OVER (PARTITION BY g.source ORDER BY g.h)::BIGINT AS upto FROM g),
k AS (SELECT c.source, c.h, (c.upto <= u.target - u.n_full * u.source_size
        OR (c.upto - c.n <= u.target - u.n_full * u.source_size AND c.upto > u.target - u.n_full * u.source_size
            AND c.n - (u.target - u.n_full * u.source_size - (c.upto - c.n)) < u.target - u.n_full * u.source_size - (c.upto - c.n)))
      AND u.n_full < 3 AS more
      FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source)
SELECT s.doc_id, s.size, u.source_size, u.target, (s.size * (u.n_full + CASE WHEN k.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM s JOIN u ON s.source IS NOT DISTINCT FROM u.source JOIN k ON s.source IS NOT DISTINCT FROM k.source AND s.h = k.h
"""

_OP7 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES = {"op3_licenses": licenses.oracle_sql(), "op7_topk": _OP7, "op8_mixing": _OP8}
