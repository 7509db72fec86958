"""Sessions, bursts, summaries and feeds over captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import runs, summaries
from . import views


def _r6(c) -> F.Column:
    return F.floor(c * 1e6 + 0.5) / 1e6


def _sessions(spark: SparkSession, sf_dir: str, gap: float) -> DataFrame:
    return runs.sessions(views.captures(spark, sf_dir), gap=gap)


def _segments(name: str, gap: float) -> str:
    return f"""{views.CAPTURES}, {name} AS (SELECT *, (sum(s) OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING))::BIGINT AS segment_id
  FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, id) > {gap} THEN 1 ELSE 0 END AS s FROM captures))"""


def sessionize_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir, runs.SESSION_GAP)
    return s.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def sessionize_expert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir, runs.EXPERT_GAP)
    return s.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _sessionize_sql(gap: float) -> str:
    return f"WITH {_segments('seg', gap)} SELECT segment_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM seg GROUP BY segment_id"


_RUNS = f"""{views.BURSTS}, linked AS (
  SELECT *, CASE WHEN lag(number) OVER w IS NULL OR number - lag(number) OVER w > 3 OR coalesce(t - lag(t) OVER w > 1.2, false)
      OR bit_count(xor(('0x' || phash)::UBIGINT, ('0x' || lag(phash) OVER w)::UBIGINT)) > 18 THEN 1 ELSE 0 END AS s
  FROM bursts WINDOW w AS (PARTITION BY prefix ORDER BY number, id)),
numbered AS (SELECT *, (sum(s) OVER (PARTITION BY prefix ORDER BY number, id ROWS UNBOUNDED PRECEDING))::BIGINT AS run_id FROM linked),
runs AS (SELECT id, prefix, run_id, count(*) OVER (PARTITION BY prefix, run_id) AS run_size FROM numbered)"""


def burst_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.burst_runs(views.bursts(spark, sf_dir)).select("id", "prefix", "run_id", "run_size")


def session_bursts_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir, runs.SESSION_GAP)
    forced = runs.forced_groups(s, runs.burst_runs(views.bursts(spark, sf_dir)))
    members = forced.groupBy("segment_id").agg(F.count(F.lit(1)).alias("burst_members"), F.countDistinct("prefix", "run_id").alias("burst_groups"))
    best = summaries.best_members(s, "segment_id", "score", "id")
    out = s.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    out = out.join(best, "segment_id").join(members, "segment_id", "left")
    return out.select("segment_id", "n", "first_ts", "last_ts", "best", F.coalesce("burst_members", F.lit(0)).alias("burst_members"), F.coalesce("burst_groups", F.lit(0)).alias("burst_groups"))


_BEST = "arg_max_last AS (SELECT segment_id, path AS best FROM (SELECT segment_id, path, row_number() OVER (PARTITION BY segment_id ORDER BY coalesce(score, 50) DESC, id DESC) AS r FROM seg) WHERE r = 1)"
_FORCED = "forced AS (SELECT * FROM (SELECT seg.id, seg.segment_id, runs.prefix, runs.run_id, count(*) OVER (PARTITION BY seg.segment_id, runs.prefix, runs.run_id) AS k FROM seg JOIN runs ON seg.id = runs.id WHERE runs.run_size >= 2) WHERE k >= 2)"
_SUMMARY = f"""WITH {_segments('seg', 1800)}, {_RUNS}, {_BEST}, {_FORCED},
m AS (SELECT segment_id, count(*) AS burst_members, count(DISTINCT prefix || ':' || run_id::VARCHAR) AS burst_groups FROM forced GROUP BY segment_id),
o AS (SELECT segment_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM seg GROUP BY segment_id)
SELECT o.segment_id, n, first_ts, last_ts, best, coalesce(burst_members, 0) AS burst_members, coalesce(burst_groups, 0) AS burst_groups
FROM o JOIN arg_max_last b ON o.segment_id = b.segment_id LEFT JOIN m ON o.segment_id = m.segment_id"""


def forced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.forced_groups(_sessions(spark, sf_dir, runs.SESSION_GAP), runs.burst_runs(views.bursts(spark, sf_dir)))


def best_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.best_members(views.captures(spark, sf_dir), "user_id", "score", "id")


def earliest_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "events").withColumn("dt", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return c.groupBy("user_id").agg(F.min("dt").alias("earliest"))


def preview_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.captures(spark, sf_dir).withColumn("dt", F.concat(F.lit("d"), F.lpad((F.col("id") % 28).cast("string"), 2, "0"))).withColumn("g", F.floor(F.col("id") / 7))
    cards = summaries.preview_cards(c, "g", "score", "id", "mtime", "dt", multi_only=True)
    return cards.withColumn("samples", F.array_join("samples", "|")).withColumn("span", _r6(F.col("span")))


_CARDS = f"""WITH {views.CAPTURES}, m AS (SELECT *, id // 7 AS g, 'd' || lpad((id % 28)::VARCHAR, 2, '0') AS dt FROM captures),
b AS (SELECT g, path AS best FROM (SELECT g, path, row_number() OVER (PARTITION BY g ORDER BY coalesce(score, 50) DESC, id DESC) AS r FROM m) WHERE r = 1),
s AS (SELECT g, string_agg(path, '|' ORDER BY id) AS samples FROM (SELECT g, path, id, row_number() OVER (PARTITION BY g ORDER BY id) AS r FROM m) WHERE r <= 4 GROUP BY g)
SELECT m.g, count(*) AS size, any_value(s.samples) AS samples, any_value(b.best) AS best, min(dt) AS earliest, floor((max(mtime) - min(mtime)) * 1e6 + 0.5) / 1e6 AS span
FROM m JOIN b ON m.g = b.g JOIN s ON m.g = s.g GROUP BY m.g HAVING count(*) > 1"""


def grouping_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.grouping_totals(runs.burst_runs(views.bursts(spark, sf_dir)).withColumn("g", F.concat_ws(":", "prefix", "run_id")), "g")


def chapters_half_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "events").withColumn("dt", F.when(F.col("event_id") % 13 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    c = c.select("event_id", text.date_label(F.col("dt")).alias("day"), text.half_day(F.col("dt")).alias("half"))
    return summaries.chapters(c, ["day", "half"], "event_id")


_CHAPTERS = """WITH c AS (SELECT event_id, CASE WHEN event_id % 13 > 0 THEN ts END AS dt FROM events)
SELECT CASE WHEN dt IS NULL THEN '' ELSE month(dt)::VARCHAR || ' 月 ' || day(dt)::VARCHAR || ' 日' END AS day,
       CASE WHEN dt IS NULL THEN '未标注时间' WHEN hour(dt) < 6 THEN '凌晨' WHEN hour(dt) < 11 THEN '上午' WHEN hour(dt) < 14 THEN '中午' WHEN hour(dt) < 17 THEN '下午' WHEN hour(dt) < 20 THEN '傍晚' ELSE '夜间' END AS half,
       count(*) AS n, min(event_id) AS first FROM c GROUP BY 1, 2"""


def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.captures(spark, sf_dir).select("id", (F.col("id") % 40).alias("done"), F.lit(40).alias("total"), (F.col("user_id") * 3.5).cast("double").alias("elapsed"))
    return c.select("id", _r6(runs.eta_seconds(F.col("done"), F.col("total"), F.col("elapsed"))).alias("eta"), text.elapsed_label(F.col("elapsed") * 7).alias("shown"), text.span_label(F.col("elapsed") * F.col("done")).alias("span"))


_ETA = f"""WITH {views.CAPTURES}, c AS (SELECT id, id % 40 AS done, 40 AS total, (user_id * 3.5)::DOUBLE AS elapsed FROM captures),
d AS (SELECT *, elapsed * 7 AS e7, elapsed * done AS sp FROM c)
SELECT id, CASE WHEN done >= 5 AND elapsed > 1 THEN floor((total - done) / (done / elapsed) * 1e6 + 0.5) / 1e6 END AS eta,
  CASE WHEN e7 < 60 THEN (floor(e7 * 10 + 0.5)::BIGINT // 10)::VARCHAR || '.' || (floor(e7 * 10 + 0.5)::BIGINT % 10)::VARCHAR || ' 秒'
       ELSE floor(e7 / 60)::BIGINT::VARCHAR || ' 分 ' || floor(e7 - floor(e7 / 60) * 60 + 0.5)::BIGINT::VARCHAR || ' 秒' END AS shown,
  CASE WHEN sp <= 0 THEN '' WHEN sp < 5 THEN '约 ' || (floor(sp * 10 + 0.5)::BIGINT // 10)::VARCHAR || '.' || (floor(sp * 10 + 0.5)::BIGINT % 10)::VARCHAR || ' 秒内'
       WHEN sp < 60 THEN floor(sp + 0.5)::BIGINT::VARCHAR || ' 秒内' WHEN sp < 3600 THEN floor(sp / 60 + 0.5)::BIGINT::VARCHAR || ' 分钟内'
       ELSE (floor(sp / 360 + 0.5)::BIGINT // 10)::VARCHAR || '.' || (floor(sp / 360 + 0.5)::BIGINT % 10)::VARCHAR || ' 小时内' END AS span FROM d"""


def cursor_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.since(views.table(spark, sf_dir, "events").withColumnRenamed("event_id", "seq"), 5000).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("cursor"))


def ring_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.newest(views.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type"), n=200)


def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.captures(spark, sf_dir).agg(F.count(F.lit(1)).alias("done"), F.count_if(F.col("rejected")).alias("rejected_running"), F.count_if(F.col("ahash").isNull()).alias("skipped"))


def preference_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.captures(spark, sf_dir).withColumn("chosen", F.col("score") > 50)
    out = summaries.preference(c, "user_id", "chosen")
    return out.withColumn("ratio", _r6(F.col("ratio")))


def largest_gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.captures(spark, sf_dir).withColumn("g", F.concat_ws(":", "user_id", "prefix"))
    return runs.largest_gap_split(c, "g", "ts", "id", 10).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("part").alias("cut_off"), F.min(F.when(F.col("part") == 1, F.col("id"))).alias("first_cut"))


_SPLIT = f"""WITH {views.CAPTURES}, m AS (SELECT *, user_id::VARCHAR || ':' || prefix AS g FROM captures),
k AS (SELECT g, id, ts, row_number() OVER w AS k, ts - lag(ts) OVER w AS gap, count(*) OVER (PARTITION BY g) AS n FROM m WINDOW w AS (PARTITION BY g ORDER BY ts, id)),
c AS (SELECT g, k AS cut FROM (SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY gap DESC NULLS LAST, k) AS r FROM k) WHERE r = 1),
p AS (SELECT k.g, id, CASE WHEN n > 10 AND k.k >= cut THEN 1 ELSE 0 END AS part FROM k JOIN c ON k.g = c.g)
SELECT g, count(*) AS n, sum(part)::BIGINT AS cut_off, min(CASE WHEN part = 1 THEN id END) AS first_cut FROM p GROUP BY g"""


def cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose cached record is still good: same size, and file time within 2 s."""
    from ..sources.cache import split_reuse

    c = views.captures(spark, sf_dir).select("path", "size", "mtime", "id")
    old = c.filter("id % 4 < 3").select("path", F.when(F.col("id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), (F.col("mtime") + F.col("id") % 7 * 0.5).alias("mtime"), F.lit("cached").alias("record"))
    old = old.union(old.withColumns({"mtime": F.col("mtime") - 50, "record": F.lit("stale")}))
    reused, fresh = split_reuse(c, old)
    return reused.select("id", F.when(F.col("record") == "cached", "reused").otherwise(F.col("record")).alias("state")).union(fresh.select("id", F.lit("new").alias("state")))


QUERIES = {f.__name__: f for f in (sessionize_global, sessionize_expert, burst_runs, session_bursts_summary, forced_groups, best_member, earliest_dt, preview_cards, grouping_totals, chapters_half_day, eta, cursor_feed, ring_200, event_counters, preference_ratio, largest_gap_split, cache_reuse)}
ORACLES = {
    "sessionize_global": _sessionize_sql(1800), "sessionize_expert": _sessionize_sql(2700),
    "burst_runs": f"WITH {_RUNS} SELECT * FROM runs", "session_bursts_summary": _SUMMARY,
    "forced_groups": f"WITH {_segments('seg', 1800)}, {_RUNS}, {_FORCED} SELECT id, segment_id, prefix, run_id FROM forced",
    "best_member": f"WITH {views.CAPTURES} SELECT user_id, path AS best FROM (SELECT user_id, path, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(score, 50) DESC, id DESC) AS r FROM captures) WHERE r = 1",
    "earliest_dt": "SELECT user_id, min(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS earliest FROM events GROUP BY user_id",
    "preview_cards": _CARDS,
    "grouping_totals": f"WITH {_RUNS} SELECT count(*) AS total, count(*) FILTER (n > 1) AS multi FROM (SELECT prefix, run_id, count(*) AS n FROM runs GROUP BY prefix, run_id)",
    "chapters_half_day": _CHAPTERS, "eta": _ETA,
    "cursor_feed": "SELECT event_type, count(*) AS n, max(event_id) AS cursor FROM events WHERE event_id > 5000 GROUP BY event_type",
    "ring_200": "SELECT event_id AS seq, event_type FROM events ORDER BY event_id DESC LIMIT 200",
    "event_counters": f"WITH {views.CAPTURES} SELECT count(*) AS done, count(*) FILTER (rejected) AS rejected_running, count(*) FILTER (ahash IS NULL) AS skipped FROM captures",
    "preference_ratio": f"WITH {views.CAPTURES}, c AS (SELECT user_id, count(*) AS n, count(*) FILTER (score > 50) AS c FROM captures GROUP BY user_id) SELECT user_id, n, CASE WHEN n >= 4 THEN floor((2 * c - n) / n * 1e6 + 0.5) / 1e6 ELSE 0.0 END AS ratio, n >= 8 AS enabled FROM c",
    "largest_gap_split": _SPLIT,
    "cache_reuse": f"WITH {views.CAPTURES} SELECT id, CASE WHEN id % 4 < 3 AND id % 5 <> 0 AND id % 7 * 0.5 < 2.0 THEN 'reused' ELSE 'new' END AS state FROM captures",
}
