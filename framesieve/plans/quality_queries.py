"""The quality rules over signals, reasons, statistics of planes, texts and paths, and the knockout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import text
from ..operators import archive, knockout, summaries
from ..sources.scan import pair_files
from . import views
from .capture_queries import _r6


def _verdicts(spark: SparkSession, sf_dir: str, p: q.Profile) -> DataFrame:
    s = views.signals(spark, sf_dir)
    columns = {k: F.col(k) for k in q.SIGNALS}
    s = s.withColumn("flags", q.quality_flags(columns, p))
    s = s.withColumn("raw", q.raw_score(columns, F.col("flags"), p))
    s = s.withColumn("auto_reject", q.rejects(F.col("flags"), F.col("raw"), p))
    return s.withColumn("reject_reason", q.reject_reason(F.col("flags"), F.col("auto_reject")))


def _flags_sql(p: q.Profile) -> str:
    very, motion = f"coalesce(salient < {p.salient_low}, false)", f"coalesce(aniso > {p.aniso} AND edge > {p.edge} AND salient < {p.salient} AND (focus IS NULL OR focus < 5), false)"
    late = f"(NOT {very} AND coalesce(blur_combined < {p.blur}, false))"
    rules = [
        ("too_small", f"greatest(width, height) < {p.side}"), ("tiny_file", f"size > 0 AND size < {p.size}"), ("very_blurry", very), ("subject_blurry", f"NOT {very} AND salient < {p.salient} AND NOT {motion}"),
        ("very_blurry", late), ("motion_blur", f"{motion} AND NOT {very} AND NOT {late}"),
        ("underexposed", f"mean < {p.dark_mean} OR under >= {p.clipped} OR (worst_dark >= {p.clipped} AND mean < {3 * p.dark_mean})"),
        ("overexposed", f"mean > {p.bright_mean} OR \"over\" >= {p.clipped} OR (worst_bright >= {p.clipped} AND mean > {p.bright_floor})"), ("low_contrast", f"contrast < {p.contrast}"),
        ("low_information", f"entropy < {p.entropy}"), ("horizon_severe", f"horizon > {p.tilt_severe}"), ("horizon_tilt", f"horizon > {p.tilt} AND horizon <= {p.tilt_severe}"),
        ("color_noise", f"noise > {p.noise}"), ("color_cast", f"\"cast\" > {p.cast}"), ("flat_tone", f"\"range\" < {p.range}"),
    ]
    cases = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in rules)
    cost = " + ".join(f"CASE WHEN list_contains(flags, '{k}') THEN {v} ELSE 0 END" for k, v in q.PENALTIES.items())
    reject = " OR ".join(f"list_contains(flags, '{k}')" for k in q.REJECTING)
    reason = " ".join(f"WHEN list_contains(flags, '{k}') THEN '{v}'" for k, v in q.REASONS.items())
    return f"""{views.SIGNALS_SQL}, fl AS (SELECT *, list_filter([{cases}], lambda x: x IS NOT NULL) AS flags FROM signals),
sc AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, blur_combined * 35 + greatest(0.0::DOUBLE, 25 - abs(mean - 128) / 128 * 25) + least(20.0::DOUBLE, contrast / 64 * 20) + least(10.0::DOUBLE, entropy / 7 * 10)
  + coalesce(composition, 0.5::DOUBLE) * 10 + {p.adjust} - ({cost}))) AS raw FROM fl),
rj AS (SELECT *, {reject} OR raw < {p.least_score} AS auto_reject FROM sc),
vd AS (SELECT *, CASE WHEN auto_reject THEN CASE WHEN NOT ({reject}) THEN '{q.LOW_SCORE_REASON}' {reason} END END AS reject_reason FROM rj)"""


def quality_flags_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir, q.STANDARD).select("ok", "ln", F.array_join("flags", ",").alias("flags"))


def quality_flags_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir, q.ADVANCED).select("ok", "ln", F.array_join("flags", ",").alias("flags"))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir, q.STANDARD).select("ok", "ln", (F.floor(F.col("raw") * 1000 + 0.5) / 1000).alias("score"), "auto_reject")


def reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir, q.ADVANCED).select("ok", "ln", "reject_reason", F.coalesce(text.reason_category(F.col("reject_reason")), F.lit("other")).alias("category"))


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(reject_reason, '{p}') THEN '{k}'" for k, p in text.REASON_GROUPS) + " ELSE 'other' END"


def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verdicts(spark, sf_dir, q.STANDARD).filter("auto_reject").withColumn("reason", F.when(F.col("ln") != 7, F.col("reject_reason")))
    return summaries.reason_histogram(v)


def prescreen_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.prescreen_stats(_verdicts(spark, sf_dir, q.STANDARD).withColumn("restored", F.col("ln") % 3 == 0), "auto_reject", "restored")


def low_aesthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = views.table(spark, sf_dir, "lineitem")  # noqa: E741
    musiq, clip = F.when(F.col("l_linenumber") != 4, F.col("l_quantity") * 2), F.col("l_discount") * 8 + 0.3
    return l.select("l_orderkey", "l_linenumber", q.low_aesthetic(musiq, clip).alias("standard"), q.low_aesthetic(musiq, clip, q.ADVANCED).alias("advanced"))


def face_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = views.table(spark, sf_dir, "lineitem")  # noqa: E741
    flags = q.face_flags(F.col("l_linenumber") - 2, F.when(F.col("l_linenumber") != 5, F.col("l_quantity") * 4), F.col("l_tax") * 10, F.col("l_returnflag") == "R")
    return l.select("l_orderkey", "l_linenumber", flags.alias("f")).select("l_orderkey", "l_linenumber", F.array_join("f", ",").alias("flags"), q.face_rejects(F.col("f")).alias("rejected"))


def verdict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's replies, fenced or broken, merged with the rules' verdicts."""
    v = _verdicts(spark, sf_dir, q.STANDARD).select("ok", "ln", "auto_reject", "reject_reason")
    k = F.col("ok") % 6
    body = F.concat(F.lit('{"verdict":"'), F.when(k == 0, "reject").when(k == 1, "PASS").when(k == 2, "maybe").otherwise("pass"), F.lit('","reason":"'), F.when(k == 3, " ").otherwise("seen"), F.lit('"}'))
    reply = text.parse_reply(F.when(k == 4, "not json").when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body))
    v = v.withColumn("reply", reply)
    rejected, reason = q.merged_verdict(F.col("auto_reject"), F.col("reject_reason"), F.col("reply.verdict"), F.col("reply.reason"))
    return v.select("ok", "ln", rejected.alias("rejected"), reason.alias("reason"), F.col("reply.verdict").alias("verdict"))


def entropy_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.entropy(views.pixels8(spark, sf_dir), "id", "v").select("id", _r6(F.col("entropy")).alias("entropy"))


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each plane: two quantiles, median, population deviation and share of dark pixels."""
    p = views.pixels8(spark, sf_dir)
    out = p.groupBy("id").agg(F.percentile("v", F.lit(0.8)).alias("q80"), F.percentile("v", F.lit(0.3)).alias("q30"), F.median("v").alias("median"), F.stddev_pop("v").alias("std"), F.avg((F.col("v") <= 110).cast("double")).alias("dark"))
    return out.select("id", *[_r6(F.col(c)).alias(c) for c in ("q80", "q30", "median", "std", "dark")])


def exposure_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.pixels8(spark, sf_dir).withColumn("v", (F.col("v") - 90) * 3)
    out = summaries.exposure_grid(p, "id", "x", "y", "v", 8, 8)
    return out.select("id", _r6(F.col("worst_dark")).alias("worst_dark"), _r6(F.col("worst_bright")).alias("worst_bright"))


def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.pixels8(spark, sf_dir).withColumn("g", F.floor(F.col("id") / 3))
    return summaries.index_range(p, "g", "v")


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, parts = views.paths(spark, sf_dir), views.parts_of()
    ext = text.extension(F.col("path"))
    return p.select("id", text.file_name(F.col("path")).alias("name"), parts["stem"].alias("stem"), ext.alias("ext"), parts["prefix"].alias("prefix"), parts["number"].cast("long").alias("number"), text.format_kind(ext).alias("kind"), text.content_type(ext).alias("type"), text.confined(F.col("path"), "/d3").alias("inside"))


def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.similarity import name_similarity as similar

    p = views.paths(spark, sf_dir).select("id", *[c.alias(k) for k, c in views.parts_of().items()])
    other = p.select((F.col("id") - 50).alias("id"), F.col("prefix").alias("p2"), F.col("number").alias("n2"))
    return p.join(other, "id").select("id", _r6(similar(F.col("prefix"), F.col("number"), F.col("p2"), F.col("n2"))).alias("sim"))


def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.captures(spark, sf_dir)
    return c.select("id", text.human_bytes(F.when(F.col("id") % 5 == 0, F.col("id") % 1500).otherwise(F.col("size"))).alias("shown"))


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    line = F.concat(F.lit("  "), F.col("text"), F.lit(" \t x  "))
    n = F.col("doc_id") % 7
    make = F.element_at(F.array(*[F.lit(x) for x in ("FUJIFILM", "Canon Inc.", "NIKON", "OM Digital Solutions", "Xiaomi", "acme", "Apple")]), (n + 1).cast("int"))
    template = F.element_at(F.array(*[F.lit(x) for x in ("a_plain", "B_clean", "c", "Z_odd", "d_x_clean", "", "e_1")]), (n + 1).cast("int"))
    return d.select(
        "doc_id", text.truncated(F.col("source"), 4).alias("short"), text.logo_of(make).alias("logo"), text.template_family(template).alias("family"), text.shows_parameters(template).alias("params"),
        text.parse_focal(F.concat(n.cast("string"), F.lit("5mm"))).alias("focal"), text.parse_aperture(F.concat(F.lit("f/"), n.cast("string"), F.lit(".8"))).alias("aperture"), F.char_length(text.squeezed(line)).alias("n"),
    )


def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.captures(spark, sf_dir).select("id", F.concat_ws(".", F.concat(F.lit("v"), (F.col("id") % 3).cast("string")), (F.col("id") % 12).cast("string")).alias("a"), F.concat_ws(".", (F.col("id") % 2).cast("string"), (F.col("id") % 11).cast("string"), (F.col("id") % 2).cast("string")).alias("b"))
    return c.select("id", text.version_newer(F.col("a"), F.col("b")).alias("newer"))


def pair_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = views.table(spark, sf_dir, "lineitem")  # noqa: E741
    side = {"eyes": "case when l_linenumber <> 3 then l_tax * 12.0 end", "aesthetic": "case when l_linenumber > 5 then l_discount * 10.0 end", "faces": "l_linenumber % 2", "face_sharpness": "case when l_linenumber <> 2 then l_quantity * 3.0 end", "blur": "l_quantity * 20.0", "mean": "cast(l_partkey % 250 as double)", "iso": "100 * (1 + l_suppkey % 8)", "camera": "concat('c', l_suppkey % 3)", "lens": "concat('l', l_partkey % 2)"}
    rows = l.selectExpr("l_orderkey", "l_linenumber", *[f"{x} as {k}" for k, x in side.items()])
    pairs = rows.alias("l").join(rows.alias("r"), (F.col("l.l_orderkey") == F.col("r.l_orderkey")) & (F.col("l.l_linenumber") + 1 == F.col("r.l_linenumber")))
    left, right = ({k: F.col(f"{t}.{k}") for k in side} for t in "lr")
    diff = text.differing_fields({k: left[k] for k in ("camera", "lens", "iso")}, {k: right[k] for k in ("camera", "lens", "iso")})
    return pairs.select(F.col("l.l_orderkey").alias("ok"), F.col("l.l_linenumber").alias("ln"), text.pair_explanation(left, right).alias("said"), F.array_join(diff, ",").alias("differ"))


_EXPLAIN = """WITH s AS (SELECT l_orderkey AS ok, l_linenumber AS ln, CASE WHEN l_linenumber <> 3 THEN l_tax * 12.0::DOUBLE END AS eyes, CASE WHEN l_linenumber > 5 THEN l_discount * 10.0::DOUBLE END AS ae, l_linenumber % 2 AS faces,
  CASE WHEN l_linenumber <> 2 THEN l_quantity * 3.0::DOUBLE END AS fs, l_quantity * 20.0::DOUBLE AS blur, (l_partkey % 250)::DOUBLE AS mean, 100 * (1 + l_suppkey % 8) AS iso, l_suppkey % 3 AS cam, l_partkey % 2 AS lens FROM lineitem),
p AS (SELECT l.ok, l.ln, l.eyes AS le, r.eyes AS re, l.ae - r.ae AS da, CASE WHEN l.faces > 0 OR r.faces > 0 THEN (l.fs - r.fs) / greatest(1.0::DOUBLE, CASE WHEN l.fs IS NULL OR r.fs IS NULL THEN NULL ELSE least(l.fs, r.fs) END) END AS fd,
  (l.blur - r.blur) / greatest(1.0::DOUBLE, least(l.blur, r.blur)) AS bd, CASE WHEN l.mean > 0 AND r.mean > 0 THEN log2(l.mean / r.mean) END AS st, l.iso / r.iso AS io, l.cam <> r.cam AS dc, l.lens <> r.lens AS dl, l.iso <> r.iso AS di
  FROM s l JOIN s r ON l.ok = r.ok AND l.ln + 1 = r.ln),
w AS (SELECT *, list_filter([CASE WHEN bd > 0.4 THEN '左图主体更锐' WHEN bd < -0.4 THEN '右图主体更锐' END,
  CASE WHEN abs(st) > 0.6 THEN CASE WHEN st > 0 THEN '左图' ELSE '右图' END || CASE WHEN abs(st) > 1.4 THEN '更亮约 1.5 档' WHEN abs(st) > 0.9 THEN '更亮约 1 档' ELSE '略亮' END END,
  CASE WHEN io >= 2 THEN '左图 ISO 更高' WHEN io <= 0.5 THEN '右图 ISO 更高' END], lambda x: x IS NOT NULL) AS weak FROM p)
SELECT ok, ln, CASE WHEN le < 0.45 AND re >= 0.65 THEN '看起来左图主体在闭眼' WHEN re < 0.45 AND le >= 0.65 THEN '看起来右图主体在闭眼' WHEN da > 0.45 THEN '看起来左图观感更舒服' WHEN da < -0.45 THEN '看起来右图观感更舒服'
  WHEN fd > 0.25 THEN '看起来左图人脸更清晰' WHEN fd < -0.25 THEN '看起来右图人脸更清晰' WHEN len(weak) > 0 THEN array_to_string(weak[1:2], ' · ') ELSE '两张差异微弱，按 ↑ 都留也是个选择' END AS said,
  array_to_string(list_filter([CASE WHEN dc THEN 'camera' END, CASE WHEN dl THEN 'lens' END, CASE WHEN di THEN 'iso' END], lambda x: x IS NOT NULL), ',') AS differ FROM w"""


def pairing_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.paths(spark, sf_dir).select("path").withColumns({"size": F.lit(1), "mtime": F.lit(0.0)})
    return pair_files(files).select("primary", F.array_join("companions", "|").alias("companions"), "analysis", "kind")


_PAIRING = f"""WITH {views.PATHS}, f AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS d, lower(regexp_extract(path, '([^/]*)\\.[^.]*$', 1)) AS s, lower(regexp_extract(path, '\\.[^.]*$')) AS e FROM paths WHERE path NOT LIKE '/winners/%'),
k AS (SELECT *, CASE e WHEN '.cr2' THEN 'raw' WHEN '.heic' THEN 'heic' WHEN '.xmp' THEN 'sidecar' WHEN '.jpg' THEN 'image' ELSE 'other' END AS kind FROM f),
g AS (SELECT d, s, list_sort(list(path) FILTER (kind = 'raw')) AS raws, list_sort(list(path) FILTER (kind = 'image')) AS images, list_sort(list(path) FILTER (kind = 'heic')) AS heics, list_sort(list(path) FILTER (kind = 'sidecar')) AS sides
      FROM k WHERE kind <> 'other' GROUP BY d, s),
h AS (SELECT coalesce(raws, []) AS raws, coalesce(images, []) AS images, coalesce(heics, []) AS heics, coalesce(sides, []) AS sides FROM g)
SELECT CASE WHEN len(raws) > 0 THEN raws[1] WHEN len(images) > 0 THEN images[1] ELSE heics[1] END AS "primary",
  array_to_string(CASE WHEN len(raws) > 0 THEN list_concat(list_concat(raws[2:], images), sides) WHEN len(images) > 0 THEN list_concat(images[2:], sides) ELSE list_concat(heics[2:], sides) END, '|') AS companions,
  CASE WHEN len(raws) > 0 THEN CASE WHEN len(images) > 0 THEN images[1] ELSE raws[1] END WHEN len(images) > 0 THEN images[1] ELSE heics[1] END AS analysis,
  CASE WHEN len(raws) > 0 THEN 'raw' WHEN len(images) > 0 THEN 'image' ELSE 'heic' END AS kind FROM h WHERE len(raws) + len(images) + len(heics) > 0"""


def folder_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.paths(spark, sf_dir).select("path").withColumns({"size": F.char_length("path").cast("long"), "mtime": F.lit(0.0)})
    pairs = pair_files(files)
    out = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return out.select("n", "bytes", text.human_bytes(F.col("bytes")).alias("shown"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knockout.replay(*views.decisions(spark, sf_dir))


def knockout_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).withColumns({c: F.array_join(c, "|") for c in ("images", "pending", "losers", "extra_winners")})


def member_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knockout.member_status(_states(spark, sf_dir))


def session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.session_status(_states(spark, sf_dir))


def transfer_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(spark, sf_dir)
    images = views.decisions(spark, sf_dir)[0]
    side = images.filter("pos % 2 = 0").select(F.col("path").alias("primary"), F.regexp_replace("path", "jpg$", "XMP").alias("companion"))
    existing = spark.range(3).select(F.concat(F.lit("winners/IMG_"), F.col("id").cast("string"), F.lit(".jpg")).alias("path"))
    return archive.transfer_plan(states, side, existing)


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knockout.member_status(_states(spark, sf_dir)).filter("status = 'winner'").select("group_id", "path")


QUERIES = {f.__name__: f for f in (quality_flags_standard, quality_flags_advanced, quality_score, reject_reason, reason_histogram, prescreen_stats, low_aesthetic, face_flags, verdict_merge, entropy_hist, quantiles, exposure_grid, index_range, path_parts, name_similarity, human_bytes, text_helpers, version_compare, pair_explanation, pairing_by_stem, folder_peek, knockout_final, member_status, session_status, transfer_plan, winners)}
_STD, _ADV = _flags_sql(q.STANDARD), _flags_sql(q.ADVANCED)
_V3 = "CASE k WHEN 0 THEN 'reject' WHEN 1 THEN 'pass' WHEN 5 THEN 'pass' END"
ORACLES = {
    "quality_flags_standard": f"WITH {_STD} SELECT ok, ln, array_to_string(flags, ',') AS flags FROM fl", "quality_flags_advanced": f"WITH {_ADV} SELECT ok, ln, array_to_string(flags, ',') AS flags FROM fl",
    "quality_score": f"WITH {_STD} SELECT ok, ln, floor(raw * 1000 + 0.5) / 1000 AS score, auto_reject FROM rj", "reject_reason": f"WITH {_ADV} SELECT ok, ln, reject_reason, {_CATEGORY} AS category FROM vd",
    "reason_histogram": f"WITH {_STD}, r AS (SELECT coalesce(CASE WHEN ln <> 7 THEN reject_reason END, '其他') AS reason FROM vd WHERE auto_reject) SELECT reason, count(*) AS n FROM r GROUP BY reason UNION ALL SELECT 'all', count(*) FROM r",
    "prescreen_stats": f"WITH {_STD} SELECT count(*) FILTER (auto_reject) AS rejected, count(*) FILTER (auto_reject AND ln % 3 = 0) AS restored, count(*) FILTER (auto_reject AND ln % 3 <> 0) AS pending FROM vd",
    "low_aesthetic": "SELECT l_orderkey, l_linenumber, l_linenumber <> 4 AND l_quantity * 2 < 55 AND l_discount * 8 + 0.3::DOUBLE < 0.55::DOUBLE AS standard, l_linenumber <> 4 AND l_quantity * 2 < 68 AND l_discount * 8 + 0.3::DOUBLE < 0.65::DOUBLE AS advanced FROM lineitem",
    "face_flags": "WITH f AS (SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_linenumber > 2 AND l_linenumber <> 5 AND l_quantity * 4 < 60 THEN 'face_very_blurry' END, CASE WHEN l_linenumber > 2 AND l_linenumber <> 5 AND l_quantity * 4 >= 60 AND l_quantity * 4 < 120 THEN 'face_blurry' END, CASE WHEN l_linenumber > 2 AND l_tax * 10 < 0.22::DOUBLE THEN 'eyes_closed' END, CASE WHEN l_linenumber > 2 AND l_returnflag = 'R' THEN 'face_clipped' END], lambda x: x IS NOT NULL) AS f FROM lineitem) SELECT l_orderkey, l_linenumber, array_to_string(f, ',') AS flags, list_contains(f, 'face_very_blurry') OR list_contains(f, 'eyes_closed') OR list_contains(f, 'face_clipped') AS rejected FROM f",
    "verdict_merge": f"WITH {_STD}, m AS (SELECT ok, ln, auto_reject, reject_reason, ok % 6 AS k FROM vd) SELECT ok, ln, CASE WHEN k = 0 THEN true WHEN k IN (1, 5) THEN false ELSE auto_reject END AS rejected, CASE WHEN k = 0 THEN 'seen' ELSE reject_reason END AS reason, {_V3} AS verdict FROM m",
    "entropy_hist": f"WITH {views.PIXELS8}, b AS (SELECT id, floor(v + 0.5) AS bin, count(*) / 64.0::DOUBLE AS p FROM pixels8 GROUP BY 1, 2) SELECT id, floor(-sum(p * log2(p)) * 1e6 + 0.5) / 1e6 AS entropy FROM b GROUP BY id",
    "quantiles": f"WITH {views.PIXELS8} SELECT id, floor(quantile_cont(v, 0.8) * 1e6 + 0.5) / 1e6 AS q80, floor(quantile_cont(v, 0.3) * 1e6 + 0.5) / 1e6 AS q30, floor(median(v) * 1e6 + 0.5) / 1e6 AS median, floor(stddev_pop(v) * 1e6 + 0.5) / 1e6 AS std, floor(avg(CASE WHEN v <= 110 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 1e6 + 0.5) / 1e6 AS dark FROM pixels8 GROUP BY id",
    "exposure_grid": f"WITH {views.PIXELS8}, c AS (SELECT id, least(2, x * 3 // 8) AS cx, least(2, y * 3 // 8) AS cy, avg(CASE WHEN (v - 90) * 3 <= 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS d, avg(CASE WHEN (v - 90) * 3 >= 247 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS b FROM pixels8 GROUP BY 1, 2, 3) SELECT id, floor(max(d) * 1e6 + 0.5) / 1e6 AS worst_dark, floor(max(b) * 1e6 + 0.5) / 1e6 AS worst_bright FROM c GROUP BY id",
    "index_range": f"WITH {views.PIXELS8}, s AS (SELECT id // 3 AS g, list_sort(list(v)) AS s FROM pixels8 GROUP BY 1) SELECT g, CASE WHEN len(s) >= 100 THEN s[floor((len(s) - 1) * 0.95::DOUBLE)::INTEGER + 1] - s[floor(len(s) * 0.05::DOUBLE)::INTEGER + 1] END AS \"range\" FROM s",
    "path_parts": f"WITH {views.PATHS}, p AS (SELECT id, path, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '\\.[^.]*$')) AS ext FROM paths) SELECT id, name, regexp_replace(name, '\\.[^.]*$', '') AS stem, ext, 'IMG_' AS prefix, id // 3 AS number, CASE ext WHEN '.cr2' THEN 'raw' WHEN '.heic' THEN 'heic' WHEN '.xmp' THEN 'sidecar' WHEN '.jpg' THEN 'image' ELSE 'other' END AS kind, CASE ext WHEN '.jpg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS type, path LIKE '/d3/%' AS inside FROM p",
    "name_similarity": f"WITH {views.PATHS} SELECT a.id, floor(greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(a.id // 3 - b.id // 3)::DOUBLE / 30.0::DOUBLE) * 1e6 + 0.5) / 1e6 AS sim FROM paths a JOIN paths b ON b.id = a.id + 50",
    "human_bytes": f"WITH {views.CAPTURES}, n AS (SELECT id, CASE WHEN id % 5 = 0 THEN id % 1500 ELSE size END AS n FROM captures) SELECT id, CASE WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 1048576 THEN round_even(n / 1024.0::DOUBLE, 0)::BIGINT::VARCHAR || ' KB' ELSE (round_even(n / 1048576.0::DOUBLE * 10, 0)::BIGINT // 10)::VARCHAR || '.' || (round_even(n / 1048576.0::DOUBLE * 10, 0)::BIGINT % 10)::VARCHAR || ' MB' END AS shown FROM n",
    "text_helpers": "SELECT doc_id, CASE WHEN length(source) > 4 THEN substr(source, 1, 4) || '…' ELSE source END AS short, CASE doc_id % 7 WHEN 0 THEN 'fujifilm.png' WHEN 1 THEN 'canon.png' WHEN 2 THEN 'nikon.png' WHEN 3 THEN 'olympus_blue_gold.png' WHEN 4 THEN 'xmage.png' WHEN 5 THEN 'default.png' ELSE 'apple.png' END AS logo, CASE doc_id % 7 WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 4 THEN 'D' WHEN 6 THEN 'E' ELSE 'A' END AS family, doc_id % 7 NOT IN (1, 4) AS params, ((doc_id % 7) * 10 + 5)::DOUBLE AS focal, ((doc_id % 7)::VARCHAR || '.8')::DOUBLE AS aperture, coalesce(length(trim(regexp_replace(replace('  ' || text || ' ' || chr(9) || ' x  ', chr(0), ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), 0)::INTEGER AS n FROM documents",
    "version_compare": f"WITH {views.CAPTURES}, v AS (SELECT id, [id % 3, id % 12, 0] AS a, [id % 2, id % 11, id % 2] AS b FROM captures) SELECT id, a[1] > b[1] OR (a[1] = b[1] AND (a[2] > b[2] OR (a[2] = b[2] AND a[3] > b[3]))) AS newer FROM v",
    "pair_explanation": _EXPLAIN, "pairing_by_stem": _PAIRING,
    "folder_peek": f"WITH p AS ({_PAIRING}) SELECT count(*) AS n, sum(length(\"primary\"))::BIGINT AS bytes, CASE WHEN sum(length(\"primary\")) < 1024 THEN sum(length(\"primary\"))::VARCHAR || ' B' WHEN sum(length(\"primary\")) < 1048576 THEN round_even(sum(length(\"primary\")) / 1024.0::DOUBLE, 0)::BIGINT::VARCHAR || ' KB' END AS shown FROM p",
}
