"""Fixed results of hashes, similarities, rules and texts."""

import numpy as np
from pyspark.sql import functions as F

from framesieve.functions import hashes, kernels, quality, similarity, text, vectors
from framesieve.plans import plane_queries


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_hash_goldens(spark):
    eight = F.array(*[F.lit(float(k)) for k in range(64)])
    steps = F.array(*[F.lit(float(k % 9)) for k in range(72)])
    row = one(spark, hashes.average_hash(eight), hashes.difference_hash(steps), hashes.average_hash(F.slice(eight, 1, 60)))
    assert tuple(row) == ("00000000ffffffff", "ffffffffffffffff", None)
    plane = np.array([[(x * 7 + y * 11 + (x * y) % 17) % 256 for x in range(32)] for y in range(32)])
    assert kernels.perceptual_hash(plane) == "9748943f602d5ef8"
    assert kernels.wavelet_hash(plane) == "0f3e78e0c1870f3e"
    assert kernels.average_hash(np.arange(64).reshape(8, 8)) == "00000000ffffffff"
    assert kernels.difference_hash(np.tile(np.arange(9), (8, 1))) == "f" * 16


def test_hash_similarity(spark):
    s = lambda a, b: hashes.hash_similarity(F.lit(a).cast("string"), F.lit(b).cast("string"))
    row = one(spark, s("f" * 16, "f" * 15 + "e"), s("f" * 16, "0" * 16), s("", "0"), s("zz", "0"), s(None, "0"), s("8" + "0" * 15, "0"))
    assert tuple(row) == (63 / 64, 0.0, None, None, None, 63 / 64)
    none = {k: F.lit(None).cast("string") for k in hashes.HASH_WEIGHTS}
    some = none | {"phash": F.lit("f"), "ahash": F.lit("0")}
    assert tuple(one(spark, hashes.combined_hash_similarity(some, none), hashes.combined_hash_similarity(some, some))) == (0.0, 1.0)
    scales = [hashes.wavelet_scale(F.lit(a), F.lit(b)) for a, b in ((5, 900), (64, 64), (127, 300), (1, 1), (4000, 3000))]
    assert tuple(one(spark, *scales)) == (8, 64, 64, 8, 2048)


def test_terms(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    row = one(spark, vectors.dot_similarity(a(1, 2), a(3, 4)), vectors.cosine_similarity(a(1, 0), a(-1, 0)), vectors.cosine_similarity(a(0, 0), a(1, 1)), vectors.dot_similarity(a(1), a(1, 2)), vectors.normalised(a(3, 4)), vectors.normalised(a(0, 0)))
    assert tuple(row) == (1.0, 0.0, None, None, [0.6, 0.8], None)
    row = one(spark, similarity.rounded(F.lit(0.285), 2), similarity.rounded(F.lit(-2.5), 0), similarity.half_even(F.lit(2.5)), similarity.time_similarity(F.lit(None).cast("double"), F.lit(1.0)))
    assert tuple(row) == (0.28, -3.0, 2.0, 0.0)
    name = similarity.name_similarity
    assert tuple(one(spark, name(F.lit("A"), F.lit(3), F.lit("A"), F.lit(6)), name(F.lit("A"), F.lit(3), F.lit("B"), F.lit(3)), name(F.lit("A"), F.lit(3), F.lit("A"), F.lit(300)))) == (0.9, 0.0, 0.0)
    assert similarity.slider_options(10, 6, 300) == {"group_size": 20, "threshold": 0.4, "half_life": 60}


def test_evidence_steps(spark):
    e = lambda base, h, gap, n: similarity.with_evidence(F.lit(base), F.lit(h), F.lit(gap).cast("double"), F.lit(n))
    row = one(spark, e(0.4, 0.5, 1, 90), e(0.9, 1.0, 1801, 90), e(0.97, 1.0, 1, 80), e(0.6, 1.0, 1, 30), e(0.9, 1.0, 1, 4), e(0.9, 1.0, None, None), e(0.9, 1.0, 1, 10))
    assert tuple(row) == (0.4, 0.45, 0.95, 0.85, 0.55, 0.55, 0.9)


BASE = {"width": 1200, "height": 800, "size": 200_000, "mean": 128.0, "contrast": 48.0, "over": 0.0, "under": 0.0, "entropy": 5.5, "blur_combined": 0.8, "aniso": 0.1, "worst_dark": 0.0, "worst_bright": 0.0, "noise": 0.3, "cast": 10.0, "range": 120.0, "salient": 1200.0, "edge": 2.0, "focus": 2.0, "horizon": None, "composition": 0.7}


def verdict(spark, profile=quality.STANDARD, **changes):
    s = {k: F.lit(v).cast("double") for k, v in (BASE | changes).items()}
    v = quality.verdict(s, profile)
    return one(spark, *[c.alias(k) for k, c in v.items()])


def test_quality_rules(spark):
    good = verdict(spark)
    assert (good["flags"], good["auto_reject"], good["reject_reason"]) == ([], False, None)
    bad = verdict(spark, salient=100.0, blur_combined=0.1)
    assert bad["flags"] == ["very_blurry"] and bad["auto_reject"] and bad["reject_reason"] == "主体失焦"
    soft, strict = verdict(spark, salient=700.0), verdict(spark, quality.ADVANCED, salient=700.0)
    assert soft["flags"] == ["subject_blurry"] and strict["flags"] == ["subject_blurry"] and strict["score"] <= soft["score"]
    moved = verdict(spark, salient=700.0, aniso=0.7, edge=6.0)
    assert moved["flags"] == ["motion_blur"] and moved["reject_reason"] == "运动模糊 · 手抖或模特动"
    assert verdict(spark, mean=5.0, contrast=1.0, entropy=0.1, width=100, height=100, size=10, horizon=20.0)["flags"] == ["too_small", "tiny_file", "underexposed", "low_contrast", "low_information", "horizon_severe"]
    assert quality.profile("Aggressive") is quality.ADVANCED and quality.profile("x") is quality.STANDARD


def test_face_and_model_verdicts(spark):
    f = quality.face_flags(F.lit(2), F.lit(50.0), F.lit(0.1), F.lit(True))
    none = quality.face_flags(F.lit(0), F.lit(50.0), F.lit(0.1), F.lit(True))
    assert tuple(one(spark, f, none, quality.face_rejects(f), quality.face_rejects(none))) == (["face_very_blurry", "eyes_closed", "face_clipped"], [], True, False)
    cleared = quality.merged_verdict(F.lit(True), F.lit("old"), F.lit("pass"), F.lit("fine"))
    added = quality.merged_verdict(F.lit(False), F.lit(None).cast("string"), F.lit("reject"), F.lit("dull"))
    assert tuple(one(spark, *cleared, *added)) == (False, "old", True, "dull")
    reply = lambda t: text.parse_reply(F.lit(t))
    row = one(spark, reply('```json\n{"verdict": "Reject", "reason": " dull "}\n```'), reply('{"verdict": "pass", "reason": " "}'), reply("no"), reply('{"verdict": "maybe", "reason": "x"}'))
    assert tuple(row) == (("reject", "dull"), None, None, None)


def test_texts(spark):
    p = F.lit("/a/b.c/IMG_0042.CR2")
    parts = one(spark, text.file_name(p), text.directory(p), text.stem(p), text.extension(p), text.number_suffix(text.stem(p)).cast("string"), text.name_prefix(text.stem(p)), text.format_kind(text.extension(p)))
    assert tuple(parts) == ("IMG_0042.CR2", "/a/b.c", "IMG_0042", ".cr2", "42", "IMG_", "raw")
    odd = one(spark, text.extension(F.lit("/x/.hidden")), text.number_suffix(F.lit("a18446744073709551616")).cast("string"), text.number_suffix(F.lit("abc")).cast("string"))
    assert tuple(odd) == ("", None, None)
    sizes = one(spark, *[text.human_bytes(F.lit(n)) for n in (0, 1023, 1024, 2560, 1048576, 1600000)])
    assert tuple(sizes) == ("0 B", "1023 B", "1 KB", "2 KB", "1.0 MB", "1.5 MB")
    newer = one(spark, *[text.version_newer(F.lit(a), F.lit(b)) for a, b in (("v1.10", "1.9"), ("1.0", "1"), ("1", "1.0.1"))])
    assert tuple(newer) == (True, False, False)
    labels = one(spark, *[text.half_day(F.lit(f"2024-01-02T{h:02}:00:00")) for h in (5, 6, 13, 16, 19, 23)], text.half_day(F.lit(None).cast("string")), text.date_label(F.lit("2024-01-02T00:00:00")))
    assert tuple(labels) == ("凌晨", "上午", "中午", "下午", "傍晚", "夜间", "未标注时间", "1 月 2 日")
    times = one(spark, *[text.effective_time(F.lit(d).cast("string"), F.lit(5.0), F.lit(7.0)) for d in ("1970-01-01T00:01:00", "1970-01-01T01:01:00+01:00", "1970-01-01T00:00:00.500", "bad", None)])
    assert tuple(times) == (60.0, 60.0, 0.5, 5.0, 5.0)
    safe = one(spark, *[text.confined(F.lit(x), "/a") for x in ("/a/b", "/ab", "/a/../b", "/a")])
    assert tuple(safe) == (True, False, False, True)


def test_kernels():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (90, 120, 3), dtype=np.uint8)
    flat = np.full((40, 50), 77, dtype=np.uint8)
    assert (kernels.lanczos(flat, 13, 9) == 77).all() and (kernels.thumbnail(flat, 20) == 77).all()
    assert kernels.thumbnail(rgb, 60).shape == (45, 60, 3)
    assert kernels.luma(np.array([[[255, 255, 255], [255, 0, 0], [0, 0, 0]]], dtype=np.uint8)).tolist() == [[255, 76, 0]]
    assert kernels.laplacian_variance(flat.astype(float)) == 0
    assert kernels.entropy(np.array([[0.0, 1.0], [2.0, 3.0]])) == 2.0
    s = kernels.signals(rgb)
    assert s["width"] == 120 and 0 < s["blur_combined"] <= 1 and s["noise"] > 0 and s["edge"] is None and s["salient"] is not None
    hist = kernels.color_histogram(rgb)
    assert hist.shape == (432,) and abs(float(np.linalg.norm(hist)) - 1) < 1e-6
    assert np.allclose(kernels.hsv(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]]], dtype=np.uint8))[0, :, 0], [0, 60, 120, 0])
    assert kernels.oriented(np.arange(6).reshape(2, 3), 6).tolist() == [[3, 0], [4, 1], [5, 2]]
    grown = kernels.bilinear(np.array([[0.0, 2.0]]), 4, 1)
    assert np.allclose(grown, [[-0.5, 0.5, 1.5, 2.0]])


def test_planes_hold_whole_texts(spark, tmp_path):
    texts = ["x" * 1500 + "y" * 1000, "short \u4e16\U0001f600", "", None, "z" * 1024]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    codes = [ord(c) % 256 for c in texts[0]] + [0] * 572
    assert plane_queries.planes32(texts[0]).reshape(-1).tolist() == codes
    assert plane_queries.planes32(texts[1]).reshape(-1).tolist() == [ord(c) % 256 for c in texts[1]] + [0] * (1024 - len(texts[1]))
    hashes_of = {(r["doc_id"], r["plane"]): r["phash"] for r in plane_queries.phash_docs(spark, str(tmp_path)).collect()}
    signals_of = {(r["doc_id"], r["plane"]): r["mean"] for r in plane_queries.plane_signals(spark, str(tmp_path)).collect()}
    assert set(hashes_of) == set(signals_of) == {(0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (4, 0)}
    assert hashes_of[0, 1] == kernels.perceptual_hash(np.array(codes[1024:2048]).reshape(32, 32))
