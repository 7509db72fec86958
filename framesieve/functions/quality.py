"""The quality rules as columns: flags, score, rejection and its reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import rounded


@dataclass(frozen=True)
class Profile:
    """Thresholds of a strength."""

    side: int
    size: int
    salient_low: float
    salient: float
    blur: float
    aniso: float
    edge: float
    dark_mean: float
    bright_mean: float
    clipped: float
    bright_floor: float
    contrast: float
    entropy: float
    tilt_severe: float
    tilt: float
    noise: float
    cast: float
    range: float
    least_score: float
    adjust: float
    musiq: float
    clipiqa: float


#: Fixed values of the two strengths.
STANDARD = Profile(640, 25_000, 550, 750, 0.28, 0.62, 5, 22, 235, 0.82, 215, 10, 0.85, 15, 4.5, 0.75, 28, 30, 35, 0, 55, 0.55)
ADVANCED = Profile(900, 40_000, 650, 1100, 0.35, 0.55, 4, 28, 228, 0.70, 208, 14, 1.20, 12, 3.0, 0.60, 22, 40, 45, -6, 68, 0.65)
#: Points that flags cost.
PENALTIES = {
    "very_blurry": 22, "motion_blur": 22, "underexposed": 22, "overexposed": 22, "low_information": 22, "horizon_severe": 22,
    "subject_blurry": 12, "low_contrast": 12, "horizon_tilt": 12, "color_noise": 8, "color_cast": 8, "flat_tone": 8, "too_small": 6, "tiny_file": 6,
}
REJECTING = ("very_blurry", "motion_blur", "underexposed", "overexposed", "low_information", "too_small", "tiny_file", "horizon_severe")
#: Messages by flag, in order of precedence, and the others.
REASONS = {
    "motion_blur": "运动模糊 · 手抖或模特动", "very_blurry": "主体失焦", "subject_blurry": "主体不够清晰", "horizon_severe": "歪斜严重 · 失控构图",
    "underexposed": "曝光严重不足", "overexposed": "高光溢出 · 细节流失", "low_information": "画面缺少内容", "too_small": "非拍摄文件（疑似截图）",
    "tiny_file": "文件异常小", "horizon_tilt": "地平线明显歪斜", "low_contrast": "反差不足", "color_noise": "高 ISO 彩噪明显", "color_cast": "白平衡偏色",
    "flat_tone": "动态范围不足 · 画面发灰",
}
LOW_SCORE_REASON, AESTHETIC_REASON, FACE_REASON, DEFAULT_REASON = "综合质量不达标", "美学评分偏低", "人脸质量不达标", "智能初筛"
#: The signals that the rules read; the last five may be null.
SIGNALS = ("width", "height", "size", "mean", "contrast", "over", "under", "entropy", "blur_combined", "aniso", "worst_dark", "worst_bright", "noise", "cast", "range", "salient", "edge", "focus", "horizon", "composition")


def profile(strength: str) -> Profile:
    return ADVANCED if strength.strip().lower() in ("advanced", "aggressive") else STANDARD


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def quality_flags(s: dict[str, Column], p: Profile = STANDARD) -> Column:
    """Flags in the rules' order; s has a column for each of SIGNALS."""
    very = _true(s["salient"] < p.salient_low)
    subject = ~very & _true(s["salient"] < p.salient)
    very_late = ~very & _true(s["blur_combined"] < p.blur)
    motion = _true((s["aniso"] > p.aniso) & (s["edge"] > p.edge) & (s["salient"] < p.salient)) & (s["focus"].isNull() | (s["focus"] < 5))
    dark = _true((s["mean"] < p.dark_mean) | (s["under"] >= p.clipped)) | _true((s["worst_dark"] >= p.clipped) & (s["mean"] < 3 * p.dark_mean))
    bright = _true((s["mean"] > p.bright_mean) | (s["over"] >= p.clipped)) | _true((s["worst_bright"] >= p.clipped) & (s["mean"] > p.bright_floor))
    rules = [
        ("too_small", F.greatest(s["width"], s["height"]) < p.side),
        ("tiny_file", (s["size"] > 0) & (s["size"] < p.size)),
        ("very_blurry", very),
        ("subject_blurry", subject & ~motion),
        ("very_blurry", very_late),
        ("motion_blur", motion & ~very & ~very_late),
        ("underexposed", dark),
        ("overexposed", bright),
        ("low_contrast", s["contrast"] < p.contrast),
        ("low_information", s["entropy"] < p.entropy),
        ("horizon_severe", s["horizon"] > p.tilt_severe),
        ("horizon_tilt", (s["horizon"] > p.tilt) & (s["horizon"] <= p.tilt_severe)),
        ("color_noise", s["noise"] > p.noise),
        ("color_cast", s["cast"] > p.cast),
        ("flat_tone", s["range"] < p.range),
    ]
    return F.array_compact(F.array(*[F.when(c, name) for name, c in rules]))


def raw_score(s: dict[str, Column], flags: Column, p: Profile = STANDARD) -> Column:
    """0 to 100, before rounding."""
    total = s["blur_combined"] * 35 + F.greatest(F.lit(0.0), 25 - F.abs(s["mean"] - 128) / 128 * 25)
    total = total + F.least(F.lit(20.0), s["contrast"] / 64 * 20) + F.least(F.lit(10.0), s["entropy"] / 7 * 10)
    total = total + F.coalesce(s["composition"], F.lit(0.5)) * 10 + p.adjust
    cost = F.lit(0)
    for name, points in PENALTIES.items():
        cost = cost + F.when(F.array_contains(flags, name), points).otherwise(0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total - cost))


def rejecting(flags: Column) -> Column:
    """Whether one of the flags rejects on its own."""
    return F.arrays_overlap(flags, F.array(*[F.lit(x) for x in REJECTING]))


def rejects(flags: Column, score: Column, p: Profile = STANDARD) -> Column:
    return rejecting(flags) | (score < p.least_score)


def reject_reason(flags: Column, rejected: Column) -> Column:
    """Message of the first flag in order of precedence; of the score if none of the flags rejects; null if not rejected."""
    named = F.coalesce(*[F.when(F.array_contains(flags, k), v) for k, v in REASONS.items()])
    return F.when(rejected, F.when(rejecting(flags), named).otherwise(LOW_SCORE_REASON))


def verdict(s: dict[str, Column], p: Profile = STANDARD) -> dict[str, Column]:
    """flags, score, auto_reject and reject_reason."""
    flags = quality_flags(s, p)
    score = raw_score(s, flags, p)
    rejected = rejects(flags, score, p)
    return {"flags": flags, "score": rounded(score, 3), "auto_reject": rejected, "reject_reason": reject_reason(flags, rejected)}


def appended(flags: Column, *more: Column) -> Column:
    """flags and those of more that aren't null and not yet there, in order."""
    return F.array_union(flags, F.array_compact(F.array(*more)))


def low_aesthetic(musiq: Column, clipiqa: Column, p: Profile = STANDARD) -> Column:
    """Both scores below the profile's."""
    return _true((musiq < p.musiq) & (clipiqa < p.clipiqa))


def with_aesthetic(v: dict[str, Column], musiq: Column, clipiqa: Column, p: Profile = STANDARD) -> dict[str, Column]:
    """A verdict (flags, score, auto_reject, reject_reason) after the aesthetic rule: flagged, rejected, a reason if there's none, eight points less."""
    flags = appended(v["flags"], F.when(low_aesthetic(musiq, clipiqa, p), "low_aesthetic"))
    hit = F.array_contains(flags, "low_aesthetic")
    return {
        "flags": flags, "score": F.when(hit, F.greatest(v["score"] - 8, F.lit(0.0))).otherwise(v["score"]), "auto_reject": hit | v["auto_reject"],
        "reject_reason": F.when(hit, F.coalesce(v["reject_reason"], F.lit(AESTHETIC_REASON))).otherwise(v["reject_reason"]),
    }


def face_flags(count: Column, sharpness: Column, eyes: Column, clipped: Column) -> Column:
    """Flags of a picture's faces, in order; none without a face."""
    rules = [("face_very_blurry", sharpness < 60), ("face_blurry", (sharpness >= 60) & (sharpness < 120)), ("eyes_closed", eyes < 0.22), ("face_clipped", clipped)]
    return F.array_compact(F.array(*[F.when((count > 0) & _true(c), name) for name, c in rules]))


def face_rejects(flags: Column) -> Column:
    return F.arrays_overlap(flags, F.array(*[F.lit(x) for x in ("face_very_blurry", "eyes_closed", "all_eyes_closed", "face_clipped")]))


def with_faces(v: dict[str, Column], faces: Column) -> dict[str, Column]:
    """A verdict after the face rules: face flags added, and rejected, with a reason if there's none, where one of them rejects."""
    flags = F.array_union(v["flags"], faces)
    hit = face_rejects(flags)
    reason = F.when(hit, F.coalesce(v["reject_reason"], F.lit(FACE_REASON))).otherwise(v["reject_reason"])
    return {"flags": flags, "score": v["score"], "auto_reject": hit | v["auto_reject"], "reject_reason": reason}


def with_reply(v: dict[str, Column], model_verdict: Column, model_reason: Column) -> dict[str, Column]:
    """A verdict after a model's: a rejection adds, anything else clears; null leaves all as it is. The rules' reason stays on a pass.

    ``extra`` is a map of what the model said, null without it.
    """
    rejected, said = F.lower(model_verdict) == "reject", model_verdict.isNotNull()
    return {
        "flags": appended(v["flags"], F.when(rejected, "llm_reject").when(said, "llm_pass")), "score": v["score"], "auto_reject": F.when(said, rejected).otherwise(v["auto_reject"]),
        "reject_reason": F.when(rejected, model_reason).otherwise(v["reject_reason"]), "extra": F.when(said, F.create_map(F.lit("llm_verdict"), model_verdict, F.lit("llm_reason"), model_reason)),
    }


def merged_verdict(auto_reject: Column, reason: Column, model_verdict: Column, model_reason: Column) -> tuple[Column, Column]:
    """(auto_reject, reason) of with_reply."""
    out = with_reply({"flags": F.array().cast("array<string>"), "score": F.lit(None), "auto_reject": auto_reject, "reject_reason": reason}, model_verdict, model_reason)
    return out["auto_reject"], out["reject_reason"]


def prescreen(auto_reject: Column, reject_reason: Column) -> Column:
    """The reason for which a picture is left out before the selection; null if it takes part."""
    return F.when(F.coalesce(auto_reject, F.lit(False)), F.coalesce(reject_reason, F.lit(DEFAULT_REASON)))


def horizon(lines: Column) -> Column:
    """Tilt from lines (structs deviation, length): the mean, weighted by length, over the third with the least deviation, one at least."""
    ordered = F.array_sort(lines)
    some = F.slice(ordered, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(lines) / 3).cast("int")))
    total = F.aggregate(some, F.lit(0.0), lambda a, x: a + x["length"])
    return F.when(F.size(lines) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x["deviation"] * x["length"]) / F.greatest(total, F.lit(1e-8)))
