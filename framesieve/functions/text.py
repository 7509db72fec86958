"""Paths, names and other texts of captures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Known extensions by kind.
RAW = (".cr2", ".cr3", ".crw", ".nef", ".nrw", ".arw", ".srf", ".sr2", ".dng", ".raf", ".orf", ".rw2", ".pef", ".rwl", ".srw", ".x3f")
HEIC = (".heic", ".heif")
IMAGE = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")
SIDECAR = (".xmp",)
#: Content types by extension.
CONTENT_TYPES = {".html": "text/html; charset=utf-8", ".js": "application/javascript; charset=utf-8", ".css": "text/css; charset=utf-8", ".svg": "image/svg+xml", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp"}
#: Logo files by what a lower-cased maker contains, in order of precedence.
LOGOS = {
    "fuji": "fujifilm.png", "canon": "canon.png", "nikon": "nikon.png", "sony": "sony.png", "leica": "leica_logo.png", "hasselblad": "hasselblad.png",
    "olympus": "olympus_blue_gold.png", "om digital": "olympus_blue_gold.png", "om system": "olympus_blue_gold.png", "panasonic": "panasonic.png",
    "pentax": "pentax.png", "ricoh": "ricoh.png", "apple": "apple.png", "xiaomi": "xmage.png",
}
#: Labels of the hours before each limit, and of the rest and of unknown times.
HALF_DAYS, NIGHT, UNDATED = ((6, "凌晨"), (11, "上午"), (14, "中午"), (17, "下午"), (20, "傍晚")), "夜间", "未标注时间"
#: Groups of reasons by pattern, in order of precedence.
REASON_GROUPS = (("blur", "失焦|焦点|模糊|未跟上"), ("eyes", "闭眼|眨眼"), ("exposure", "曝光|高光|过暗|过亮|溢出"), ("comp", "被切|反差|信息|缺少"), ("format", "截图|尺寸|文件异常|非拍摄"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/\\\\]*$", 0)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/\\\\]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty for names without one and for dot-files."""
    return F.lower(F.regexp_extract(file_name(path), "^.+(\\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), "^(.+)\\.[^.]*$", "$1")


def number_suffix(name: Column) -> Column:
    """The number that a stem ends with; null if there's none, or one beyond 64 bits."""
    digits = F.regexp_extract(name, "([0-9]+)$", 1)
    n = F.when(digits != "", digits).try_cast("decimal(38,0)")
    return F.when(n < F.lit("18446744073709551616").cast("decimal(38,0)"), n.cast("decimal(20,0)"))


def name_prefix(name: Column) -> Column:
    return F.regexp_replace(name, "[0-9]+$", "")


def format_kind(ext: Column) -> Column:
    return F.when(ext.isin(*RAW), "raw").when(ext.isin(*HEIC), "heic").when(ext.isin(*IMAGE), "image").when(ext.isin(*SIDECAR), "sidecar").otherwise("other")


def content_type(ext: Column) -> Column:
    out = F.lit("application/octet-stream")
    for e, t in CONTENT_TYPES.items():
        out = F.when(ext == e, t).otherwise(out)
    return out


def parse_focal(text: Column) -> Column:
    """50 from "50mm"."""
    return F.regexp_replace(F.trim(text), "(mm)+$", "").try_cast("double")


def parse_aperture(text: Column) -> Column:
    """2.8 from "f/2.8"."""
    return F.regexp_replace(F.trim(text), "^f/", "").try_cast("double")


def human_bytes(n: Column) -> Column:
    """B, whole KB, or MB with one decimal; halves go to the even digit."""
    tenths = F.rint(n / 1048576.0 * 10).cast("long")
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(F.rint(n / 1024.0).cast("long").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB")))
    )


def squeezed(text: Column, default: str = "") -> Column:
    """Without NULs, white space runs as one space, trimmed; the default if nothing is left."""
    out = F.trim(F.regexp_replace(F.regexp_replace(text, "\\x00", ""), "\\s+", " "))
    return F.when(out.isNull() | (out == ""), default).otherwise(out)


def joined_line(*parts: Column, separator: str = "  ") -> Column:
    """The parts that aren't blank, in one line."""
    return F.array_join(F.filter(F.array(*[squeezed(p) for p in parts]), lambda x: x != ""), separator)


def truncated(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def logo_of(make: Column) -> Column:
    """Logo file of the first known maker that make contains, else the default's."""
    out = F.lit("default.png")
    for name, file in reversed(LOGOS.items()):
        out = F.when(F.contains(F.lower(make), F.lit(name)), file).otherwise(out)
    return out


def version_parts(version: Column) -> Column:
    """Numbers of a version, a leading v left out."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(version, "^[vV]", ""), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("long"))


def version_newer(a: Column, b: Column) -> Column:
    """Whether a is a later version than b; missing parts count as 0."""
    pairs = F.arrays_zip(version_parts(a).alias("a"), version_parts(b).alias("b"))
    order = F.aggregate(pairs, F.lit(0), lambda s, p: F.when(s != 0, s).otherwise(F.signum(F.coalesce(p["a"], F.lit(0)) - F.coalesce(p["b"], F.lit(0))).cast("int")))
    return order > 0


def template_family(template: Column, known: tuple[str, ...] = ("A", "B", "C", "D", "E", "F", "G")) -> Column:
    """What stands before the first underscore, if it is known; else A."""
    name = F.upper(F.element_at(F.split(template, "_"), 1))
    return F.when(name.isin(*known), name).otherwise("A")


def shows_parameters(template: Column) -> Column:
    return ~F.endswith(template, F.lit("_clean"))


def half_day(datetime: Column) -> Column:
    """Label of the part of the day that an ISO text names."""
    hour = F.regexp_extract(datetime, "T([0-9]{2}):", 1).try_cast("int")
    out = F.lit(NIGHT)
    for limit, label in reversed(HALF_DAYS):
        out = F.when(hour < limit, label).otherwise(out)
    return F.when(hour.isNull(), UNDATED).otherwise(out)


def date_label(datetime: Column) -> Column:
    """Month and day that an ISO text names, or nothing."""
    month, day = (F.regexp_extract(datetime, "([0-9]{4})-([0-9]{2})-([0-9]{2})", k).try_cast("int").cast("string") for k in (2, 3))
    return F.coalesce(F.concat(month, F.lit(" 月 "), day, F.lit(" 日")), F.lit(""))


def elapsed_label(seconds: Column) -> Column:
    """Seconds with one decimal, or minutes and seconds; nothing for negative or unknown ones."""
    tenths = F.floor(seconds * 10 + 0.5).cast("long")
    minutes = F.floor(seconds / 60).cast("long")
    short = F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" 秒"))
    long = F.concat(minutes.cast("string"), F.lit(" 分 "), F.floor(seconds - minutes * 60 + 0.5).cast("long").cast("string"), F.lit(" 秒"))
    return F.when(seconds.isNull() | (seconds < 0), "").when(seconds < 60, short).otherwise(long)


def span_label(seconds: Column) -> Column:
    """How long a burst or group took."""
    tenths, hours = F.floor(seconds * 10 + 0.5).cast("long"), F.floor(seconds / 360 + 0.5).cast("long")

    def point(n: Column) -> Column:
        return F.concat(F.floor(n / 10).cast("long").cast("string"), F.lit("."), (n % 10).cast("string"))

    return (
        F.when(seconds.isNull() | (seconds <= 0), "")
        .when(seconds < 5, F.concat(F.lit("约 "), point(tenths), F.lit(" 秒内")))
        .when(seconds < 60, F.concat(F.floor(seconds + 0.5).cast("long").cast("string"), F.lit(" 秒内")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60 + 0.5).cast("long").cast("string"), F.lit(" 分钟内")))
        .otherwise(F.concat(point(hours), F.lit(" 小时内")))
    )


def confined(path: Column, folder: str) -> Column:
    """Whether path is folder or below it, without steps upward."""
    return ((path == folder) | F.startswith(path, F.lit(folder.rstrip("/") + "/"))) & ~path.rlike("(^|/)\\.\\.(/|$)")


def effective_time(exif_datetime: Column, timestamp: Column, mtime: Column) -> Column:
    """Seconds of the metadata's time, read as UTC; else the timestamp, else the file's time."""
    stated = F.coalesce(*[F.unix_micros(F.try_to_timestamp(exif_datetime, F.lit(form))) / 1e6 for form in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")])
    return F.coalesce(stated, timestamp, mtime)


def parse_reply(content: Column) -> Column:
    """Struct (verdict, reason) of a model's reply, code fences left out; null unless the verdict is pass or reject and the reason isn't blank."""
    body = F.regexp_replace(F.regexp_replace(F.trim(content), "^```[a-zA-Z]*\\s*", ""), "\\s*```$", "")
    verdict, reason = F.lower(F.trim(F.get_json_object(body, "$.verdict"))), F.trim(F.get_json_object(body, "$.reason"))
    return F.when(verdict.isin("pass", "reject") & (reason != ""), F.struct(verdict.alias("verdict"), reason.alias("reason")))


def reason_category(reason: Column) -> Column:
    """Group of a reason for rejection, by the first pattern that fits."""
    out = F.lit("other")
    for label, pattern in reversed(REASON_GROUPS):
        out = F.when(reason.rlike(pattern), label).otherwise(out)
    return out


def pair_explanation(left: dict[str, Column], right: dict[str, Column], aesthetic: Column | None = None, sharper: Column | None = None) -> Column:
    """How two members differ: the first clear sign, else up to two weaker ones, else that there is little difference.

    aesthetic and sharper are how far recent choices lean to either (-1 to 1, null where too few were made): a sign that agrees says so.
    """
    agrees = F.lit("（与近期选择一致）")

    def leaning(said: str, condition: Column | None) -> Column:
        return F.lit(said) if condition is None else F.concat(F.lit(said), F.when(condition, agrees).otherwise(""))

    tasteful, sharp = (None if aesthetic is None else F.abs(aesthetic) > 0.3), (None if sharper is None else sharper > 0.3)
    le, re = left["eyes"], right["eyes"]
    da = left["aesthetic"] - right["aesthetic"]

    def relative(name: str) -> Column:
        return (left[name] - right[name]) / F.greatest(F.lit(1.0), F.least(left[name], right[name]))

    face = F.when((F.coalesce(left["faces"], F.lit(0)) > 0) | (F.coalesce(right["faces"], F.lit(0)) > 0), relative("face_sharpness"))
    blur, iso = relative("blur"), F.when((left["iso"] > 0) & (right["iso"] > 0), left["iso"] / right["iso"])
    stops = F.when((left["mean"] > 0) & (right["mean"] > 0), F.log2(left["mean"] / right["mean"]))
    amount = F.when(F.abs(stops) > 1.4, "更亮约 1.5 档").when(F.abs(stops) > 0.9, "更亮约 1 档").otherwise("略亮")
    weak = F.array(
        F.when(blur > 0.4, "左图主体更锐").when(blur < -0.4, "右图主体更锐"),
        F.when(F.abs(stops) > 0.6, F.concat(F.when(stops > 0, "左图").otherwise("右图"), amount)),
        F.when(iso >= 2, "左图 ISO 更高").when(iso <= 0.5, "右图 ISO 更高"),
    )
    weak = F.array_join(F.slice(F.array_compact(weak), 1, 2), " · ")
    return (
        F.when((le < 0.45) & (re >= 0.65), "看起来左图主体在闭眼")
        .when((re < 0.45) & (le >= 0.65), "看起来右图主体在闭眼")
        .when(da > 0.45, leaning("看起来左图观感更舒服", tasteful))
        .when(da < -0.45, leaning("看起来右图观感更舒服", tasteful))
        .when(face > 0.25, leaning("看起来左图人脸更清晰", sharp))
        .when(face < -0.25, leaning("看起来右图人脸更清晰", sharp))
        .when(weak != "", weak)
        .otherwise("两张差异微弱，按 ↑ 都留也是个选择")
    )


def shown_fields(meta: dict[str, Column]) -> dict[str, Column]:
    """The eight fields of a picture as they are shown; empty where they aren't known."""
    known = {k: F.coalesce(meta[k].cast("string"), F.lit("")) for k in ("camera", "lens", "focal_length", "aperture", "shutter")}
    known["iso"] = F.when(F.coalesce(meta["iso"].cast("string"), F.lit("")) != "", F.concat(F.lit("ISO "), meta["iso"].cast("string"))).otherwise("")
    known["dim"] = F.when((meta["width"] > 0) & (meta["height"] > 0), F.concat_ws("×", meta["width"].cast("string"), meta["height"].cast("string"))).otherwise("")
    known["size"] = F.when(meta["size"] > 0, human_bytes(meta["size"])).otherwise("")
    return known


def marked_fields(own: dict[str, Column], other: dict[str, Column]) -> Column:
    """Names of the shown fields that both have and that differ."""
    a, b = shown_fields(own), shown_fields(other)
    return F.array_compact(F.array(*[F.when((a[k] != "") & (b[k] != "") & (a[k] != b[k]), k) for k in a]))


def group_progress(decided: Column, total: Column) -> Column:
    """Percentage of a group's decisions, 100 at most; 0 for none to make."""
    return F.when(total > 0, F.least(F.lit(100.0), decided / total * 100)).otherwise(0.0)


def group_title(short_id: Column, datetime: Column, total: Column) -> Column:
    """The half of the day and the number of pictures, where they are known; else the short id."""
    count = F.concat(F.lit("连拍 "), total.cast("string"), F.lit(" 张"))
    plain = F.concat(F.lit("组 #"), F.coalesce(short_id, F.lit("")))
    return F.when(F.coalesce(datetime, F.lit("")) != "", F.concat(half_day(datetime), F.lit(" · "), count)).when(total > 1, count).otherwise(plain)


def iso_format(time: Column) -> Column:
    """A timestamp as ISO text to whole seconds."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def differing_fields(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Names of the fields that both have and that differ, in order."""
    return F.array_compact(F.array(*[F.when(a[k] != b[k], k) for k in a]))
