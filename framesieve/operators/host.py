"""Tables about the installation: components and their files, capabilities, logs, thumbnails, model requests and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name

MANIFEST = "id string, version string, runtime string, models array<string>, files array<struct<path string, url string, sha256 string, size_bytes bigint>>, checksum_status string"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(file, manifest columns) of JSON documents, a byte order mark left out; a broken document has nulls."""
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    return files.select("file", manifest(F.col("value")).alias("m")).select("file", "m.*")


def manifest(text: Column) -> Column:
    """A manifest's fields from its JSON; nulls where it is broken."""
    return F.from_json(F.regexp_replace(text, "^\\ufeff", ""), MANIFEST)


def manifest_of(asked: Column, environment: Column, official: Column, packaged: Column) -> Column:
    """Where a manifest is read from: what was asked for, else the environment's, the official or the packaged one; blanks don't count."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in (asked, environment, official, packaged)])


def component_status(defined: DataFrame, installed: DataFrame) -> DataFrame:
    """(id, status): installed, unverified, version_mismatch or not_installed.

    defined: (id, version); installed: (id, version, checksum_status, files_ready).
    """
    m = installed.select(F.col("id").alias("mid"), F.col("version").alias("mv"), "checksum_status", "files_ready")
    status = (
        F.when(F.col("mid").isNull(), "not_installed")
        .when(F.col("mv") != F.col("version"), "version_mismatch")
        .when((F.col("checksum_status") == "verified") & F.col("files_ready"), "installed")
        .otherwise("unverified")
    )
    return defined.join(m, F.col("id") == F.col("mid"), "left").select("id", status.alias("status"))


def verified_files(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, state) of each file of a manifest: ok, missing, size or checksum. files: (path, content)."""
    want = manifests.select("id", F.explode("files").alias("f")).select("id", "f.path", "f.sha256", "f.size_bytes")
    have = files.select(F.col("path").alias("p"), F.length("content").alias("n"), F.sha2("content", 256).alias("digest"))
    state = F.when(F.col("p").isNull(), "missing").when(F.col("n") != F.col("size_bytes"), "size").when(F.col("digest") != F.lower("sha256"), "checksum").otherwise("ok")
    return want.join(have, F.col("path") == F.col("p"), "left").select("id", "path", state.alias("state"))


def install_size(manifests: DataFrame) -> DataFrame:
    return manifests.select("id", F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["size_bytes"]).alias("bytes"))


def capabilities(flags: DataFrame) -> DataFrame:
    """flags with face_aware, quality_models, quality_models_reason and tycoon_ready, each a rule over which parts are there."""
    faces = F.col("detection") & F.col("recognition") & F.col("landmark")
    quality = F.col("expert") & F.col("musiq") & F.col("clipiqa") & F.col("preprocessor")
    reason = (
        F.when(quality, "available")
        .when(~F.col("expert"), "expert_component_not_installed")
        .when(~F.col("expert_quality"), "expert_quality_component_not_installed")
        .when(F.col("musiq") & F.col("clipiqa"), "quality_models_fixed_shape_not_parity_verified")
        .otherwise("quality_models_not_installed")
    )
    ready = F.col("provider") & F.col("expert") & F.col("embedding") & faces
    return flags.withColumns({"face_aware": F.col("expert") & faces, "quality_models": quality, "quality_models_reason": reason, "tycoon_ready": ready})


def job_logs(files: DataFrame, n: int = 50) -> DataFrame:
    """The newest n log files (path, size, mtime) of job folders."""
    own = files.filter(F.col("path").rlike("/_pic_selecter/jobs/[^/]+\\.log$"))
    return own.orderBy(F.col("mtime").desc(), "path").limit(n)


def logos(files: DataFrame) -> DataFrame:
    """Names of logo pictures in order."""
    return files.filter(F.lower("path").rlike("/logos/[^/]+\\.png$")).select(file_name(F.col("path")).alias("name"), "path").orderBy("name")


def thumbnail_key(path: Column, width: int) -> Column:
    """The first 16 hex digits of SHA-256 over the path and the width as four little-endian bytes."""
    return F.substring(F.sha2(F.concat(F.encode(path, "UTF-8"), F.lit(width.to_bytes(4, "little"))), 256), 1, 16)


def thumbnail_state(sources: DataFrame, thumbnails: DataFrame, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, key, fresh) of each source: whether a thumbnail (key, mtime) at least as new as it (path, mtime) is there.

    by: columns of both that tell sources of one path apart. Of several thumbnails with one key the newest counts.
    """
    names = [f"__{c}__" for c in by]
    rows = sources.select("path", "mtime", *by, thumbnail_key(F.col("path"), width).alias("key"))
    t = thumbnails.groupBy(F.col("key").alias("k"), *[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(F.max("mtime").alias("made"))
    same = F.col("key") == F.col("k")
    for c, n in zip(by, names, strict=True):
        same &= F.col(c) == F.col(n)
    return rows.join(t, same, "left").select("path", "key", F.coalesce(F.col("made") >= F.col("mtime"), F.lit(False)).alias("fresh"))


def data_url(content: Column) -> Column:
    return F.concat(F.lit("data:image/jpeg;base64,"), F.base64(content))


def judge_payload(protocol: Column, model: Column, image_url: Column, prompt: Column) -> Column:
    """The JSON of a request in the protocol chat, responses or messages."""

    def request(limit: str, content: Column, field: str) -> Column:
        return F.to_json(F.struct(model.alias("model"), F.lit(0.0).alias("temperature"), F.lit(384).alias(limit), F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias(field)))

    def parts(image: str, words: str, image_field: Column) -> Column:
        a = F.to_json(F.struct(F.lit(image).alias("type"), image_field))
        b = F.to_json(F.struct(F.lit(words).alias("type"), prompt.alias("text")))
        return F.array(F.parse_json(a), F.parse_json(b))

    source = F.struct(F.lit("base64").alias("type"), F.lit("image/jpeg").alias("media_type"), F.regexp_replace(image_url, "^[^,]*,", "").alias("data"))
    return (
        F.when(protocol == "chat", request("max_tokens", parts("image_url", "text", F.struct(image_url.alias("url")).alias("image_url")), "messages"))
        .when(protocol == "responses", request("max_output_tokens", parts("input_image", "input_text", image_url.alias("image_url")), "input"))
        .when(protocol == "messages", request("max_tokens", parts("image", "text", source.alias("source")), "messages"))
    )


def reply_text(protocol: Column, body: Column) -> Column:
    """The text of a reply in its protocol's envelope."""
    own = F.when(protocol == "chat", F.get_json_object(body, "$.choices[0].message.content"))
    own = own.when(protocol == "responses", F.coalesce(F.get_json_object(body, "$.output_text"), F.get_json_object(body, "$.output[0].content[0].text")))
    return own.when(protocol == "messages", F.get_json_object(body, "$.content[0].text"))


def model_list(body: Column) -> Column:
    """Ids in a provider's list of models."""
    return F.filter(F.transform(F.from_json(body, "data array<struct<id string>>")["data"], lambda m: m["id"]), lambda i: i.isNotNull())


def meta_entry(exif: dict[str, Column], quality: dict[str, Column], mtime: Column) -> Column:
    """JSON of all that is known of a picture, without nulls: metadata, then quality (which wins), then its time."""
    fields = exif | quality | {"mtime": mtime}
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def availability(extra: Column, **notes: bool) -> Column:
    """An open map with notes on what was available."""
    return F.map_concat(extra, F.create_map(*[x for k, v in notes.items() for x in (F.lit(k), F.lit(str(v).lower()))]))
