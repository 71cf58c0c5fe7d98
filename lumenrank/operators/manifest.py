"""The manifest of items, their exclusions and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.operators.keys import keep_first


def infer_session(path: Column, strategy: str = "parent") -> Column:
    """Capture session of a path relative to the root: its folder, else the first two ``_`` parts of its stem."""
    plain = F.translate(path, "\\", "/")
    parts = F.split(plain, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    tokens = F.filter(F.split(stem, "_"), lambda t: t != "")
    by_stem = F.when(F.size(tokens) >= 2, F.array_join(F.slice(tokens, 1, 2), "_")).otherwise("default_session")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(by_stem) if strategy == "parent" else by_stem


def item_kind(path: Column) -> Column:
    """crop for paths with /crops/, else original."""
    return F.when(F.contains(F.translate(path, "\\", "/"), F.lit("/crops/")), "crop").otherwise("original")


def safe_name(name: Column, length: int = 80, fallback: str = "image") -> Column:
    """Letters, digits, - and _ only, others as _; cut to length, without _ at its ends."""
    cut = F.btrim(F.left(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), F.lit(length)), F.lit("_"))
    return F.when(F.coalesce(cut, F.lit("")) == "", fallback).otherwise(cut)


# Fixed value: extensions that a file name keeps.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp")


def safe_filename(title: Column, extension: str = ".jpg") -> Column:
    """A file name from a page title: no File: prefix, URL-decoded, one of the known extensions, 120 characters."""
    plain = F.regexp_replace(title, "^File:", "")
    name = F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)
    found = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    known = found.isin(*IMAGE_EXTENSIONS)
    stem = F.when(known, F.substr(name, F.lit(1), F.char_length(name) - F.char_length(found))).otherwise(name)
    safe = F.rtrim(F.btrim(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_"), F.lit("._")))
    return F.concat(F.left(F.when(safe == "", "image").otherwise(safe), F.lit(120)), F.when(known, found).otherwise(F.lit(extension)))


def truthy(c: Column) -> Column:
    """Whether a text says yes."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def active_exclusions(log: DataFrame, order: list[str] | None = None) -> DataFrame:
    """image_id, reason of the items whose last event excludes them."""
    last = keep_first(log.filter(F.col("image_id").isNotNull()), ["image_id"], [F.desc_nulls_last(c) for c in order or ["timestamp"]])
    return last.filter(truthy(F.col("excluded"))).select("image_id", "reason")


def drop_excluded(df: DataFrame, log: DataFrame, order: list[str] | None = None) -> DataFrame:
    return df.join(active_exclusions(log, order), "image_id", "left_anti")


def build_manifest(scan: DataFrame, derivatives: DataFrame | None = None, exclusions: DataFrame | None = None) -> DataFrame:
    """The manifest of scanned files: sessions, split groups and batches, one row a path (or content), without exclusions.

    The last derivative row of a path counts. With derivatives, copies are told apart by path, else by
    content, in the order of paths.
    """
    df = scan if "capture_session_id" in scan.columns else scan.withColumn("capture_session_id", infer_session(F.col("relative_path")))
    if derivatives is not None:
        order = [F.desc("generation")] if "generation" in derivatives.columns else [F.desc("source_image_id")]
        last = keep_first(derivatives, ["relative_path"], order).select("relative_path", F.col("import_batch_id").alias("_batch"), F.col("source_image_id").alias("_source"))
        df = df.join(last, "relative_path", "left")
    else:
        df = df.withColumn("_batch", F.lit(None).cast("string")).withColumn("_source", F.lit(None).cast("string"))
    own = F.concat_ws("_", "capture_session_id", F.left("phash", F.lit(12)))
    df = df.withColumn("split_group_id", F.coalesce("_source", own)).withColumn("import_batch_id", F.coalesce("_batch", *(["import_batch_id"] if "import_batch_id" in df.columns else [])))
    df = df.drop("_batch", "_source")
    key = "relative_path" if derivatives is not None and not derivatives.isEmpty() else "sha256"
    df = keep_first(df, [key], [F.col("relative_path"), F.col("image_id")])
    return df if exclusions is None else drop_excluded(df, exclusions)


def first_by_hash(df: DataFrame, content: str = "sha256", order: str = "relative_path") -> DataFrame:
    """The first file of each content."""
    return keep_first(df, [content], [F.col(order)])


def import_summary(derivatives: DataFrame, manifest: DataFrame) -> DataFrame:
    """Originals, crops, size of the manifest and batch of an import."""
    size = manifest.agg(F.count(F.lit(1)).alias("manifest_size"))
    return derivatives.agg(F.count_if(F.col("derivative_kind") == "original").alias("originals"), F.count_if(F.col("derivative_kind") == "sky_crop").alias("crops"), F.max("import_batch_id").alias("batch_id")).crossJoin(F.broadcast(size))


def list_batches(manifest: DataFrame) -> DataFrame:
    """Distinct batches that have a name, the last one first."""
    return manifest.select("import_batch_id").filter(F.trim("import_batch_id") != "").distinct().orderBy(F.desc("import_batch_id"))


def batch_id(name: Column, at: Column) -> Column:
    """Safe name and UTC time (the session's zone is UTC)."""
    return F.concat_ws("_", safe_name(name), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))


def derived_name(image_id: Column, stem: Column, extension: Column, crop: Column | None = None, x: Column | None = None, y: Column | None = None, size: Column | None = None) -> Column:
    """id_stem.ext, or id_cropNN_xX_yY_sS.jpg for a crop."""
    if crop is None:
        return F.concat(image_id, F.lit("_"), safe_name(stem), F.lower(extension))
    return F.format_string("%s_crop%02d_x%d_y%d_s%d.jpg", image_id, crop, x, y, size)
