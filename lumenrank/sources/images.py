"""Image files as rows."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of Spark's source of binary files.
BINARY_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])

# Fixed value: file endings that are scanned.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")


def _plain(path: Column) -> Column:
    """One spelling for the paths of the two sources."""
    return F.regexp_replace(path, "^file:/+", "/")


def with_content_id(df: DataFrame, content: str = "content") -> DataFrame:
    """df with sha256 of the content, and image_id, its first 16 characters."""
    return df.withColumn("sha256", F.sha2(content, 256)).withColumn("image_id", F.substr("sha256", F.lit(1), F.lit(16)))


#: Tasks into which Spark deals the listing of paths; its own figure is one for each of up to 10,000 paths.
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def few_listing_tasks(spark: SparkSession) -> None:
    """From now on the session lists paths in about as many tasks as run at once.

    It is not set back: a stream lists the paths of each of its batches under the settings that the session then has.
    """
    spark.conf.set(_LISTING, str(max(1, min(int(spark.conf.get(_LISTING)), spark.sparkContext.defaultParallelism))))


def _load(spark: SparkSession, kind: str, where: str | list[str], **options: object) -> DataFrame:
    """The files of a folder, or of paths."""
    few_listing_tasks(spark)
    return spark.read.format(kind).option("recursiveFileLookup", True).options(**options).load(where)


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, paths: list[str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """path, relative_path, sha256, image_id of the files under root (or of paths in it) with a known ending, whatever its case.

    files: rows of Spark's source of binary files, if they were read before.
    """
    files = _load(spark, "binaryFile", paths or root) if files is None else files
    base = re.sub("^file:/+", "/", root).rstrip("/") + "/"
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = with_content_id(files.filter(ending.isin(*extensions))).withColumn("path", _plain(F.col("path")))
    return named.select("path", F.replace("path", F.lit(base), F.lit("")).alias("relative_path"), "sha256", "image_id")


def scan_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, paths: list[str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """Scanned files that can be decoded, with width, height and the image (blue, green, red bytes). files: as in scan_files."""
    decoded = _load(spark, "image", paths or root, dropInvalid=True)
    decoded = decoded.select(_plain(F.col("image.origin")).alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), "image")
    # in decoded's session: files of a stream have its own
    return decoded.join(scan_files(spark, root, extensions, paths, files), "path").select("path", "relative_path", "sha256", "image_id", "width", "height", "image")


def bitmap(width: Column, height: Column, rows: Column) -> Column:
    """The bytes of a bitmap file of 24-bit colours; rows: hexadecimal digits (blue, green, red) of its rows, the lowest first,
    each filled up to a multiple of 4 bytes."""
    little = lambda n: F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)])
    size = (F.char_length(rows) / 2).cast("int")
    head = F.concat(F.lit("424D"), little(size + 54), F.lit("00000000"), little(F.lit(54)), little(F.lit(40)), little(width), little(height), F.lit("01001800"), F.lit("00000000"), little(size), F.lit("00000000" * 4))
    return F.unhex(F.concat(head, rows))


def write_files(files: DataFrame, folder: str) -> int:
    """Write each row (name, content) as a file of folder; how many. A task that runs again writes the same files again."""

    def put(found):
        from pyarrow import fs

        for batch in found:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                where, path = fs.FileSystem.from_uri(target)
                where.create_dir(path, recursive=True)
                with where.open_output_stream(f"{path}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    target = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    target = re.sub("^file:/+", "file:///", target)
    return files.select("name", "content").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
