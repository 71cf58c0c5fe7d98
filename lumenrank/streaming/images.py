"""Image files as a stream: features, scores and the analysis of each micro-batch, kept in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lumenrank.operators.concepts import with_concepts
from lumenrank.operators.models import Fitted
from lumenrank.operators.pixels import extract, masked, pixels
from lumenrank.plans.jobs import analyze_batches, important_regions
from lumenrank.plans.stages import cut
from lumenrank.schemas import PREDICTIONS
from lumenrank.sources.images import BINARY_FILES, EXTENSIONS, few_listing_tasks, scan_images
from lumenrank.sources.tables import append_table, read_table

#: Predictions of a stream: those of a batch, with what analyze_batch adds.
STREAM_PREDICTIONS = T.StructType([f for f in PREDICTIONS if f.name not in ("explanation_path", "overlay_path")] + [T.StructField(n, k) for n, k in (("top_regions", T.StringType()), ("neighbours", T.StringType()), ("label", T.DoubleType()), ("explanation", T.StringType()))])


#: Pixels that are too few for a task of their own, and those that are enough for one: their windows take long for their few bytes.
FEW_PIXELS, PIXELS_A_TASK = 8_192, 2_000_000


def analyze_images(images: DataFrame, batch_id: str, run_id: str, fitted: Fitted | None, feature_table: str, prediction_table: str, half_width: float = 0.0, extractors: tuple[str, ...] = ("color", "texture", "composition")) -> None:
    """Features and predictions of images (image_id, relative_path, image), added to two tables.

    Features are made for images that the feature table lacks; predictions for those that (batch, run) lacks. So a batch
    that comes again, whole or after it broke off anywhere, leaves the tables as one run of it does. What the tables
    hold is not written again. Pixels are made once, for features and regions. A prediction's regions are tiles by saliency.
    """
    spark = images.sparkSession
    done = read_table(spark, prediction_table, STREAM_PREDICTIONS).filter((F.col("batch_id") == batch_id) & (F.col("run_id") == run_id))
    have = read_table(spark, feature_table, T.StructType([T.StructField("image_id", T.StringType())]))
    known = have.select("image_id", F.lit(True).alias("_known")).distinct()
    seen = done.select("image_id", F.lit(True).alias("_seen")).distinct()
    found = cut(images.dropDuplicates(["image_id"]).select("image_id", "relative_path", "image").join(known, "image_id", "left").join(seen, "image_id", "left"), "images")
    n, dots, fresh, unseen = found.agg(F.count(F.lit(1)), F.sum(F.col("image.height").cast("long") * F.col("image.width")), F.count_if(F.col("_known").isNull()), F.count_if(F.col("_seen").isNull())).first()
    if not fresh and not unseen:
        return
    # as many tasks as run at once, or more of PIXELS_A_TASK
    parts = max(min(spark.sparkContext.defaultParallelism, -(-dots // FEW_PIXELS)), -(-dots // PIXELS_A_TASK))
    px = masked(pixels(found.select("image_id", "image"), known_once=True), parts)
    mine = px if fresh == n else px.join(found.filter("_known IS NULL").select("image_id"), "image_id", "left_semi")
    features = with_concepts(extract(mine, extractors))
    if fresh:
        append_table(features, feature_table)
    if unseen:
        manifest = found.filter("_seen IS NULL").select("image_id", "relative_path", F.lit(batch_id).alias("import_batch_id"))
        got = analyze_batches(manifest, run_id, read_table(spark, feature_table, features.schema), fitted, half_width, regions=important_regions(px))
        append_table(got.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STREAM_PREDICTIONS]), prediction_table)


def score_images(spark: SparkSession, folder: str, run_id: str, fitted: Fitted | None, feature_table: str, prediction_table: str, checkpoint: str, half_width: float = 0.0, files_a_batch: int = 1_000, extractors: tuple[str, ...] = ("color", "texture", "composition")) -> StreamingQuery:
    """Analyse the image files that arrive in folder; micro-batch k of the stream is the batch stream-k.

    A batch's paths (at most files_a_batch) pass through the driver; files are read and decoded by tasks.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY_FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(folder)

    def step(batch: DataFrame, number: int) -> None:
        ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        paths = sorted(r[0] for r in batch.select("path", "length").filter(ending.isin(*EXTENSIONS)).select("path").collect())
        if paths:
            analyze_images(scan_images(spark, folder, paths=paths, files=batch), f"stream-{number:06d}", run_id, fitted, feature_table, prediction_table, half_width, extractors)

    few_listing_tasks(spark)
    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
