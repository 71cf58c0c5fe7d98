"""Annotation and exclusion logs as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenrank.operators.labels import SCORE
from lumenrank.schemas import RATINGS


def rating_stream(spark: SparkSession, folder: str, watermark: str = "1 day") -> DataFrame:
    """Rating events of a folder of Parquet logs, each id once within the watermark."""
    events = spark.readStream.schema(RATINGS).option("recursiveFileLookup", True).parquet(folder)
    return events.withWatermark("rating_timestamp", watermark).dropDuplicatesWithinWatermark(["rating_id"])


def running_labels(ratings: DataFrame) -> DataFrame:
    """Running count, mean, deviation and agreement of each item: sums that state can carry (update or complete mode)."""
    got = ratings.filter(F.col("image_id").isNotNull()).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_raters"), F.avg(SCORE).alias("mean_score"), F.stddev_pop(SCORE).alias("std_score"))
    return got.withColumn("agreement_index", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("std_score") / 5)))


def touched_labels(ratings: DataFrame, log: Callable[[], DataFrame], sink: Callable[[DataFrame], None], aggregate: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """For each micro-batch, recompute the labels of the items it touches from the whole log, and hand them to sink.

    Medians and trimmed means cannot be carried in state; only touched items are read again.
    """

    def step(batch: DataFrame, _: int) -> None:
        items = batch.select("image_id").distinct().persist()
        sink(aggregate(log().join(items, "image_id", "left_semi")))
        items.unpersist()

    return ratings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exclusion_state(events: DataFrame, order: str = "timestamp") -> DataFrame:
    """image_id, excluded, reason of the last event of each item (update or complete mode)."""
    last = events.groupBy("image_id").agg(F.max_by(F.struct("excluded", "reason"), F.struct(order)).alias("_e"))
    return last.select("image_id", "_e.excluded", "_e.reason")


def stream_scores(images: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Score the items of every micro-batch; sink upserts by its own key, so a batch that comes again changes nothing."""

    def step(batch: DataFrame, number: int) -> None:
        sink(score(batch), number)

    return images.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
