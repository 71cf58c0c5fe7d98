"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.plans.stages import cut as stage_table
from lumenrank.plans.stages import new_path

__all__ = ["TEXT_BATCH_ROWS", "WORD_PATTERN", "documents", "free_names", "new_path", "small_batches", "stage_table", "word_count"]

#: Rows in one Arrow batch of texts; a batch of the longest documents must fit in a Python worker.
TEXT_BATCH_ROWS = 512

#: White space as the contracts spell it: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows, unless the session already has a smaller bound.

    The bound is a setting of the session that Spark reads when a plan runs, so it stays set. Spark bounds a batch by
    bytes too (spark.sql.execution.arrow.maxBytesPerBatch).
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names like those wanted that no column has, whatever its case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words, without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")

