"""One row per key, upserts and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order; null keys are one key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of both tables, new ones in place of old ones with the same keys; among new ones the last in order."""
    both = existing.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, keys, [F.desc("_age"), *(order or [])]).drop("_age")


def missing(target: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of target whose key is not in existing."""
    return target.join(existing.select(key).distinct(), key, "left_anti")
