"""Bins of scores, and splits that keep groups whole."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.functions.ranks import global_row_number, quantiles
from lumenrank.plans.stages import cut


def seeded(seed: int, *columns: str) -> Column:
    """A reproducible order: MD5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def score_bins(df: DataFrame, column: str, n_bins: int = 5, name: str = "score_bin") -> DataFrame:
    """df with a quantile bin of column: right-closed, equal edges merged, at least 2 asked for.

    The bin is the number of distinct edges above the least that lie below the value.
    """
    # no more values are looked for than there are bins
    distinct = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(n_bins).count()
    q = max(2, min(n_bins, distinct))
    edges = quantiles(df, [column], [i / q for i in range(q + 1)])[column]
    inner = sorted({e for e in edges if e is not None and e > edges[0]})
    below = sum((F.when(F.col(column) > e, 1).otherwise(0) for e in inner), F.lit(0))
    return df.withColumn(name, F.when(F.col(column).isNotNull(), below).cast("int"))


def grouped_holdout(df: DataFrame, group: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """df with partition 'test' for a share of the groups (rounded up) and 'dev' for the rest."""
    groups = df.select(group).filter(F.col(group).isNotNull()).distinct()
    n = groups.count()
    placed = global_row_number(groups, [seeded(seed, group), F.col(group)], "_place")
    test = placed.filter(F.col("_place") <= math.ceil(fraction * n)).select(group, F.lit("test").alias("partition"))
    return df.join(test, group, "left").withColumn("partition", F.coalesce("partition", F.lit("dev")))


def group_folds(dev: DataFrame, group: str, bin_column: str, n_splits: int = 5, seed: int = 42) -> DataFrame:
    """group and fold: groups dealt to and fro over the folds, within their most frequent bin, the largest first."""
    counts = dev.groupBy(group, bin_column).agg(F.count(F.lit(1)).alias("_k"))
    sized = counts.groupBy(group).agg(F.sum("_k").alias("_size"), F.max_by(bin_column, F.struct("_k", -F.col(bin_column))).alias("_bin"))
    # numbered over all bins at once, by ranges; a row for each bin tells where it begins
    placed = global_row_number(sized, [F.col("_bin"), F.desc("_size"), seeded(seed, group), F.col(group)], "_place")
    starts = placed.groupBy(F.col("_bin").alias("_of")).agg(F.min("_place").alias("_first"))
    placed = placed.join(F.broadcast(starts), F.col("_bin").eqNullSafe(F.col("_of")))
    place = F.col("_place") - F.col("_first")
    lap, at = F.floor(place / n_splits), F.pmod(place, F.lit(n_splits))
    return placed.withColumn("fold", F.when(lap % 2 == 0, at).otherwise(n_splits - 1 - at).cast("int")).select(group, "fold")


def grouped_splits(manifest: DataFrame, labels: DataFrame, target: str = "mean_score", n_splits: int = 5, bins: int = 5, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """image_id, split_group_id, score_bin, partition, fold: no group straddles partitions or folds.

    Test rows have fold -1; with fewer dev rows than folds all are in fold 0.
    """
    merged = cut(manifest.select("image_id", F.col("split_group_id").cast("string").alias("split_group_id")).join(labels.select("image_id", target), "image_id"), "merged")
    binned = grouped_holdout(score_bins(merged, target, bins), "split_group_id", fraction, seed)
    dev = binned.filter("partition = 'dev'")
    folds = group_folds(dev, "split_group_id", "score_bin", n_splits, seed)
    if dev.limit(n_splits).count() < n_splits:
        folds = folds.withColumn("fold", F.lit(0))
    out = binned.join(folds, "split_group_id", "left")
    fold = F.when(F.col("partition") == "test", -1).otherwise(F.coalesce("fold", F.lit(0))).cast("int")
    return out.select("image_id", "split_group_id", "score_bin", "partition", fold.alias("fold"))


def split_overview(splits: DataFrame, labels: DataFrame, target: str = "mean_score") -> DataFrame:
    """Items, labelled items and mean score of each partition and fold."""
    both = splits.join(labels.select("image_id", target), "image_id", "left")
    return both.groupBy("partition", "fold").agg(F.count(F.lit(1)).alias("items"), F.count(target).alias("labelled"), F.avg(target).alias("mean_score"))


def training_frame(features: DataFrame, labels: DataFrame, splits: DataFrame, target: str = "mean_score", holdout: int = 0) -> DataFrame:
    """Features with target and role: train (dev, another fold), val (dev, the fold held out), test."""
    role = F.when(F.col("partition") == "test", "test").when((F.col("partition") == "dev") & (F.col("fold") == holdout), "val").when(F.col("partition") == "dev", "train")
    return features.join(labels.select("image_id", target), "image_id").join(splits.select("image_id", "partition", "fold"), "image_id").withColumn("role", role)
