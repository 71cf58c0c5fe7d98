"""Metrics of scores, rankings and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.functions.ranks import average_ranks, group_quantiles, quantiles, sketched_quantiles




def regression_metrics(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """mae, rmse, r2, pearson, spearman, qwk and n, over all rows or by columns; null where n is below 2."""
    keys = by or []
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*keys, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"))
    ranked = average_ranks(average_ranks(rows, "_y", "_ry", keys), "_p", "_rp", keys)
    i, j = _grade(F.col("_y")), _grade(F.col("_p"))
    got = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("_y") - F.col("_p"))).alias("mae"),
        F.sqrt(F.avg((F.col("_y") - F.col("_p")) ** 2)).alias("rmse"),
        F.when(F.var_pop("_y") > 0, 1 - F.avg((F.col("_y") - F.col("_p")) ** 2) / F.var_pop("_y")).alias("r2"),
        F.corr("_y", "_p").alias("pearson"),
        F.corr("_ry", "_rp").alias("spearman"),
        _kappa(i, j).alias("qwk"),
    )
    enough = F.col("n") >= 2
    return got.select(*keys, "n", *[F.when(enough, F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in ("mae", "rmse", "r2", "pearson", "spearman", "qwk")])


def _grade(c: Column, low: int = 1, high: int = 10) -> Column:
    """Rounded half to even, within low and high."""
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.rint(c)))


def _kappa(i: Column, j: Column) -> Column:
    """Quadratic weighted kappa by moments: the expected disagreement needs no table of counts."""
    expected = F.avg(i * i) + F.avg(j * j) - 2 * F.avg(i) * F.avg(j)
    return F.when(F.abs(expected) < 1e-12, 1.0).otherwise(1 - F.avg((i - j) ** 2) / expected)


def qwk(df: DataFrame, y: str = "y", p: str = "p", low: int = 1, high: int = 10, by: list[str] | None = None) -> DataFrame:
    """Quadratic weighted kappa of grades low to high."""
    i, j = _grade(F.col(y), low, high), _grade(F.col(p), low, high)
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    return rows.groupBy(*(by or [])).agg(_kappa(i, j).alias("qwk"))


def ranking_metrics(df: DataFrame, y: str = "y", score: str = "score", pred: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """n, accuracy, roc_auc and kendall_tau (tau-b) of 0/1 labels; null where one class is missing.

    The area comes from average ranks; with 0/1 labels tau-b follows from it and the sizes of score ties.
    """
    keys = by or []
    predicted = pred if pred is not None else (F.col(score) >= 0.5).cast("int")
    rows = df.select(*keys, F.col(y).cast("int").alias("_y"), F.col(score).cast("double").alias("_s"), predicted.alias("_c")).filter(F.col("_y").isNotNull() & F.col("_s").isNotNull())
    ranked = average_ranks(rows, "_s", "_r", keys)
    ties = rows.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_t")).groupBy(*keys).agg(F.sum(F.col("_t") * (F.col("_t") - 1) / 2).alias("_tied"))
    got = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("_y") == F.col("_c")).cast("double")).alias("accuracy"),
        F.sum("_y").alias("_n1"),
        F.sum(F.when(F.col("_y") == 1, F.col("_r"))).alias("_sum"),
    )
    got = got.join(ties, keys) if keys else got.crossJoin(F.broadcast(ties))
    n1, n0, n = F.col("_n1").cast("double"), (F.col("n") - F.col("_n1")).cast("double"), F.col("n").cast("double")
    both = (n1 > 0) & (n0 > 0)
    auc = (F.col("_sum") - n1 * (n1 + 1) / 2) / (n1 * n0)
    free = n * (n - 1) / 2 - F.col("_tied")
    tau = (2 * auc - 1) * F.sqrt(n1 * n0 / free)
    return got.select(*keys, "n", "accuracy", F.when(both, auc).alias("roc_auc"), F.when(both & (free > 0), tau).alias("kendall_tau"))


def coverage(df: DataFrame, y: str, low: Column, high: Column, by: list[str] | None = None) -> DataFrame:
    """Share of y within [low, high]."""
    return df.groupBy(*(by or [])).agg(F.avg(((F.col(y) >= low) & (F.col(y) <= high)).cast("double")).alias("coverage"))


def ece(df: DataFrame, y: str = "y", p: str = "p", n_bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins of the predictions' range, the last one closed.

    With predictions all alike there is one bin, so the error is the plain gap.
    """
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"))
    ends = rows.agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"), F.count(F.lit(1)).alias("_all"))
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    bin_ = F.when(width > 0, F.least(F.floor((F.col("_p") - F.col("_lo")) / width), F.lit(n_bins - 1))).otherwise(0)
    bins = rows.crossJoin(F.broadcast(ends)).groupBy(bin_.alias("_b"), "_all").agg(F.count(F.lit(1)).alias("_n"), F.abs(F.avg("_p") - F.avg("_y")).alias("_gap"))
    return bins.agg(F.sum(F.col("_gap") * F.col("_n") / F.col("_all")).alias("ece"))


def conformal(df: DataFrame, y: str = "y", p: str = "p", alpha: float = 0.1, by: list[str] | None = None, sketched: bool = False) -> DataFrame:
    """Half width that holds 1 - alpha of the absolute errors, of each group where by is given; 0 without errors.

    sketched: by KLL sketches, whose rank error is stated there, in place of exact ranks; for many groups or great ones.
    """
    errors = df.select(*(by or []), F.abs(F.col(y) - F.col(p)).cast("double").alias("_e"))
    if not by:
        half = quantiles(errors, ["_e"], [1 - alpha])["_e"][0]
        return df.sparkSession.createDataFrame([(half or 0.0,)], "half_width double")
    found = (sketched_quantiles if sketched else group_quantiles)(errors, by, "_e", 1 - alpha, "half_width")
    groups = df.select(*by).distinct()
    same = F.lit(True)
    for c in by:
        found = found.withColumnRenamed(c, f"_by_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return groups.join(found, same, "left").select(*by, F.coalesce("half_width", F.lit(0.0)).alias("half_width"))


def ensemble(predictions: DataFrame, item: str = "image_id", p: str = "p") -> DataFrame:
    """Mean, deviation and 10 % and 90 % quantiles of the models' predictions of each item."""
    return predictions.groupBy(item).agg(F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.percentile(p, F.lit(0.1)).alias("p10"), F.percentile(p, F.lit(0.9)).alias("p90"))


