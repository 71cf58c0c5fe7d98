"""Validation of records by named rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rating_rules(max_score: float = 10.0) -> dict[str, Column]:
    """What a rating must meet: ids that are there and a score from 0 to 10 (0.0 included)."""
    score = F.col("raw_score_1_to_10")
    return {
        "image_id": F.col("image_id").isNotNull() & (F.col("image_id") != ""),
        "rater_id": F.col("rater_id").isNotNull() & (F.col("rater_id") != ""),
        "score_missing": score.isNotNull() & ~F.isnan(score),
        "score_range": score.between(0.0, max_score) | score.isNull() | F.isnan(score),
    }


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that meet all rules, the others with the names of the rules they break in ``reasons``)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    judged = df.withColumn("reasons", broken)
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def half_steps(df: DataFrame) -> DataFrame:
    """Ratings that are not a multiple of 0.5: allowed, but worth a warning."""
    return df.filter(F.col("raw_score_1_to_10") * 2 != F.rint(F.col("raw_score_1_to_10") * 2))
