"""Table schemas, and the checks on columns that every operator may rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _D, _B, _TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


MANIFEST = _of(("image_id", _S), ("relative_path", _S), ("sha256", _S), ("width", _I), ("height", _I), ("import_batch_id", _S), ("capture_date", _S), ("capture_session_id", _S), ("phash", _S), ("split_group_id", _S))
RATINGS = _of(("rating_id", _S), ("image_id", _S), ("rater_id", _S), ("rating_session_id", _S), ("raw_score_1_to_10", _D), ("rating_timestamp", _TS), ("note", _S))
PAIRWISE = _of(("pair_id", _S), ("left_image_id", _S), ("right_image_id", _S), ("rater_id", _S), ("winner", _S), ("tie_flag", _B), ("preference_strength", _D), ("timestamp", _TS))
AGGREGATED = _of(("image_id", _S), ("mean_score", _D), ("median_score", _D), ("trimmed_mean_score", _D), ("std_score", _D), ("sem_score", _D), ("n_raters", T.LongType()), ("agreement_index", _D), ("normalized_mean_score", _D), ("pairwise_win_rate", _D))
SPLITS = _of(("image_id", _S), ("split_group_id", _S), ("score_bin", _I), ("partition", _S), ("fold", _I))
EXCLUSIONS = _of(("image_id", _S), ("relative_path", _S), ("excluded", _S), ("reason", _S), ("timestamp", _S))
PREDICTIONS = _of(("batch_id", _S), ("run_id", _S), ("image_id", _S), ("relative_path", _S), ("kind", _S), ("predicted_score", _D), ("uncertainty", _D), ("top_features", _S), ("top_concepts", _S), ("explanation_path", _S), ("overlay_path", _S), ("created_at", _TS))

SCHEMAS = {"manifest": MANIFEST, "ratings": RATINGS, "pairwise": PAIRWISE, "aggregated": AGGREGATED, "splits": SPLITS, "exclusions": EXCLUSIONS, "predictions": PREDICTIONS}


def require_columns(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """df, or an error that names every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks columns: {', '.join(missing)}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of schema, by name; missing ones are typed nulls, others go. Bad values become null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def require_non_empty(df: DataFrame, table: str, hint: str) -> DataFrame:
    """df, or an error with a hint on how to fill it."""
    if df.isEmpty():
        raise ValueError(f"{table} is empty. {hint}")
    return df
