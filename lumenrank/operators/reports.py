"""Reports over predictions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.functions.ranks import global_row_number

_MODES = {
    "score_high": lambda: [F.desc_nulls_last("predicted_score")],
    "score_low": lambda: [F.asc_nulls_last("predicted_score")],
    "uncertainty_high": lambda: [F.desc_nulls_last("uncertainty")],
    "newest": lambda: [F.desc_nulls_last("created_at")],
}


def rank_predictions(df: DataFrame, mode: str = "score_high") -> DataFrame:
    """df with position by mode, ids breaking ties."""
    return global_row_number(df, [*_MODES[mode](), F.col("image_id")], "position")


def triage(df: DataFrame, n: int = 8, by: list[str] | None = None) -> DataFrame:
    """The n highest, lowest and most uncertain predictions of each run and batch: df with section and position."""
    keys = by or ["run_id", "batch_id"]
    sections = {"top": "score_high", "low": "score_low", "uncertain": "uncertainty_high"}
    ranks = {s: F.row_number().over(Window.partitionBy(*keys).orderBy(*_MODES[m](), "image_id")) for s, m in sections.items()}
    ranked = df.withColumns({f"_{s}": r for s, r in ranks.items()})
    picks = F.array_compact(F.array(*[F.when(F.col(f"_{s}") <= n, F.struct(F.lit(s).alias("section"), F.col(f"_{s}").alias("position"))) for s in sections]))
    return ranked.withColumn("_p", F.explode(picks)).select(*df.columns, "_p.section", "_p.position")


def batch_kpis(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, mean and largest score, largest uncertainty; texts that are no numbers count as missing."""
    score, doubt = F.col("predicted_score").try_cast("double"), F.col("uncertainty").try_cast("double")
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"), F.max(doubt).alias("max_uncertainty"))


def search_predictions(df: DataFrame, needle: str, columns: tuple[str, ...] = ("top_features", "top_concepts"), regex: bool = False) -> DataFrame:
    """Rows whose JSON columns hold a text, whatever its case; as a pattern on request."""
    found = F.lit(False)
    for c in columns:
        hit = F.col(c).rlike(f"(?i){needle}") if regex else F.contains(F.lower(c), F.lit(needle.lower()))
        found = found | F.coalesce(hit, F.lit(False))
    return df.filter(found)


def json_names(c: Column, key: str, n: int = 4) -> Column:
    """Names in the first n records of a JSON array, joined; blank ones are left out, bad JSON gives ''."""
    records = F.from_json(c, "array<map<string,string>>")
    names = F.transform(F.slice(records, 1, n), lambda r: F.element_at(r, key))
    return F.coalesce(F.array_join(F.filter(names, lambda x: x.isNotNull() & (F.trim(x) != "")), ", "), F.lit(""))


def summarize_runs(metrics: DataFrame) -> DataFrame:
    """One row a run from run_id, model, role, metrics (map): a column for each model, role and metric."""
    each = metrics.select("run_id", "model", "role", F.explode("metrics").alias("metric", "value"))
    return each.withColumn("column", F.concat_ws("_", "model", "role", "metric")).groupBy("run_id").pivot("column").agg(F.first("value"))


def run_metrics(metrics: DataFrame, names: tuple[str, ...] = ("mae", "rmse", "r2")) -> DataFrame:
    """run_id, model, role and the named metrics, one row each."""
    return metrics.select("run_id", "model", "role", *[F.element_at("metrics", n).alias(n) for n in names])


def epoch_metrics(history: DataFrame) -> DataFrame:
    """run_id, epoch, partition, metric, value from run_id and history (array of struct with epoch, partition, loss, rmse)."""
    each = history.select("run_id", F.explode("history").alias("h")).select("run_id", "h.*")
    return each.unpivot(["run_id", "epoch", "partition"], ["loss", "rmse"], "metric", "value")
