"""Jobs: labels from logs, features of new items, and the analysis of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.operators.analysis import as_vector, feature_columns, nearest_exact
from lumenrank.operators.concepts import CONCEPTS, explanation_text, top_of, with_concepts
from lumenrank.operators.keys import missing, upsert
from lumenrank.operators.labels import aggregate_ratings, merged_pairs
from lumenrank.operators.manifest import item_kind
from lumenrank.operators.models import Fitted, local_contributions
from lumenrank.operators.pixels import cloud_mask, extract, gray, pixels, region_table, saliency
from lumenrank.operators.splits import grouped_splits
from lumenrank.operators.validation import rating_rules, validate
from lumenrank.plans.stages import cut, together

#: How many regions of an item a prediction tells.
TOP_REGIONS = 8


def aggregate_labels(manifest: DataFrame, ratings: DataFrame, pairs: DataFrame, min_gap: float = 2.0) -> dict[str, DataFrame]:
    """Tables that labelling leads to: ratings (valid), pairwise (explicit and derived), aggregated, splits, rejected."""
    valid, rejected = validate(ratings, rating_rules())
    labels = aggregate_ratings(valid, pairs)
    return {"ratings": valid, "rejected": rejected, "pairwise": merged_pairs(pairs, valid, min_gap), "aggregated": labels, "splits": grouped_splits(manifest, labels)}


def extract_features(images: DataFrame, existing: DataFrame | None = None, extractors: tuple[str, ...] = ("color", "texture", "composition"), concepts: bool = True, long_edge: int = 512) -> DataFrame:
    """Features of images (image_id, image), or of those only that existing lacks, merged into it."""
    todo = images if existing is None else missing(images, existing, "image_id")
    found = extract(gray(pixels(todo, long_edge)), extractors)
    found = with_concepts(found) if concepts else found
    return found if existing is None else upsert(existing, found, ["image_id"], [F.col("image_id")])


def important_regions(px: DataFrame, importance: str | None = None, tile: int = 32, region: str | None = None) -> DataFrame:
    """Regions of pixels by importance: a column that is given (what a model looks at, say), or else saliency."""
    seen = gray(px) if "cloud" in px.columns else cloud_mask(gray(px))
    return region_table(seen if importance else saliency(seen), importance or "saliency", tile, region)


def incremental(source: DataFrame, sink: DataFrame, key: str, fn) -> DataFrame:
    """sink with what fn makes of the rows of source whose key it lacks."""
    return upsert(sink, fn(missing(source, sink, key)), [key], [F.col(key)])


def _analysed(todo: DataFrame, run_id: str, features: DataFrame, fitted: Fitted | None, half_width: float, labels: DataFrame | None, neighbours: int, regions: DataFrame | None = None) -> DataFrame:
    """Predictions for the items of todo (batch_id, image_id, relative_path)."""
    ids = todo.select("image_id").distinct()
    columns = [c for c in feature_columns(features) if c not in CONCEPTS]
    base = features.select("image_id", *columns)

    def told_scores() -> DataFrame:
        """image_id, predicted_score, concepts, features: the strongest ones of each item."""
        rows = cut(with_concepts(features.join(ids, "image_id", "left_semi")), "rows")
        best = F.transform(top_of(rows.columns), lambda x: F.struct(x["concept"].alias("concept"), x["score"].alias("score"))).alias("concepts")
        if fitted is None:
            return rows.select("image_id", F.lit(None).cast("double").alias("predicted_score"), best, F.lit(None).cast("array<struct<feature:string,delta_prediction:double>>").alias("features"))
        scored = fitted.predict(rows).select("image_id", F.col("p").alias("predicted_score"), best)
        each = local_contributions(fitted, rows, features, k=8)
        order = F.sort_array(F.collect_list(F.struct((-F.abs("delta_prediction")).alias("k"), "feature", "delta_prediction")))
        strongest = each.groupBy("image_id").agg(F.transform(order, lambda x: F.struct(x["feature"].alias("feature"), x["delta_prediction"].alias("delta_prediction"))).alias("features"))
        return scored.join(strongest, "image_id", "left")

    def told_neighbours() -> DataFrame:
        """image_id, neighbours: the ids of the nearest items, the nearest first."""
        if neighbours == 0:
            return ids.select("image_id", F.lit(None).cast("array<string>").alias("neighbours"))
        near = nearest_exact(as_vector(base.join(ids, "image_id", "left_semi")), as_vector(base), neighbours)
        return near.withColumnRenamed("image_id", "_n").groupBy(F.col("query").alias("image_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_n"))), lambda x: x["_n"]).alias("neighbours"))

    out = todo
    for told in together(features.sparkSession, told_scores, told_neighbours):
        out = out.join(told, "image_id", "left")
    if labels is not None:
        out = out.join(labels.select("image_id", F.col("mean_score").alias("label")), "image_id", "left")
    else:
        out = out.withColumn("label", F.lit(None).cast("double"))
    if regions is not None:
        # region_table ranks an item's regions, so the strongest eight are told by rank
        told = F.transform(F.sort_array(F.collect_list(F.struct("region_rank", "region_id", "mean_importance", "area_fraction", "cloud_fraction"))), lambda x: F.struct(x["region_id"].alias("region_id"), x["mean_importance"].alias("mean_importance"), x["area_fraction"].alias("area_fraction"), x["cloud_fraction"].alias("cloud_fraction")))
        marked = regions.filter(F.col("region_rank") <= TOP_REGIONS).join(ids, "image_id", "left_semi").groupBy("image_id").agg(F.to_json(told).alias("top_regions"))
        out = out.join(marked, "image_id", "left")
    else:
        out = out.withColumn("top_regions", F.lit(None).cast("string"))
    said = explanation_text(F.coalesce("predicted_score", F.lit(0.0)), F.lit(half_width), F.transform("features", lambda x: x["feature"]), F.transform("concepts", lambda x: x["concept"]))
    return out.select(
        "batch_id", F.lit(run_id).alias("run_id"), "image_id", "relative_path", item_kind(F.col("relative_path")).alias("kind"), "predicted_score", F.lit(float(half_width)).alias("uncertainty"),
        F.to_json("features").alias("top_features"), F.to_json("concepts").alias("top_concepts"), "top_regions", F.to_json("neighbours").alias("neighbours"), "label", said.alias("explanation"), F.current_timestamp().alias("created_at"),
    )


def analyze_batch(manifest: DataFrame, batch_id: str, run_id: str, features: DataFrame, fitted: Fitted | None, half_width: float = 0.0, existing: DataFrame | None = None, labels: DataFrame | None = None, overwrite: bool = False, neighbours: int = 5, regions: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(predictions with those of the batch added, counts of analysed and skipped items).

    Items already scored in (batch, run) are skipped unless overwrite. Each gets score, uncertainty, its eight
    strongest features, four concepts, nearest items, label and a text; its eight most important regions where regions
    (as important_regions gives them) are there. Without a model the score is null. Rows of existing stay as they are; a
    column that it lacks is null in them.
    """
    chosen = manifest.filter(F.col("import_batch_id") == batch_id).select(F.lit(batch_id).alias("batch_id"), "image_id", "relative_path")
    n = chosen.count()
    done = None if existing is None else existing.filter((F.col("batch_id") == batch_id) & (F.col("run_id") == run_id))
    todo = chosen if overwrite or done is None else missing(chosen, done, "image_id")
    found = _analysed(todo, run_id, features, fitted, half_width, labels, neighbours, regions)
    analysed = todo.count()
    counts = {"analyzed": analysed, "skipped": n - analysed}
    if existing is None:
        return found, counts
    return upsert(existing, found, ["batch_id", "run_id", "image_id"], [F.desc("created_at")]), counts


def analyze_batches(manifest: DataFrame, run_id: str, features: DataFrame, fitted: Fitted | None, half_width: float = 0.0, labels: DataFrame | None = None, neighbours: int = 5, regions: DataFrame | None = None) -> DataFrame:
    """Predictions for the items of every batch, as analyze_batch gives them for one; the items are scored at once."""
    todo = manifest.select(F.col("import_batch_id").alias("batch_id"), "image_id", "relative_path")
    return _analysed(todo, run_id, features, fitted, half_width, labels, neighbours, regions)
