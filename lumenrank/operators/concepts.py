"""Concept scores of items, and texts about predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What adds to a concept's score before the logistic curve, by feature and weight;
# |a-b| stands for the distance of two features.
CONCEPT_WEIGHTS: dict[str, tuple[tuple[str, float], ...]] = {
    "concept_towering_clouds": (("vertical_mass_middle", 3.0), ("dominant_cloud_area_fraction", 2.5), ("horizon_row_fraction", -1.0)),
    "concept_dramatic_edges": (("edge_density", 2.0), ("contrast", 0.02), ("entropy", 0.3)),
    "concept_rim_lighting": (("dynamic_range", 0.02), ("contrast", 0.03), ("horizon_confidence", 0.5)),
    "concept_crepuscular_rays": (("saliency_spread", 1.5), ("edge_orientation_bin_2", 1.5), ("edge_orientation_bin_5", 1.5)),
    "concept_layered_depth": (("|brightness_top-brightness_bottom|", 2.0), ("vertical_mass_middle", 1.5)),
    "concept_cumulus_like": (("connected_components", 2.0 / 20), ("blob_count", 1.5 / 20)),
    "concept_storm_like": (("contrast", 0.04), ("fractal_dimension_proxy", 0.4), ("mean_brightness", -1.0 / 255)),
    "concept_dramatic_mood": (("concept_dramatic_edges", 1.0), ("concept_storm_like", 1.0), ("concept_layered_depth", 1.0), ("1", -1.5)),
    "concept_strong_depth_cues": (("concept_layered_depth", 1.0), ("rule_of_thirds_distance", 1.0)),
    "concept_cloud_sky_contrast": (("dynamic_range", 0.03), ("|cloud_area_fraction-sky_area_fraction|", 1.5)),
}
CONCEPTS = tuple(CONCEPT_WEIGHTS)


def with_concepts(features: DataFrame) -> DataFrame:
    """features with the ten concept scores; a missing or null feature counts as 0."""
    have = set(features.columns)

    def value(name: str) -> Column:
        if name == "1":
            return F.lit(1.0)
        if name.startswith("|"):
            a, b = name.strip("|").split("-")
            return F.abs(value(a) - value(b))
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in have else F.lit(0.0)

    plain = {k: v for k, v in CONCEPT_WEIGHTS.items() if not any(f.startswith("concept_") for f, _ in v)}
    for group in (plain, {k: v for k, v in CONCEPT_WEIGHTS.items() if k not in plain}):
        made = {}
        for name, parts in group.items():
            total = F.lit(0.0)
            for feature, weight in parts:
                total = total + weight * value(feature)
            made[name] = 1 / (1 + F.exp(-total))
        features = features.withColumns(made)
        have |= set(made)
    return features


def top_of(columns: list[str], k: int = 4) -> Column:
    """The k highest concepts of a row with these columns, as an array of s, concept and score, the highest first."""
    cells = F.array(*[F.struct((-F.col(c)).alias("s"), F.lit(c).alias("concept"), F.col(c).alias("score")) for c in CONCEPTS if c in columns])
    return F.slice(F.array_sort(cells), 1, k)


def top_concepts(features: DataFrame, k: int = 4) -> DataFrame:
    """image_id, concept, score, rank: the k highest concepts of each item, row by row."""
    return features.select("image_id", F.posexplode(top_of(features.columns, k)).alias("rank", "x")).select("image_id", "x.concept", "x.score", (F.col("rank") + 1).alias("rank"))


def explanation_text(score: Column, uncertainty: Column, features: Column, concepts: Column) -> Column:
    """A sentence on a prediction from its features and concepts (arrays of names, strongest first)."""
    feature_names = F.transform(F.slice(features, 1, 4), lambda x: F.replace(x, F.lit("_"), F.lit(" ")))
    concept_names = F.transform(F.slice(concepts, 1, 3), lambda x: F.replace(F.replace(x, F.lit("concept_"), F.lit("")), F.lit("_"), F.lit(" ")))
    said = lambda names, other: F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.array_join(names, ", ")).otherwise(other)
    return F.format_string(
        "Predicted score %.2f +/- %.2f. The model associates this rating with %s. Top concept signals: %s. These attributions describe model behavior rather than proven causal drivers.",
        score.cast("double"),
        uncertainty.cast("double"),
        said(feature_names, "mixed visual evidence"),
        said(concept_names, "no strong concept signals"),
    )


def explanation_record(df: DataFrame, columns: list[str], caveat: str) -> DataFrame:
    """df with record: the columns and the caveat as JSON."""
    return df.withColumn("record", F.to_json(F.struct(*columns, F.lit(caveat).alias("caveat"))))
