"""Regions of predictions, hybrid models, contributions of a linear model, and trees on small tables."""

import json

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from lumenrank.operators import models, pixels
from lumenrank.plans import jobs


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = [(f"i{k:02d}", float(a), float(b), None if k % 9 == 4 else float(c), float(5 + a - 0.5 * b + 0.2 * c)) for k, (a, b, c) in enumerate(rng.normal(size=(60, 3)))]
    df = spark.createDataFrame(rows, "image_id string, feat_a double, feat_b double, feat_c double, mean_score double").persist()
    splits = df.select("image_id", F.when(F.col("image_id") < "i12", "test").otherwise("dev").alias("partition"), F.when(F.col("image_id") < "i12", -1).otherwise(F.pmod(F.hash("image_id"), F.lit(3))).alias("fold"))
    return df.drop("mean_score"), df.select("image_id", "mean_score"), splits


@pytest.fixture(scope="module")
def squares(spark):
    """Dark pictures of 64 x 96 with a bright square, each in another tile of 32."""
    rows = [(f"p{k}", y, x, *(3 * (230.0 if (y // 8, x // 8) == (4 * (k % 2) + 1, 4 * (k % 3) + 1) else 20.0,))) for k in range(3) for y in range(64) for x in range(96)]
    return spark.createDataFrame(rows, "image_id string, y int, x int, r double, g double, b double").persist()


def test_regions_by_saliency(spark, squares):
    got = {(r.image_id, r.region_rank): r for r in jobs.important_regions(squares).collect()}
    assert len(got) == 18
    assert {k[0]: r.region_id for k, r in got.items() if k[1] == 1} == {"p0": "0_0", "p1": "1_1", "p2": "0_2"}
    assert all(r.area_fraction == pytest.approx(1 / 6) for r in got.values())


def test_predictions_tell_their_regions(spark, squares):
    """Eight regions an item at most; items without pixels, and rows from before, have none."""
    manifest = spark.createDataFrame([(f"p{k}", f"b/{k}.png", "b1" if k < 3 else "b2") for k in range(5)], "image_id string, relative_path string, import_batch_id string")
    features = spark.createDataFrame([(f"p{k}", float(k), 1.0) for k in range(5)], "image_id string, feat_a double, feat_b double")
    regions = jobs.important_regions(squares, tile=16).persist()
    assert regions.groupBy("image_id").count().first()["count"] == 24
    got, counts = jobs.analyze_batch(manifest, "b1", "r", features, None, regions=regions)
    want = {}
    for r in regions.orderBy("image_id", "region_rank").collect():
        want.setdefault(r.image_id, []).append((r.region_id, round(r.mean_importance, 9)))
    told = {r.image_id: [(x["region_id"], round(x["mean_importance"], 9)) for x in json.loads(r.top_regions)] for r in got.collect()}
    assert counts["analyzed"] == 3 and told == {k: v[:8] for k, v in want.items()}
    other, _ = jobs.analyze_batch(manifest, "b2", "r", features, None, existing=got.drop("top_regions"), regions=regions)
    assert {r.image_id: r.top_regions for r in other.collect()} == dict.fromkeys((f"p{k}" for k in range(5)))
    none, _ = jobs.analyze_batch(manifest, "b1", "r", features, None, neighbours=0)
    assert {(r.top_regions, r.neighbours) for r in none.collect()} == {(None, None)}


def test_hybrid_features(spark, frame):
    """Components equal those of the dev items' centred features; test items do not move them."""
    features, labels, splits = frame
    got = {r.image_id: r for r in models.hybrid_features(features, splits, 2).collect()}
    dev = {r.image_id for r in splits.filter("partition = 'dev'").collect()}
    ids = sorted(got)
    x = np.array([[got[i].feat_a, got[i].feat_b, got[i].feat_c or 0.0] for i in ids])
    seen = np.array([i in dev for i in ids])
    centred = x - x[seen].mean(0)
    _, _, axes = np.linalg.svd(centred[seen], full_matrices=False)
    for k in range(2):
        assert np.allclose(np.abs(centred @ axes[k]), np.abs([got[i][f"embed_{k:02d}"] for i in ids]), atol=1e-8)
    moved = features.withColumn("feat_a", F.when(F.col("image_id") < "i12", 1000.0).otherwise(F.col("feat_a")))
    again = {r.image_id: r for r in models.hybrid_features(moved, splits, 2).collect()}
    assert all(again[i].embed_00 == pytest.approx(got[i].embed_00) for i in dev)


def test_hybrid_model(spark, frame):
    features, labels, splits = frame
    run = models.train_hybrid(features, labels, splits, k=2, estimator=GBTRegressor(featuresCol="_x", labelCol="mean_score", maxIter=5, maxDepth=3, seed=1))
    assert list(run.models) == ["gbt"] and run.models["gbt"].scaler.columns == ["feat_a", "feat_b", "feat_c", "embed_00", "embed_01"]
    assert {(r.model, r.role) for r in run.metrics.collect()} == {("gbt", "val"), ("gbt", "test")}
    assert run.predictions.filter("p IS NULL").count() == 0


def test_contributions_of_a_linear_model(spark, frame):
    """A linear model's contribution is its coefficient times the scaled distance from the median."""
    features, labels, _ = frame
    columns = ["feat_a", "feat_b", "feat_c"]
    fitted = models.fit_regressor("elasticnet", features.join(labels, "image_id"), columns, "mean_score")
    pdf = features.toPandas().set_index("image_id")
    middle, weights = pdf.median(), dict(zip(columns, fitted.model.coefficients.toArray() / np.array(fitted.scaler.std), strict=True))
    got = {(r.image_id, r.feature): r.delta_prediction for r in models.local_contributions(fitted, features, features).collect()}
    assert len(got) == 180
    for (item, name), delta in got.items():
        value = pdf.loc[item, name]
        assert delta == pytest.approx(0.0 if np.isnan(value) else weights[name] * (value - middle[name]), abs=1e-9)


def test_trees_learn_a_step(spark):
    """A forest and boosted trees give both sides of a step, which a line cannot."""
    rows = [(float(k), 2.0 if k < 30 else 8.0) for k in range(60)]
    train = spark.createDataFrame(rows, "feat_a double, mean_score double")
    trees = {"random_forest": RandomForestRegressor(featuresCol="_x", labelCol="mean_score", numTrees=9, maxDepth=3, minInstancesPerNode=2, featureSubsetStrategy="all", seed=42), "gbt": GBTRegressor(featuresCol="_x", labelCol="mean_score", maxIter=12, maxDepth=2, stepSize=0.5, seed=42)}
    for kind, estimator in trees.items():
        got = {r.feat_a: r.p for r in models.fit_regressor(kind, train, ["feat_a"], "mean_score", estimator).predict(train).collect()}
        assert got[5.0] == pytest.approx(2.0, abs=0.3) and got[55.0] == pytest.approx(8.0, abs=0.3)


def test_feature_job_joins_its_parts(spark, squares):
    """Every column of the job equals the extractor's own; an extractor that is off leaves none."""
    whole = {r.image_id: r.asDict() for r in pixels.extract(squares).collect()}
    for name, extractor in pixels.EXTRACTORS.items():
        for r in extractor(pixels.gray(squares), pixels.cloud_mask(pixels.gray(squares))).collect():
            assert {c: whole[r.image_id][c] for c in r.asDict()} == pytest.approx(r.asDict(), abs=1e-9), name
    assert "entropy" not in pixels.extract(squares, ("color",)).columns
