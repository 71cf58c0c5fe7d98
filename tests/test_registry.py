"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import inspect
import math
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenrank.operators import models
from lumenrank.plans import jobs, registry
from lumenrank.plans.fixtures import TABLES, view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    ran = duck.execute(registry.SQL[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == columns
    other = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in ran.fetchall()), key=repr)
    assert rows == other


@pytest.mark.parametrize("name", sorted({"select_collection", "pixel_phash", "crop_candidates", "feature_embedding"}))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_model_queries_use_the_operators_settings(spark, monkeypatch):
    """Settings with which the queries call the operators; a linear model is fitted in place of the trees."""
    seen, fit, shuffle = {}, models.fit_regressor, models.permutation_importance

    def fitted(kind, train, columns, target, estimator=None):
        seen[kind] = estimator or models.REGRESSORS[kind](train, target)
        return fit("elasticnet", train, columns, target)

    def shuffled(*given, **named):
        call = inspect.signature(shuffle).bind(*given, **named)
        call.apply_defaults()
        seen["repeats"] = call.arguments["repeats"]

    monkeypatch.setattr(models, "fit_regressor", fitted)
    monkeypatch.setattr(models, "permutation_importance", shuffled)
    registry.QUERIES["train_baseline"](spark, SF)
    registry.QUERIES["permutation_importance"](spark, SF)
    forest, boosted = seen["random_forest"], seen["gbt"]
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getFeatureSubsetStrategy()) == (300, 30, "all")
    assert (boosted.getMaxIter(), boosted.getStepSize(), seen["repeats"]) == (100, 0.1, 8)


def test_every_batch_is_analysed(spark):
    """All items of the manifest, each in its own batch; a batch has what it gets when analysed alone."""
    items = view(spark, SF, "v_manifest").select(F.col("import_batch_id").alias("batch_id"), "image_id").persist()
    got = registry.QUERIES["analyze_batches"](spark, SF).persist()
    assert sorted(map(tuple, got.select("batch_id", "image_id").collect()), key=repr) == sorted(map(tuple, items.collect()), key=repr)
    batch = items.agg(F.min("batch_id")).first()[0]
    features = view(spark, SF, "v_features")
    run = registry._run(spark, SF, ("elasticnet",))
    alone, counts = jobs.analyze_batch(view(spark, SF, "v_manifest"), batch, "run", features, run.models["elasticnet"], run.half_widths.first()["half_width"], labels=registry._labels(spark, SF))
    columns = ["image_id", "kind", "predicted_score", "neighbours", "label"]
    told = lambda df: sorted([tuple(plain(v) for v in r) for r in df.select(*columns).collect()], key=repr)
    assert counts["skipped"] == 0 and told(alone) == told(got.filter(F.col("batch_id") == batch))
