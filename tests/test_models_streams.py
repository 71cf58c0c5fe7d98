"""Models, batches and streams on small tables."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from lumenrank.operators import analysis, browse, models, reports
from lumenrank.plans.jobs import analyze_batch
from lumenrank.streaming import streams


def drain(df, name):
    """Run a stream over what is there now, into a table in memory, and return that."""
    df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)



def small():
    return {"random_forest": RandomForestRegressor(featuresCol="_x", labelCol="mean_score", numTrees=5, maxDepth=4), "gbt": GBTRegressor(featuresCol="_x", labelCol="mean_score", maxIter=3)}



@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    rows = [(f"i{k:02d}", float(a), float(b), None if k % 9 == 0 else float(c), float(5 + a - 0.5 * b)) for k, (a, b, c) in enumerate(rng.normal(size=(60, 3)))]
    df = spark.createDataFrame(rows, "image_id string, feat_a double, feat_b double, feat_c double, mean_score double").persist()
    splits = df.select("image_id", F.when(F.col("image_id") < "i12", "test").otherwise("dev").alias("partition"), F.when(F.col("image_id") < "i12", -1).otherwise(F.pmod(F.hash("image_id"), F.lit(3))).alias("fold"))
    return df.drop("mean_score"), df.select("image_id", "mean_score"), splits


def test_suite_and_batch(spark, frame):
    features, labels, splits = frame
    pairs = spark.createDataFrame([(f"i{a:02d}", f"i{b:02d}") for a in range(60) for b in range(a + 1, 60, 7)], "left_image_id string, right_image_id string")
    known = labels.withColumnsRenamed({"image_id": "left_image_id", "mean_score": "l"}), labels.withColumnsRenamed({"image_id": "right_image_id", "mean_score": "r"})
    pairs = pairs.join(known[0], "left_image_id").join(known[1], "right_image_id").select("left_image_id", "right_image_id", F.when(F.col("l") > F.col("r"), F.col("left_image_id")).otherwise(F.col("right_image_id")).alias("winner"), F.lit(False).alias("tie_flag"))
    run = models.train_baseline(features, labels, splits, pairs, estimators=small())
    got = {(r.model, r.role): r for r in run.metrics.collect()}
    assert got["elasticnet", "test"].r2 > 0.9 and set(run.models) == {"elasticnet", "random_forest", "gbt"}
    assert models.select_best(run.metrics) == "elasticnet"
    assert run.pairwise["available"] and run.pairwise["metrics"].first().roc_auc > 0.9
    strongest = models.local_contributions(run.models["elasticnet"], features, features, k=1).collect()
    assert len(strongest) == 60 and {r.feature for r in strongest} <= {"feat_a", "feat_b", "feat_c"}
    importance = {r.feature: r.importance_mean for r in models.permutation_importance(run.models["elasticnet"], features.join(labels, "image_id"), "mean_score", 2).collect()}
    assert importance["feat_a"] > importance["feat_b"] > importance["feat_c"] - 1e-6

    manifest = features.select("image_id", F.concat(F.lit("b/crops/"), "image_id").alias("relative_path"), F.when(F.col("image_id") < "i12", "b1").otherwise("b2").alias("import_batch_id"))
    first, counts = analyze_batch(manifest, "b1", "r1", features, run.models["elasticnet"], 0.5, labels=labels)
    first = first.persist()
    assert counts == {"analyzed": 12, "skipped": 0} and first.filter("predicted_score IS NULL").count() == 0
    again, counts = analyze_batch(manifest, "b1", "r1", features, run.models["elasticnet"], 0.5, existing=first, labels=labels)
    assert counts == {"analyzed": 0, "skipped": 12} and again.count() == 12
    assert first.filter(F.col("explanation").startswith("Predicted score")).count() == 12
    names = first.select(reports.json_names(F.col("top_features"), "feature").alias("n")).first().n
    assert names.count(",") == 2


def test_elastic_net_equals_coordinate_descent(spark, frame):
    features, labels, _ = frame
    train = features.join(labels, "image_id")
    fitted = models.fit_regressor("elasticnet", train, ["feat_a", "feat_b", "feat_c"], "mean_score")
    pdf = train.toPandas()
    x = pdf[["feat_a", "feat_b", "feat_c"]].to_numpy()
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    x = (x - x.mean(0)) / x.std(0)
    y = pdf["mean_score"].to_numpy() - pdf["mean_score"].mean()
    w = np.zeros(3)
    for _ in range(500):
        for j in range(3):
            rho = x[:, j] @ (y - x @ w + x[:, j] * w[j]) / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - 0.05 * 0.3, 0) / (1 + 0.05 * 0.7)
    assert np.allclose(fitted.model.coefficients.toArray(), w, atol=1e-5)


def test_no_preferences(spark, frame):
    none = spark.createDataFrame([], "left_image_id string, right_image_id string, winner string, tie_flag boolean")
    assert models.train_ranking(frame[0], none, none) == {"available": False, "reason": "no preferences to learn from"}


def test_neighbours_against_numpy(spark, frame):
    v = analysis.as_vector(frame[0]).persist()
    rows = {r.image_id: np.array(r.vector) for r in v.collect()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    want = {k: [x for _, x in sorted((-cos(a, b), j) for j, b in rows.items() if j != k)[:3]] for k, a in rows.items()}
    got = {}
    for r in analysis.nearest_all(v, v, 3).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.image_id)
    assert got == want
    assert [r.image_id for r in analysis.nearest(v, "i07", 3).collect()] == want["i07"]
    assert analysis.nearest(v, "none", 3).count() == 0


def test_pruned_neighbours_equal_all(spark, monkeypatch):
    """The same neighbours where cells are skipped; on clustered vectors most pairs are."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 6))
    rows = [(int(k), (centres[k % 12] + rng.normal(0, 0.05, 6)).round(4).tolist()) for k in range(360)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, [0.0] * 6), (1003, [0.0] * 6), (1004, (-centres[0]).tolist()), (1005, None)]
    v = spark.createDataFrame(rows, "image_id long, vector array<double>")
    whole = v.filter("vector IS NOT NULL")
    told = lambda df: sorted((r.query, r.image_id, round(r.similarity, 9), r["rank"]) for r in df.collect())
    monkeypatch.setattr(analysis, "BLOCK_ROWS", 50)
    for asked, k, pivots in ((whole, 5, 12), (whole.filter("image_id % 40 = 0 OR image_id > 999"), 40, None), (whole.filter("image_id > 1001"), 3, 1)):
        found, met = analysis.nearest_pruned(asked, v, k, pivots=pivots)
        assert told(found) == told(analysis.nearest_all(asked, whole, k))
        met = met.first()
        assert met.compared <= met.pairs == asked.count() * 365
        if pivots == 12:
            assert met.compared < 0.5 * met.pairs
    none = v.limit(0)
    assert analysis.nearest_pruned(none, v, 3)[0].count() == 0 and analysis.nearest_pruned(whole, none, 3)[0].count() == 0


def test_projection_is_centred(spark, frame):
    got = models.embed(frame[0], 2)
    assert abs(got.agg(F.avg("embed_00")).first()[0]) < 1e-9


def test_next_unrated_wraps(spark):
    ordered = spark.createDataFrame([(f"i{k}", k) for k in range(1, 6)], "image_id string, position long")
    rated = lambda *ks: spark.createDataFrame([(f"i{k}",) for k in ks], "image_id string")
    assert browse.next_unrated(ordered, rated(4, 5), 4).first()[0] == 1
    assert browse.next_unrated(ordered, rated(4), 3).first()[0] == 5
    assert browse.next_unrated(ordered, rated(1, 2, 3, 4, 5), 5).first()[0] == 5


def test_streams_equal_batch(spark, tmp_path):
    from lumenrank.operators.labels import aggregate_ratings
    from lumenrank.sources.tables import append_ratings, read_annotations
    from lumenrank.schemas import RATINGS

    folder = str(tmp_path / "log")
    rows = [(f"i{k % 4}", f"r{k % 3}", float(k % 10)) for k in range(30)]
    append_ratings(spark.createDataFrame(rows, "image_id string, rater_id string, raw_score_1_to_10 double"), folder)
    log = read_annotations(spark, folder, RATINGS)
    seen = []
    query = streams.touched_labels(spark.readStream.schema(RATINGS).option("recursiveFileLookup", True).parquet(folder), lambda: log, lambda df: seen.extend(df.collect()), aggregate_ratings, str(tmp_path / "cp"))
    query.awaitTermination()
    want = {r.image_id: r.mean_score for r in aggregate_ratings(log).collect()}
    assert {r.image_id: r.mean_score for r in seen} == want
    running = drain(streams.running_labels(spark.readStream.schema(RATINGS).option("recursiveFileLookup", True).parquet(folder)), "running")
    assert {r.image_id: r.mean_score for r in running.collect()} == pytest.approx(want)
