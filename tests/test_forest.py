"""The forest whose deep nodes are grown in tasks."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lumenrank.operators import forest, models


def by_hand(x, y, w, depth, least):
    """Each row's prediction by a tree that tries every split of every node."""

    def rec(rows, level):
        total, weight, best = (w[rows] * y[rows]).sum(), w[rows].sum(), (1e-9, None, None)
        for j in range(x.shape[1]) if level < depth and np.ptp(y[rows]) > 0 else ():
            for a in np.unique(x[rows, j])[:-1]:
                sides = rows[x[rows, j] <= a], rows[x[rows, j] > a]
                gain = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in sides) - total**2 / weight
                if min(map(len, sides)) >= least and gain > best[0] + 1e-9:
                    best = (gain, *sides)
        return {int(i): total / weight for i in rows} if best[1] is None else rec(best[1], level + 1) | rec(best[2], level + 1)

    told = rec(np.arange(len(y)), 0)
    return np.array([told[i] for i in range(len(y))])


@pytest.mark.parametrize("n, depth", [(1, 3), (2, 3), (7, 0), (40, 2), (60, 30)])
def test_subtree_is_the_tree_by_hand(n, depth):
    rng = np.random.default_rng(n)
    x, y, w = rng.normal(size=(n, 3)).astype(np.float32), rng.normal(size=n), rng.integers(1, 4, n).astype(float)
    x[:, 2] = np.round(x[:, 2])
    feature, number, left = forest.grow(x, y, w, depth, 2)
    assert number[forest.descend(feature, number, left, x)] == pytest.approx(by_hand(x, y, w, depth, 2))


def test_values_without_a_middle():
    x = np.array([[-np.inf], [-np.inf], [np.inf], [np.inf], [np.nan], [np.nan]], dtype=np.float32)
    y = np.array([0.0, 0, 1, 1, 5, 5])
    feature, number, left = forest.grow(x[:4], y[:4], np.ones(4), 5, 2)
    assert number[forest.descend(feature, number, left, x[:4])].tolist() == [0, 0, 1, 1]
    assert len(forest.grow(x, y, np.ones(6), 5, 2)[0]) >= 1


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    made = [(f"i{k}", [float(v) for v in x], float(x[0] + abs(x[1]))) for k, x in enumerate(rng.normal(size=(600, 3)))]
    return spark.createDataFrame(made, "image_id string, x array<double>, y double").withColumn("_x", array_to_vector("x")).drop("x").persist()


def told(model, df):
    return {r.image_id: r.prediction for r in model.transform(df).collect()}


def test_forest_is_the_mean_of_trees_on_bags(spark, rows):
    got = told(forest.DeepForest(labelCol="y", numTrees=7, maxDepth=5).fit(rows), rows)
    held = rows.select("image_id", "_x", "y", F.xxhash64("image_id", "y", models.vector_to_array("_x")).alias("key")).collect()
    x, y, keys = np.array([r._x.toArray() for r in held], dtype=np.float32), np.array([r.y for r in held]), np.array([r.key for r in held])
    total = np.zeros(len(y))
    for t in range(7):
        w = forest.bag(keys, t, 42)
        feature, number, left = forest.grow(x[w > 0], y[w > 0], w[w > 0].astype(float), 5, 2)
        total += number[forest.descend(feature, number, left, x)]
    assert got == pytest.approx({r.image_id: p for r, p in zip(held, total / 7, strict=True)})


def test_large_nodes_are_split_before_tasks_take_them(spark, rows, monkeypatch):
    """No task takes a node of more than LEAF_ROWS rows, and the driver holds only the splits above."""
    whole = forest.DeepForest(labelCol="y", numTrees=20).fit(rows)
    monkeypatch.setattr(forest, "LEAF_ROWS", 60)
    deep = forest.DeepForest(labelCol="y", numTrees=20).fit(rows)
    blocks = rows.select(F.xxhash64("image_id", "y", models.vector_to_array("_x")).alias("key"), models.vector_to_array("_x", "float32").alias("x"), "y").mapInPandas(forest._packed(deep.top, 42), forest._BLOCKS)
    sizes = [r[0] for r in blocks.groupBy("tree", "sub").agg(F.sum("n")).collect()]
    assert max(sizes) <= 60 and len(sizes) == deep.subtrees.count() > 20
    assert deep.subtrees.agg(F.sum("nodes")).first()[0] > 3 * sum(len(t) for t in deep.top.nodes)
    known = {r.image_id: r.y for r in rows.collect()}
    errors = [np.mean([abs(p - known[i]) for i, p in told(m, rows).items()]) for m in (whole, deep)]
    assert errors[1] < 1.5 * errors[0] < 0.3
    # many rows to be scored go to a subtree in parts
    many = rows.withColumn("image_id", F.explode(F.array("image_id", F.concat("image_id", F.lit("b")))))
    once, twice = told(deep, rows), told(deep, many)
    assert len(twice) == 1200 and {i: twice[i + "b"] for i in once} == pytest.approx(once)
    # rows that no split can part
    alike = rows.withColumn("_x", F.lit(None).cast("double")).withColumn("_x", array_to_vector(F.array(F.lit(1.0))))
    assert len({round(p, 9) for p in told(forest.DeepForest(labelCol="y", numTrees=3).fit(alike), alike).values()}) == 1


def test_registered_forest_keeps_its_nodes_in_a_table(spark, rows):
    fitted = models.REGRESSORS["random_forest"](rows, "y")
    assert (fitted.getNumTrees(), fitted.getMaxDepth(), fitted.minInstancesPerNode) == (300, 30, 2)
    model = fitted.fit(rows.limit(80))
    assert sum(len(t) for t in model.top.nodes) == 300 and model.subtrees.count() == 300
    with pytest.raises(ValueError, match="no rows"):
        fitted.fit(rows.limit(0))
