"""Splits keep groups whole; metrics equal brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from lumenrank.functions.ranks import average_ranks, global_row_number
from lumenrank.functions.tdist import two_sided
from lumenrank.operators.metrics import conformal, coverage, ece, qwk, ranking_metrics, regression_metrics
from lumenrank.operators.splits import grouped_splits, score_bins
from pyspark.sql import functions as F


@pytest.mark.parametrize("seed", [1, 7, 42])
def test_groups_stay_whole(spark, seed):
    rng = random.Random(seed)
    manifest = spark.createDataFrame([(f"i{i}", f"g{i // 2}") for i in range(40)], "image_id string, split_group_id string")
    labels = spark.createDataFrame([(f"i{i}", rng.uniform(1, 9)) for i in range(40)], "image_id string, mean_score double")
    rows = grouped_splits(manifest, labels, n_splits=3, bins=3, seed=seed).collect()
    assert len(rows) == 40
    seen = defaultdict(set)
    for r in rows:
        seen[r.split_group_id].add((r.partition, r.fold))
        assert (r.fold == -1) == (r.partition == "test")
    assert all(len(v) == 1 for v in seen.values())
    assert sum(next(iter(v))[0] == "test" for v in seen.values()) == math.ceil(0.2 * 20)


def test_bins_equal_quantile_cut(spark):
    values = [1.0, 1, 1, 2, 2, 3, 5, 8, 8, 9, 10, 10]
    got = [r.score_bin for r in score_bins(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", 4).orderBy("v").collect()]
    assert got == pd.qcut(pd.Series(values), 4, duplicates="drop", labels=False).tolist()
    flat = score_bins(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 4)
    assert {r.score_bin for r in flat.collect()} == {0}


def test_regression_metrics(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(2, 20, 60) / 2
    p = np.clip(y + rng.normal(0, 1.5, 60).round(1), 0, 10)
    got = regression_metrics(spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))).first()
    assert got.mae == pytest.approx(np.abs(y - p).mean())
    assert got.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got.spearman == pytest.approx(pd.Series(y).rank().corr(pd.Series(p).rank()))
    i, j = np.clip(np.rint(y), 1, 10).astype(int), np.clip(np.rint(p), 1, 10).astype(int)
    table = np.zeros((10, 10))
    np.add.at(table, (i - 1, j - 1), 1)
    w = (np.subtract.outer(np.arange(10), np.arange(10)) / 9) ** 2
    want = 1 - (w * table).sum() / (w * np.outer(table.sum(1), table.sum(0)) / 60).sum()
    assert got.qwk == pytest.approx(want)
    assert qwk(spark.createDataFrame([(5.0, 5.0)] * 3, "y double, p double")).first().qwk == 1.0
    assert regression_metrics(spark.createDataFrame([(5.0, 5.0)], "y double, p double")).first().mae is None


def test_ranking_metrics_against_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.randint(0, 8) / 8) for _ in range(50)]
    got = ranking_metrics(spark.createDataFrame(rows, "y int, score double")).first()
    wins = [(a > b) + 0.5 * (a == b) for u, a in rows for v, b in rows if u == 1 and v == 0]
    assert got.roc_auc == pytest.approx(sum(wins) / len(wins))
    c = d = tx = ty = 0
    for k, (u, a) in enumerate(rows):
        for v, b in rows[:k]:
            s = (u - v) * (a - b)
            c, d, tx, ty = c + (s > 0), d + (s < 0), tx + (u != v), ty + (a != b)
    assert got.kendall_tau == pytest.approx((c - d) / math.sqrt(tx * ty))
    one = ranking_metrics(spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, score double")).first()
    assert one.roc_auc is None and one.accuracy == 0.5


def test_calibration(spark):
    df = spark.createDataFrame([(0.0, 0.1), (1.0, 0.9), (1.0, 0.8), (0.0, 0.2)], "y double, p double")
    assert ece(df).first().ece == pytest.approx(0.15)
    assert ece(spark.createDataFrame([(1.0, 0.5), (0.0, 0.5), (1.0, 0.5)], "y double, p double")).first().ece == pytest.approx(1 / 6)
    assert coverage(df, "y", F.col("p") - 0.15, F.col("p") + 0.15).first().coverage == 0.5
    assert conformal(df, alpha=0.5).first().half_width == pytest.approx(0.15)
    assert conformal(df.limit(0)).first().half_width == 0.0


def test_ranks(spark):
    df = spark.createDataFrame([(float(v),) for v in [3, 1, 3, 2, 3]], "v double")
    assert sorted((r.v, r.k) for r in average_ranks(df, "v", "k").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]
    numbered = global_row_number(spark.range(1000).withColumn("id", 999 - F.col("id")), [F.desc("id")], "n")
    assert all(r.n == 1000 - r.id for r in numbered.collect())


def test_t_distribution():
    # tables of Student's t: two-sided 5 % points
    for df, t in ((1, 12.706), (5, 2.571), (30, 2.042), (120, 1.980)):
        assert two_sided(t, df) == pytest.approx(0.05, abs=2e-4)
    assert two_sided(0.0, 5) == pytest.approx(1.0) and two_sided(None, 3) is None


def test_widths_of_groups(spark):
    """Exact quantiles of groups, with ties, nulls and a group of half of all rows; sketches within their rank error."""
    import numpy as np

    from lumenrank.functions.ranks import group_quantiles, sketched_quantiles
    from lumenrank.operators.metrics import conformal

    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=4001), "b": rng.integers(0, 4, 300).astype(float), None: rng.normal(size=7), "one": np.array([2.5])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("empty", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for share in (0.0, 0.37, 0.9, 1.0):
        got = {r.g: r.q for r in group_quantiles(df, ["g"], "v", share, "q").collect()}
        assert set(got) == set(groups) and all(abs(got[g] - np.quantile(v, share)) < 1e-12 for g, v in groups.items())
    near = {r.g: r.q for r in sketched_quantiles(df, ["g"], "v", 0.9, "q").collect()}
    assert set(near) == set(groups) and abs((groups["a"] <= near["a"]).mean() - 0.9) < 0.01
    judged = df.select("g", F.lit(0.0).alias("y"), F.col("v").alias("p"))
    for sketched in (False, True):
        widths = {r.g: r.half_width for r in conformal(judged, by=["g"], sketched=sketched).collect()}
        assert set(widths) == {*groups, "empty"} and widths["empty"] == 0.0 and widths["one"] == 2.5
    assert abs(conformal(judged).first().half_width - np.quantile(np.abs(np.concatenate(list(groups.values()))), 0.9)) < 1e-12
