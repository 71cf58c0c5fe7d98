"""Labels, exclusions, validation and schemas."""

from datetime import datetime
from itertools import combinations

import pytest

from lumenrank.operators.labels import aggregate_ratings, merge_pairs, normalize_by_rater, pseudo_pairs, win_rate
from lumenrank.operators.manifest import active_exclusions, drop_excluded, infer_session, safe_filename, safe_name
from lumenrank.operators.validation import rating_rules, validate
from lumenrank.schemas import AGGREGATED, PAIRWISE, RATINGS, conform, empty_table, require_columns, require_non_empty

T0 = datetime(2024, 1, 1)


def ratings(spark, rows):
    return spark.createDataFrame([(f"r{i}", a, b, "s", float(s) if s is not None else None, datetime(2024, 1, 1, i // 60, i % 60), None) for i, (a, b, s) in enumerate(rows)], RATINGS)


def pairs(spark, rows):
    return spark.createDataFrame([(f"p{i}", *r, T0) for i, r in enumerate(rows)], PAIRWISE)


def test_aggregate(spark):
    r = ratings(spark, [("img1", "a", 8), ("img1", "b", 10), ("img2", "a", 6), ("img2", "b", 7)])
    p = pairs(spark, [("img1", "img2", "a", "img1", False, 0.8)])
    got = {x.image_id: x for x in aggregate_ratings(r, p).collect()}
    assert got["img1"].mean_score == 9.0 and got["img1"].n_raters == 2 and 0 <= got["img1"].agreement_index <= 1
    assert got["img1"].pairwise_win_rate == 1.0 and got["img2"].pairwise_win_rate == 0.0
    assert set(aggregate_ratings(r).columns) == {f.name for f in AGGREGATED}


def test_tie_and_null_tie(spark):
    for tie in (True, None):
        got = {x.image_id: x.pairwise_win_rate for x in win_rate(pairs(spark, [("a", "b", "r", None, tie, None)])).collect()}
        assert got == {"a": 0.5, "b": 0.5}
    no_column = pairs(spark, [("a", "b", "r", "b", True, None)]).drop("tie_flag")
    assert {x.image_id: x.pairwise_win_rate for x in win_rate(no_column).collect()} == {"a": 0.0, "b": 1.0}


def test_trimmed_mean(spark):
    rows = [("x", f"r{i}", s) for i, s in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 10])]
    assert aggregate_ratings(ratings(spark, rows)).first().trimmed_mean_score == pytest.approx(sum(range(1, 9)) / 8)


def test_constant_rater_counts_as_one(spark):
    got = normalize_by_rater(ratings(spark, [("a", "r", 5), ("b", "r", 5)])).collect()
    assert all(x.rater_z == 0 and x.normalized_score == 5 for x in got)


def test_pseudo_pairs_against_loop(spark):
    rows = [(f"i{i % 7}", f"r{i % 3}", (i * 37) % 11) for i in range(40)]
    got = {(x.left_image_id, x.right_image_id, x.rater_id, x.winner, x.preference_strength) for x in pseudo_pairs(ratings(spark, rows)).collect()}
    want = set()
    for rater in {r for _, r, _ in rows}:
        for a, b in combinations([x for x in rows if x[1] == rater], 2):
            if abs(a[2] - b[2]) >= 2:
                want.add((a[0], b[0], rater, a[0] if a[2] > b[2] else b[0], float(abs(a[2] - b[2]))))
    assert got == want


def test_explicit_pair_wins(spark):
    e = pairs(spark, [("a", "b", "r", "a", False, 0.1)])
    d = pairs(spark, [("a", "b", "r", "b", False, 5.0), ("a", "c", "r", "c", False, 5.0)])
    got = {(x.left_image_id, x.right_image_id): x.winner for x in merge_pairs(e, d).collect()}
    assert got == {("a", "b"): "a", ("a", "c"): "c"}


def test_validate(spark):
    valid, rejected = validate(ratings(spark, [("a", "r", 0.0), ("a", "r", 11), ("a", "r", None), (None, "r", 5), ("b", "", float("nan"))]), rating_rules())
    assert [x.raw_score_1_to_10 for x in valid.collect()] == [0.0]
    assert sorted(tuple(x.reasons) for x in rejected.collect()) == [("image_id",), ("rater_id", "score_missing"), ("score_missing",), ("score_range",)]


def test_schemas(spark):
    df = spark.createDataFrame([("1", "x")], "b string, extra string")
    with pytest.raises(ValueError, match="image_id, rater_id"):
        require_columns(df, ["image_id", "rater_id", "b"], "ratings")
    assert conform(df, RATINGS).schema.fieldNames() == RATINGS.fieldNames()
    assert empty_table(spark, RATINGS).isEmpty()
    with pytest.raises(ValueError, match="Rate some"):
        require_non_empty(empty_table(spark, RATINGS), "ratings", "Rate some items first.")


def test_exclude_then_restore(spark):
    log = spark.createDataFrame([("a", "True", "blur", "1"), ("b", " YES ", "dup", "1"), ("a", "False", "ok", "2"), ("c", None, "x", "1")], "image_id string, excluded string, reason string, timestamp string")
    assert [x.image_id for x in active_exclusions(log).collect()] == ["b"]
    assert {x.image_id for x in drop_excluded(log.select("image_id").distinct(), log).collect()} == {"a", "c"}


def test_names(spark):
    df = spark.createDataFrame([("trip one/IMG_0001_x.jpg", "File:A b%20c?.JPG", "--é ü!__"), ("IMG_0001_x.jpg", "", "___")], "p string, t string, n string")
    from pyspark.sql import functions as F

    got = df.select(infer_session(F.col("p")).alias("a"), infer_session(F.col("p"), "stem").alias("b"), safe_filename(F.col("t")).alias("c"), safe_name(F.col("n")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("trip one", "IMG_0001", "A_b_c.jpg", "--é_ü"), ("IMG_0001", "IMG_0001", "image.jpg", "image")]
