"""Committed tables, compacted logs, streams with state, drawn pairs, chains of blockers and near hashes."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.functions.shuffles import bijection
from lumenrank.operators import curation, models
from lumenrank.operators.labels import pseudo_pairs, win_rate
from lumenrank.operators.near_hashes import near_pairs
from lumenrank.plans import jobs, stages
from lumenrank.schemas import PAIRWISE, RATINGS
from lumenrank.sources import images, tables
from lumenrank.streaming import images as image_streams
from lumenrank.streaming import preferences

# --- tables

ODD_TEXTS = ['a "quoted", b', "two\nlines", "\r\n windows, too", " spaces around ", "back\\slash \\\" both", "é 漢字 \U0001f600", None, "plain", '"', "'", "\t"]


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    rows = [(i, t, f"x{i}") for i, t in enumerate(ODD_TEXTS)]
    df = spark.createDataFrame(rows, "n int, text string, after string")
    tables.write_table(df, path)
    back = tables.read_table(spark, path, df.schema)
    assert sorted(map(tuple, back.collect())) == rows
    tables.write_table(back.filter("n > 2"), path)
    assert sorted(map(tuple, tables.read_table(spark, path, df.schema).collect())) == rows[3:]


@pytest.mark.parametrize("ending", ["", ".csv"])
def test_a_write_that_breaks_off_leaves_a_whole_table(spark, tmp_path, monkeypatch, ending):
    """Wherever a replacement stops, readers find the old or the new rows, and the next write works."""
    schema, rename = "a int", tables._rename
    made = lambda a, b: spark.range(a, b).select(F.col("id").cast("int").alias("a"))
    told = lambda path: sorted(r.a for r in tables.read_table(spark, path, made(0, 0).schema).collect())  # noqa: E731, ARG005
    for stop in range(4):
        path = str(tmp_path / f"t{stop}{ending}")
        tables.write_table(made(0, 3), path)
        calls = Counter()

        def failing(*given, calls=calls, stop=stop):
            if calls["n"] == stop:
                raise OSError("broke off")
            calls["n"] += 1
            rename(*given)

        monkeypatch.setattr(tables, "_rename", failing)
        if stop < 3:
            with pytest.raises(OSError, match="broke off"):
                tables.write_table(made(3, 8), path)
        else:  # after the last rename
            delete = spark._jvm.org.apache.hadoop.fs.FileSystem
            assert delete is not None
            tables.write_table(made(3, 8), path)
        monkeypatch.setattr(tables, "_rename", rename)
        assert told(path) == ([0, 1, 2] if stop < 2 else [3, 4, 5, 6, 7]), stop
        tables.write_table(made(9, 10), path)
        assert told(path) == [9]
        assert [p.name for p in tmp_path.iterdir() if p.name.startswith(f"t{stop}") and not p.name.endswith(".crc")] == [f"t{stop}{ending}"]


# --- logs


def ratings_of(spark, n, first=0, raters=300):
    k = F.col("id")
    return spark.range(first, first + n).select(k.cast("string").alias("rating_id"), F.concat(F.lit("i"), k % 7).alias("image_id"), F.concat(F.lit("r"), k % raters).alias("rater_id"), (k % 10).cast("double").alias("raw_score_1_to_10"))


def files_of(folder):
    return [p for p in folder.rglob("*.parquet") if not p.name.startswith(".")]


def test_compacted_log(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    told = lambda: sorted(int(r.rating_id) for r in tables.read_annotations(spark, str(log), RATINGS).collect())
    for k in range(3):
        tables.append_ratings(ratings_of(spark, 500, 500 * k), str(log), buckets=4)
    assert len(files_of(log)) <= 3 * 4 and told() == list(range(1500))
    before = len(files_of(log))
    # a compaction that breaks off before its record counts for nothing
    monkeypatch.setattr(tables, "_rename", lambda *_: (_ for _ in ()).throw(OSError("broke off")))
    with pytest.raises(OSError, match="broke off"):
        tables.compact_log(spark, str(log), RATINGS, buckets=4)
    monkeypatch.undo()
    assert told() == list(range(1500))
    assert tables.compact_log(spark, str(log), RATINGS, buckets=4) == before
    assert len(files_of(log)) <= 4 and told() == list(range(1500))
    tables.append_ratings(ratings_of(spark, 100, 1500), str(log), buckets=4)
    assert told() == list(range(1600))
    tables.compact_log(spark, str(log), RATINGS, buckets=4)
    assert len(files_of(log)) <= 4 and told() == list(range(1600))
    assert tables.compact_log(spark, str(tmp_path / "log"), RATINGS, buckets=4) == len(files_of(log))
    # old files that are still there after the record do not count twice
    kept = {p: p.read_bytes() for p in files_of(log)}
    tables.compact_log(spark, str(log), RATINGS, buckets=4)
    for p, content in kept.items():
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    assert told() == list(range(1600))


# --- streams


def pairs_of(spark, n, first=0):
    rng = random.Random(first)
    rows = []
    for k in range(first, first + n):
        a, b = rng.sample("abcdefgh", 2)
        tie = rng.choice([True, False, False, None])
        rows.append((str(k), a, b, "r", rng.choice([a, b, None]), tie, 0.5))
    return spark.createDataFrame(rows, "pair_id string, left_image_id string, right_image_id string, rater_id string, winner string, tie_flag boolean, preference_strength double")


def test_preference_stream(spark, tmp_path):
    """Win rates of a stream that stops and goes on equal win_rate; preferences that come twice count once."""
    log, held = str(tmp_path / "log"), {}

    def keep(batch, number):
        held.update({r.image_id: (r.wins, r.ties, r.n_pairs, r.pairwise_win_rate) for r in batch.collect()})

    first, second = pairs_of(spark, 60), pairs_of(spark, 50, 60)
    for rows in (first, first.limit(40).unionByName(second)):
        tables.append_pairwise(rows, log, buckets=2)
        preferences.keep_win_rates(preferences.preference_stream(spark, log), keep, str(tmp_path / "checkpoint")).awaitTermination()
    whole = first.unionByName(second)
    want = {r.image_id: r.pairwise_win_rate for r in win_rate(whole).collect()}
    assert {k: v[3] for k, v in held.items()} == pytest.approx(want)
    assert sum(v[2] for v in held.values()) == 2 * 110
    assert spark.conf.get(preferences._PROVIDER) != preferences._ROCKS


@pytest.fixture(scope="module")
def pictures(spark, tmp_path_factory):
    """Twelve bitmap files of 8 x 8, two of them alike, and a file that is none."""
    folder = tmp_path_factory.mktemp("pictures")
    rng = np.random.default_rng(3)
    rasters = [rng.integers(0, 256, (8, 8, 3)) for _ in range(11)]
    rows = [(f"p{k:02d}.bmp", "".join(f"{c:02X}" for c in r.ravel())) for k, r in enumerate([*rasters, rasters[0]])]
    made = spark.createDataFrame(rows, "name string, hex string")
    assert images.write_files(made.select("name", images.bitmap(F.lit(8), F.lit(8), F.col("hex")).alias("content")), str(folder)) == 12
    (folder / "note.txt").write_text("no image")
    (folder / "bad.png").write_bytes(b"no image either")
    return folder, rasters


def test_bitmaps_are_images(spark, pictures):
    folder, rasters = pictures
    got = {r.relative_path: r for r in images.scan_images(spark, str(folder)).collect()}
    assert len(got) == 12 and {(r.width, r.height) for r in got.values()} == {(8, 8)}
    for k, raster in enumerate(rasters):
        # rows are stored from the lowest up
        assert np.array_equal(np.frombuffer(bytes(got[f"p{k:02d}.bmp"].image.data), np.uint8).reshape(8, 8, 3), raster[::-1])


def test_image_stream(spark, pictures, tmp_path):
    """A stream of image files leaves what the batch job makes; a batch that comes again changes nothing."""
    folder, _ = pictures
    found = images.scan_images(spark, str(folder)).dropDuplicates(["image_id"]).persist()
    features = jobs.extract_features(found.select("image_id", "image"), None, ("color",)).persist()
    known = features.select("image_id", (F.col("mean_brightness") / 25).alias("mean_score"))
    columns = ["mean_brightness", "contrast", "saturation_mean"]
    fitted = models.fit_regressor("elasticnet", features.join(known, "image_id"), columns, "mean_score")
    feature_table, prediction_table = str(tmp_path / "features"), str(tmp_path / "predictions")
    image_streams.score_images(spark, str(folder), "run", fitted, feature_table, prediction_table, str(tmp_path / "checkpoint"), files_a_batch=5, extractors=("color",)).awaitTermination()
    read = lambda: sorted([tuple(r) for r in tables.read_table(spark, prediction_table, image_streams.STREAM_PREDICTIONS).collect()], key=repr)
    first = read()
    got = tables.read_table(spark, prediction_table, image_streams.STREAM_PREDICTIONS)
    assert got.select("batch_id").distinct().count() == 3
    want = {r.image_id: r.p for r in fitted.predict(features).collect()}
    assert {r.image_id: r.predicted_score for r in got.collect()} == pytest.approx(want)
    assert {tuple(r) for r in tables.read_table(spark, feature_table, features.schema).select("image_id", "mean_brightness").collect()} == {tuple(r) for r in features.select("image_id", "mean_brightness").collect()}
    # again, once whole and once after the features alone were written
    names = [r[0] for r in got.filter("batch_id = 'stream-000001'").select("relative_path").collect()]
    again = images.scan_images(spark, str(folder)).filter(F.col("relative_path").isin(names))
    image_streams.analyze_images(again, "stream-000001", "run", fitted, feature_table, prediction_table, extractors=("color",))
    assert read() == first
    tables.write_table(got.filter("batch_id <> 'stream-000001'"), prediction_table)
    image_streams.analyze_images(again, "stream-000001", "run", fitted, feature_table, prediction_table, extractors=("color",))
    at = image_streams.STREAM_PREDICTIONS.fieldNames().index
    plain = lambda rows: sorted((r[at("batch_id")], r[at("image_id")], round(r[at("predicted_score")], 9), r[at("kind")]) for r in rows)
    assert plain(read()) == plain(first)


def test_stream_adds_to_tables(spark, pictures, tmp_path):
    """A later batch leaves the files of earlier ones as they are, and adds features with other columns, too."""
    folder, _ = pictures
    found = images.scan_images(spark, str(folder)).persist()
    features, predictions = str(tmp_path / "features"), str(tmp_path / "predictions")
    files = lambda path: {x.name for x in Path(path).glob("*.parquet")}
    image_streams.analyze_images(found.filter("relative_path < 'p05'"), "one", "run", None, features, predictions, extractors=("color",))
    before = files(features), files(predictions)
    image_streams.analyze_images(found, "two", "run", None, features, predictions, extractors=("color",))
    assert all(old and old < files(path) for old, path in zip(before, (features, predictions), strict=True))
    assert spark.read.parquet(features).count() == 11 and spark.read.parquet(predictions).groupBy("batch_id").count().count() == 2
    tables.append_table(spark.range(1).select(F.lit("x").alias("image_id"), F.lit(1.0).alias("other")), features)
    assert spark.read.parquet(features).filter("other IS NULL AND mean_brightness IS NOT NULL").count() == 11


# --- shuffles, pairs, chains, hashes


def test_keyed_bijection():
    for n in (1, 2, 3, 10, 97, 1000, 4097):
        places = [bijection(np.arange(n), np.full(n, n), key) for key in range(3)]
        for p in places:
            assert sorted(p.tolist()) == list(range(n))
        if n > 90:
            assert (places[0] != places[1]).mean() > 0.9 and (places[0] != np.arange(n)).mean() > 0.9
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 50, 400)
    numbers = (rng.random(400) * sizes).astype(int)
    alone = [bijection(np.array([k]), np.array([n]), 5)[0] for k, n in zip(numbers, sizes, strict=True)]
    assert bijection(numbers, sizes, 5).tolist() == alone
    # neighbours part: a shuffle, not a shift
    assert abs(np.corrcoef(np.arange(5000), bijection(np.arange(5000), np.full(5000, 5000), 1))[0, 1]) < 0.06


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_drawn_pairs(spark, most):
    """As many as asked for or as there are, each once, all among the pairs that are made without a limit."""
    rng = random.Random(4)
    rows = [(str(k), f"i{k}", rng.choice("abc") if k < 90 else "d", float(rng.randint(1, 10)), k % 5) for k in range(120)] + [("x", "x", None, 1.0, 0), ("y", "y", "a", None, 0), ("z", "z", "lone", 3.0, 0)]
    df = spark.createDataFrame(rows, "rating_id string, image_id string, rater_id string, raw_score_1_to_10 double, t int").withColumn("rating_timestamp", F.timestamp_seconds("t")).drop("t")
    every = {tuple(r) for r in pseudo_pairs(df, 2.0).collect()}
    got = [tuple(r) for r in pseudo_pairs(df, 2.0, most).collect()]
    assert len(set(got)) == len(got) and set(got) <= every
    count = lambda pairs: Counter(r[3] for r in pairs)
    assert count(got) == {k: min(n, most) for k, n in count(every).items()}


def test_parts_of_a_prolific_rater(spark, monkeypatch):
    from lumenrank.operators import labels

    df = ratings_of(spark, 60, raters=1).withColumn("rating_timestamp", F.lit(None).cast("timestamp"))
    whole = {tuple(r) for r in pseudo_pairs(df).collect()}
    monkeypatch.setattr(labels, "PART_RATINGS", 7)
    assert {tuple(r) for r in pseudo_pairs(df).collect()} == whole and len(whole) > 1000


def greedy(rows):
    a_seen, b_seen, kept = set(), set(), []
    for n, a, b in sorted(rows):
        if (a is None or a not in a_seen) and (b is None or b not in b_seen):
            kept.append(n)
            a_seen |= {a} - {None}
            b_seen |= {b} - {None}
    return kept


def seen(spark, rows):
    kept, rounds = curation.first_seen(stages.cut(spark.createDataFrame(rows, "n long, a string, b string")))
    return sorted(r.n for r in kept.collect()), rounds


def test_chain_of_blocking_rows(spark):
    """Each of 10,000 rows shares a key with the next: every second one stays, in few rounds."""
    rows = [(k, f"a{(k + 1) // 2}", f"b{k // 2}") for k in range(10_000)]
    got, rounds = seen(spark, rows)
    assert got == greedy(rows) == list(range(0, 10_000, 2)) and rounds <= 40


@pytest.mark.parametrize("keys", [3, 12, 40])
def test_first_seen_against_loop(spark, keys):
    rng = random.Random(keys)
    pick = lambda: None if rng.random() < 0.1 else f"k{rng.randrange(keys)}"
    rows = [(k, pick(), pick()) for k in range(80)] + [(100 + k, "hot", f"h{k}") for k in range(30)]
    assert seen(spark, rows)[0] == greedy(rows)


def test_near_hashes(spark, monkeypatch):
    """All pairs within the distance, also where many share a band."""
    from lumenrank.operators import near_hashes

    rng = random.Random(9)
    flip = lambda bits, n: "".join(c if k not in chosen else "10"[int(c)] for chosen in [set(rng.sample(range(64), n))] for k, c in enumerate(bits))
    centres = ["".join(rng.choice("01") for _ in range(64)) for _ in range(6)]
    values = [flip(c, rng.randint(0, 6)) for c in centres for _ in range(15)] + ["0" * 64, "1" * 64, "0" * 63 + "1"]
    df = spark.createDataFrame([(v,) for v in [*values, *values[:9]]] + [(None,), ("01",), ("2" * 64,)], "phash string")
    for hot in (500, 3):
        monkeypatch.setattr(near_hashes, "HOT_BAND", hot)
        for d in (0, 1, 4, 9):
            far = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True))
            want = {(x, y, far(x, y)) for x in set(values) for y in set(values) if x < y and far(x, y) <= d}
            got = [tuple(r) for r in near_pairs(df, d).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError, match="distance"):
        near_pairs(df, 40)


def test_permutation_orders_rows_once(spark, monkeypatch):
    calls = Counter()
    number = models.global_row_number
    monkeypatch.setattr(models, "global_row_number", lambda *a, **k: (calls.update(["n"]), number(*a, **k))[1])
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(f"i{k}", float(a), float(b), float(3 * a)) for k, (a, b) in enumerate(rng.normal(size=(80, 2)))], "image_id string, f_a double, f_b double, y double")
    fitted = models.fit_regressor("elasticnet", df, ["f_a", "f_b"], "y")
    got = {r.feature: (r.importance_mean, r.importance_std) for r in models.permutation_importance(fitted, df, "y", 8).collect()}
    assert calls["n"] == 1 and got["f_a"][0] > 1 and abs(got["f_b"][0]) < 0.05 and got["f_a"][1] > 0
