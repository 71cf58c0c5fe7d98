"""Files in and out, images, and what is made of them."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.operators import pixels
from lumenrank.operators.concepts import explanation_text, with_concepts
from lumenrank.operators.curation import select_collection
from lumenrank.operators.manifest import build_manifest
from lumenrank.plans.jobs import extract_features
from lumenrank.schemas import PAIRWISE, RATINGS
from lumenrank.sources import tables
from lumenrank.sources.images import scan_files, scan_images


def png(path, image):
    h, w, _ = image.shape
    raw = b"".join(b"\0" + row.tobytes() for row in image.astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def sky():
    image = np.zeros((64, 80, 3), dtype=np.uint8)
    image[:] = (90, 170, 235)
    image[12:36, 16:56] = 245
    image[52:] = (40, 90, 35)
    return image


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", 2)], "image_id string, phash string, width int")
    path = str(tmp_path / "t")
    assert tables.read_table(spark, path, RATINGS).isEmpty()
    tables.write_table(df, path)
    again = spark.read.parquet(path)
    tables.write_table(again.withColumn("width", F.col("width") + 1), path)  # reads what it replaces
    assert spark.read.parquet(path).first().width == 3
    csv = str(tmp_path / "t.csv")
    tables.write_table(df, csv)
    assert tables.read_table(spark, csv, df.schema).first().width == 2


def test_annotation_logs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("rater_id,image_id,raw_score_1_to_10\nann,x,7\n")
    (tmp_path / "b.csv").write_text("image_id,rater_id,raw_score_1_to_10,extra\ny,bob,oops,1\n")
    tables.append_ratings(spark.createDataFrame([("z", "cay", 3.5)], "image_id string, rater_id string, raw_score_1_to_10 double"), str(tmp_path / "p"))
    got = {(r.image_id, r.rater_id): r for r in tables.read_annotations(spark, str(tmp_path), RATINGS).collect()}
    assert set(got) == {("x", "ann"), ("y", "bob"), ("z", "cay")}
    assert got["y", "bob"].raw_score_1_to_10 is None and got["z", "cay"].rating_id
    assert tables.read_annotations(spark, str(tmp_path / "none"), RATINGS).isEmpty()
    tables.append_pairwise(spark.createDataFrame([("a", "b", "r", "a", False)], "left_image_id string, right_image_id string, rater_id string, winner string, tie_flag boolean"), str(tmp_path / "q"))
    assert tables.read_annotations(spark, str(tmp_path / "q"), PAIRWISE).first().winner == "a"


def test_exclusion_layouts(spark, tmp_path):
    old, new = tmp_path / "old.csv", tmp_path / "e.csv"
    old.write_text("image_id,excluded,reason,timestamp\na,True,blur | p/a.jpg,2024\nz,p/z.jpg,True,dark,2025\nx,y\n")
    new.write_text('image_id,relative_path,excluded,reason,timestamp\na,True,blur | p/a.jpg,2024\nb,p/b.jpg,False,ok,Mon, 1 Jan\n\nc,p/c.jpg,True,"too dark, ""blurry""",2026\nd,,True,,\n')
    told = lambda path: [tuple(r) for r in tables.read_exclusions(spark, str(path)).orderBy("image_id").collect()]
    assert told(old) == [("a", "p/a.jpg", "True", "blur", "2024"), ("z", "p/z.jpg", "True", "dark", "2025")]
    # four fields are the older layout under its header only
    assert told(new) == [("b", "p/b.jpg", "False", "ok", "Mon, 1 Jan"), ("c", "p/c.jpg", "True", 'too dark, "blurry"', "2026"), ("d", "", "True", "", "")]
    log = str(tmp_path / "quoted")
    rows = [("e", "p,1", True, 'commas, and "quotes"', "2026"), ("f", None, False, None, "2027")]
    tables.append_exclusions(spark.createDataFrame(rows, "image_id string, relative_path string, excluded boolean, reason string, timestamp string"), log)
    assert told(log) == [("e", "p,1", "True", 'commas, and "quotes"', "2026"), ("f", "", "False", "", "2027")]
    folder = str(tmp_path / "log")
    tables.append_exclusions(spark.createDataFrame([("c", None, True, "dup")], "image_id string, relative_path string, excluded boolean, reason string"), folder)
    assert tables.read_exclusions(spark, folder).first().excluded == "True"
    assert tables.read_exclusions(spark, str(tmp_path / "none")).isEmpty()


def test_bundles(spark, tmp_path):
    data = base64.b64encode(b"bytes jpg").decode()
    bundle = {"rater_id": "", "session_id": "s1", "ratings": [{"image_id": "a", "score": 7, "note": "n"}], "pairwise": [{"left_image_id": "a", "right_image_id": "b", "winner": "a"}], "imported_images": [{"image_id": "a", "data_url": f"data:image/png;base64,{data}"}, {"image_id": "b", "data_url": "none"}]}
    (tmp_path / "b.json").write_text(json.dumps(bundle, indent=1))
    ratings, pairs, images = tables.read_label_bundles(spark, str(tmp_path))
    r, p, i = ratings.collect(), pairs.collect(), images.collect()
    assert len(r) == len(p) == len(i) == 1
    assert r[0].rater_id == "friend" and r[0].rating_session_id == "s1" and p[0].preference_strength == 0.5 and p[0].tie_flag is False
    assert bytes(i[0].content) == b"bytes jpg" and i[0].suffix == ".png"


def test_export_and_runs(spark, tmp_path):
    m = spark.createDataFrame([("abc123", "p.jpg", None, 12)], "image_id string, relative_path string, width int, height int")
    doc = json.loads(tables.export_manifest(m, "pack").first().document)
    assert doc["items"][0] == {"image_id": "abc123", "relative_path": "p.jpg", "width": 0, "height": 12}
    for name in ("run_1", "run_2"):
        tables.write_run(spark.createDataFrame([(0.5,)], "mae double"), str(tmp_path), name)
    assert [r.run_id for r in tables.read_runs(spark, str(tmp_path)).collect()] == ["run_2", "run_1"]
    assert tables.read_runs(spark, str(tmp_path / "none")).isEmpty()


def test_images(spark, tmp_path, sky):
    png(tmp_path / "one.png", sky)
    png(tmp_path / "two.PNG", sky)
    png(tmp_path / "other.png", sky[:, ::-1] // 2)
    (tmp_path / "bad.png").write_bytes(b"not an image")
    (tmp_path / "note.txt").write_text("x")
    assert scan_files(spark, str(tmp_path)).count() == 4
    scan = scan_images(spark, str(tmp_path)).filter("relative_path <> 'two.PNG'")
    assert {(r.width, r.height) for r in scan.collect()} == {(80, 64)}
    features = extract_features(scan.select("image_id", "image"))
    row = features.collect()
    assert len(row) == 2 and {"mean_brightness", "entropy", "horizon_confidence", "concept_storm_like"} <= set(features.columns)
    again = extract_features(scan.select("image_id", "image"), features)
    assert again.count() == 2
    px = pixels.pixels(scan.filter("relative_path = 'one.png'").select("image_id", "image"))
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in px.collect()}
    assert got[0, 0] == (90, 170, 235) and got[20, 20] == (245, 245, 245) and len(got) == 64 * 80
    masks = pixels.sky_cloud_masks(px).persist()
    crops = pixels.crop_candidates(masks, min_size=24).collect()
    assert 1 <= len(crops) <= 8
    grid = {(r.y, r.x): (r.sky, r.cloud) for r in masks.collect()}
    for c in crops:
        cells = [grid[y, x] for y in range(c.y, c.y + c.size) for x in range(c.x, c.x + c.size)]
        assert c.sky_fraction == pytest.approx(sum(a for a, _ in cells) / len(cells)) and c.cloud_fraction == pytest.approx(sum(b for _, b in cells) / len(cells))
    assert len(pixels.phash(px).first().phash) == 64
    assert pixels.region_table(pixels.cloud_mask(px), "r").count() == 6


def test_manifest_of_copies(spark):
    scan = spark.createDataFrame([("i1", "b.jpg", "h", "0101"), ("i1", "a.jpg", "h", "0101"), ("i2", "s/c.jpg", "k", "1111")], "image_id string, relative_path string, sha256 string, phash string")
    assert {r.relative_path for r in build_manifest(scan).collect()} == {"a.jpg", "s/c.jpg"}
    derivatives = spark.createDataFrame([("a.jpg", "b1", "src", 1), ("a.jpg", "b2", "src2", 2)], "relative_path string, import_batch_id string, source_image_id string, generation int")
    got = {r.relative_path: r for r in build_manifest(scan, derivatives).collect()}
    assert len(got) == 3 and got["a.jpg"].split_group_id == "src2" and got["a.jpg"].import_batch_id == "b2" and got["s/c.jpg"].split_group_id == "s_1111"


def test_collection_against_loop(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice("abcdefgh"), rng.choice(["u1", "u2", "u3", "u4", "u5", None])) for i in range(60)]
    got = [r.position for r in select_collection(spark.createDataFrame(rows, "position int, item string, url string"), "item", "url", ["position"]).orderBy("position").collect()]
    items, urls, want = set(), set(), []
    for i, a, b in rows:
        if a not in items and (b is None or b not in urls):
            want.append(i)
            items.add(a)
            urls.add(b)
    assert got == want


def test_texts(spark):
    df = spark.createDataFrame([(7.0, 0.5, ["mean_brightness"], ["concept_storm_like"]), (1.0, 0.0, [], None)], "s double, u double, f array<string>, c array<string>")
    got = [r[0] for r in df.select(explanation_text(F.col("s"), F.col("u"), F.col("f"), F.col("c"))).collect()]
    assert got[0].startswith("Predicted score 7.00 +/- 0.50") and "mean brightness" in got[0] and "storm like" in got[0]
    assert "mixed visual evidence" in got[1] and "no strong concept signals" in got[1]
    one = with_concepts(spark.createDataFrame([("a",)], "image_id string")).first()
    assert one.concept_layered_depth == 0.5 and one.concept_dramatic_mood == pytest.approx(0.5)


def test_phash_against_a_plain_reduction(spark):
    """Bits of the low frequencies of a 32 x 32 reduction: larger sides are averaged by cell, smaller ones repeated."""
    rng = np.random.default_rng(4)
    cos = np.array([[np.sqrt((1 if u == 0 else 2) / 32) * np.cos(np.pi * (2 * k + 1) * u / 64) for k in range(32)] for u in range(8)])
    rows, want = [], {}
    for i, (h, w) in enumerate(((8, 8), (40, 50), (32, 20), (64, 7))):
        image = rng.integers(0, 256, (h, w)).astype(float)
        rows += [(str(i), y, x, float(image[y, x])) for y in range(h) for x in range(w)]
        small = image
        for axis, n in ((0, h), (1, w)):
            cells = np.arange(n) * 32 // n if n >= 32 else None
            take = lambda k: np.flatnonzero(cells == k) if cells is not None else [k * n // 32]  # noqa: E731, B023
            small = np.stack([np.take(small, take(k), axis=axis).mean(axis=axis) for k in range(32)], axis=axis)
        low = (cos @ small @ cos.T).round(9)
        middle = np.median(low[1:].ravel())
        want[str(i)] = "".join("1" if c > middle else "0" for c in low.ravel())
    px = spark.createDataFrame(rows, "image_id string, y int, x int, gray double")
    assert {r.image_id: r.phash for r in pixels.phash(px).collect()} == want


def test_phash_of_equal_middle_frequencies(spark):
    """Frequencies (2, 6) and (6, 2) are equal and the two middle ones, 6e-14 from a boundary of the ninth place: neither is above the median."""
    long = np.longdouble
    cos = np.array([[np.sqrt(long(1 if u == 0 else 2) / 32) * np.cos(4 * np.arctan(long(1)) * (2 * k + 1) * u / 64) for k in range(32)] for u in range(8)])
    rasters = (
        "4d9f6b739d6e5994706b93647066715e65598d844b6a836d8c7676767e3e668a858f66a06a86708751728c7a606e736997689f7c7e61695c709a7555975e658c",
        "7979829b8b9e97b07276863f8950824a617785529797927655b971969c745e83535b6951899a9aa87c93427d67ac54666970b77d626cad7c909d766f2c759068",
    )
    rows, want = [], {}
    for i, raster in enumerate(rasters):
        image = np.frombuffer(bytes.fromhex(raster), dtype=np.uint8).reshape(8, 8)
        rows += [(str(i), y, x, float(image[y, x])) for y in range(8) for x in range(8)]
        low = cos @ np.kron(image, np.ones((4, 4), dtype=long)) @ cos.T
        assert abs(low[2, 6] - low[6, 2]) < 1e-15
        middle = np.sort(low[1:].ravel())[27:29].mean()
        want[str(i)] = "".join("1" if c - middle > 1e-12 else "0" for c in low.ravel())
        assert want[str(i)][22] == want[str(i)][50] == "0" and want[str(i)][8:].count("1") == 27
    for order in (rows, rows[::-1], [r for _, r in sorted((r[2], r) for r in rows)]):
        px = spark.createDataFrame(order, "image_id string, y int, x int, gray double")
        assert {r.image_id: r.phash for r in pixels.phash(px).collect()} == want


def test_quantiles_and_safe_swap(spark, tmp_path):
    from lumenrank.functions.ranks import quantiles

    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 50, 501).astype(float), rng.normal(size=501)
    df = spark.createDataFrame([(float(x), None if i % 5 == 0 else float(y), None) for i, (x, y) in enumerate(zip(a, b))], "a double, b double, c double").repartition(5)
    got = quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 0.93, 1.0])
    assert got["c"] == [None] * 5
    assert np.allclose(got["a"], np.quantile(a, [0.0, 0.25, 0.5, 0.93, 1.0]))
    assert np.allclose(got["b"], np.quantile(np.delete(b, range(0, 501, 5)), [0.0, 0.25, 0.5, 0.93, 1.0]))
    path = str(tmp_path / "t")
    tables.write_table(df, path)
    tables.write_table(spark.read.parquet(path).select("a"), path)
    assert spark.read.parquet(path).columns == ["a"] and [p.name for p in tmp_path.iterdir()] == ["t"]
