"""Steps whose memory, shuffles or time grew too fast: same results, with less of it."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenrank.functions import ranks, shuffles
from lumenrank.operators import analysis, labels, models, near_hashes, pixels


def test_likely_cells_hold_the_largest():
    """Few cells are looked at, all of the k largest among them, with ties and less columns than k."""
    rng = np.random.default_rng(3)
    for width, k in ((4000, 5), (513, 40), (3, 5), (600, 1)):
        near = rng.normal(size=(20, width)).round(3)
        near[0] = 0.5
        near[1, ::2] = -np.inf
        row, col = analysis._likely(near, k, 1e-12)
        for r in range(20):
            least = np.sort(near[r])[-min(k, width)]
            assert set(np.flatnonzero((near[r] >= least) & (near[r] > -np.inf))) <= set(col[row == r])
        assert (row > 1).sum() <= 18 * (k + 150)


def test_queries_go_once_to_a_pack_of_cells(spark, monkeypatch):
    """On vectors without clusters every query meets nearly every cell; it is sent once for several cells, with the same results."""
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.normal(size=(300, 40)))], "image_id long, vector array<double>")
    made = []
    monkeypatch.setattr(analysis, "cut", lambda df, name="stage", cut=analysis.cut: (made.append(name), cut(df, name))[1])
    monkeypatch.setattr(analysis, "BLOCK_ROWS", 100)
    found, met = analysis.nearest_pruned(v, v, 4, pivots=20)
    told = lambda df: sorted((r.query, r.image_id, round(r.similarity, 9), r["rank"]) for r in df.collect())
    assert told(found) == told(analysis.nearest_all(v, v, 4)) and met.first().compared > 0.5 * met.first().pairs
    assert "sent" not in made
    monkeypatch.setattr(analysis, "ALL_PAIRS", 0)
    assert told(analysis.nearest_exact(v, v, 4)) == told(found)


def _line(spark):
    rows = [(f"i{k}", float(a), float(b), float(3 * a)) for k, (a, b) in enumerate(np.random.default_rng(1).normal(size=(60, 2)))]
    df = spark.createDataFrame(rows, "image_id string, f_a double, f_b double, y double")
    return df, models.fit_regressor("elasticnet", df, ["f_a", "f_b"], "y")


def test_repeats_share_one_python_process(spark, monkeypatch):
    """The partners of all repeats come from one use of the bijection, and are those of each repeat's own key."""
    df, fitted = _line(spark)
    uses = []
    monkeypatch.setattr(models, "shuffled", lambda *a, shuffled=models.shuffled: (uses.append(a), shuffled(*a))[1])
    assert models.permutation_importance(fitted, df, "y", 4).count() == 2 and len(uses) == 1
    got = spark.range(30).withColumn("k", F.explode(F.array(*[F.lit(x).cast("long") for x in (4, 9)]))).select("id", "k", shuffles.shuffled(F.col("id"), 30, F.col("k")).alias("at")).collect()
    for k in (4, 9):
        assert [r["at"] for r in sorted(got) if r["k"] == k] == shuffles.bijection(np.arange(30), 30, k).tolist()


def test_contributions_need_no_join(spark, capsys):
    df, fitted = _line(spark)
    models.local_contributions(fitted, df.drop("y"), df.drop("y")).explain()
    assert "Join" not in capsys.readouterr().out


def test_merged_pairs_without_a_shuffle_of_pairs(spark, monkeypatch, capsys):
    """As merge_pairs of all implied preferences, with repeated keys, shared raters, nulls and raters in parts."""
    rng = np.random.default_rng(6)
    pick = lambda n, p: None if rng.random() < p else f"k{rng.integers(n)}"
    rows = [(f"r{k}", pick(4, 0.1), pick(5, 0.1), float(rng.integers(1, 9)), int(rng.integers(6))) for k in range(150)]
    df = spark.createDataFrame(rows, "rating_id string, image_id string, rater_id string, raw_score_1_to_10 double, t int").withColumn("rating_timestamp", F.timestamp_seconds("t")).drop("t")
    every = labels.pseudo_pairs(df)
    explicit = every.filter("rater_id IN ('k0', 'k1')").dropDuplicates(labels.PAIR_KEYS).limit(40).select(F.concat(F.lit("e"), "pair_id").alias("pair_id"), *labels.PAIR_KEYS, "winner")
    explicit = spark.createDataFrame(explicit.collect(), explicit.schema)
    told = lambda pairs: sorted((tuple(r) for r in pairs.select("pair_id", *labels.PAIR_KEYS, "winner", "source").collect()), key=repr)
    want = told(labels.merge_pairs(explicit, every))
    assert len(want) < every.count()
    for part, most in ((2_000, 500_000), (7, 100)):
        monkeypatch.setattr(labels, "PART_RATINGS", part)
        monkeypatch.setattr(labels, "TASK_PAIRS", most)
        assert told(labels.merged_pairs(explicit, df)) == want
    labels._distinct_pairs(df, 2.0).explain()
    plan = capsys.readouterr().out
    assert plan.index("Exchange") > plan.index("SortMergeJoin")


def test_near_hashes_in_blocks(spark, monkeypatch):
    """Hashes of hot bands, or all of them, are compared in blocks."""
    rng = np.random.default_rng(8)
    values = [int(x) for x in rng.integers(0, 2**62, 150)] + [int(x) for x in rng.integers(0, 2**9, 60)]
    df = spark.createDataFrame([(f"{x:064b}",) for x in values], "phash string")
    want = {(f"{x:064b}", f"{y:064b}", (x ^ y).bit_count()) for x in set(values) for y in set(values) if x < y and (x ^ y).bit_count() <= 6}
    monkeypatch.setattr(near_hashes, "BLOCK_HASHES", 13)
    for hot in (20, 1):  # some bands in blocks; all pairs in blocks
        monkeypatch.setattr(near_hashes, "HOT_BAND", hot)
        got = near_hashes.near_pairs(df, 6)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_smoothing_sorts_rows_four_times(spark):
    """Opening and closing give what eight windows in turn give; the two dilations between them are one."""
    rng = np.random.default_rng(2)
    rasters = [(rng.random((h, w)) < 0.6).astype(int) for h, w in ((7, 9), (1, 5), (12, 3), (20, 20))]
    px = spark.createDataFrame([(str(k), y, x, int(v)) for k, a in enumerate(rasters) for (y, x), v in np.ndenumerate(a)], "image_id string, y int, x int, m int")
    got = pixels.smooth(px, "m")
    want = {}
    for k, a in enumerate(rasters):
        for f in (np.min, np.max, np.max, np.min):
            a = np.array([[f(a[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3]) for x in range(a.shape[1])] for y in range(a.shape[0])])
        want |= {(str(k), y, x): int(v) for (y, x), v in np.ndenumerate(a)}
    assert {(r.image_id, r.y, r.x): r.m for r in got.collect()} == want
    assert got._jdf.queryExecution().sparkPlan().toString().count("Window [") == 6
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Sort [") == 4


def test_images_are_reduced_where_they_are_decoded(spark):
    """Blocks, those at the edges too, have the means of their pixels, and no pixel is shuffled for it; an image listed twice counts once."""
    rng = np.random.default_rng(4)
    cubes = {f"i{k}": rng.integers(0, 256, (h, w, c), dtype=np.uint8) for k, (h, w, c) in enumerate(((5, 7, 3), (2, 3, 3), (9, 4, 1), (4, 4, 4)))}
    rows = [(k, (c.shape[0], c.shape[1], c.shape[2], bytearray(c.tobytes()))) for k, c in cubes.items()]
    images = spark.createDataFrame([*rows, rows[0]], "image_id string, image struct<height:int,width:int,nChannels:int,data:binary>")
    want = {}
    for k, c in cubes.items():
        step = -(-max(c.shape[:2]) // 4)
        for y in range(0, c.shape[0], step):
            for x in range(0, c.shape[1], step):
                blue, green, red = (c[y : y + step, x : x + step, min(i, c.shape[2] - 1)].astype(float).mean() for i in (0, 1, 2))
                want[k, y // step, x // step] = (red, green, blue)
    found = pixels.pixels(images, long_edge=4)
    rows = found.collect()
    assert len(rows) == len(want)
    assert {(r.image_id, r.y, r.x): (r.r, r.g, r.b) for r in rows} == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_few_values_are_sorted_in_a_task_a_column(spark, monkeypatch):
    """Quantiles of few values take one table; those of many, by ranges, are the same."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(float(a), None if k % 3 else float(b)) for k, (a, b) in enumerate(zip(rng.integers(0, 9, 400), rng.normal(size=400)))], "a double, b double")
    made = []
    monkeypatch.setattr(ranks, "cut", lambda df, name="stage", cut=ranks.cut: (made.append(name), cut(df, name))[1])
    few = ranks.quantiles(df, ["a", "b"], [0.0, 0.3, 0.5, 1.0])
    assert made == ["counted"]
    monkeypatch.setattr(ranks, "FEW_VALUES", 0)
    assert few == ranks.quantiles(df, ["a", "b"], [0.0, 0.3, 0.5, 1.0])


def test_a_stream_lists_its_batches_in_few_tasks(spark, tmp_path):
    """Each batch lists its paths when it begins, long after the stream was started: the session keeps to few tasks."""
    from lumenrank.sources import images

    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.unset(name)
    folder, listed = tmp_path / "in", []
    folder.mkdir()
    for k in range(80):
        (folder / f"f{k}.png").write_bytes(b"x")
    images.few_listing_tasks(spark)
    files = spark.readStream.format("binaryFile").schema(images.BINARY_FILES).option("maxFilesPerTrigger", 40).load(str(folder))

    def step(batch, number):
        listed.append((batch.count(), int(spark.conf.get(name))))

    files.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert listed == [(40, spark.sparkContext.defaultParallelism)] * 2


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    """Items with the same vectors, zero vectors and a vector that only a query has: as nearest_all, on distinct vectors only."""
    rng = np.random.default_rng(6)
    v = rng.integers(1, 9, (30, 3)).astype(float)[rng.integers(0, 30, 400)]
    v[:20] = 0
    v[20:24] *= 2
    ids = [f"i{k}" for k in rng.permutation(400)]
    items = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "image_id string, vector array<double>")
    asked = items.filter("substr(image_id, -1) IN ('1', '4')").unionByName(spark.createDataFrame([("new", [1.0, 2.0, 30.0]), ("none", [0.0, 0.0, 0.0])], "image_id string, vector array<double>"))
    told = lambda df: sorted((r["query"], r["rank"], r["image_id"], round(r["similarity"], 10)) for r in df.collect())
    want, sizes = told(analysis.nearest_all(asked, items)), []
    whole = analysis.nearest_all
    monkeypatch.setattr(analysis, "nearest_all", lambda q, v, k, key, size, itself: (sizes.append(size), whole(q, v, k, key, size, itself))[1])
    monkeypatch.setattr(analysis, "FEW_PAIRS", 0)
    assert told(analysis.nearest_exact(asked, items)) == want
    assert sizes == [(len({tuple(r.vector) for r in asked.collect()}), len({tuple(x) for x in v}))] and sizes[0][1] < 40
    monkeypatch.setattr(analysis, "ALL_PAIRS", 0)
    assert told(analysis.nearest_exact(asked, items)) == want


def test_blocks_skip_cells_of_items(monkeypatch):
    """On vectors of few dimensions a block's queries meet few of its items, with the results of all products; also with zero
    and equal vectors, parts that are not asked for and bounds."""
    rng = np.random.default_rng(7)
    n = 2500
    v = np.c_[rng.normal(5.3, 0.5, n), rng.poisson(30, n), rng.integers(0, 51, n), 50 - np.minimum(15, rng.geometric(0.5, n))].astype(float)
    v[:3], v[100:140], v[200:210] = 0, v[99], 2 * v[300:310]
    ids = np.array([f"i{k}" for k in rng.permutation(n)], dtype=object)
    items = pd.DataFrame({"item": ids, "iv": list(v), "part": rng.integers(0, 2, n)})
    asks = rng.random((n, 2)) < 0.7
    asks[~asks.any(axis=1), 0] = True
    looked, likely = [], analysis._likely
    monkeypatch.setattr(analysis, "_likely", lambda near, k, slack: (looked.append(near.size), likely(near, k, slack))[1])
    queries = pd.DataFrame({"query": ids, "qv": list(v)})

    def told(few, **more):
        looked.clear()
        monkeypatch.setattr(analysis, "FEW_ITEMS", few)
        got = analysis._multiply(5, "image_id", **more)(queries, items, asks if len(more) else None)
        return got.assign(similarity=got["similarity"].round(12)).sort_values(["query", "similarity", "image_id"], ascending=[True, False, True]).reset_index(drop=True), sum(looked)

    for more in ({}, {"itself": True}):
        (want, whole), (got, some) = told(10**9, **more), told(1_024, **more)
        assert want.equals(got) and len(got) == 5 * n
        assert whole >= n * n and some < whole / 2
    # what is less like a query than its bound may be left out, nothing else
    kth = want.groupby("query")["similarity"].min()
    queries["bound"] = queries["query"].map(kth)
    got, fewer = told(1_024, itself=True)
    assert want.equals(got) and fewer <= some
