"""Registered queries of compacted logs, preference and image streams, near hashes and drawn pairs, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.operators import keys, labels, models
from lumenrank.operators.manifest import build_manifest
from lumenrank.operators.near_hashes import near_pairs
from lumenrank.plans import jobs
from lumenrank.plans.fixtures import view
from lumenrank.plans.registering import query
from lumenrank.plans.registering import rounded as _r
from lumenrank.plans.stages import cut, new_path
from lumenrank.schemas import RATINGS
from lumenrank.sources import images, tables
from lumenrank.streaming import images as image_streams
from lumenrank.streaming import preferences


@query("SELECT rating_id, image_id, rater_id, round(raw_score_1_to_10, 6) AS score, note FROM v_ratings", ("v_ratings",))
def compacted_logs(spark, sf_dir):
    """Ratings appended in three batches, of which the first two are merged."""
    folder, rated = new_path(spark, "log"), view(spark, sf_dir, "v_ratings")
    third = F.pmod(F.col("rating_id").cast("long"), F.lit(3))
    for i in (0, 1):
        tables.append_ratings(rated.filter(third == i), folder)
    tables.compact_log(spark, folder, RATINGS)
    tables.append_ratings(rated.filter(third == 2), folder)
    return tables.read_annotations(spark, folder, RATINGS).select("rating_id", "image_id", "rater_id", _r("raw_score_1_to_10", "score"), "note")


_SIDES = "sides AS (" + " UNION ALL ".join(f"SELECT {s}_image_id AS image_id, CAST(NOT tie_flag AND winner = {s}_image_id AS INT) AS won, CAST(tie_flag AS INT) AS tied FROM v_pairs" for s in ("left", "right")) + ")"


@query(f"--with {_SIDES} SELECT image_id, CAST(sum(won) AS BIGINT) AS wins, CAST(sum(tied) AS BIGINT) AS ties, count(*) AS n_pairs, round((sum(won) + 0.5 * sum(tied)) / count(*), 6) AS pairwise_win_rate FROM sides GROUP BY image_id", ("v_pairs",))
def preference_stream(spark, sf_dir):
    """Win rates carried in a stream's state: half of the preferences, then all, so half of them come twice."""
    base, pairs = new_path(spark, "preferences"), view(spark, sf_dir, "v_pairs")

    def keep(batch: DataFrame, number: int) -> None:
        old = tables.read_table(spark, f"{base}/rates", batch.schema)
        tables.write_table(keys.upsert(old, batch, ["image_id"]), f"{base}/rates")

    schema = None
    for half in (pairs.filter("CAST(pair_id AS BIGINT) % 2 = 0"), pairs):
        tables.append_pairwise(half, f"{base}/log")
        stream = preferences.preference_stream(spark, f"{base}/log", watermark="36500 days")
        schema = preferences.running_win_rates(stream).schema
        preferences.keep_win_rates(stream, keep, f"{base}/checkpoint").awaitTermination()
    return tables.read_table(spark, f"{base}/rates", schema).select("image_id", "wins", "ties", "n_pairs", _r("pairwise_win_rate"))


def _bitmaps(spark: SparkSession, sf_dir: str) -> str:
    """The rasters as bitmap files in a folder of the shared one."""
    folder = new_path(spark, "images")
    row = F.repeat(F.lpad(F.hex(F.col("gray").cast("int")), 2, "0"), 3)
    cells = view(spark, sf_dir, "v_pixels").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("y"), "x", row.alias("c")))).alias("cells"))
    content = images.bitmap(F.lit(8), F.lit(8), F.array_join(F.transform("cells", lambda c: c["c"]), ""))
    images.write_files(cells.select(F.concat("image_id", F.lit(".bmp")).alias("name"), content.alias("content")), folder)
    return folder


_FILES = "files AS (SELECT image_id, '424df6000000000000003600000028000000080000000800000001001800' || '00000000c0000000' || repeat('00', 16) || lower(string_agg(repeat(printf('%02x', CAST(gray AS INT)), 3), '' ORDER BY y DESC, x)) AS content FROM v_pixels GROUP BY image_id)"


@query(f"--with {_FILES} SELECT image_id || '.bmp' AS relative_path, sha256(unhex(content)) AS sha256, left(sha256(unhex(content)), 16) AS image_id, 8 AS width, 8 AS height FROM files", ("v_pixels",))
def scanned_images(spark, sf_dir):
    """Image files: paths, content hashes and sizes."""
    return images.scan_images(spark, _bitmaps(spark, sf_dir)).select("relative_path", "sha256", "image_id", "width", "height")


@query(f"--with {_FILES}, named AS (SELECT left(sha256(unhex(content)), 16) AS id, image_id FROM files) SELECT n.id AS image_id, round(avg(gray), 4) AS mean_brightness, 1 AS predictions FROM (SELECT id, min(image_id) AS image_id FROM named GROUP BY id) n JOIN v_pixels p ON p.image_id = n.image_id GROUP BY n.id", ("v_pixels",))
def image_stream(spark, sf_dir):
    """Image files as a stream, analysed by a model in micro-batches; the last batch comes twice."""
    folder, base = _bitmaps(spark, sf_dir), new_path(spark, "image-stream")
    found = cut(images.scan_images(spark, folder).dropDuplicates(["image_id"]), "scan")
    features = cut(jobs.extract_features(found.select("image_id", "image"), None, ("color",)), "features")
    known = features.select("image_id", F.round(F.col("mean_brightness") / 25.5, 6).alias("mean_score"))
    fitted = models.fit_regressor("elasticnet", features.join(known, "image_id"), [c for c in features.columns if c != "image_id" and not c.startswith("concept_")], "mean_score")
    feature_table, prediction_table = f"{base}/features", f"{base}/predictions"
    image_streams.score_images(spark, folder, "run", fitted, feature_table, prediction_table, f"{base}/checkpoint", files_a_batch=2_000, extractors=("color",)).awaitTermination()
    told = tables.read_table(spark, prediction_table, image_streams.STREAM_PREDICTIONS)
    last = told.agg(F.max("batch_id")).first()[0]
    # the paths of one micro-batch
    again = sorted(f"{folder}/{r[0]}" for r in told.filter(F.col("batch_id") == last).select("relative_path").collect())
    image_streams.analyze_images(images.scan_images(spark, folder, paths=again), last, "run", fitted, feature_table, prediction_table, extractors=("color",))
    told = tables.read_table(spark, prediction_table, image_streams.STREAM_PREDICTIONS)
    each = told.filter("predicted_score IS NOT NULL").groupBy("image_id").agg(F.count_distinct("run_id").cast("int").alias("predictions"))
    return tables.read_table(spark, feature_table, features.schema).select("image_id", F.round("mean_brightness", 4).alias("mean_brightness")).join(each, "image_id")


_SIGNS = "signs AS (SELECT vec_id, string_agg(CASE WHEN e > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS bits FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id)"
_APART = "length(replace(ltrim(CAST(xor(CAST(a.bits AS BIT), CAST(b.bits AS BIT)) AS VARCHAR)), '0', ''))"


@query(f"WITH {_SIGNS}, known AS (SELECT DISTINCT bits FROM signs) SELECT a.bits AS left_bits, b.bits AS right_bits, CAST({_APART} AS INT) AS distance FROM known a JOIN known b ON a.bits < b.bits WHERE {_APART} <= 14")
def near_hashes(spark, sf_dir):
    """Signs of the vectors as hashes, and all pairs at most 14 bits apart."""
    signs = F.array_join(F.transform("embedding", lambda e: F.when(e > 0, "1").otherwise("0")), "")
    got = near_pairs(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(signs.alias("phash")), 14)
    return got.select(F.col("left").alias("left_bits"), F.col("right").alias("right_bits"), "distance")


@query(
    """--with numbered AS (SELECT *, row_number() OVER (PARTITION BY rater_id ORDER BY rating_timestamp, rating_id) AS n FROM v_ratings),
counted AS (SELECT a.rater_id, count(*) AS pairs FROM numbered a JOIN numbered b ON a.rater_id = b.rater_id AND a.n < b.n AND abs(a.raw_score_1_to_10 - b.raw_score_1_to_10) >= 2 GROUP BY a.rater_id)
SELECT rater_id, least(pairs, 20) AS pairs, least(pairs, 20) AS distinct_pairs, 0 AS wrong FROM counted""",
    ("v_ratings",),
)
def drawn_pairs(spark, sf_dir):
    """At most 20 of each rater's implied preferences, drawn by their numbers."""
    got = labels.pseudo_pairs(view(spark, sf_dir, "v_ratings"), 2.0, max_pairs_per_rater=20)
    wrong = F.count_if((F.col("preference_strength") < 2) | ~F.col("winner").isin(F.col("left_image_id"), F.col("right_image_id")))
    return got.groupBy("rater_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("pair_id").alias("distinct_pairs"), wrong.cast("int").alias("wrong"))


@query(
    """--with scan AS (SELECT *, CAST(image_id AS BIGINT) AS k FROM v_manifest),
made AS (SELECT relative_path, 'batch_' || CAST(k % 7 AS VARCHAR) AS import_batch_id, 'source_' || CAST(k % 50 AS VARCHAR) AS source_image_id FROM scan WHERE k % 3 = 0)
SELECT s.image_id, s.relative_path, coalesce(m.source_image_id, s.capture_session_id || '_' || left(s.sha256, 12)) AS split_group_id, coalesce(m.import_batch_id, s.import_batch_id) AS import_batch_id FROM scan s LEFT JOIN made m ON s.relative_path = m.relative_path""",
    ("v_manifest",),
)
def derived_manifest(spark, sf_dir):
    """A manifest with derivatives of a third of the items, each listed twice; the later generation counts."""
    scan = view(spark, sf_dir, "v_manifest").drop("split_group_id").withColumn("phash", F.col("sha256"))
    k = F.col("image_id").cast("long")
    made = scan.filter(k % 3 == 0).select("relative_path", F.concat(F.lit("batch_"), k % 7).alias("import_batch_id"), F.concat(F.lit("source_"), k % 50).alias("source_image_id"), F.lit(2).alias("generation"))
    older = made.withColumns({"import_batch_id": F.lit("old"), "source_image_id": F.lit("old"), "generation": F.lit(1)})
    return build_manifest(scan, made.unionByName(older)).select("image_id", "relative_path", "split_group_id", "import_batch_id")
