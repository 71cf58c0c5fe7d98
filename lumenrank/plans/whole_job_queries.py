"""Registered queries of whole jobs: labels from raw ratings, feature tables, regions of analysed batches, bundles and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenrank.operators import models, pixels
from lumenrank.plans import jobs
from lumenrank.plans.fixtures import pixel_cubes, table, view
from lumenrank.plans.registering import SQL, query
from lumenrank.plans.registering import rounded as _r
from lumenrank.plans.stages import new_path
from lumenrank.sources import tables


@query(
    """--with good AS (SELECT CAST(event_id AS STRING) AS rating_id, regexp_extract(props, '([0-9]+)', 1) AS image_id, CAST(user_id AS STRING) AS rater_id, value / 5 AS s, ts FROM events WHERE value / 5 BETWEEN 0 AND 10 AND regexp_extract(props, '([0-9]+)', 1) <> '' AND user_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY rater_id ORDER BY ts, rating_id) AS n FROM good),
derived AS (SELECT a.image_id AS l, b.image_id AS r, a.rater_id, CASE WHEN a.s > b.s THEN a.image_id ELSE b.image_id END AS winner, b.ts, sha256(a.rating_id || '|' || b.rating_id) AS pair_id FROM numbered a JOIN numbered b ON a.rater_id = b.rater_id AND a.n < b.n AND abs(a.s - b.s) >= 2.0),
all_pairs AS (SELECT left_image_id AS l, right_image_id AS r, rater_id, winner, CAST(timestamp AS TIMESTAMP) AS ts, pair_id, 0 AS k FROM v_pairs UNION ALL SELECT l, r, rater_id, winner, ts, pair_id, 1 FROM derived),
merged_pairs AS (SELECT winner FROM (SELECT *, row_number() OVER (PARTITION BY l, r, rater_id, ts ORDER BY k, pair_id) AS place FROM all_pairs) WHERE place = 1),
preferred AS (SELECT winner AS image_id, count(*) AS n FROM merged_pairs GROUP BY 1),
told AS (SELECT image_id, avg(s) AS mean_score, count(*) AS n_raters FROM good GROUP BY 1),
merged AS (SELECT t.*, m.split_group_id FROM told t JOIN v_manifest m ON t.image_id = m.image_id),
groups AS (SELECT DISTINCT split_group_id AS g FROM merged),
test AS (SELECT g FROM (SELECT g, row_number() OVER (ORDER BY md5('42|' || g), g) AS k, count(*) OVER () AS n FROM groups) WHERE k <= ceil(0.2 * n))
SELECT m.image_id, CASE WHEN g IS NULL THEN 'dev' ELSE 'test' END AS partition, round(m.mean_score, 6) AS mean_score, m.n_raters, coalesce(p.n, 0) AS preferred FROM merged m LEFT JOIN test ON m.split_group_id = g LEFT JOIN preferred p ON p.image_id = m.image_id""",
    ("v_pairs", "v_manifest"),
)
def labels_from_ratings(spark, sf_dir):
    """The job from raw ratings, some of them out of range, to labels, splits and merged preferences."""
    rated = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("rating_id"), F.regexp_extract("props", "([0-9]+)", 1).alias("image_id"), F.col("user_id").cast("string").alias("rater_id"), (F.col("value") / 5).alias("raw_score_1_to_10"), F.col("ts").alias("rating_timestamp"))
    pairs = view(spark, sf_dir, "v_pairs").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    made = jobs.aggregate_labels(view(spark, sf_dir, "v_manifest"), rated, pairs)
    preferred = made["pairwise"].groupBy(F.col("winner").alias("image_id")).agg(F.count(F.lit(1)).alias("preferred"))
    both = made["splits"].select("image_id", "partition").join(made["aggregated"].select("image_id", _r("mean_score"), "n_raters"), "image_id")
    return both.join(preferred, "image_id", "left").fillna(0, ["preferred"])


_FOUR = ("mean_brightness", "contrast", "dynamic_range", "saturation_mean", "lab_a_mean", "lab_b_mean", "blue_orange_balance", "color_temperature_proxy", "cloud_area_fraction", "sky_area_fraction", *[f"hue_bin_{i}" for i in range(8)])
_FIVE = ("horizon_row_fraction", "horizon_confidence", "symmetry", "saliency_center_x", "saliency_center_y", "saliency_spread", "rule_of_thirds_distance")
_SIX = ("entropy", "glcm_homogeneity", "glcm_energy", "glcm_correlation", *[f"edge_orientation_bin_{i}" for i in range(8)])


@query(f"SELECT image_id, {', '.join((*_FOUR, *_FIVE, *_SIX, 'glcm_contrast'))} FROM ({SQL['color_features']}) JOIN ({SQL['composition_features']}) USING (image_id) JOIN ({SQL['pixel_entropy']}) USING (image_id) JOIN ({SQL['pixel_co_occurrence']}) USING (image_id) JOIN ({SQL['edge_orientation']}) USING (image_id)")
def feature_table(spark, sf_dir):
    """The feature job's joined table, but for the columns of the smoothed cloud mask other than its share."""
    got = pixels.extract(pixel_cubes(spark, sf_dir).withColumn("gray", F.col("g")))
    return got.select("image_id", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in _FOUR], *[F.round(c, 5).alias(c) for c in _FIVE], *[_r(c) for c in _SIX], F.round("glcm_contrast", 4).alias("glcm_contrast"))


@query(
    """--with cells AS (SELECT image_id, CAST(y // 4 AS VARCHAR) || '_' || CAST(x // 4 AS VARCHAR) AS region_id, avg(gray) AS mean_importance, count(*) / 64 AS area_fraction, avg(CAST(gray > 128 AS INT)) AS cloud_fraction FROM v_pixels GROUP BY 1, 2),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY mean_importance DESC, region_id) AS INT) AS region_rank FROM cells)
SELECT import_batch_id AS batch_id, m.image_id, region_rank, region_id, round(mean_importance, 6) AS mean_importance, round(area_fraction, 6) AS area_fraction, round(cloud_fraction, 6) AS cloud_fraction FROM v_manifest m JOIN placed p ON m.image_id = p.image_id WHERE region_rank <= 8""",
    ("v_pixels", "v_manifest"),
)
def batch_regions(spark, sf_dir):
    """The regions that the analysis of every batch tells, without a model."""
    px = view(spark, sf_dir, "v_pixels").withColumn("cloud", (F.col("gray") > 128).cast("int"))
    got = jobs.analyze_batches(view(spark, sf_dir, "v_manifest"), "run", view(spark, sf_dir, "v_features"), None, neighbours=0, regions=jobs.important_regions(px, "gray", tile=4))
    told = F.from_json("top_regions", "array<struct<region_id:string,mean_importance:double,area_fraction:double,cloud_fraction:double>>")
    each = got.select("batch_id", "image_id", F.posexplode(told).alias("place", "x"))
    return each.select("batch_id", "image_id", (F.col("place") + 1).alias("region_rank"), "x.region_id", *[_r(F.col(f"x.{c}"), c) for c in ("mean_importance", "area_fraction", "cloud_fraction")])


@query(
    """--with b AS (SELECT *, CAST(pair_id AS BIGINT) % 40 AS room FROM v_pairs)
SELECT left_image_id, right_image_id, CASE WHEN room % 2 = 0 THEN rater_id WHEN room % 4 <> 1 THEN 'room' || CAST(room AS STRING) ELSE 'friend' END AS rater_id, CASE WHEN room % 3 <> 0 THEN winner END AS winner, CASE WHEN room % 5 = 0 THEN false ELSE tie_flag END AS tie_flag,
  round(CASE WHEN room % 7 = 0 THEN 0.5::DOUBLE ELSE preference_strength END, 9) AS preference_strength, CASE WHEN room % 11 <> 0 THEN CAST(CAST(timestamp AS DATE) AS STRING) END AS day FROM b""",
    ("v_pairs",),
)
def bundled_pairs(spark, sf_dir):
    """Preferences of label bundles, whose fields may be empty or missing; a bundle has those of a room, 25,000 at most."""
    folder, room = new_path(spark, "pair-bundles"), F.pmod(F.col("pair_id").cast("long"), F.lit(40))
    item = F.struct(
        "left_image_id", "right_image_id", F.when(room % 2 == 0, F.col("rater_id")).otherwise("").alias("rater_id"), F.when(room % 3 != 0, F.col("winner")).otherwise("").alias("winner"),
        F.when(room % 5 != 0, F.col("tie_flag")).alias("tie_flag"), F.when(room % 7 != 0, F.col("preference_strength")).alias("preference_strength"), F.when(room % 11 != 0, F.col("timestamp").cast("string")).alias("timestamp"),
    )
    part = F.floor(F.col("pair_id").cast("long") / 1_000_000)
    each = view(spark, sf_dir, "v_pairs").groupBy(room.alias("room"), part.alias("part")).agg(F.collect_list(item).alias("pairwise"))
    head = F.when(F.col("room") % 4 != 1, F.concat(F.lit("room"), F.col("room").cast("string"))).alias("rater_id")
    each.select("room", "part", F.to_json(F.struct(head, "pairwise")).alias("value")).repartition("room", "part").write.partitionBy("room", "part").text(folder)
    _, pairs, _ = tables.read_label_bundles(spark, folder)
    return pairs.select("left_image_id", "right_image_id", "rater_id", "winner", "tie_flag", F.round("preference_strength", 9).alias("preference_strength"), F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


@query(SQL["compare_groups"])
def evaluation_groups(spark, sf_dir):
    """The group comparison of an evaluation, written beside a run and read back."""
    known = view(spark, sf_dir, "v_labels").withColumn("mean_score", F.round("mean_score", 6))
    paths = models.write_evaluation(models.evaluate(view(spark, sf_dir, "v_features"), known), new_path(spark, "runs"), "run_1")
    return spark.read.parquet(paths["groups"]).select("feature", *[_r(c) for c in ("high_mean", "mid_mean", "effect_size_d", "t_stat")])
