"""Registered queries of sources, sinks, tables of runs, validation, masks, images and streams, and their DuckDB SQL.

Files that a query writes lie in the shared folder; what it returns is read back from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.operators import browse, concepts, curation, keys, labels, manifest, metrics, models, pixels, reports
from lumenrank.plans import jobs
from lumenrank.plans.fixtures import pixel_cubes, table, view
from lumenrank.plans.registering import query
from lumenrank.plans.registering import rounded as _r
from lumenrank.plans.stages import cut, new_path
from lumenrank.schemas import PAIRWISE, RATINGS, conform, require_columns, require_non_empty
from lumenrank.sources import images, tables
from lumenrank.streaming import streams

# --- tables and logs


@query("SELECT image_id, round(f_price, 6) AS f_price, CAST(f_n AS BIGINT) AS f_n FROM v_features WHERE f_n >= 3", ("v_features",))
def replace_table(spark, sf_dir):
    """A table that is replaced by what is read from itself."""
    path, features = new_path(spark, "features"), view(spark, sf_dir, "v_features")
    tables.write_table(features, path)
    tables.write_table(tables.read_table(spark, path, features.schema).filter("f_n >= 3"), path)
    return tables.read_table(spark, path, features.schema).select("image_id", _r("f_price"), F.col("f_n").cast("long").alias("f_n"))


@query("SELECT image_id, relative_path, sha256, width, height FROM v_manifest", ("v_manifest",))
def csv_table(spark, sf_dir):
    path, items = new_path(spark, "manifest") + ".csv", view(spark, sf_dir, "v_manifest").select("image_id", "relative_path", "sha256", "width", "height")
    tables.write_table(items, path)
    return tables.read_table(spark, path, items.schema)


@query("SELECT rating_id, image_id, rater_id, rating_session_id, round(raw_score_1_to_10, 6) AS score, note FROM v_ratings", ("v_ratings",))
def rating_logs(spark, sf_dir):
    """Ratings appended in two batches, and a CSV log with its columns in another order, read as one table."""
    folder, rated = new_path(spark, "ratings"), view(spark, sf_dir, "v_ratings")
    third = F.pmod(F.col("rating_id").cast("long"), F.lit(3))
    for i in (0, 1):
        tables.append_ratings(rated.filter(third == i), f"{folder}/parquet")
    rated.filter(third == 2).select("note", "raw_score_1_to_10", "rater_id", "rating_timestamp", "rating_session_id", "image_id", "rating_id").write.option("header", True).csv(f"{folder}/csv")
    got = tables.read_annotations(spark, folder, RATINGS)
    return got.select("rating_id", "image_id", "rater_id", "rating_session_id", _r("raw_score_1_to_10", "score"), "note")


@query("SELECT pair_id, left_image_id, right_image_id, rater_id, winner, tie_flag, round(preference_strength, 9) AS preference_strength FROM v_pairs", ("v_pairs",))
def pairwise_logs(spark, sf_dir):
    folder = new_path(spark, "pairwise")
    tables.append_pairwise(view(spark, sf_dir, "v_pairs"), folder)
    got = tables.read_annotations(spark, folder, PAIRWISE)
    return got.select("pair_id", "left_image_id", "right_image_id", "rater_id", "winner", "tie_flag", F.round("preference_strength", 9).alias("preference_strength"))


@query(
    """SELECT CAST(user_id AS STRING) AS image_id, 'p/' || event_type AS relative_path, CASE WHEN event_type IN ('error', 'signup') THEN 'True' ELSE 'False' END AS excluded, props || ', "' || event_type || '"' AS reason, CAST(event_id AS STRING) AS timestamp FROM events"""
)
def exclusion_log(spark, sf_dir):
    """Exclusion events whose reasons hold commas and quotes, appended and read back."""
    folder = new_path(spark, "exclusions")
    reason = F.concat("props", F.lit(', "'), "event_type", F.lit('"'))
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("image_id"), F.concat(F.lit("p/"), "event_type").alias("relative_path"), F.col("event_type").isin("error", "signup").alias("excluded"), reason.alias("reason"), F.col("event_id").cast("string").alias("timestamp"))
    tables.append_exclusions(log, folder)
    return tables.read_exclusions(spark, folder)


@query("SELECT CAST(user_id AS STRING) AS image_id, 'p/' || event_type AS relative_path, 'True' AS excluded, event_type || ' x' AS reason, CAST(event_id AS STRING) AS timestamp FROM events WHERE event_type <> 'view'")
def old_exclusion_log(spark, sf_dir):
    """Logs of the older layout, where a reason holds the path; lines of other widths go."""
    folder = new_path(spark, "old-exclusions")
    line = F.concat_ws(",", F.col("user_id").cast("string"), F.lit("True"), F.concat("event_type", F.lit(" x | p/"), "event_type"), F.col("event_id").cast("string"))
    line = F.when(F.col("event_type") == "view", F.concat(F.col("user_id").cast("string"), F.lit(",True"))).otherwise(line)
    lines = table(spark, sf_dir, "events").select(line.alias("image_id,excluded,reason,timestamp"))
    # a header in every file
    lines.write.option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\u0001").csv(folder)
    return tables.read_exclusions(spark, folder)


_BUNDLED = """--with b AS (SELECT *, CAST(rater_id AS BIGINT) % 40 AS room FROM v_ratings)
"""


def _bundles(spark: SparkSession, sf_dir: str) -> str:
    """Label bundles, one JSON document a file: 40 rooms of raters; a room's own rater or session may be missing."""
    folder = new_path(spark, "bundles")
    room = F.pmod(F.col("rater_id").cast("long"), F.lit(40))
    item = F.struct("image_id", F.col("raw_score_1_to_10").alias("score"), "note", F.when(room % 2 == 0, F.col("rater_id")).otherwise("").alias("rater_id"))
    image = F.struct(F.concat(F.lit("i"), "rating_id").alias("image_id"), F.concat(F.lit("data:image/"), F.when(room % 3 == 0, "jpeg").otherwise("png"), F.lit(";base64,"), F.base64(F.col("rating_id").cast("binary"))).alias("data_url"))
    rated = view(spark, sf_dir, "v_ratings").withColumn("room", room)
    each = rated.groupBy("room").agg(F.collect_list(item).alias("ratings"), F.collect_list(image).alias("imported_images"))
    head = (F.when(F.col("room") % 4 != 1, F.concat(F.lit("room"), F.col("room").cast("string"))).alias("rater_id"), F.when(F.col("room") % 5 != 0, F.lit("evening")).otherwise("").alias("session_id"))
    each.select("room", F.to_json(F.struct(*head, "ratings", "imported_images")).alias("value")).repartition("room").write.partitionBy("room").text(folder)
    return folder


@query(
    _BUNDLED
    + """SELECT image_id, CASE WHEN room % 2 = 0 THEN rater_id WHEN room % 4 <> 1 THEN 'room' || CAST(room AS STRING) ELSE 'friend' END AS rater_id, CASE WHEN room % 5 <> 0 THEN 'evening' ELSE 'friend_export' END AS rating_session_id, round(raw_score_1_to_10, 6) AS score, note FROM b""",
    ("v_ratings",),
)
def label_bundles(spark, sf_dir):
    ratings, _, _ = tables.read_label_bundles(spark, _bundles(spark, sf_dir))
    return ratings.select("image_id", "rater_id", "rating_session_id", _r("raw_score_1_to_10", "score"), "note")


@query(_BUNDLED + "SELECT 'i' || rating_id AS image_id, rating_id AS content, CASE WHEN room % 3 = 0 THEN '.jpg' ELSE '.png' END AS suffix FROM b", ("v_ratings",))
def bundled_images(spark, sf_dir):
    _, _, found = tables.read_label_bundles(spark, _bundles(spark, sf_dir))
    return found.select("image_id", F.col("content").cast("string").alias("content"), "suffix")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.png' END AS suffix FROM documents")
def data_urls(spark, sf_dir):
    """Whole texts as data URLs, decoded."""
    kind = F.when(F.col("doc_id") % 2 == 0, "JPG").otherwise("png")
    url = F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(F.coalesce("text", F.lit("")).cast("binary")))
    got = tables.decode_data_urls(table(spark, sf_dir, "documents").select("doc_id", url.alias("data_url")))
    return got.select("doc_id", F.sha2("content", 256).alias("sha256"), "suffix")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, substr(sha256(coalesce(text, '')), 1, 16) AS image_id FROM documents")
def content_ids(spark, sf_dir):
    got = images.with_content_id(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content")))
    return got.select("doc_id", "sha256", "image_id")


@query("SELECT 'pack' AS package_name, 'any' AS rater_hint, image_id, relative_path, width, height FROM v_manifest", ("v_manifest",))
def export_manifest(spark, sf_dir):
    documents = tables.export_manifest(view(spark, sf_dir, "v_manifest"), "pack", "any")
    told = F.from_json("document", "package_name string, rater_hint string, n_items int, items array<struct<image_id:string,relative_path:string,width:int,height:int>>")
    return documents.select(told.alias("d")).select("d.package_name", "d.rater_hint", F.explode("d.items").alias("i")).select("package_name", "rater_hint", "i.*")


@query(
    """--with fresh AS (SELECT CAST(l_partkey AS STRING) AS image_id, CAST(l_quantity AS INT) AS width, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC) AS r FROM lineitem WHERE l_partkey % 3 = 0)
SELECT m.image_id, coalesce(f.width, m.width) AS width FROM v_manifest m LEFT JOIN fresh f ON m.image_id = f.image_id AND f.r = 1""",
    ("v_manifest",),
)
def upsert_items(spark, sf_dir):
    """Sizes of a third of the items are replaced, the last of many new rows counting."""
    old = view(spark, sf_dir, "v_manifest").select("image_id", "width")
    new = table(spark, sf_dir, "lineitem").filter("l_partkey % 3 = 0").select(F.col("l_partkey").cast("string").alias("image_id"), F.col("l_quantity").cast("int").alias("width"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    got = keys.upsert(old, new, ["image_id"], [F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_suppkey"), F.desc("l_quantity")])
    return got.select("image_id", "width")


# --- checks and names


@query("SELECT CAST(event_id AS STRING) AS rating_id, CAST(user_id AS STRING) AS rater_id, CAST(NULL AS STRING) AS image_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS raw_score_1_to_10, event_type AS note FROM events")
def conform_ratings(spark, sf_dir):
    """A table without some columns and with texts for numbers, brought to the schema of ratings."""
    raw = table(spark, sf_dir, "events").select(F.regexp_extract("props", "([0-9]+)", 1).alias("raw_score_1_to_10"), F.col("event_type").alias("note"), F.col("user_id").alias("rater_id"), F.col("event_id").alias("rating_id"), F.lit(1).alias("extra"))
    got = require_columns(require_non_empty(conform(raw, RATINGS), "ratings", "Rate some items."), ["rating_id", "image_id"], "ratings")
    return got.select("rating_id", "rater_id", "image_id", "raw_score_1_to_10", "note")


@query("SELECT pair_id, left_image_id, right_image_id FROM v_pairs WHERE left_image_id IN (SELECT image_id FROM v_manifest WHERE width > 1000) AND right_image_id IN (SELECT image_id FROM v_manifest WHERE width > 1000)", ("v_pairs", "v_manifest"))
def restrict_pairs(spark, sf_dir):
    ids = view(spark, sf_dir, "v_manifest").filter("width > 1000")
    return models.restrict_pairs(view(spark, sf_dir, "v_pairs"), ids).select("pair_id", "left_image_id", "right_image_id")


@query("SELECT image_id, relative_path FROM v_manifest WHERE image_id NOT IN (SELECT image_id FROM v_ratings)", ("v_manifest", "v_ratings"))
def missing_items(spark, sf_dir):
    return keys.missing(view(spark, sf_dir, "v_manifest"), view(spark, sf_dir, "v_ratings"), "image_id").select("image_id", "relative_path")


@query("SELECT position, item_id, width FROM v_collection WHERE width >= 600 AND width >= 300", ("v_collection",))
def minimum_size(spark, sf_dir):
    return curation.filter_min_size(view(spark, sf_dir, "v_collection").withColumn("height", F.col("width")), 600, 300).select("position", "item_id", "width")


@query("SELECT count(*) FILTER (WHERE NOT contains(relative_path, '/crops/')) AS originals, count(*) FILTER (WHERE contains(relative_path, '/crops/')) AS crops, max(import_batch_id) AS batch_id, (SELECT count(*) FROM v_ratings) AS manifest_size FROM v_manifest", ("v_manifest", "v_ratings"))
def import_summary(spark, sf_dir):
    items = view(spark, sf_dir, "v_manifest")
    kind = F.when(manifest.item_kind(F.col("relative_path")) == "crop", "sky_crop").otherwise("original")
    return manifest.import_summary(items.withColumn("derivative_kind", kind), view(spark, sf_dir, "v_ratings"))


@query("SELECT o_orderkey, trim(left(regexp_replace(o_orderpriority || ' #', '[^a-zA-Z0-9_-]', '_', 'g'), 80), '_') || '_' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS batch_id FROM orders")
def batch_ids(spark, sf_dir):
    name = F.concat("o_orderpriority", F.lit(" #"))
    return table(spark, sf_dir, "orders").select("o_orderkey", manifest.batch_id(name, F.col("o_orderdate").cast("timestamp")).alias("batch_id"))


@query(
    """SELECT p_partkey, CAST(p_partkey AS STRING) || '_' || trim(left(regexp_replace(p_name || '.v1', '[^a-zA-Z0-9_-]', '_', 'g'), 80), '_') || '.png' AS original,
  CAST(p_partkey AS STRING) || '_crop' || lpad(CAST(p_size % 8 AS STRING), 2, '0') || '_x' || CAST(p_size AS STRING) || '_y' || CAST(p_size * 2 AS STRING) || '_s' || CAST(p_size * 10 AS STRING) || '.jpg' AS crop FROM part"""
)
def derived_names(spark, sf_dir):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    original = manifest.derived_name(key, F.concat("p_name", F.lit(".v1")), F.lit(".PNG"))
    crop = manifest.derived_name(key, F.lit(""), F.lit(""), size % 8, size, size * 2, size * 10)
    return table(spark, sf_dir, "part").select("p_partkey", original.alias("original"), crop.alias("crop"))


@query(
    """SELECT CAST(p_partkey AS STRING) AS image_id, printf('Predicted score %.2f +/- %.2f. The model associates this rating with %s. Top concept signals: %s. These attributions describe model behavior rather than proven causal drivers.', p_size / 5.0::DOUBLE, 0.5::DOUBLE,
  CASE WHEN p_size % 4 = 0 THEN 'mixed visual evidence' ELSE 'edge density, ' || replace(p_name, '_', ' ') END, CASE WHEN p_size % 3 = 0 THEN 'no strong concept signals' ELSE 'towering clouds, ' || p_brand END) AS explanation FROM part"""
)
def explanation_texts(spark, sf_dir):
    features = F.when(F.col("p_size") % 4 != 0, F.array(F.lit("edge_density"), F.col("p_name")))
    signals = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("concept_towering_clouds"), F.col("p_brand")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("image_id"), concepts.explanation_text(F.col("p_size") / 5, F.lit(0.5), features, signals).alias("explanation"))


@query("SELECT p_partkey, to_json({'p_name': p_name, 'p_size': p_size, 'caveat': 'not causal'}) AS record FROM part")
def explanation_records(spark, sf_dir):
    return concepts.explanation_record(table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size")), ["p_name", "p_size"], "not causal").select("p_partkey", "record")


@query("SELECT image_id, round(agreement_index, 6) AS agreement_index, n_raters FROM (SELECT image_id, round(least(1, greatest(0, 1 - stddev_pop(raw_score_1_to_10) / 5)), 6) AS agreement_index, count(*) AS n_raters FROM v_ratings_wide GROUP BY image_id) ORDER BY agreement_index DESC, image_id LIMIT 25", ("v_ratings_wide",))
def agreement_ranking(spark, sf_dir):
    known = labels.aggregate_ratings(view(spark, sf_dir, "v_ratings_wide")).withColumn("agreement_index", F.round("agreement_index", 6))
    return browse.agreement_ranking(known, 25)


# --- runs

_JUDGED = "judged AS (SELECT 'run_' || model AS run_id, model, kind AS role, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM v_predictions GROUP BY model, kind)"
_RUN = T.StructType([T.StructField(n, T.StringType()) for n in ("model", "role")] + [T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()))])


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.regression_metrics(view(spark, sf_dir, "v_predictions"), by=["model", "kind"])
    return got.select(F.concat(F.lit("run_"), "model").alias("run_id"), "model", F.col("kind").alias("role"), *[_r(c) for c in ("mae", "rmse", "r2")])


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of a run for each model, written and read back."""
    root = new_path(spark, "runs")
    told = cut(_judged(spark, sf_dir).select("run_id", "model", "role", F.create_map(*[x for c in ("mae", "rmse", "r2") for x in (F.lit(c), F.col(c))]).alias("metrics")))
    for run in sorted(r[0] for r in told.select("run_id").distinct().collect()):
        tables.write_run(told.filter(F.col("run_id") == run).drop("run_id"), root, run)
    return tables.read_runs(spark, root, _RUN)


@query(f"--with {_JUDGED} SELECT run_id, model, role, mae, rmse, r2 FROM judged", ("v_predictions",))
def run_metrics(spark, sf_dir):
    return reports.run_metrics(_runs(spark, sf_dir))


@query(f"--with {_JUDGED} SELECT run_id, max(mae) FILTER (WHERE model = 'A' AND role = 'F') AS A_F_mae, max(rmse) FILTER (WHERE model = 'N' AND role = 'O') AS N_O_rmse, max(r2) FILTER (WHERE model = 'R' AND role = 'F') AS R_F_r2 FROM judged GROUP BY run_id", ("v_predictions",))
def summarize_runs(spark, sf_dir):
    got = reports.summarize_runs(_runs(spark, sf_dir))
    return got.select("run_id", *[F.col(c) if c in got.columns else F.lit(None).cast("double").alias(c) for c in ("A_F_mae", "N_O_rmse", "R_F_r2")])


_EPOCHS = "SELECT 'run_' || l_returnflag AS run_id, l_linenumber AS epoch, l_linestatus AS partition, round(avg(CAST(l_tax AS DOUBLE)), 6) AS loss, round(avg(CAST(l_discount AS DOUBLE)), 6) AS rmse FROM lineitem GROUP BY ALL"


@query(f"WITH e AS ({_EPOCHS}) SELECT run_id, epoch, partition, 'loss' AS metric, loss AS value FROM e UNION ALL SELECT run_id, epoch, partition, 'rmse', rmse FROM e")
def epoch_metrics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("run_"), "l_returnflag").alias("run_id"), F.col("l_linenumber").alias("epoch"), F.col("l_linestatus").alias("partition")).agg(_r(F.avg(F.col("l_tax").cast("double")), "loss"), _r(F.avg(F.col("l_discount").cast("double")), "rmse"))
    history = lines.groupBy("run_id").agg(F.collect_list(F.struct("epoch", "partition", "loss", "rmse")).alias("history"))
    return reports.epoch_metrics(history)


@query(f"--with {_JUDGED} SELECT arg_min(model, mae) AS model FROM judged WHERE role = 'F'", ("v_predictions",))
def best_model(spark, sf_dir):
    judged = _judged(spark, sf_dir).withColumn("role", F.when(F.col("role") == "F", "val").otherwise("test"))
    return spark.createDataFrame([(models.select_best(judged),)], "model string")


@query(
    """--with long_rows AS (UNPIVOT v_features ON f_price, f_discount, f_tax, f_max_qty, f_n, f_retail, f_size INTO NAME feature VALUE value)
SELECT a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 6) AS r FROM long_rows a JOIN long_rows b ON a.image_id = b.image_id
WHERE list_position(['f_price', 'f_discount', 'f_tax', 'f_max_qty', 'f_n', 'f_retail', 'f_size'], a.feature) < list_position(['f_price', 'f_discount', 'f_tax', 'f_max_qty', 'f_n', 'f_retail', 'f_size'], b.feature) GROUP BY 1, 2""",
    ("v_features",),
)
def evaluate_run(spark, sf_dir):
    """The tables of an evaluation, written beside a run and read back."""
    known = view(spark, sf_dir, "v_labels").withColumn("mean_score", F.round("mean_score", 6))
    paths = models.write_evaluation(models.evaluate(view(spark, sf_dir, "v_features"), known), new_path(spark, "runs"), "run_1")
    return spark.read.parquet(paths["correlation"]).select("f1", "f2", _r("r"))


# --- images and masks


@query("SELECT image_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, round(avg(gray), 6) AS gray FROM v_pixels GROUP BY ALL", ("v_pixels",))
def image_pixels(spark, sf_dir):
    """Decoded images, as the image source gives them, to pixels in blocks of 2 x 2."""
    grays = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.6) / 1.2 * 255).cast("int"))))
    data = F.unhex(F.array_join(F.transform(grays, lambda g: F.repeat(F.lpad(F.hex(g), 2, "0"), F.lit(3))), ""))
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), data.alias("data"))
    decoded = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), image.alias("image"))
    return pixels.pixels(decoded, long_edge=4).select("image_id", "y", "x", _r("g", "gray"))


_CUBES = "px AS (SELECT image_id, y, x, gray * (8 - x) / 8 AS r, gray AS g, gray * (8 - y) / 8 AS b, gray FROM v_pixels)"
_HSV = (
    _CUBES
    + """, spans AS (SELECT *, greatest(r, g, b) AS val, greatest(r, g, b) - least(r, g, b) AS span FROM px),
turns AS (SELECT *, CASE WHEN span = 0 THEN 0 WHEN val = r THEN 60 * (g - b) / span WHEN val = g THEN 120 + 60 * (b - r) / span ELSE 240 + 60 * (r - g) / span END AS turn FROM spans),
hsv AS (SELECT *, round_even(((turn % 360) + 360) % 360 / 2, 0) % 180 AS hue, CASE WHEN val > 0 THEN round_even(255 * span / val, 0) ELSE 0 END AS sat FROM turns)"""
)


def _smoothed(source: str, columns: tuple[str, ...]) -> str:
    """Eight windows that open and close 0/1 columns, the last as table smooth."""
    parts, last = [], source
    for i, f in enumerate(("min", "max", "max", "min")):
        for along, across in (("x", "y"), ("y", "x")):
            name = "smooth" if i == 3 and along == "y" else f"s{i}{along}"
            cells = ", ".join(f"{f}({c}) OVER (PARTITION BY image_id, {across} ORDER BY {along} RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS {c}" for c in columns)
            parts.append(f"{name} AS (SELECT * REPLACE ({cells}) FROM {last})")
            last = name
    return ", ".join(parts)


_SKY = "raw AS (SELECT *, CAST((hue BETWEEN 85 AND 135 AND sat >= 20 AND val >= 70) OR (sat <= 95 AND val >= 115) OR (sat <= 70 AND val >= 145) AS INT) AS sky, CAST(sat <= 85 AND val >= 125 AS INT) AS cloud FROM hsv)"


@query(f"--with {_HSV}, {_SKY}, {_smoothed('raw', ('sky', 'cloud'))} SELECT image_id, y, x, sky, cloud FROM smooth", ("v_pixels",))
def sky_cloud_masks(spark, sf_dir):
    return pixels.sky_cloud_masks(pixel_cubes(spark, sf_dir)).select("image_id", "y", "x", "sky", "cloud")


_CLOUD = f"raw AS (SELECT *, CAST(val > 110 AND sat < 120 AS INT) AS cloud FROM hsv), {_smoothed('raw', ('cloud',))}"
_LINEAR = "CASE WHEN {c} / 255 <= 0.04045 THEN {c} / 255 / 12.92 ELSE pow(({c} / 255 + 0.055) / 1.055, 2.4) END"
_LAB = f"""lin AS (SELECT *, {_LINEAR.format(c="r")} AS lr, {_LINEAR.format(c="g")} AS lg, {_LINEAR.format(c="b")} AS lb FROM smooth),
xyz AS (SELECT *, (0.412453::DOUBLE * lr + 0.357580::DOUBLE * lg + 0.180423::DOUBLE * lb) / 0.950456 AS cx, 0.212671::DOUBLE * lr + 0.715160::DOUBLE * lg + 0.072169::DOUBLE * lb AS cy, (0.019334::DOUBLE * lr + 0.119193::DOUBLE * lg + 0.950227::DOUBLE * lb) / 1.088754 AS cz FROM lin),
fs AS (SELECT *, {", ".join(f"CASE WHEN c{c} > 0.008856 THEN cbrt(c{c}) ELSE 7.787 * c{c} + 16 / 116.0::DOUBLE END AS f{c}" for c in "xyz")} FROM xyz),
lab AS (SELECT *, 500 * (fx - fy) + 128 AS la, 200 * (fy - fz) + 128 AS lb2 FROM fs)"""
_COLOR = ("mean_brightness", "contrast", "dynamic_range", "saturation_mean", "lab_a_mean", "lab_b_mean", "blue_orange_balance", "color_temperature_proxy", "cloud_area_fraction", "sky_area_fraction", *[f"hue_bin_{i}" for i in range(8)])


@query(
    f"""--with {_HSV}, {_CLOUD}, {_LAB} SELECT image_id, round(avg((r + g + b) / 3) + 1e-9, 4) AS mean_brightness, round(stddev_pop((r + g + b) / 3) + 1e-9, 4) AS contrast, round(max((r + g + b) / 3) - min((r + g + b) / 3) + 1e-9, 4) AS dynamic_range,
  round(avg(sat) + 1e-9, 4) AS saturation_mean, round(avg(la) + 1e-9, 4) AS lab_a_mean, round(avg(lb2) + 1e-9, 4) AS lab_b_mean, round((avg(b) + 1) / (avg(r) + 1) + 1e-9, 4) AS blue_orange_balance, round(avg(lb2) - avg(la) + 1e-9, 4) AS color_temperature_proxy,
  round(avg(cloud) + 1e-9, 4) AS cloud_area_fraction, round(1 - avg(cloud) + 1e-9, 4) AS sky_area_fraction, {", ".join(f"round(count(*) FILTER (WHERE least(floor(hue / 22.5), 7) = {i}) / count(*) / 22.5 + 1e-9, 4) AS hue_bin_{i}" for i in range(8))} FROM lab GROUP BY image_id""",
    ("v_pixels",),
)
def color_features(spark, sf_dir):
    """Every colour feature (shares of 192 pixel values can lie half way between two roundings, so both sides add a little)."""
    return pixels.color_features(pixel_cubes(spark, sf_dir)).select("image_id", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in _COLOR])


# beyond an edge the row or column inside it is seen again
_SLOPES = """sides AS (SELECT *, coalesce(lag(gray) OVER h, lead(gray) OVER h, gray) AS le, coalesce(lead(gray) OVER h, lag(gray) OVER h, gray) AS ri FROM v_pixels WINDOW h AS (PARTITION BY image_id, y ORDER BY x)),
ds AS (SELECT *, ri - le AS d, le + 2 * gray + ri AS s FROM sides),
slopes AS (SELECT image_id, y, x, gray, coalesce(lag(d) OVER v, lead(d) OVER v, d) + 2 * d + coalesce(lead(d) OVER v, lag(d) OVER v, d) AS gx, coalesce(lead(s) OVER v, lag(s) OVER v, s) - coalesce(lag(s) OVER v, lead(s) OVER v, s) AS gy FROM ds WINDOW v AS (PARTITION BY image_id, x ORDER BY y))"""


@query(
    f"""--with {_SLOPES}, angles AS (SELECT image_id, least(floor((degrees(atan2(gy, gx)) + 180) % 180 / 22.5), 7) AS bin FROM slopes)
SELECT image_id, {", ".join(f"round(count(*) FILTER (WHERE bin = {i}) / count(*) / 22.5, 6) AS edge_orientation_bin_{i}" for i in range(8))} FROM angles GROUP BY image_id""",
    ("v_pixels",),
)
def edge_orientation(spark, sf_dir):
    got = pixels.edge_orientation(view(spark, sf_dir, "v_pixels"))
    return got.select("image_id", *[_r(c) for c in got.columns if c != "image_id"])


_COMPOSED = ("horizon_row_fraction", "horizon_confidence", "vertical_mass_top", "vertical_mass_middle", "vertical_mass_bottom", "brightness_top", "brightness_bottom", "negative_space_fraction", "symmetry", "saliency_center_x", "saliency_center_y", "saliency_spread", "rule_of_thirds_distance")


@query(
    f"""--with {_SLOPES}, edges AS (SELECT image_id, y, round(avg(abs(gy)), 9) AS e FROM slopes GROUP BY ALL),
hor AS (SELECT image_id, arg_max(y, e * 1000 - y * 1e-6) / 7 AS horizon_row_fraction, max(e) / (avg(e) + 1e-6) AS horizon_confidence FROM edges GROUP BY image_id),
masks AS (SELECT *, CAST(gray > 128 AS INT) AS cloud FROM v_pixels),
mass AS (SELECT image_id, avg(cloud) FILTER (WHERE y < 2) AS vertical_mass_top, avg(cloud) FILTER (WHERE y >= 2 AND y < 5) AS vertical_mass_middle, avg(cloud) FILTER (WHERE y >= 5) AS vertical_mass_bottom, avg(gray) FILTER (WHERE y < 2) / 255 AS brightness_top, avg(gray) FILTER (WHERE y >= 5) / 255 AS brightness_bottom, avg(1 - cloud) AS negative_space_fraction FROM masks GROUP BY image_id),
sym AS (SELECT a.image_id, corr(a.gray, b.gray) AS symmetry FROM v_pixels a JOIN v_pixels b ON a.image_id = b.image_id AND a.y = b.y AND a.x = 7 - b.x GROUP BY a.image_id),
m1 AS (SELECT *, avg(gray) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m FROM v_pixels),
m2 AS (SELECT *, abs(gray - avg(m) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING)) AS d FROM m1),
m3 AS (SELECT *, coalesce(d / nullif(max(d) OVER (PARTITION BY image_id), 0), 0) AS sal FROM m2),
sal AS (SELECT image_id, sum(x * sal) / (sum(sal) + 1e-6) / 8 AS cx, sum(y * sal) / (sum(sal) + 1e-6) / 8 AS cy, stddev_pop(sal) AS saliency_spread FROM m3 GROUP BY image_id)
SELECT image_id, {", ".join(f"round({c}, 5) AS {c}" for c in _COMPOSED[:9])}, round(cx, 5) AS saliency_center_x, round(cy, 5) AS saliency_center_y, round(saliency_spread, 5) AS saliency_spread,
  round(least({", ".join(f"sqrt((cx - {a} / 3.0::DOUBLE) * (cx - {a} / 3.0::DOUBLE) + (cy - {b} / 3.0::DOUBLE) * (cy - {b} / 3.0::DOUBLE))" for a in (1, 2) for b in (1, 2))}), 5) AS rule_of_thirds_distance
FROM hor JOIN mass USING (image_id) JOIN sym USING (image_id) JOIN sal USING (image_id)""",
    ("v_pixels",),
)
def composition_features(spark, sf_dir):
    """Every composition feature."""
    px = view(spark, sf_dir, "v_pixels")
    got = pixels.composition_features(px, px.withColumn("cloud", (F.col("gray") > 128).cast("int")))
    return got.select("image_id", *[F.round(c, 5).alias(c) for c in _COMPOSED])


# --- streams


def _log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; a file source watches a folder, so the table's own files are picked by name."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/events.parquet*")


def _upserted(spark: SparkSession, folder: str, key: str) -> Callable[..., None]:
    """A sink that keeps the last row of each key in a table."""

    def sink(batch: DataFrame, number: int = 0) -> None:
        old = tables.read_table(spark, folder, batch.schema)
        tables.write_table(keys.upsert(old, batch, [key]), folder)

    return sink


def _rated(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").cast("string").alias("rating_id"), F.regexp_extract("props", "([0-9]+)", 1).alias("image_id"), F.col("user_id").cast("string").alias("rater_id"), F.least(F.lit(10.0), F.col("value") / 10).alias("raw_score_1_to_10"), F.col("ts").alias("rating_timestamp"))


@query(
    """--with placed AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY raw_score_1_to_10) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM v_ratings)
SELECT image_id, round(avg(raw_score_1_to_10), 6) AS mean_score, round(quantile_cont(raw_score_1_to_10, 0.5), 6) AS median_score, round(avg(raw_score_1_to_10) FILTER (WHERE k > n // 10 AND k <= n - n // 10), 6) AS trimmed_mean_score, count(*) AS n_raters FROM placed GROUP BY image_id""",
    ("v_ratings",),
)
def touched_labels(spark, sf_dir):
    """Labels of the items that a stream's batches touch, medians and trimmed means included, from the whole log."""
    base = new_path(spark, "touched")
    log = lambda: _rated(table(spark, sf_dir, "events"))
    streams.touched_labels(_rated(_log_stream(spark, sf_dir)), log, _upserted(spark, f"{base}/labels", "image_id"), labels.aggregate_ratings, f"{base}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{base}/labels")
    return got.select("image_id", _r("mean_score"), _r("median_score"), _r("trimmed_mean_score"), "n_raters")


@query("SELECT CAST(event_id AS STRING) AS image_id, round(value / 10 + 1, 6) AS predicted_score FROM events")
def scores_stream(spark, sf_dir):
    """Items of a stream, scored and kept by their key."""
    base = new_path(spark, "scores")
    score = lambda batch: batch.select(F.col("event_id").cast("string").alias("image_id"), (F.col("value") / 10 + 1).alias("predicted_score"))
    streams.stream_scores(_log_stream(spark, sf_dir), score, _upserted(spark, f"{base}/scores", "image_id"), f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/scores").select("image_id", _r("predicted_score"))


@query("SELECT image_id, CASE WHEN CAST(image_id AS BIGINT) % 2 = 0 THEN -1.0::DOUBLE ELSE round(f_price * 2, 6) END AS score FROM v_features", ("v_features",))
def incremental_scores(spark, sf_dir):
    """Only items that a table lacks are scored; what it has stays."""
    features = view(spark, sf_dir, "v_features")
    have = features.filter(F.col("image_id").cast("long") % 2 == 0).select("image_id", F.lit(-1.0).alias("score"))
    got = jobs.incremental(features, have, "image_id", lambda todo: todo.select("image_id", (F.col("f_price") * 2).alias("score")))
    return got.select("image_id", _r("score"))


@query("SELECT count(*) AS ratings, count(DISTINCT image_id) AS items, count(DISTINCT rater_id) AS raters FROM v_ratings", ("v_ratings",))
def rating_stream(spark, sf_dir):
    """Appended rating logs as a stream, each id once though it was appended twice."""
    base = new_path(spark, "rating-stream")
    for _ in range(2):
        tables.append_ratings(view(spark, sf_dir, "v_ratings"), f"{base}/log")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(f"{base}/seen")

    streams.rating_stream(spark, f"{base}/log").writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/seen").agg(F.count(F.lit(1)).alias("ratings"), F.count_distinct("image_id").alias("items"), F.count_distinct("rater_id").alias("raters"))
