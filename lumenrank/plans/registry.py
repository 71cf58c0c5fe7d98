"""Registered queries over the driver's tables, and the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.operators import analysis, browse, concepts, curation, keys, labels, manifest, metrics, models, pixels, reports, splits, validation
from lumenrank.plans import jobs
from lumenrank.plans.fixtures import VIEWS, pixel_cubes, table, view
from lumenrank.plans.registering import QUERIES, SQL, Query, query
from lumenrank.plans.registering import rounded as _r
from lumenrank.plans.stages import cut, new_path
from lumenrank.streaming import streams



# --- labels

_NORMAL = """--with rated AS (
  SELECT *, (raw_score_1_to_10 - avg(raw_score_1_to_10) OVER w) / coalesce(nullif(stddev_pop(raw_score_1_to_10) OVER w, 0), 1) AS z FROM v_ratings_wide WINDOW w AS (PARTITION BY rater_id)),
g AS (SELECT avg(z) AS m, coalesce(nullif(stddev_pop(z), 0), 1) AS s FROM rated),
normal AS (SELECT rated.*, least(10, greatest(0, 5 + 1.5 * (z - m) / s)) AS nz FROM rated, g)
"""


@query(_NORMAL + "SELECT image_id, rater_id, raw_score_1_to_10 AS score, round(z, 6) AS rater_z, round(nz, 6) AS normalized_score FROM normal", ("v_ratings_wide",))
def normalize_by_rater(spark, sf_dir):
    got = labels.normalize_by_rater(view(spark, sf_dir, "v_ratings_wide"))
    return got.select("image_id", "rater_id", F.col("raw_score_1_to_10").alias("score"), _r("rater_z"), _r("normalized_score"))


_RATES = "rates AS (SELECT image_id, avg(pt) AS rate FROM (SELECT left_image_id AS image_id, CASE WHEN tie_flag THEN 0.5 WHEN winner = left_image_id THEN 1.0 ELSE 0.0 END AS pt FROM v_pairs UNION ALL SELECT right_image_id, CASE WHEN tie_flag THEN 0.5 WHEN winner = right_image_id THEN 1.0 ELSE 0.0 END FROM v_pairs) GROUP BY image_id)"


@query(f"--with {_RATES} SELECT image_id, round(rate, 6) AS pairwise_win_rate FROM rates", ("v_pairs",))
def win_rate(spark, sf_dir):
    return labels.win_rate(view(spark, sf_dir, "v_pairs")).select("image_id", _r("pairwise_win_rate"))


@query(
    _NORMAL
    + f""", {_RATES},
placed AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY raw_score_1_to_10) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM normal),
got AS (SELECT image_id, avg(raw_score_1_to_10) AS a, quantile_cont(raw_score_1_to_10, 0.5) AS med, avg(raw_score_1_to_10) FILTER (WHERE k > n // 10 AND k <= n - n // 10) AS tr, stddev_pop(raw_score_1_to_10) AS sd, count(*) AS c, avg(nz) AS nm FROM placed GROUP BY image_id)
SELECT got.image_id, round(a, 6) AS mean_score, round(med, 6) AS median_score, round(tr, 6) AS trimmed_mean_score, round(sd, 6) AS std_score, round(sd / sqrt(c), 6) AS sem_score, c AS n_raters,
  round(least(1, greatest(0, 1 - sd / 5)), 6) AS agreement_index, round(nm, 6) AS normalized_mean_score, round(coalesce(rate, 0.5), 6) AS pairwise_win_rate FROM got LEFT JOIN rates ON got.image_id = rates.image_id""",
    ("v_ratings_wide", "v_pairs"),
)
def aggregate_ratings(spark, sf_dir):
    got = labels.aggregate_ratings(view(spark, sf_dir, "v_ratings_wide"), view(spark, sf_dir, "v_pairs"))
    return got.select(*[c if c in ("image_id", "n_raters") else _r(c) for c in got.columns])


_PSEUDO = """--with numbered AS (SELECT *, row_number() OVER (PARTITION BY rater_id ORDER BY rating_timestamp, rating_id) AS n FROM v_ratings),
derived AS (SELECT a.image_id AS left_image_id, b.image_id AS right_image_id, a.rater_id, CASE WHEN a.raw_score_1_to_10 > b.raw_score_1_to_10 THEN a.image_id ELSE b.image_id END AS winner, abs(a.raw_score_1_to_10 - b.raw_score_1_to_10) AS strength, b.rating_timestamp AS ts, sha256(a.rating_id || '|' || b.rating_id) AS pair_id
  FROM numbered a JOIN numbered b ON a.rater_id = b.rater_id AND a.n < b.n AND abs(a.raw_score_1_to_10 - b.raw_score_1_to_10) >= 2.0)
"""


@query(_PSEUDO + "SELECT pair_id, left_image_id, right_image_id, rater_id, winner, round(strength, 6) AS preference_strength FROM derived", ("v_ratings",))
def pseudo_pairs(spark, sf_dir):
    got = labels.pseudo_pairs(view(spark, sf_dir, "v_ratings"))
    return got.select("pair_id", "left_image_id", "right_image_id", "rater_id", "winner", _r("preference_strength"))


@query(
    _PSEUDO
    + """, both_kinds AS (SELECT pair_id, left_image_id, right_image_id, rater_id, winner, CAST(timestamp AS TIMESTAMP) AS ts, 0 AS k FROM v_pairs UNION ALL SELECT pair_id, left_image_id, right_image_id, rater_id, winner, ts, 1 FROM derived)
SELECT left_image_id, right_image_id, rater_id, winner, k = 0 AS explicit FROM (SELECT *, row_number() OVER (PARTITION BY left_image_id, right_image_id, rater_id, ts ORDER BY k, pair_id) AS r FROM both_kinds) WHERE r = 1""",
    ("v_ratings", "v_pairs"),
)
def merge_pairs(spark, sf_dir):
    explicit = view(spark, sf_dir, "v_pairs").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    ratings = view(spark, sf_dir, "v_ratings").withColumn("rating_timestamp", F.col("rating_timestamp").cast("timestamp"))
    got = labels.merged_pairs(explicit, ratings)
    return got.select("left_image_id", "right_image_id", "rater_id", "winner", F.col("source").isNull().alias("explicit"))


@query(
    """SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN s IS NULL THEN ['score_missing'] WHEN s < 0 OR s > 10 THEN ['score_range'] ELSE ['valid'] END) AS reason FROM (SELECT value / 5 AS s FROM events)) GROUP BY reason"""
)
def validate_ratings(spark, sf_dir):
    rated = view(spark, sf_dir, "v_ratings").withColumn("rating_id", F.col("rating_id").cast("long")).drop("raw_score_1_to_10")
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("rating_id"), (F.col("value") / 5).alias("raw_score_1_to_10"))
    valid, rejected = validation.validate(rated.join(raw, "rating_id"), validation.rating_rules())
    return valid.select(F.lit("valid").alias("reason")).unionByName(rejected.select(F.explode("reasons").alias("reason"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- exclusions and manifest

_ACTIVE = "active AS (SELECT image_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY timestamp DESC, seq DESC) AS r FROM v_exclusions) WHERE r = 1 AND lower(trim(excluded)) IN ('1', 'true', 'yes', 'y'))"


@query(f"--with {_ACTIVE} SELECT image_id, reason FROM active", ("v_exclusions",))
def active_exclusions(spark, sf_dir):
    return manifest.active_exclusions(view(spark, sf_dir, "v_exclusions"), ["timestamp", "seq"])


@query(f"--with {_ACTIVE} SELECT image_id, relative_path FROM v_manifest WHERE image_id NOT IN (SELECT image_id FROM active)", ("v_exclusions", "v_manifest"))
def drop_excluded(spark, sf_dir):
    return manifest.drop_excluded(view(spark, sf_dir, "v_manifest"), view(spark, sf_dir, "v_exclusions"), ["timestamp", "seq"]).select("image_id", "relative_path")


@query(
    f"""--with {_ACTIVE}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY relative_path, image_id) AS r FROM v_manifest) WHERE r = 1)
SELECT image_id, relative_path, string_split(relative_path, '/')[-2] AS capture_session_id, string_split(relative_path, '/')[-2] || '_' || sha256[1:12] AS split_group_id, CASE WHEN contains(relative_path, '/crops/') THEN 'crop' ELSE 'original' END AS kind FROM firsts WHERE image_id NOT IN (SELECT image_id FROM active)""",
    ("v_exclusions", "v_manifest"),
)
def build_manifest(spark, sf_dir):
    scan = view(spark, sf_dir, "v_manifest").drop("split_group_id", "capture_session_id").withColumn("phash", F.col("sha256"))
    last = keys.keep_first(view(spark, sf_dir, "v_exclusions"), ["image_id"], [F.desc("timestamp"), F.desc("seq")])
    got = manifest.build_manifest(scan, exclusions=last)
    return got.select("image_id", "relative_path", "capture_session_id", "split_group_id", manifest.item_kind(F.col("relative_path")).alias("kind"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_by_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return manifest.first_by_hash(docs, "sha256", "doc_id")


@query(
    """SELECT p_partkey, coalesce(nullif(trim(left(regexp_replace(p_name || '/' || p_type || ' #1', '[^a-zA-Z0-9_-]', '_', 'g'), 80), '_'), ''), 'image') AS name,
  regexp_replace(regexp_replace(p_name || '#' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') || '.png' AS file FROM part"""
)
def safe_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = manifest.safe_name(F.concat_ws("", "p_name", F.lit("/"), "p_type", F.lit(" #1")))
    file = manifest.safe_filename(F.concat(F.lit("File:"), "p_name", F.lit("%23"), "p_brand", F.lit(".PNG")))
    return part.select("p_partkey", name.alias("name"), file.alias("file"))


@query("SELECT import_batch_id, row_number() OVER (ORDER BY import_batch_id DESC) AS k FROM (SELECT DISTINCT import_batch_id FROM v_manifest WHERE trim(import_batch_id) <> '')", ("v_manifest",))
def list_batches(spark, sf_dir):
    from lumenrank.functions.ranks import global_row_number

    return global_row_number(manifest.list_batches(view(spark, sf_dir, "v_manifest")), [F.desc("import_batch_id")], "k")


# --- splits

_BINS = """--with rounded AS (SELECT image_id, round(mean_score, 6) AS mean_score FROM v_labels),
edges AS (SELECT quantile_cont(mean_score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM rounded),
binned AS (SELECT image_id, mean_score, CAST(len(list_filter(list_distinct(e), lambda x: x > e[1] AND x < mean_score)) AS INT) AS score_bin FROM rounded, edges)
"""


@query(_BINS + "SELECT image_id, round(mean_score, 6) AS mean_score, score_bin FROM binned", ("v_labels",))
def score_bins(spark, sf_dir):
    return splits.score_bins(_labels(spark, sf_dir), "mean_score").select("image_id", "mean_score", "score_bin")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_labels with scores rounded, as the last digit of a mean depends on the order of its terms."""
    return view(spark, sf_dir, "v_labels").withColumn("mean_score", F.round("mean_score", 6))


_TEST = """groups AS (SELECT DISTINCT split_group_id AS g FROM {src}),
test AS (SELECT g FROM (SELECT g, row_number() OVER (ORDER BY md5('42|' || g), g) AS k, count(*) OVER () AS n FROM groups) WHERE k <= ceil(0.2 * n))"""


@query("--with " + _TEST.format(src="v_manifest") + " SELECT image_id, split_group_id, CASE WHEN g IS NULL THEN 'dev' ELSE 'test' END AS partition FROM v_manifest LEFT JOIN test ON split_group_id = g", ("v_manifest",))
def grouped_holdout(spark, sf_dir):
    return splits.grouped_holdout(view(spark, sf_dir, "v_manifest"), "split_group_id").select("image_id", "split_group_id", "partition")


_SPLITS = (
    _BINS
    + """, merged AS (SELECT b.image_id, split_group_id, score_bin, mean_score FROM v_manifest m JOIN binned b ON m.image_id = b.image_id), """
    + _TEST.format(src="merged")
    + """, parted AS (SELECT *, g IS NOT NULL AS held FROM merged LEFT JOIN test ON split_group_id = g),
counts AS (SELECT split_group_id, score_bin, count(*) AS k FROM parted WHERE NOT held GROUP BY 1, 2),
sized AS (SELECT split_group_id, sum(k) AS size, arg_max(score_bin, k * 1000 - score_bin) AS b FROM counts GROUP BY 1),
dealt AS (SELECT split_group_id, row_number() OVER (PARTITION BY b ORDER BY size DESC, md5('42|' || split_group_id), split_group_id) - 1 AS p FROM sized),
folded AS (SELECT split_group_id, CAST(CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS INT) AS fold FROM dealt),
split_table AS (SELECT image_id, parted.split_group_id, score_bin, CASE WHEN held THEN 'test' ELSE 'dev' END AS partition, CASE WHEN held THEN -1 ELSE fold END AS fold, mean_score FROM parted LEFT JOIN folded ON parted.split_group_id = folded.split_group_id)
"""
)


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.grouped_splits(view(spark, sf_dir, "v_manifest"), _labels(spark, sf_dir))


@query(_SPLITS + "SELECT image_id, split_group_id, score_bin, partition, fold FROM split_table", ("v_labels", "v_manifest"))
def grouped_splits(spark, sf_dir):
    return _splits(spark, sf_dir)


@query(_SPLITS + "SELECT partition, fold, count(*) AS items, count(mean_score) AS labelled, round(avg(mean_score), 6) AS mean_score FROM split_table GROUP BY 1, 2", ("v_labels", "v_manifest"))
def split_overview(spark, sf_dir):
    return splits.split_overview(_splits(spark, sf_dir), _labels(spark, sf_dir)).select("partition", "fold", "items", "labelled", _r("mean_score"))


@query(
    _SPLITS
    + "SELECT CASE WHEN partition = 'test' THEN 'test' WHEN fold = 0 THEN 'val' ELSE 'train' END AS role, count(*) AS n, round(sum(mean_score), 4) AS total, round(avg(f_price), 6) AS f_price, count(f_size) AS n_size FROM split_table JOIN v_features USING (image_id) GROUP BY 1",
    ("v_labels", "v_manifest", "v_features"),
)
def training_frame(spark, sf_dir):
    frame = splits.training_frame(view(spark, sf_dir, "v_features"), _labels(spark, sf_dir), _splits(spark, sf_dir))
    return frame.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mean_score"), 4).alias("total"), _r(F.avg("f_price"), "f_price"), F.count("f_size").alias("n_size"))


@query(
    """SELECT left_image_id, right_image_id, CAST(winner = left_image_id AS INT) AS y, round(a.f_price - b.f_price, 6) AS f_price, round(a.f_tax - b.f_tax, 6) AS f_tax, round(a.f_size - b.f_size, 6) AS f_size
FROM v_pairs JOIN v_features a ON left_image_id = a.image_id JOIN v_features b ON right_image_id = b.image_id WHERE NOT tie_flag AND winner IS NOT NULL""",
    ("v_pairs", "v_features"),
)
def pair_features(spark, sf_dir):
    got = models.pair_features(view(spark, sf_dir, "v_features"), view(spark, sf_dir, "v_pairs"))
    return got.select("left_image_id", "right_image_id", "y", _r("f_price"), _r("f_tax"), _r("f_size"))


# --- metrics

_RANKED = """--with ranked AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY y) + (count(*) OVER (PARTITION BY model, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS rp,
  least(10, greatest(1, round_even(y, 0))) AS i, least(10, greatest(1, round_even(p, 0))) AS j FROM v_predictions)
"""
_KAPPA = "1 - avg((i - j) * (i - j)) / (avg(i * i) + avg(j * j) - 2 * avg(i) * avg(j))"


@query(
    _RANKED
    + f"SELECT model, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(corr(y, p), 6) AS pearson, round(corr(ry, rp), 6) AS spearman, round({_KAPPA}, 6) AS qwk FROM ranked GROUP BY model",
    ("v_predictions",),
)
def regression_metrics(spark, sf_dir):
    got = metrics.regression_metrics(view(spark, sf_dir, "v_predictions"), by=["model"])
    return got.select("model", "n", *[_r(c) for c in ("mae", "rmse", "r2", "pearson", "spearman", "qwk")])


@query(
    """--with ranked AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM v_predictions)
SELECT count(*) AS n, round(corr(ry, rp), 6) AS spearman FROM ranked""",
    ("v_predictions",),
)
def global_spearman(spark, sf_dir):
    return metrics.regression_metrics(view(spark, sf_dir, "v_predictions")).select("n", _r("spearman"))


@query(_RANKED + f"SELECT model, round({_KAPPA}, 6) AS qwk FROM ranked GROUP BY model", ("v_predictions",))
def qwk(spark, sf_dir):
    return metrics.qwk(view(spark, sf_dir, "v_predictions"), by=["model"]).select("model", _r("qwk"))


@query(
    """--with ranked AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM v_binary),
s AS (SELECT count(*) AS n, CAST(sum(y) AS DOUBLE) AS n1, sum(r) FILTER (WHERE y = 1) AS sr, avg(CAST((score >= 0.5)::INT = y AS DOUBLE)) AS acc FROM ranked),
t AS (SELECT sum(k * (k - 1) / 2) AS tied FROM (SELECT count(*) AS k FROM v_binary GROUP BY score)),
a AS (SELECT *, (sr - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) AS auc FROM s)
SELECT n, round(acc, 6) AS accuracy, round(auc, 6) AS roc_auc, round((2 * auc - 1) * sqrt(n1 * (n - n1) / (CAST(n AS DOUBLE) * (n - 1) / 2 - tied)), 6) AS kendall_tau FROM a, t""",
    ("v_binary",),
)
def ranking_metrics(spark, sf_dir):
    got = metrics.ranking_metrics(view(spark, sf_dir, "v_binary"))
    return got.select("n", _r("accuracy"), _r("roc_auc"), _r("kendall_tau"))


@query("SELECT model, round(avg(CAST(y BETWEEN p - uncertainty AND p + uncertainty AS DOUBLE)), 6) AS coverage FROM v_predictions GROUP BY model", ("v_predictions",))
def coverage(spark, sf_dir):
    p, u = F.col("p"), F.col("uncertainty")
    return metrics.coverage(view(spark, sf_dir, "v_predictions"), "y", p - u, p + u, ["model"]).select("model", _r("coverage"))


@query(
    """--with e AS (SELECT min(p) AS lo, (max(p) - min(p)) / 10 AS w, count(*) AS n FROM v_predictions),
b AS (SELECT least(floor((p - lo) / w), 9) AS b, count(*) AS k, abs(avg(p) - avg(y)) AS gap, any_value(n) AS n FROM v_predictions, e GROUP BY 1) SELECT round(sum(gap * k / n), 6) AS ece FROM b""",
    ("v_predictions",),
)
def ece(spark, sf_dir):
    return metrics.ece(view(spark, sf_dir, "v_predictions")).select(_r("ece"))


@query("SELECT model, round(quantile_cont(abs(y - p), 0.9), 6) AS half_width FROM v_predictions GROUP BY model", ("v_predictions",))
def conformal(spark, sf_dir):
    return metrics.conformal(view(spark, sf_dir, "v_predictions"), by=["model"]).select("model", _r("half_width"))


@query("SELECT image_id, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std, round(quantile_cont(p, 0.1), 6) AS p10, round(quantile_cont(p, 0.9), 6) AS p90 FROM v_predictions GROUP BY image_id", ("v_predictions",))
def ensemble(spark, sf_dir):
    return metrics.ensemble(view(spark, sf_dir, "v_predictions")).select("image_id", *[_r(c) for c in ("mean", "std", "p10", "p90")])


# --- analysis

_LONG = "long_rows AS (UNPIVOT v_features ON f_price, f_discount, f_tax, f_max_qty, f_n, f_retail, f_size INTO NAME feature VALUE value)"


@query(
    f"""--with {_LONG}, rounded AS (SELECT image_id, round(mean_score, 6) AS mean_score FROM v_labels), q AS (SELECT quantile_cont(mean_score, 0.4) AS a, quantile_cont(mean_score, 0.6) AS b, quantile_cont(mean_score, 0.9) AS c FROM rounded JOIN v_features USING (image_id)),
sided AS (SELECT feature, CASE WHEN mean_score >= c THEN value END AS h, CASE WHEN mean_score BETWEEN a AND b THEN value END AS m FROM long_rows JOIN rounded USING (image_id), q),
s AS (SELECT feature, avg(h) AS hm, avg(m) AS mm, count(h) AS nh, count(m) AS nm, var_samp(h) AS vh, var_samp(m) AS vm FROM sided GROUP BY feature)
SELECT feature, round(hm, 6) AS high_mean, round(mm, 6) AS mid_mean, round((hm - mm) / sqrt(((nh - 1) * vh + (nm - 1) * vm) / (nh + nm - 2)), 6) AS effect_size_d, round((hm - mm) / sqrt(vh / nh + vm / nm), 6) AS t_stat FROM s""",
    ("v_features", "v_labels"),
)
def compare_groups(spark, sf_dir):
    features, known = view(spark, sf_dir, "v_features"), _labels(spark, sf_dir).select("image_id", "mean_score")
    high, mid = analysis.quantile_selectors(features.join(known, "image_id"))
    return analysis.compare_groups(features, known, high, mid).select("feature", *[_r(c) for c in ("high_mean", "mid_mean", "effect_size_d", "t_stat")])


@query(
    f"""--with {_LONG} SELECT a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 6) AS r FROM long_rows a JOIN long_rows b ON a.image_id = b.image_id
WHERE list_position(['f_price', 'f_discount', 'f_tax', 'f_max_qty', 'f_n', 'f_retail', 'f_size'], a.feature) < list_position(['f_price', 'f_discount', 'f_tax', 'f_max_qty', 'f_n', 'f_retail', 'f_size'], b.feature) GROUP BY 1, 2""",
    ("v_features",),
)
def correlation(spark, sf_dir):
    return analysis.correlation(view(spark, sf_dir, "v_features")).select("f1", "f2", _r("r"))


@query("SELECT " + ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS {c}" for c in ("f_price", "f_discount", "f_tax", "f_max_qty", "f_n", "f_retail", "f_size")) + " FROM v_features", ("v_features",))
def medians(spark, sf_dir):
    got = analysis.medians(view(spark, sf_dir, "v_features"))
    return got.select(*[_r(c) for c in got.columns])


@query(f"--with {_LONG}, mid AS (SELECT feature, quantile_cont(value, 0.5) AS m FROM long_rows GROUP BY feature) SELECT image_id, feature, round(value, 6) AS value, round(abs(value - m), 6) AS delta FROM long_rows JOIN mid USING (feature)", ("v_features",))
def median_deviation(spark, sf_dir):
    got = analysis.median_deviation(view(spark, sf_dir, "v_features")).filter("value IS NOT NULL")
    return got.select("image_id", "feature", _r("value"), _r("delta"))


_UNIT = "u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))


@query(f"WITH {_UNIT} SELECT b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM u a, u b WHERE a.vec_id = 7 AND b.vec_id <> 7 ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id LIMIT 10")
def nearest(spark, sf_dir):
    return analysis.nearest(_vectors(spark, sf_dir), 7, 10, "vec_id").select("vec_id", _r("similarity"))


_ALL_NEAREST = f"WITH {_UNIT} SELECT query, vec_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS r FROM u a JOIN u b ON a.vec_id <> b.vec_id) WHERE r <= 5"


@query(_ALL_NEAREST)
def nearest_all(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return analysis.nearest_all(v, v, 5, "vec_id").select("query", "vec_id", _r("similarity"), "rank")


@query(_ALL_NEAREST)
def nearest_pruned(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return analysis.nearest_pruned(v, v, 5, "vec_id")[0].select("query", "vec_id", _r("similarity"), "rank")


@query(f"--with {_LONG} SELECT a.feature, round(a.value, 6) AS a, round(b.value, 6) AS b, round(b.value - a.value, 6) AS delta FROM long_rows a JOIN long_rows b ON a.feature = b.feature WHERE a.image_id = '1' AND b.image_id = '2'", ("v_features",))
def compare_items(spark, sf_dir):
    return analysis.compare_items(view(spark, sf_dir, "v_features"), "1", "2").select("feature", _r("a"), _r("b"), _r("delta"))


# --- browsing

@query("SELECT image_id, row_number() OVER (ORDER BY md5('7|' || image_id), image_id) AS position FROM v_manifest", ("v_manifest",))
def random_order(spark, sf_dir):
    return browse.random_order(view(spark, sf_dir, "v_manifest"), 7).select("image_id", "position")


_DIVERSE = "turned AS (SELECT *, row_number() OVER (PARTITION BY capture_session_id ORDER BY md5('7|' || image_id), image_id) AS t FROM v_manifest), ordered AS (SELECT image_id, row_number() OVER (ORDER BY t, md5('7|' || capture_session_id), image_id) AS position FROM turned)"


@query(f"--with {_DIVERSE} SELECT image_id, position FROM ordered", ("v_manifest",))
def diverse_order(spark, sf_dir):
    return browse.order_items(view(spark, sf_dir, "v_manifest"), "diverse", 7).select("image_id", "position")


@query(
    f"""--with {_DIVERSE}, o AS (SELECT position FROM ordered WHERE image_id NOT IN (SELECT image_id FROM v_ratings WHERE rater_id = '5')), n AS (SELECT count(*) AS n FROM ordered)
SELECT coalesce(arg_min(position, ((position - 1501) % n + n) % n), any_value(least(1501, n))) AS next_position FROM n LEFT JOIN o ON true""",
    ("v_manifest", "v_ratings"),
)
def next_unrated(spark, sf_dir):
    ordered = browse.diverse_order(view(spark, sf_dir, "v_manifest"), "capture_session_id", 7)
    return browse.next_unrated(ordered, view(spark, sf_dir, "v_ratings").filter("rater_id = '5'"), 1500)


@query("SELECT count(r.image_id) AS rated, count(*) - count(r.image_id) AS open, round(count(r.image_id) / count(*), 6) AS share FROM v_manifest m LEFT JOIN (SELECT DISTINCT image_id FROM v_ratings WHERE rater_id = '5') r ON m.image_id = r.image_id", ("v_manifest", "v_ratings"))
def progress(spark, sf_dir):
    return browse.progress(view(spark, sf_dir, "v_manifest"), view(spark, sf_dir, "v_ratings"), "5").select("rated", "open", _r("share"))


@query(
    """--with i AS (SELECT m.image_id, relative_path FROM v_manifest m ANTI JOIN (SELECT image_id FROM v_ratings WHERE rater_id = '5') r ON m.image_id = r.image_id WHERE contains(relative_path, '/crops/'))
SELECT image_id, position, CAST(ceil(n / 24.0) AS INT) AS pages, n AS n_open FROM (SELECT image_id, row_number() OVER (ORDER BY relative_path, image_id) AS position, count(*) OVER () AS n FROM i) WHERE position BETWEEN 25 AND 48""",
    ("v_manifest", "v_ratings"),
)
def gallery_page(spark, sf_dir):
    got = browse.gallery(view(spark, sf_dir, "v_manifest"), view(spark, sf_dir, "v_ratings"), "5", "open", "crop", 2, 24)
    return got.select("image_id", "position", "pages", "n_open")


@query("SELECT 'ratings' AS \"table\", count(*) AS n_rows FROM v_ratings UNION ALL SELECT 'pairwise', count(*) FROM v_pairs UNION ALL SELECT 'manifest', count(*) FROM v_manifest UNION ALL SELECT 'features', count(*) FROM v_features UNION ALL SELECT 'labels', count(*) FROM v_labels", ("v_ratings", "v_pairs", "v_manifest", "v_features", "v_labels"))
def dashboard(spark, sf_dir):
    return browse.dashboard({n: view(spark, sf_dir, f"v_{v}") for n, v in (("ratings", "ratings"), ("pairwise", "pairs"), ("manifest", "manifest"), ("features", "features"), ("labels", "labels"))})


@query("SELECT round(raw_score_1_to_10, 6) AS score, count(*) AS n FROM v_ratings_wide GROUP BY 1", ("v_ratings_wide",))
def score_distribution(spark, sf_dir):
    return browse.score_distribution(view(spark, sf_dir, "v_ratings_wide")).select(_r("score"), "n")


# --- reports


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction for each item and model, over v_predictions."""
    p = view(spark, sf_dir, "v_predictions")
    return p.groupBy("model", "image_id").agg(F.avg("p").alias("predicted_score"), F.max("uncertainty").alias("uncertainty"), F.max("created_at").alias("created_at"), F.min("kind").alias("kind")).withColumn("predicted_score", F.round("predicted_score", 6)).withColumn("uncertainty", F.round("uncertainty", 6))


_PRED = "pred AS (SELECT model, image_id, round(avg(p), 6) AS predicted_score, round(max(uncertainty), 6) AS uncertainty, max(created_at) AS created_at, min(kind) AS kind FROM v_predictions GROUP BY 1, 2)"


@query(
    f"""--with {_PRED}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY predicted_score DESC, image_id) AS a, row_number() OVER (PARTITION BY model ORDER BY predicted_score, image_id) AS b, row_number() OVER (PARTITION BY model ORDER BY uncertainty DESC, image_id) AS c FROM pred)
SELECT model, image_id, 'top' AS section, CAST(a AS INT) AS position FROM r WHERE a <= 8 UNION ALL SELECT model, image_id, 'low', CAST(b AS INT) FROM r WHERE b <= 8 UNION ALL SELECT model, image_id, 'uncertain', CAST(c AS INT) FROM r WHERE c <= 8""",
    ("v_predictions",),
)
def triage(spark, sf_dir):
    return reports.triage(_predictions(spark, sf_dir), 8, ["model"]).select("model", "image_id", "section", "position")


@query(f"--with {_PRED} SELECT model || '-' || image_id AS image_id, predicted_score, row_number() OVER (ORDER BY predicted_score DESC, model || '-' || image_id) AS position FROM pred", ("v_predictions",))
def rank_predictions(spark, sf_dir):
    each = _predictions(spark, sf_dir).withColumn("image_id", F.concat_ws("-", "model", "image_id"))
    return reports.rank_predictions(each).select("image_id", "predicted_score", "position")


@query(f"--with {_PRED} SELECT model, kind, count(*) AS n, round(avg(predicted_score), 6) AS mean_score, round(max(predicted_score), 6) AS max_score, round(max(uncertainty), 6) AS max_uncertainty FROM pred GROUP BY 1, 2", ("v_predictions",))
def batch_kpis(spark, sf_dir):
    return reports.batch_kpis(_predictions(spark, sf_dir), ["model", "kind"]).select("model", "kind", "n", _r("mean_score"), _r("max_score"), _r("max_uncertainty"))


@query("SELECT event_id, coalesce(json_extract_string('[' || props || ']', '$[0].k'), '') AS names FROM events")
def json_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", reports.json_names(F.concat(F.lit("["), "props", F.lit("]")), "k").alias("names"))


@query("SELECT event_id FROM events WHERE contains(lower(props), '\"k\": 7')")
def search_predictions(spark, sf_dir):
    return reports.search_predictions(table(spark, sf_dir, "events"), '"K": 7', ("props",)).select("event_id")


@query("SELECT doc_id FROM documents WHERE contains(trim(regexp_replace(lower(CASE lang WHEN 'en' THEN 'CC-BY-SA 4.0' WHEN 'de' THEN 'CC0' WHEN 'fr' THEN 'All rights reserved' ELSE 'Public Domain' END || ' ' || source), '[^a-z0-9]+', ' ', 'g')), 'cc by') OR lang = 'de'")
def licence_filter(spark, sf_dir):
    items = view(spark, sf_dir, "v_collection").filter(curation.licence_allowed([F.col("license"), F.col("collection")], ["cc by", "cc0"]))
    return items.select(F.col("position").alias("doc_id"))


@query("SELECT page_id, sha256(trim(regexp_replace(html, '<[^>]+>', '', 'g'))) AS plain_sha256 FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(curation.strip_tags(F.col("html")), 256).alias("plain_sha256"))


# one row at a time, with the keys of those kept so far
_SELECTED = f"""WITH RECURSIVE v_collection AS ({VIEWS["v_collection"]}),
o AS (SELECT *, row_number() OVER (ORDER BY collection, position) AS n FROM v_collection WHERE width >= 100 AND license <> 'All rights reserved'),
g AS (
  SELECT CAST(0 AS BIGINT) AS n, false AS kept, CAST([] AS VARCHAR[]) AS items, CAST([] AS VARCHAR[]) AS urls
  UNION ALL
  SELECT n, kept, CASE WHEN kept AND item_id IS NOT NULL THEN list_append(items, item_id) ELSE items END, CASE WHEN kept AND url IS NOT NULL THEN list_append(urls, url) ELSE urls END
  FROM (SELECT o.n, o.item_id, o.url, g.items, g.urls, NOT (coalesce(list_contains(g.items, o.item_id), false) OR coalesce(list_contains(g.urls, o.url), false)) AS kept FROM g JOIN o ON o.n = g.n + 1))
SELECT o.position, o.item_id, o.url FROM o JOIN g ON o.n = g.n WHERE g.kept"""


@query(_SELECTED)
def select_collection(spark, sf_dir):
    items = curation.filter_min_size(view(spark, sf_dir, "v_collection").withColumn("height", F.col("width")), 100, 100)
    items = items.filter(curation.licence_allowed([F.col("license")], ["cc", "public domain"]))
    return curation.select_collection(items, "item_id", "url", ["collection", "position"]).select("position", "item_id", "url")


# --- pixels and concepts


def _gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_pixels")


@query("--with n AS (SELECT image_id, gray, count(*) AS k FROM v_pixels GROUP BY 1, 2) SELECT image_id, round(-sum(k / 64.0 * log2(k / 64.0)), 6) AS entropy FROM n GROUP BY image_id", ("v_pixels",))
def pixel_entropy(spark, sf_dir):
    return pixels.entropy(_gray(spark, sf_dir)).select("image_id", _r("entropy"))


@query(
    """--with nb AS (SELECT a.image_id, w, a.gray AS i, b.gray AS j FROM v_pixels a JOIN (SELECT unnest([0, 1]) AS w) ON true JOIN v_pixels b ON a.image_id = b.image_id AND b.x = a.x + 1 AND b.y = a.y - w),
pairs AS (SELECT image_id, w, i, j FROM nb UNION ALL SELECT image_id, w, j, i FROM nb),
c AS (SELECT image_id, w, i, j, count(*) AS k FROM pairs GROUP BY ALL), p AS (SELECT *, k / sum(k) OVER (PARTITION BY image_id, w) AS p FROM c),
m AS (SELECT *, sum(p * i) OVER (PARTITION BY image_id, w) AS mu FROM p),
e AS (SELECT image_id, w, sum(p * (i - j) * (i - j)) AS a, sum(p / (1 + (i - j) * (i - j))) AS b, sqrt(sum(p * p)) AS c, sum(p * (i - mu) * (j - mu)) / sum(p * (i - mu) * (i - mu)) AS d FROM m GROUP BY 1, 2)
SELECT image_id, round(avg(a), 4) AS glcm_contrast, round(avg(b), 6) AS glcm_homogeneity, round(avg(c), 6) AS glcm_energy, round(avg(d), 6) AS glcm_correlation FROM e GROUP BY image_id""",
    ("v_pixels",),
)
def pixel_co_occurrence(spark, sf_dir):
    got = pixels.co_occurrence(_gray(spark, sf_dir))
    return got.select("image_id", F.round("glcm_contrast", 4).alias("glcm_contrast"), *[_r(f"glcm_{c}") for c in ("homogeneity", "energy", "correlation")])


@query("SELECT a.image_id, round(corr(a.gray, b.gray), 6) AS symmetry FROM v_pixels a JOIN v_pixels b ON a.image_id = b.image_id AND a.y = b.y AND a.x = 7 - b.x GROUP BY a.image_id", ("v_pixels",))
def pixel_symmetry(spark, sf_dir):
    return pixels.symmetry(_gray(spark, sf_dir)).select("image_id", _r("symmetry"))


@query("SELECT image_id, CAST(y // 4 AS VARCHAR) || '_' || CAST(x // 4 AS VARCHAR) AS region_id, round(avg(gray), 6) AS mean_importance, round(avg(CAST(gray > 128 AS INT)), 6) AS cloud_fraction, round(count(*) / 64, 6) AS area_fraction FROM v_pixels GROUP BY 1, 2", ("v_pixels",))
def pixel_regions(spark, sf_dir):
    px = _gray(spark, sf_dir).withColumn("cloud", (F.col("gray") > 128).cast("int"))
    return pixels.region_table(px, "gray", tile=4).select("image_id", "region_id", _r("mean_importance"), _r("cloud_fraction"), _r("area_fraction"))


@query(
    """--with e AS (SELECT DISTINCT image_id, s, x // s AS bx, y // s AS by FROM v_pixels, (SELECT unnest([2, 4, 8, 16, 32]) AS s) WHERE gray > 140 AND x < 8 - 8 % s AND y < 8 - 8 % s),
c AS (SELECT image_id, s, count(*) AS n FROM e GROUP BY 1, 2), f AS (SELECT image_id, CASE WHEN count(*) >= 2 THEN -regr_slope(ln(n), ln(s)) ELSE 0 END AS v FROM c GROUP BY image_id)
SELECT i.image_id, round(coalesce(v, 0), 6) + 0.0 AS fractal_dimension_proxy FROM (SELECT DISTINCT image_id FROM v_pixels) i LEFT JOIN f ON i.image_id = f.image_id""",
    ("v_pixels",),
)
def pixel_fractal(spark, sf_dir):
    px = _gray(spark, sf_dir).withColumn("cloud", (F.col("gray") > 140).cast("int"))
    return pixels.fractal_dimension(px).select("image_id", (F.round("fractal_dimension_proxy", 6) + 0.0).alias("fractal_dimension_proxy"))


@query(
    """SELECT image_id, round(avg((r + g + b) / 3), 6) AS mean_brightness, round(stddev_pop((r + g + b) / 3), 6) AS contrast, round(max((r + g + b) / 3) - min((r + g + b) / 3), 6) AS dynamic_range, round((avg(b) + 1) / (avg(r) + 1), 6) AS blue_orange_balance
FROM (SELECT image_id, gray * (8 - x) / 8 AS r, gray AS g, gray * (8 - y) / 8 AS b FROM v_pixels) GROUP BY image_id""",
    ("v_pixels",),
)
def pixel_color(spark, sf_dir):
    return pixels.color_features(pixel_cubes(spark, sf_dir)).select("image_id", *[_r(c) for c in ("mean_brightness", "contrast", "dynamic_range", "blue_orange_balance")])


@query()
def pixel_features(spark, sf_dir):
    got = concepts.with_concepts(pixels.extract(pixel_cubes(spark, sf_dir)))
    return got.select("image_id", *[_r(c) for c in got.columns if c != "image_id"])


# 8 x 8 rasters fill the reduction's 32 x 32 cells, 4 x 4 cells a pixel
@query(
    """--with waves AS (SELECT u, place, sum(sqrt((CASE WHEN u = 0 THEN 1 ELSE 2 END) / 32.0::DOUBLE) * cos(pi() * (2 * (4 * place + j) + 1) * u / 64)) AS w FROM range(8) a(u), range(8) b(place), range(4) c(j) GROUP BY u, place),
freq AS (SELECT image_id, a.u AS u, b.u AS v, round(sum(gray * a.w * b.w), 9) AS c FROM v_pixels JOIN waves a ON a.place = y JOIN waves b ON b.place = x GROUP BY ALL),
mid AS (SELECT image_id, median(c) FILTER (WHERE u > 0) AS m FROM freq GROUP BY image_id)
SELECT image_id, string_agg(CASE WHEN c > m THEN '1' ELSE '0' END, '' ORDER BY u, v) AS phash FROM freq JOIN mid USING (image_id) GROUP BY image_id""",
    ("v_pixels",),
)
def pixel_phash(spark, sf_dir):
    return pixels.phash(_gray(spark, sf_dir))


# every crop's cells are counted one by one
@query(
    """--with sizes AS (SELECT k, CAST(greatest(3, round_even(8 * scale, 0)) AS INT) AS size FROM (VALUES (0, 0.35::DOUBLE), (1, 0.5::DOUBLE), (2, 0.7::DOUBLE), (3, 0.9::DOUBLE), (4, 1.0::DOUBLE)) t(k, scale)),
spots AS (SELECT DISTINCT k, size, p FROM (SELECT k, size, unnest(list_append(range(0, 8 - size + 1, CAST(greatest(1, round_even(size * 0.5::DOUBLE, 0)) AS INT)), 8 - size)) AS p FROM sizes)),
counted AS (SELECT image_id, a.k, a.size, a.p AS top, b.p AS side, sum(CAST(gray > 90 AS INT)) / (a.size * a.size) AS sky, sum(CAST(gray > 130 AS INT)) / (a.size * a.size) AS cloud
  FROM spots a JOIN spots b ON a.k = b.k JOIN v_pixels v ON v.y >= a.p AND v.y < a.p + a.size AND v.x >= b.p AND v.x < b.p + a.size GROUP BY image_id, a.k, a.size, a.p, b.p),
best AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY sky + cloud * 0.5::DOUBLE DESC, size DESC, k, top, side) AS crop FROM counted WHERE sky >= 0.5 AND cloud >= 0.08::DOUBLE)
SELECT image_id, CAST(crop AS INT) AS crop, CAST(side AS INT) AS x, CAST(top AS INT) AS y, size, round(sky, 6) AS sky_fraction, round(cloud, 6) AS cloud_fraction FROM best WHERE crop <= 8""",
    ("v_pixels",),
)
def crop_candidates(spark, sf_dir):
    masks = _gray(spark, sf_dir).withColumn("sky", (F.col("gray") > 90).cast("int")).withColumn("cloud", (F.col("gray") > 130).cast("int"))
    got = pixels.crop_candidates(masks, min_size=3, min_sky=0.5)
    return got.select("image_id", "crop", "x", "y", "size", _r("sky_fraction"), _r("cloud_fraction"))


_CONCEPT_SQL = """--with f AS (SELECT image_id, f_price * 10 AS contrast, f_retail AS entropy, f_discount AS edge_density, f_tax AS horizon_confidence, f_max_qty AS dynamic_range, f_n AS mean_brightness FROM v_features),
c AS (SELECT image_id, 1 / (1 + exp(-(2.0 * edge_density + 0.02 * contrast + 0.3 * entropy))) AS a, 1 / (1 + exp(-(0.02 * dynamic_range + 0.03 * contrast + 0.5 * horizon_confidence))) AS b, 1 / (1 + exp(-(0.04 * contrast - mean_brightness / 255))) AS s, 1 / (1 + exp(-0.03 * dynamic_range)) AS d FROM f)
"""


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"contrast": F.col("f_price") * 10, "entropy": F.col("f_retail"), "edge_density": F.col("f_discount"), "horizon_confidence": F.col("f_tax"), "dynamic_range": F.col("f_max_qty"), "mean_brightness": F.col("f_n")}
    return concepts.with_concepts(view(spark, sf_dir, "v_features").select("image_id", *[c.alias(n) for n, c in names.items()]))


@query(
    _CONCEPT_SQL
    + """SELECT image_id, round(a, 6) AS concept_dramatic_edges, round(b, 6) AS concept_rim_lighting, round(s, 6) AS concept_storm_like, round(d, 6) AS concept_cloud_sky_contrast, round(1 / (1 + exp(-(a + s + 0.5 - 1.5))), 6) AS concept_dramatic_mood, round(1 / (1 + exp(-0.5)), 6) AS concept_strong_depth_cues FROM c""",
    ("v_features",),
)
def concept_scores(spark, sf_dir):
    return _concepts(spark, sf_dir).select("image_id", *[_r(f"concept_{c}") for c in ("dramatic_edges", "rim_lighting", "storm_like", "cloud_sky_contrast", "dramatic_mood", "strong_depth_cues")])


@query(
    _CONCEPT_SQL
    + """, l AS (SELECT image_id, unnest(['concept_dramatic_edges', 'concept_rim_lighting', 'concept_storm_like', 'concept_cloud_sky_contrast', 'concept_dramatic_mood', 'concept_strong_depth_cues', 'concept_towering_clouds', 'concept_crepuscular_rays', 'concept_layered_depth', 'concept_cumulus_like']) AS concept,
  unnest([a, b, s, d, 1 / (1 + exp(-(a + s + 0.5 - 1.5))), 1 / (1 + exp(-0.5)), 0.5, 0.5, 0.5, 0.5]) AS score FROM c)
SELECT image_id, concept, round(score, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, concept) AS r FROM l) WHERE r <= 4""",
    ("v_features",),
)
def top_concepts(spark, sf_dir):
    return concepts.top_concepts(_concepts(spark, sf_dir)).select("image_id", "concept", _r("score"), "rank")


# --- models

def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table, made once from the tables that it is a view of."""
    return cut(view(spark, sf_dir, "v_features"), "features")


def _run(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...], pairs: bool = False, features: DataFrame | None = None) -> models.Run:
    return models.train_baseline(view(spark, sf_dir, "v_features") if features is None else features, _labels(spark, sf_dir), cut(_splits(spark, sf_dir)), view(spark, sf_dir, "v_pairs") if pairs else None, kinds=kinds)


@query()
def train_baseline(spark, sf_dir):
    return _run(spark, sf_dir, ("elasticnet", "random_forest", "gbt")).metrics


@query()
def train_ranking(spark, sf_dir):
    return models.train_ranking(view(spark, sf_dir, "v_features"), view(spark, sf_dir, "v_pairs").filter("pair_id % 5 <> 0"), view(spark, sf_dir, "v_pairs").filter("pair_id % 5 = 0"))["metrics"]


@query()
def feature_embedding(spark, sf_dir):
    got = models.embed(view(spark, sf_dir, "v_features"), 4)
    return got.select("image_id", *[_r(F.abs(F.col(c)), c) for c in got.columns if c != "image_id"])


@query()
def local_contributions(spark, sf_dir):
    features = _features(spark, sf_dir)
    run = _run(spark, sf_dir, ("elasticnet",), features=features)
    return models.local_contributions(run.models["elasticnet"], features, features, k=4).select("image_id", "feature", _r("delta_prediction"))


@query()
def permutation_importance(spark, sf_dir):
    features, known = _features(spark, sf_dir), _labels(spark, sf_dir)
    run = _run(spark, sf_dir, ("elasticnet",), features=features)
    return models.permutation_importance(run.models["elasticnet"], features.join(known, "image_id"), "mean_score")


@query()
def analyze_batches(spark, sf_dir):
    features = _features(spark, sf_dir)
    run = _run(spark, sf_dir, ("elasticnet",), features=features)
    width = run.half_widths.first()["half_width"]
    got = jobs.analyze_batches(view(spark, sf_dir, "v_manifest"), "run", features, run.models["elasticnet"], width, labels=_labels(spark, sf_dir))
    return got.drop("created_at")


# --- streams


def _streamed(spark: SparkSession, sf_dir: str, name: str, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The last complete result of a stream over the events table, as a table in the shared folder."""
    base = new_path(spark, name)
    schema = table(spark, sf_dir, "events").schema
    # a file source watches a folder; the table's own files are picked by name
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/events.parquet*")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result")

    streamed = shape(events)
    streamed.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/result")


@query(
    "SELECT image_id, count(*) AS n_raters, round(avg(raw_score_1_to_10), 6) AS mean_score, round(stddev_pop(raw_score_1_to_10), 6) AS std_score, round(least(1, greatest(0, 1 - stddev_pop(raw_score_1_to_10) / 5)), 6) AS agreement_index FROM v_ratings GROUP BY image_id",
    ("v_ratings",),
)
def labels_stream(spark, sf_dir):
    def shape(events: DataFrame) -> DataFrame:
        rated = events.select(F.regexp_extract("props", "([0-9]+)", 1).alias("image_id"), F.least(F.lit(10.0), F.col("value") / 10).alias("raw_score_1_to_10"))
        return streams.running_labels(rated)

    got = _streamed(spark, sf_dir, "labels", shape)
    return got.select("image_id", "n_raters", _r("mean_score"), _r("std_score"), _r("agreement_index"))


@query(
    "SELECT image_id, excluded, reason FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY timestamp DESC, seq DESC) AS r FROM v_exclusions) WHERE r = 1",
    ("v_exclusions",),
)
def exclusions_stream(spark, sf_dir):
    def shape(events: DataFrame) -> DataFrame:
        said = F.when(F.col("event_type") == "error", "True").when(F.col("event_type") == "signup", " YES").otherwise("False")
        log = events.select(F.col("user_id").cast("string").alias("image_id"), said.alias("excluded"), F.col("event_type").alias("reason"), F.struct(F.col("ts"), F.col("event_id")).alias("timestamp"))
        return streams.exclusion_state(log)

    return _streamed(spark, sf_dir, "exclusions", shape)


# sources, sinks, validation, masks and streams register themselves beside these
from lumenrank.plans import more_queries, stream_queries, whole_job_queries  # noqa: E402, F401

__all__ = ["QUERIES", "SQL", "Query"]
