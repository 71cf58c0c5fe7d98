"""Rating tables as views over the driver's tables; a text runs in Spark SQL and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_ratings": """SELECT CAST(event_id AS STRING) AS rating_id, regexp_extract(props, '([0-9]+)', 1) AS image_id,
  CAST(user_id AS STRING) AS rater_id, CAST(CAST(ts AS DATE) AS STRING) AS rating_session_id,
  least(CAST(10 AS DOUBLE), value / 10) AS raw_score_1_to_10, ts AS rating_timestamp, event_type AS note FROM events""",
    "v_ratings_wide": """SELECT CAST(l_partkey AS STRING) AS image_id, CAST(l_suppkey AS STRING) AS rater_id,
  CAST(l_quantity AS DOUBLE) / 5 AS raw_score_1_to_10, l_shipdate AS rating_timestamp FROM lineitem""",
    "v_pairs": """SELECT CAST(o_orderkey AS STRING) AS pair_id, CAST(o_custkey % 200 AS STRING) AS left_image_id,
  CAST(o_orderkey % 200 AS STRING) AS right_image_id, o_orderpriority AS rater_id,
  CASE o_orderstatus WHEN 'F' THEN CAST(o_custkey % 200 AS STRING) WHEN 'O' THEN CAST(o_orderkey % 200 AS STRING) END AS winner,
  o_orderstatus = 'P' AS tie_flag, CAST(o_totalprice AS DOUBLE) / 500000 AS preference_strength, o_orderdate AS timestamp
  FROM orders WHERE o_custkey % 200 <> o_orderkey % 200""",
    "v_manifest": """SELECT CAST(p_partkey AS STRING) AS image_id,
  'data/' || p_brand || CASE WHEN p_size % 3 = 0 THEN '/crops/' ELSE '/originals/' END || CAST(p_partkey AS STRING) || '.jpg' AS relative_path,
  md5(p_name || p_brand || CAST(p_size AS STRING)) AS sha256, p_size * 40 + 200 AS width, p_size * 30 + 200 AS height,
  p_type AS import_batch_id, p_brand AS capture_session_id, p_brand || '_' || CAST(p_size AS STRING) AS split_group_id FROM part""",
    "v_labels": """SELECT CAST(l_partkey AS STRING) AS image_id, avg(CAST(l_quantity AS DOUBLE) / 5) AS mean_score, count(*) AS n_raters
  FROM lineitem GROUP BY l_partkey""",
    "v_features": """SELECT CAST(p_partkey AS STRING) AS image_id, CAST(avg(l_extendedprice) AS DOUBLE) / 10000 AS f_price, CAST(avg(l_discount) AS DOUBLE) AS f_discount,
  CAST(avg(l_tax) AS DOUBLE) AS f_tax, CAST(max(l_quantity) AS DOUBLE) AS f_max_qty, CAST(count(*) AS DOUBLE) AS f_n, CAST(max(p_retailprice) AS DOUBLE) / 1000 AS f_retail,
  max(CASE WHEN p_size % 17 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END) AS f_size
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey""",
    "v_predictions": """SELECT l_returnflag AS model, CAST(l_partkey AS STRING) AS image_id, CAST(l_quantity AS DOUBLE) / 5 AS y,
  least(CAST(10 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(l_quantity AS DOUBLE) / 5 + (CAST(l_discount AS DOUBLE) - 0.05) * 20)) AS p, CAST(l_tax AS DOUBLE) * 10 AS uncertainty,
  l_linestatus AS kind, l_shipdate AS created_at FROM lineitem""",
    "v_binary": """SELECT l.doc_id AS id, l.quality AS y, CAST(d.n_chars AS DOUBLE) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "v_exclusions": """SELECT event_id AS seq, CAST(user_id AS STRING) AS image_id,
  CASE event_type WHEN 'error' THEN 'True' WHEN 'signup' THEN ' YES' ELSE 'False' END AS excluded, event_type AS reason, ts AS timestamp FROM events""",
    "v_collection": """SELECT doc_id AS position, md5(text) AS item_id, source || '/' || CAST(n_chars AS STRING) AS url, source AS collection,
  CASE lang WHEN 'en' THEN 'CC-BY-SA 4.0' WHEN 'de' THEN 'CC0' WHEN 'fr' THEN 'All rights reserved' ELSE 'Public Domain' END AS license,
  n_chars AS width FROM documents""",
}

_PIXELS = """SELECT CAST(vec_id AS STRING) AS image_id, CAST(floor(i / 8) AS INT) AS y, CAST(i % 8 AS INT) AS x,
  CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.6) / 1.2 * 255))) AS DOUBLE) AS gray
  FROM (SELECT vec_id, {cells} FROM embeddings)"""
SPARK_PIXELS = _PIXELS.format(cells="posexplode(embedding) AS (i, e)")
DUCKDB_PIXELS = _PIXELS.format(cells="unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; its base tables are bound when it is made."""
    text = SPARK_PIXELS if name == "v_pixels" else VIEWS[name]
    for t in TABLES:
        if f" {t}" in text:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def pixel_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 x 8 rasters in colours: red falls to the right, blue downwards."""
    from pyspark.sql import functions as F

    return view(spark, sf_dir, "v_pixels").select("image_id", "y", "x", (F.col("gray") * (8 - F.col("x")) / 8).alias("r"), F.col("gray").alias("g"), (F.col("gray") * (8 - F.col("y")) / 8).alias("b"))


def with_views(*names: str) -> str:
    """The WITH clause of a DuckDB query over views."""
    return "WITH " + ",\n".join(f"{n} AS ({DUCKDB_PIXELS if n == 'v_pixels' else VIEWS[n]})" for n in names)
