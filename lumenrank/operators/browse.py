"""What a labelling page asks for: pages of items, orders, progress and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.functions.ranks import global_row_number
from lumenrank.operators.manifest import item_kind
from lumenrank.operators.splits import seeded


def _rated(ratings: DataFrame, rater: str) -> DataFrame:
    return ratings.filter(F.col("rater_id") == rater).select("image_id").distinct().withColumn("_rated", F.lit(True))


def gallery(manifest: DataFrame, ratings: DataFrame, rater: str, status: str = "all", kind: str = "all", page: int = 1, size: int = 24) -> DataFrame:
    """A page of items by path, with labelled, kind, position, and the page count and counts of what the filters leave."""
    items = manifest.join(_rated(ratings, rater), "image_id", "left").withColumn("labelled", F.coalesce("_rated", F.lit(False))).withColumn("kind", item_kind(F.col("relative_path"))).drop("_rated")
    if status != "all":
        items = items.filter(F.col("labelled") == (status == "labelled"))
    if kind != "all":
        items = items.filter(F.col("kind") == kind)
    counts = items.agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("pages"), F.count_if("labelled").alias("n_labelled"), F.count_if(~F.col("labelled")).alias("n_open"))
    placed = global_row_number(items, [F.col("relative_path"), F.col("image_id")], "position")
    return placed.filter(F.col("position").between((page - 1) * size + 1, page * size)).crossJoin(F.broadcast(counts))


def random_order(df: DataFrame, seed: int) -> DataFrame:
    """df with position: a reproducible shuffle."""
    return global_row_number(df, [seeded(seed, "image_id"), F.col("image_id")], "position")


def diverse_order(df: DataFrame, group: str, seed: int) -> DataFrame:
    """df with position: one item of each group in turn, shuffled within and among groups."""
    inside = F.row_number().over(Window.partitionBy(group).orderBy(seeded(seed, "image_id"), "image_id"))
    turned = df.withColumn("_turn", inside)
    return global_row_number(turned, [F.col("_turn"), seeded(seed, group), F.col("image_id")], "position").drop("_turn")


def order_items(df: DataFrame, mode: str = "dataset", seed: int = 0, group: str = "capture_session_id") -> DataFrame:
    """df with position by mode: dataset (path), random or diverse."""
    if mode == "random":
        return random_order(df, seed)
    if mode == "diverse":
        return diverse_order(df, group, seed)
    return global_row_number(df, [F.col("relative_path"), F.col("image_id")], "position")


def next_unrated(ordered: DataFrame, rated: DataFrame, position: int) -> DataFrame:
    """One row, next_position: the nearest open item after a position, round the end; with none open the next, at most the last."""
    n = ordered.agg(F.count(F.lit(1)).alias("n"))
    open_items = ordered.join(rated.select("image_id").distinct(), "image_id", "left_anti").select("position").crossJoin(F.broadcast(n))
    ahead = F.pmod(F.col("position") - position - 1, F.col("n"))
    best = open_items.agg(F.min_by("position", ahead).alias("_p"))
    return n.crossJoin(F.broadcast(best)).select(F.coalesce("_p", F.least(F.lit(position + 1).cast("long"), "n")).alias("next_position"))


def progress(manifest: DataFrame, ratings: DataFrame, rater: str) -> DataFrame:
    """rated, open, share of a rater."""
    items = manifest.select("image_id").distinct().join(_rated(ratings, rater), "image_id", "left")
    got = items.agg(F.count_if("_rated").alias("rated"), F.count(F.lit(1)).alias("_n"))
    return got.select("rated", (F.col("_n") - F.col("rated")).alias("open"), F.when(F.col("_n") > 0, F.col("rated") / F.col("_n")).otherwise(0.0).alias("share"))


def dashboard(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n_rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def score_distribution(ratings: DataFrame, column: str = "raw_score_1_to_10") -> DataFrame:
    return ratings.groupBy(F.col(column).alias("score")).agg(F.count(F.lit(1)).alias("n"))


def agreement_ranking(labels: DataFrame, n: int = 10) -> DataFrame:
    return labels.select("image_id", "agreement_index", "n_raters").orderBy(F.desc("agreement_index"), "image_id").limit(n)
