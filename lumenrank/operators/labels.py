"""Labels of items from ratings and preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.functions.shuffles import shuffled
from lumenrank.operators.keys import keep_first
from lumenrank.plans.stages import cut

SCORE = "raw_score_1_to_10"


def normalize_by_rater(ratings: DataFrame) -> DataFrame:
    """ratings with rater_z and normalized_score: standardised per rater, then over all, and put on 0 to 10.

    Deviations are of the population; a rater without any counts as 1.
    """
    rater = ratings.filter(F.col("rater_id").isNotNull()).groupBy("rater_id").agg(F.avg(SCORE).alias("_m"), F.stddev_pop(SCORE).alias("_s"))
    z = (F.col(SCORE) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    scored = ratings.join(rater, "rater_id").withColumn("rater_z", z).drop("_m", "_s")
    # one row
    overall = scored.agg(F.avg("rater_z").alias("_gm"), F.stddev_pop("rater_z").alias("_gs"))
    unit = (F.col("rater_z") - F.col("_gm")) / F.when(F.col("_gs") > 0, F.col("_gs")).otherwise(1.0)
    return scored.crossJoin(F.broadcast(overall)).withColumn("normalized_score", F.least(F.lit(10.0), F.greatest(F.lit(0.0), 5 + 1.5 * unit))).drop("_gm", "_gs")


def win_rate(pairs: DataFrame) -> DataFrame:
    """image_id, pairwise_win_rate: mean of 1 (won), 0.5 (tie) and 0 over an item's preferences.

    A null tie flag is a tie; a missing tie column means none.
    """
    tie = F.coalesce(F.col("tie_flag"), F.lit(True)) if "tie_flag" in pairs.columns else F.lit(False)

    def side(mine: str) -> Column:
        points = F.when(tie, 0.5).when(F.col("winner") == F.col(mine), 1.0).otherwise(0.0)
        return F.struct(F.col(mine).alias("image_id"), points.alias("points"))

    each = pairs.select(F.explode(F.array(side("left_image_id"), side("right_image_id"))).alias("x")).select("x.*")
    return each.filter(F.col("image_id").isNotNull()).groupBy("image_id").agg(F.avg("points").alias("pairwise_win_rate"))


def aggregate_ratings(ratings: DataFrame, pairs: DataFrame | None = None, trim: int = 10) -> DataFrame:
    """Per item: mean, median, trimmed mean (n div trim cut at each end), deviation, error, count, agreement,
    normalised mean and win rate (0.5 where no preference names it)."""
    scored = normalize_by_rater(ratings).filter(F.col("image_id").isNotNull())
    w = Window.partitionBy("image_id")
    place = F.row_number().over(w.orderBy(SCORE))
    n = F.count(F.lit(1)).over(w)
    placed = scored.withColumn("_p", place).withColumn("_n", n).withColumn("_cut", F.expr(f"_n div {trim}"))
    inner = F.when((F.col("_p") > F.col("_cut")) & (F.col("_p") <= F.col("_n") - F.col("_cut")), F.col(SCORE))
    labels = placed.groupBy("image_id").agg(
        F.avg(SCORE).alias("mean_score"),
        F.percentile(SCORE, F.lit(0.5)).alias("median_score"),
        F.avg(inner).alias("trimmed_mean_score"),
        F.stddev_pop(SCORE).alias("std_score"),
        (F.stddev_pop(SCORE) / F.sqrt(F.count(F.lit(1)))).alias("sem_score"),
        F.count(F.lit(1)).alias("n_raters"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.stddev_pop(SCORE) / 5)).alias("agreement_index"),
        F.avg("normalized_score").alias("normalized_mean_score"),
    )
    if pairs is None:
        return labels.withColumn("pairwise_win_rate", F.lit(0.5))
    return labels.join(win_rate(pairs), "image_id", "left").withColumn("pairwise_win_rate", F.coalesce("pairwise_win_rate", F.lit(0.5)))


#: Ratings of a rater in one part, about, where pairs are made.
PART_RATINGS = 2_000


def _implied(both: DataFrame, *kept: str) -> DataFrame:
    """Preferences of rows with the columns rating_id, image_id, score and at of the earlier (_e) and the later rating (_l)."""
    earlier, later = F.col("_e"), F.col("_l")
    return both.select(
        F.sha2(F.concat_ws("|", earlier["rating_id"], later["rating_id"]), 256).alias("pair_id"),
        earlier["image_id"].alias("left_image_id"),
        later["image_id"].alias("right_image_id"),
        "rater_id",
        F.when(earlier["score"] > later["score"], earlier["image_id"]).otherwise(later["image_id"]).alias("winner"),
        F.lit(False).alias("tie_flag"),
        F.abs(earlier["score"] - later["score"]).alias("preference_strength"),
        later["at"].alias("timestamp"),
        F.lit("derived_from_ratings").alias("source"),
        *kept,
    )


def _drawn_pairs(numbered: DataFrame, min_gap: float, most: int) -> DataFrame:
    """rater_id, _e, _l of at most `most` of each rater's pairs that are min_gap apart.

    In the order of their scores, the ratings that lie min_gap below one are the first so many. So a rater's pairs have
    numbers, running over the upper rating; a keyed bijection draws `most` of them, and each number leads back to its two ratings.
    """
    order = Window.partitionBy("rater_id").orderBy("score", "n")
    below = F.expr(f"count(1) OVER (PARTITION BY rater_id ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND {float(min_gap)}D PRECEDING)")
    placed = cut(numbered.withColumn("place", F.row_number().over(order) - 1).withColumn("below", below).withColumn("upto", F.sum("below").over(order)), "placed")
    raters = placed.groupBy("rater_id").agg(F.max("upto").alias("pairs")).filter("pairs > 0")
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("pairs"), F.lit(most)) - 1)).alias("k")
    draws = raters.select("rater_id", "pairs", some).withColumn("drawn", F.when(F.col("pairs") <= most, F.col("k")).otherwise(shuffled(F.col("k"), F.col("pairs"), 42)))
    # the upper rating of a number is the first whose running count exceeds it
    marks = placed.filter("below > 0").select("rater_id", F.col("upto").alias("at"), F.lit(1).alias("mark"), F.struct("n", "x", "below", "upto").alias("up"))
    asked = draws.select("rater_id", F.col("drawn").alias("at"), F.lit(0).alias("mark"), F.lit(None).cast(marks.schema["up"].dataType).alias("up"))
    following = Window.partitionBy("rater_id").orderBy(F.desc("at"), F.desc("mark")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a mark at the same place ends before the number
    found = asked.withColumn("at", F.col("at") + 0.5).unionByName(marks.withColumn("at", F.col("at").cast("double"))).withColumn("up", F.last("up", ignorenulls=True).over(following)).filter("mark = 0")
    found = found.select("rater_id", F.col("up.n").alias("n1"), F.col("up.x").alias("x1"), (F.col("at") - 0.5 - (F.col("up.upto") - F.col("up.below"))).cast("int").alias("place"))
    both = found.join(placed.select("rater_id", "place", F.col("n").alias("n2"), F.col("x").alias("x2")), ["rater_id", "place"])
    swap = F.col("n1") < F.col("n2")
    return both.select("rater_id", F.when(swap, F.col("x1")).otherwise(F.col("x2")).alias("_e"), F.when(swap, F.col("x2")).otherwise(F.col("x1")).alias("_l"))


def pseudo_pairs(ratings: DataFrame, min_gap: float = 2.0, max_pairs_per_rater: int | None = None) -> DataFrame:
    """Preferences that a rater's own ratings imply: every two ratings at least min_gap apart, the earlier on the left.

    The rows of a rater grow with the square of the rater's ratings. A prolific rater is spread over tasks: left rows
    are dealt to parts of about ``PART_RATINGS``, and each part meets all right rows. max_pairs_per_rater (off by default)
    draws so many of a rater's pairs by their numbers, before any are made.
    """
    order = Window.partitionBy("rater_id").orderBy("rating_timestamp", "rating_id")
    x = F.struct("rating_id", "image_id", F.col(SCORE).alias("score"), F.col("rating_timestamp").alias("at")).alias("x")
    numbered = ratings.filter(F.col("rater_id").isNotNull() & F.col(SCORE).isNotNull()).select("rater_id", F.col(SCORE).cast("double").alias("score"), F.row_number().over(order).alias("n"), x)
    if max_pairs_per_rater is not None:
        return _implied(_drawn_pairs(numbered, min_gap, max_pairs_per_rater))
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("rater_id")) / PART_RATINGS).cast("int")
    dealt = numbered.withColumn("parts", parts)
    left = dealt.select("rater_id", F.pmod("n", "parts").alias("part"), F.col("n").alias("n1"), F.col("score").alias("s1"), F.col("x").alias("_e"))
    right = dealt.select("rater_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("n").alias("n2"), F.col("score").alias("s2"), F.col("x").alias("_l"))
    return _implied(left.join(right, ["rater_id", "part"]).filter((F.col("n1") < F.col("n2")) & (F.abs(F.col("s1") - F.col("s2")) >= min_gap)))


def merge_pairs(explicit: DataFrame, derived: DataFrame) -> DataFrame:
    """Both kinds of preferences, one for each (left, right, rater, timestamp); explicit ones win."""
    a = explicit.withColumn("_rank", F.lit(0))
    b = derived.withColumn("_rank", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    return keep_first(both, PAIR_KEYS, [F.col("_rank"), F.col("pair_id")]).drop("_rank")


#: Implied preferences that a task makes, about, where they are sorted in its memory.
TASK_PAIRS = 500_000

#: What tells one preference from another.
PAIR_KEYS = ["left_image_id", "right_image_id", "rater_id", "timestamp"]


def _distinct_pairs(ratings: DataFrame, min_gap: float) -> DataFrame:
    """pseudo_pairs, one for each (left, right, rater, timestamp), the least pair_id.

    Only ratings are shuffled: the later ones are dealt to parts by item and time, so that preferences with the same
    key arise in the same task, which sorts its own. There are so many tasks that each makes about TASK_PAIRS.
    """
    order = Window.partitionBy("rater_id").orderBy("rating_timestamp", "rating_id")
    rater = Window.partitionBy("rater_id")
    x = F.struct("rating_id", "image_id", F.col(SCORE).alias("score"), F.col("rating_timestamp").alias("at")).alias("x")
    known = ratings.filter(F.col("rater_id").isNotNull() & F.col(SCORE).isNotNull())
    sizes = known.groupBy("rater_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    tasks = int((sizes.agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0) / TASK_PAIRS) + 1
    numbered = known.select("rater_id", F.col(SCORE).cast("double").alias("score"), F.row_number().over(order).alias("n"), x, F.ceil(F.count(F.lit(1)).over(rater) / PART_RATINGS).cast("int").alias("parts"))
    left = numbered.select("rater_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("n").alias("n1"), F.col("score").alias("s1"), F.col("x").alias("_e"))
    right = numbered.select("rater_id", F.pmod(F.xxhash64("x.image_id", "x.at"), "parts").cast("int").alias("part"), F.col("n").alias("n2"), F.col("score").alias("s2"), F.col("x").alias("_l"))
    left, right = (side.repartition(tasks, "rater_id", "part") for side in (left, right))
    both = left.hint("merge").join(right, ["rater_id", "part"]).filter((F.col("n1") < F.col("n2")) & (F.abs(F.col("s1") - F.col("s2")) >= min_gap))
    return keep_first(_implied(both, "part"), [*PAIR_KEYS, "part"], [F.col("pair_id")]).drop("part")


def merged_pairs(explicit: DataFrame, ratings: DataFrame, min_gap: float = 2.0) -> DataFrame:
    """merge_pairs of explicit preferences and those that ratings imply, without a shuffle of the implied ones.

    Only those of raters who also gave explicit ones can meet an explicit one; these alone are merged with them.
    """
    both = cut(explicit.select("rater_id").distinct().join(ratings.select("rater_id").distinct(), "rater_id"), "raters")
    stamp = explicit.schema["timestamp"].dataType
    stamped = lambda df: df.withColumn("timestamp", F.col("timestamp").cast(stamp))
    met = merge_pairs(explicit, stamped(pseudo_pairs(ratings.join(both, "rater_id", "left_semi"), min_gap)))
    return met.unionByName(stamped(_distinct_pairs(ratings.join(both, "rater_id", "left_anti"), min_gap)), allowMissingColumns=True)
