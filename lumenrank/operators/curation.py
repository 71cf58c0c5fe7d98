"""Selection of collected items by licence, size and first sight of two keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def licence_text(*columns: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", *columns)), "[^a-z0-9]+", " "))


def licence_allowed(columns: list[Column], terms: list[str]) -> Column:
    """Whether any allowed term occurs in the licence; no terms allow all."""
    if not terms:
        return F.lit(True)
    text = licence_text(*columns)
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, licence_text(F.lit(t))) for t in terms]), F.lit(False))


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "<[^>]+>", ""))


def filter_min_size(df: DataFrame, width: int, height: int) -> DataFrame:
    return df.filter((F.col("width") >= width) & (F.col("height") >= height))


def _heads(rows: DataFrame, key: str) -> DataFrame:
    """key and the numbers of its first and second row (null where it has one), for keys that are not null.

    Tasks send at most two rows of a key, so a frequent key costs no more than others.
    """
    order = F.row_number().over(Window.partitionBy(key).orderBy("n"))
    few = rows.select(key, "n").filter(F.col(key).isNotNull()).withColumn("_r", order).filter("_r <= 2")
    return few.groupBy(key).agg(F.min("n").alias(f"first_{key}"), F.max(F.when(F.col("_r") == 2, F.col("n"))).alias(f"second_{key}"))


def _chains(single: DataFrame) -> tuple[DataFrame, int]:
    """n, end, odd of rows (n, end, odd) that follow the row `end`: the end of each row's chain, whether its length is odd, and
    the number of rounds. All chains halve in a round."""
    from lumenrank.plans.stages import cut

    rounds = 0
    while True:
        beyond = single.select(F.col("n").alias("end"), F.col("end").alias("_end"), F.col("odd").alias("_odd"))
        step = cut(single.join(beyond, "end", "left"), "chains")
        single = step.select("n", F.coalesce("_end", "end").alias("end"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"))
        rounds += 1
        if step.filter("_end IS NOT NULL").isEmpty():
            return single, rounds


def first_seen(rows: DataFrame) -> tuple[DataFrame, int]:
    """n of the rows (n, a, b; a table) that are kept going by n: no kept row before has the same a or the same b. And the
    rounds taken.

    In a round the rows that come first in both their groups are kept. A row with a single row before it in its groups is
    kept just if that one is not; such rows form chains, which are followed to their ends by doubling, so a chain costs
    the logarithm of its length. Rows that share a key with a kept one go, and the rest, which holds ever fewer rows, goes on.
    """
    from lumenrank.plans.stages import cut

    kept, rounds = None, 0
    while True:
        judged = rows
        for key in ("a", "b"):
            judged = judged.join(_heads(rows, key), key, "left")
        judged = cut(judged, "judged")
        opens = {k: F.col(k).isNull() | (F.col("n") == F.col(f"first_{k}")) for k in ("a", "b")}
        after = {k: F.coalesce(F.col("n") == F.col(f"second_{k}"), F.lit(False)) for k in ("a", "b")}
        before = F.when(opens["a"] & after["b"], F.col("first_b")).when(opens["b"] & after["a"], F.col("first_a")).when(after["a"] & after["b"] & (F.col("first_a") == F.col("first_b")), F.col("first_a"))
        roots = judged.filter(opens["a"] & opens["b"]).select("n")
        single = cut(judged.select("n", before.alias("end"), F.lit(True).alias("odd")).filter("end IS NOT NULL"), "single")
        now = roots
        rounds += 1
        if not single.isEmpty():
            chains, jumps = _chains(single)
            rounds += jumps
            even = chains.filter(~F.col("odd")).join(roots.withColumnRenamed("n", "end"), "end", "left_semi").select("n")
            now = roots.unionByName(even)
        now = cut(now, "kept")
        kept = now if kept is None else kept.unionByName(now)
        taken = rows.join(now, "n", "left_semi")
        for key in ("a", "b"):
            rows = rows.join(taken.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
        rows = cut(rows.join(now, "n", "left_anti").select("n", "a", "b"), "rest")
        if rows.isEmpty():
            return kept, rounds


def select_collection(items: DataFrame, key_a: str, key_b: str, order: list[str], target: int | None = None) -> DataFrame:
    """Items in order, each kept if no kept item before it has the same key_a or the same key_b.

    A row that goes for one key does not block others by its other key. Null keys block nothing. Only numbers and keys go
    through the rounds of first_seen.
    """
    from lumenrank.functions.ranks import global_row_number
    from lumenrank.plans.stages import cut

    by = [F.col(c) for c in order]
    numbered = cut(global_row_number(items, by, "_number"), "numbered")
    kept, _ = first_seen(cut(numbered.select(F.col("_number").alias("n"), F.col(key_a).alias("a"), F.col(key_b).alias("b")), "keys"))
    kept = numbered.join(kept.withColumnRenamed("n", "_number"), "_number", "left_semi").drop("_number")
    return kept if target is None else kept.orderBy(*by).limit(target)
