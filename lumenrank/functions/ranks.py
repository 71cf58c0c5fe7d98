"""Positions in a total order over a whole table, without one task that sorts everything."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.plans.stages import cut


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """df with a row number from 1 in the given order.

    Rows are dealt by range, numbered inside each range, and shifted by the sizes of the ranges
    before; only those sizes (one number a partition) pass through the driver. The ranges are written as a
    table, so that numbers stay right when executors are lost.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before, rows = 0, []
    for part, n in sorted((r[0], r[1]) for r in ranged.groupBy("_part").count().collect()):
        rows.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _before long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = ranged.withColumn("_inside", inside).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_before", "_inside")


def average_ranks(df: DataFrame, column: str, name: str, by: list[str] | None = None) -> DataFrame:
    """df with the rank of column from 1, equal values sharing the mean of their ranks.

    Values are counted first, so ranks are found over distinct values (dealt by range when there
    are no groups) and joined back: no task sorts all rows, and a frequent value costs one row.
    """
    keys = by or []
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_k"))
    if keys:
        upto = F.sum("_k").over(Window.partitionBy(*keys).orderBy(column))
    else:
        counts = running_total(counts, [F.col(column)], "_k", "_upto")
        upto = F.col("_upto")
    ranks = counts.select(*keys, F.col(column).alias("_v"), (upto - (F.col("_k") - 1) / 2).alias(name))
    same = F.col("_v") == F.col(column)
    for k in keys:
        ranks = ranks.withColumnRenamed(k, f"_k_{k}")
        same = same & F.col(f"_k_{k}").eqNullSafe(F.col(k))
    return df.join(ranks, same).drop("_v", *[f"_k_{k}" for k in keys])


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows up to each one in order; order must be total.

    As global_row_number: ranges are summed apart and shifted by the sums of the ranges before.
    """
    # dealing by range reads its rows twice
    return _running_total(cut(df, "counted"), order, value, name)


def _running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """As running_total, of a table that is cheap to read twice."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = sorted((r[0], r[1]) for r in ranged.groupBy("_part").agg(F.sum(value)).collect())
    before, rows = 0, []
    for part, total in sums:
        rows.append((part, float(before)))
        before += total or 0
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _before double")
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")


#: Counted values that are few enough for a task a column.
FEW_VALUES = 2_000_000


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of columns, interpolated between neighbours; None for a column without values.

    Values are counted. At most FEW_VALUES of them (of all columns together) are sorted in a task a column; more are
    summed in order by ranges, and the few values at the asked ranks are all that reaches the driver (two for each column
    and share), so neither a large column nor a frequent value lands in one task.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    counts = df.select(F.explode(cells).alias("x")).select("x.*").filter("v IS NOT NULL").groupBy("i", "v").agg(F.count(F.lit(1)).alias("k"))
    counts = cut(counts, "counted")
    if counts.count() <= FEW_VALUES:
        found = {r["i"]: r["q"] for r in counts.groupBy("i").agg(F.percentile("v", list(shares), F.col("k")).alias("q")).collect()}
        return {c: list(found.get(i, [None] * len(shares))) for i, c in enumerate(columns)}
    summed = cut(_running_total(counts, [F.col("i"), F.col("v")], "k", "upto"), "sums")
    sizes = {r[0]: r[1] for r in summed.groupBy("i").agg(F.sum("k")).collect()}
    asked, before = [], 0
    for i in range(len(columns)):
        n = sizes.get(i, 0)
        if n:
            asked += [(i, float(before + rank)) for rank in sorted({f(p * (n - 1)) for p in shares for f in (math.floor, math.ceil)})]
        before += n
    if not asked:
        return {c: [None] * len(shares) for c in columns}
    ranks = df.sparkSession.createDataFrame(asked, "i int, rank double")
    hit = summed.join(F.broadcast(ranks), "i").filter((F.col("rank") >= F.col("upto") - F.col("k")) & (F.col("rank") < F.col("upto")))
    at = {(r[0], int(r[1])): r[2] for r in hit.select("i", "rank", "v").collect()}
    out, before = {}, 0
    for i, c in enumerate(columns):
        n, got = sizes.get(i, 0), []
        for p in shares:
            place = p * (n - 1)
            low, high = math.floor(place), math.ceil(place)
            got.append(None if not n else at[i, before + low] if low == high or at[i, before + low] == at[i, before + high] else (high - place) * at[i, before + low] + (place - low) * at[i, before + high])
        out[c], before = got, before + n
    return out


def group_quantiles(df: DataFrame, by: list[str], value: str, share: float, name: str) -> DataFrame:
    """by, name: the exact quantile of value in each group, interpolated between neighbours; groups without values are left out.

    Values of all groups are counted and summed in one order by ranges, so no task holds a group; of each group the one or
    two values at the asked rank are kept. Groups are told apart with nulls as one value.
    """
    counts = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_k"))
    summed = cut(running_total(counts, [*map(F.col, by), F.col("_v")], "_k", "_upto"), "sums")
    sizes = summed.groupBy(*by).agg(F.sum("_k").alias("_n"), F.max("_upto").alias("_end"))
    place = F.lit(share) * (F.col("_n") - 1)
    asked = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], (F.col("_end") - F.col("_n")).alias("_start"), F.floor(place).alias("_low"), F.ceil(place).alias("_high"), place.alias("_place"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    holds = lambda rank: (F.col("_start") + F.col(rank) >= F.col("_upto") - F.col("_k")) & (F.col("_start") + F.col(rank) < F.col("_upto"))
    hit = summed.join(asked, same).filter(holds("_low") | holds("_high"))
    low, high, part = F.min("_v"), F.max("_v"), F.max(F.col("_place") - F.col("_low"))
    return hit.groupBy(*by).agg(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(name))


def sketched_quantiles(df: DataFrame, by: list[str], value: str, share: float, name: str, k: int = 1_000) -> DataFrame:
    """by, name: a value of each group whose rank differs from the asked one by about 2.3 / k of the group's size at most (99 %
    of the time); groups without values are left out.

    KLL sketches of k items are made in tasks and merged, so what is shuffled does not grow with a group.
    """
    sketch = F.call_function("kll_sketch_agg_double", F.col("_v"), F.lit(k))
    held = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy(*by).agg(sketch.alias("_s"))
    return held.select(*by, F.call_function("kll_sketch_get_quantile_double", F.col("_s"), F.lit(float(share))).alias(name))
