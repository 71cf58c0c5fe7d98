"""Pairs of bit strings within a Hamming distance, without comparing all of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.plans.stages import cut

BITS = 64

#: Distinct hashes that may share a band before they are compared in blocks; hashes in one block, about, and pairs at once.
HOT_BAND, BLOCK_HASHES, SLICE_PAIRS = 500, 16_384, 2_000_000


def as_number(bits: Column) -> Column:
    """64 characters 0 and 1 as a long."""
    half = lambda at: F.conv(F.substring(bits, at, 32), 2, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(33))


def _cuts(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """Borders of so many nearly equal runs of the bits from low to below high."""
    at = [low + (high - low) * k // parts for k in range(parts + 1)]
    return [(a, b) for a, b in zip(at, at[1:], strict=False) if b > a]


def _run(x: Column, a: int, b: int) -> Column:
    return F.shiftrightunsigned(x, a).bitwiseAND((1 << (b - a)) - 1 if b - a < BITS else -1)


def _as_bits(h: Column) -> Column:
    return F.lpad(F.bin(h), BITS, "0")


def near_pairs(hashes: DataFrame, distance: int, bits: str = "phash") -> DataFrame:
    """left, right, distance of all pairs of different values of bits (64 characters 0 and 1) at most so far apart.

    Equal values are one row; whoever needs items joins them. Two values within a distance d agree on one of d + 1 bands of
    their bits; a pair is taken in the first band that it agrees on only. A band value that many share is dealt into blocks of
    about BLOCK_HASHES, and a task compares one block with another. Where that would be more pairs than there are, all are
    compared in blocks, once. Null and other lengths take no part. Only numbers are shuffled, and nothing is broadcast
    but a row for each hot band value.
    """
    if not 0 <= distance < BITS // 2:
        raise ValueError(f"a distance from 0 to {BITS // 2 - 1}, not {distance}")
    known = cut(hashes.filter(F.col(bits).rlike(f"^[01]{{{BITS}}}$")).select(as_number(F.col(bits)).alias("h")).distinct(), "hashes")
    bands = _cuts(0, BITS, distance + 1)
    keyed = known.select("h", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), _run(F.col("h"), a, b).alias("value")) for i, (a, b) in enumerate(bands)])).alias("k")).select("h", "k.*")
    hot = cut(keyed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_BAND), "hot")
    n, most = known.count(), hot.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
    whole = most >= float(n) * n and most > 0
    if whole:
        bands = [(0, 0)]  # no bits: all agree
        keyed = known.select("h", F.lit(0).alias("band"), F.lit(0).cast("long").alias("value"))
        hot = known.sparkSession.createDataFrame([(0, 0, n)], "band int, value long, n long")
    # a hot value lies in blocks, each of which meets itself and those after it
    size = F.ceil(F.col("n") / BLOCK_HASHES).cast("int")
    dealt = keyed.join(F.broadcast(hot), ["band", "value"]).select("h", "band", "value", size.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("h"), "blocks").cast("int"))
    left = dealt.select("band", "value", "h", F.col("block").alias("a"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("b"))
    # new names, so that the two sides of one table can meet
    own = [F.col(c).alias(c) for c in ("band", "value", "h")]
    right = dealt.select(*own, F.explode(F.sequence(F.lit(0), "block")).alias("a"), F.col("block").alias("b"))
    masks = [np.uint64(((1 << (b - a)) - 1) << a) for a, b in bands]

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        one, other = (np.sort(df["h"].to_numpy(np.int64)).view(np.uint64) for df in (x, y))
        out = [np.zeros((2, 0), np.uint64)]
        if len(one) and len(other):
            band, same = x["band"].iloc[0], x["a"].iloc[0] == x["b"].iloc[0]
            step = max(1, SLICE_PAIRS // len(other))
            for at in range(0, len(one), step):
                row, col = np.nonzero(np.bitwise_count(one[at : at + step, None] ^ other[None, :]) <= distance)
                p, q = one[at : at + step][row], other[col]
                fits = p < q if same else np.ones(len(p), bool)
                for mask in masks[:band]:
                    fits &= (p ^ q) & mask != 0
                out.append(np.stack([p[fits], q[fits]]))
        p, q = np.concatenate(out, axis=1)
        return pd.DataFrame({"p": p.view(np.int64), "q": q.view(np.int64)})

    by = ("band", "value", "a", "b")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(lambda x, y: compare(x, y), "p long, q long")
    if not whole:
        cold = keyed.join(F.broadcast(hot.select("band", "value")), ["band", "value"], "left_anti")
        xor = F.col("p").bitwiseXOR(F.col("q"))
        first = F.coalesce(*[F.when(_run(xor, a, b) == 0, F.lit(i)) for i, (a, b) in enumerate(bands)]) == F.col("band")
        p, q = (cold.select(F.col("band").alias("band"), F.col("value").alias("value"), F.col("h").alias(c)) for c in ("p", "q"))
        both = p.hint("merge").join(q, ["band", "value"])
        found = found.unionByName(both.filter((F.col("p") < F.col("q")) & (F.bit_count(xor) <= distance) & first).select("p", "q"))
    told = found.select(_as_bits(F.col("p")).alias("x"), _as_bits(F.col("q")).alias("y"), F.bit_count(F.col("p").bitwiseXOR(F.col("q"))).alias("distance"))
    return told.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), "distance")
