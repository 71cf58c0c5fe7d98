"""Mixing sources to target weights by hash thresholds.

Each document has a hash. Sizes are summed by source and by the leading bits of the hash; the
running sums show in which bucket a source's budget ends. Only that bucket is refined, by further
bits, until one hash value is left. A document is then taken by comparing its hash with its
source's threshold: nothing is sorted, reruns agree, and a larger budget takes a superset.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null doc_id
hashes as the empty string. Rows that repeat a doc_id of a source are taken together. An empty table
gives no rows. Very long texts are only counted, in Spark. Other columns, whatever their names, are ignored by
``mix_sources`` and kept by ``take_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrank.functions.ranks import global_row_number
from lumenrank.llm.common import stage_table, word_count

#: Bits of the hash, and those that one round looks at.
HASH_BITS, ROUND_BITS = 60, 10

#: Tables of sources up to this size are broadcast, larger ones joined by shuffle.
BROADCAST_SOURCES = 100_000


def mix_hash(doc_id: Column) -> Column:
    """60 bits of the id's MD5: the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: weights repeat over the sources by code point, null last.

    The targets add up to share times all sizes; one above ``most`` times its source's size stops
    there, and the excess goes to the others by weight until none is above.
    """
    sizes = stage_table(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = global_row_number(sizes, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = stage_table(ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).drop("_rank"), "weights")
    total = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level = share * (total[0] or 0), 0.0
    if total[1]:
        level = budget / total[1]
        while True:
            above = F.col("weight") * level >= F.col("cap")
            capped, free = ranked.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
            new = (budget - capped) / free if free > 0 else level
            if new <= level:
                break
            level = new
    return ranked.select("source", "source_size", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


def _join_sources(left: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    right = sources.withColumnRenamed("source", "_source")
    return left.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix_limits(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, bool]:
    """source, source_size, target, whole (repeats of every document), threshold (hashes up to it once more).

    sized: source, size and hash h of the documents. The flag tells whether the table is small enough to broadcast.
    """
    targets = source_targets(sized, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(0)
    sources = targets.withColumn("whole", whole.cast("long"))
    sources = stage_table(sources.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    small = sources.count() <= BROADCAST_SOURCES

    # opened: where each source's budget ends so far, as the leading bits of the hash, and the sum before them
    opened = sources.select("source", "left", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    done = None
    for bits in range(ROUND_BITS, HASH_BITS + 1, ROUND_BITS):
        shift = HASH_BITS - bits
        inside = _join_sources(sized, opened, small).filter(F.shiftright("h", shift + ROUND_BITS) == F.col("prefix"))
        hist = inside.groupBy("source", "left", "before", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) + F.col("before")
        over = hist.withColumn("upto", upto).filter(F.col("upto") > F.col("left"))
        edge = over.groupBy("source", "left").agg(F.min_by(F.struct("bucket", "n", "low", "high", "upto"), "bucket").alias("e")).select("source", "left", "e.*")
        edge = stage_table(edge.withColumn("before", F.col("upto") - F.col("n")), "edges")
        nearer = (F.col("upto") - F.col("left")) < (F.col("left") - F.col("before"))
        ended = edge.filter(F.col("low") == F.col("high")).select("source", F.when(nearer, F.col("high")).otherwise(F.col("high") - 1).alias("threshold"))
        done = ended if done is None else done.unionByName(ended)
        opened = edge.filter(F.col("low") < F.col("high")).select("source", "left", F.col("bucket").alias("prefix"), "before")
        if opened.isEmpty():
            break
    # a source whose budget is never passed takes everything
    found = sources.join(done.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    threshold = F.coalesce("threshold", F.lit(1 << HASH_BITS))
    return stage_table(found.select("source", "source_size", "target", "whole", threshold.alias("threshold")), "limits"), small


def _repeats(most: float) -> Column:
    return F.col("whole") + F.when(F.col("whole") >= int(most), 0).otherwise((F.col("h") <= F.col("threshold")).cast("long"))


def _sized(docs: DataFrame) -> DataFrame:
    return stage_table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mix_hash(F.col("doc_id")).alias("h")), "sizes")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken of each document.

    Each source's target is met by whole repeats of all its documents and, for what is left, by
    those under its hash threshold; the document at the threshold is taken if that comes nearer.
    """
    sized = _sized(docs)
    limits, small = mix_limits(sized, weights, share, most)
    mixed = _join_sources(sized, limits, small).withColumn("repeats", _repeats(most))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents of the mix: each as often as it is taken, with the columns of docs. Texts are not shuffled."""
    limits, small = mix_limits(_sized(docs), weights, share, most)
    # the row travels as one column, so that its own names clash with nothing
    held = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), mix_hash(F.col("doc_id")).alias("h"))
    times = _join_sources(held, limits.select("source", "whole", "threshold"), small).withColumn("times", _repeats(most)).filter("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).select("row.*")
