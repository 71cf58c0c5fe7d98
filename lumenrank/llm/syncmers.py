"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if its least s-mer (under a hash) is its first or its last one.
Whether it is depends on the k-mer alone, so an edit changes only the anchors that touch it, and
equal passages have equal anchors wherever they lie. A fingerprint is the ``SKETCH`` least distinct
anchor hashes with the place of their first occurrence, in hexadecimal. Likeness is positional: of the least
anchors of two texts, it is the share that both have in the same order (the longest chain that rises in both).

Nulls: a null text is the empty text, whose fingerprint is empty; two empty fingerprints have
likeness 1, an empty and another one 0. A text shorter than a k-mer has one anchor, itself. A null
doc_id comes after all others in descending order; rows that repeat a doc_id follow by text. An empty
table gives no rows. Very long texts are hashed one by one; a text must fit in a Python worker. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import small_batches
from lumenrank.llm.words import mix

K, S, SKETCH = 14, 6, 64

#: Ranges of ids dealt out for each shuffle partition, so that partitions even out.
RANGES = 4

_U = np.uint64
_FACTOR = _U(0x9E3779B97F4A7C15)


def _smers(points: np.ndarray) -> np.ndarray:
    total = np.zeros(len(points) - S + 1, dtype=_U)
    for j in range(S):
        total = total * _FACTOR + points[j : j + len(total)]
    total ^= total >> _U(31)
    total *= _U(0xBF58476D1CE4E5B9)
    return total ^ (total >> _U(29))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the closed syncmers of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_U)
    if not len(points):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    if len(points) < K:
        total = _U(len(points))
        with np.errstate(over="ignore"):
            for p in points:
                total = total * _FACTOR + p
        return np.zeros(1, dtype=np.int64), mix(np.array([total]))
    smers = _smers(points)
    w = K - S + 1
    done, least = 1, smers
    while done < w:
        step = min(done, w - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    at = np.flatnonzero((smers[: len(least)] == least) | (smers[w - 1 :] == least))
    # three s-mers cover a k-mer: their hashes tell it from others
    return at, mix(smers[at] * _U(3) + smers[at + (K - S) // 2] * _U(0xC2B2AE3D27D4EB4F) + smers[at + K - S] * _FACTOR)


def sketch(text: str) -> np.ndarray:
    """The least distinct 32-bit anchor hashes of a text, ascending, and the place of each (its first): rows of two."""
    at, hashes = anchors(text)
    hashes = (hashes >> _U(32)).astype(np.uint32)
    if len(hashes) > 4 * SKETCH:
        few = hashes <= np.partition(hashes, 2 * SKETCH)[2 * SKETCH]
        if len(np.unique(hashes[few])) >= SKETCH:
            at, hashes = at[few], hashes[few]
    least, first = np.unique(hashes, return_index=True)
    return np.column_stack((least[:SKETCH], at[first[:SKETCH]].astype(np.uint32)))


def fingerprint(least: np.ndarray) -> str:
    return least.astype(">u4").tobytes().hex()


def chain(places: np.ndarray) -> int:
    """The length of the longest strictly rising chain of pairs of places."""
    tails: list[int] = []
    # equal first places fall in the second, so that a chain takes one of them
    for y in places[np.lexsort((-places[:, 1], places[:, 0])), 1].tolist():
        k = bisect_left(tails, y)
        tails[k : k + 1] = [y]
    return len(tails)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the least anchors of both that lie in the same order in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a[:, 0], b[:, 0])[:SKETCH]
    common, at, to = np.intersect1d(a[:, 0], b[:, 0], assume_unique=True, return_indices=True)
    near = common <= union[-1]
    return chain(np.column_stack((a[at[near], 1], b[to[near], 1])).astype(np.int64)) / len(union)


def match_positions(a: str, b: str) -> list[tuple[int, int]]:
    """Places of the anchors that two texts share, where an anchor occurs once in each."""
    (pa_, ha), (pb_, hb) = anchors(a), anchors(b)
    ua, ia, ca = np.unique(ha, return_index=True, return_counts=True)
    ub, ib, cb = np.unique(hb, return_index=True, return_counts=True)
    common = np.intersect1d(ua[ca == 1], ub[cb == 1])
    return sorted((int(pa_[ia[np.searchsorted(ua, h)]]), int(pb_[ib[np.searchsorted(ub, h)]])) for h in common)


_LOW = -(1 << 63)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, dealt by ranges of doc_id and sorted so that each row's successor follows it.

    Successors are in descending doc_id, after the last the first. The row that follows a range's
    last one is sent along with the range (``halo``); texts are shuffled once. Columns: range, halo, key,
    doc_id, text; sorted within partitions by range, halo, key descending, text.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(_LOW)))
    # where ranges begin: a number for each range, from a sketch of the ids
    probs = [i / (parts * RANGES) for i in range(1, parts * RANGES)]
    found = keyed.agg(F.percentile_approx("key", probs, 10_000)).first()[0] or []
    splits = np.array(sorted(set(found)), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, key.to_numpy(), side="right").astype(np.int32))

    ranged = keyed.withColumn("range", range_of("key"))
    tops = {r[0]: r[1] for r in ranged.groupBy("range").agg(F.max("key")).collect()}
    used = sorted(tops)
    # the first row of a range follows the last row of the next higher one; the first of all follows the last of all
    goes = {tops[r]: used[(i + 1) % len(used)] for i, r in enumerate(used)}
    sent = spark.createDataFrame(list(goes.items()), "key long, to int")
    own = ranged.withColumn("halo", F.lit(False))
    halo = keyed.join(F.broadcast(sent), "key").select("doc_id", "text", "key", F.col("to").alias("range"), F.lit(True).alias("halo"))
    return own.unionByName(halo).repartition(parts, "range").sortWithinPartitions("range", "halo", F.col("key").desc(), "text")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the row whose successor comes next: (range, doc_id, text, sketch)

    def row(before, text, own):
        _, doc, old, mine = before
        half = len(old) // 2
        edited = old[: len(old) - half] + text[:half]
        other = sketch(edited)
        return doc, len(old), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(mine), fingerprint(other), likeness(mine, other), likeness(mine, own)

    for batch in found:
        rows = []
        for rng, halo, doc, text in zip(*(batch.column(c).to_pylist() for c in ("range", "halo", "doc_id", "text")), strict=True):
            text = text or ""
            own = sketch(text)
            if held is not None and held[0] == rng:
                rows.append(row(held, text, own))
                held = None
            if not halo:
                held = (rng, doc, text, own)
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likenesses.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document, in descending doc_id.
    """
    small_batches(docs.sparkSession)
    return with_next(docs).select("range", "halo", "doc_id", "text").mapInArrow(_compare, _OUT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each document."""
    small_batches(docs.sparkSession)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(sketch(t or "")) for t in batch.column("text").to_pylist()])], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")
