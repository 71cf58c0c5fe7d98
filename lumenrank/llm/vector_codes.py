"""Codes of vectors: exact integer codebooks of equal parts, over Hilbert-sorted blocks.

Components become integers floor(scale * x). Each part of each vector is a point; the points of a part position are
range-sorted along a Hilbert curve and stored in flat blocks with the box that holds them (least and largest component)
and their sums. In a round a block keeps the entries that can be nearest to some point of its box: an entry
whose least distance to the box exceeds another one's largest distance goes. One entry left takes the block by
its stored sums; otherwise its points are compared with the shortlist in 64-bit integers. Partial sums meet by (part, entry);
only codebooks (parts x entries x components) pass through the driver.

Rows whose vector is null, or holds null or non-finite components, go. Vectors must share one length, which is a multiple of
the number of parts (empty vectors have empty parts); anything else is a ValueError. scale * x must lie within +-2^27,
so that squared distances are exact; more is an error. Repeated rows and ids are rows of their own: starts are taken by id
(null last), then components. Fewer rows than entries make smaller codebooks. Null labels are one label. No rows give no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import stage_table

#: Points in a block.
BLOCK = 128

#: Bits of a Hilbert key.
KEY_BITS = 62

#: Components lie within this many bits and a sign.
COMPONENT_BITS = 27

#: Points compared with a shortlist at once.
KERNEL = 8192

_POINTS = "part int, key long, row long, point binary"
_BLOCKS = "part int, n int, rows binary, points binary, low binary, high binary, sums binary"


def hilbert_keys(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places of points on the Hilbert curve through the box from low to high; axes beyond KEY_BITS do not count.

    Gray-code rotations are undone from the highest bit to the lowest for all points at once.
    """
    n, dims = points.shape[0], min(points.shape[1], KEY_BITS)
    if not dims or not n:
        return np.zeros(n, np.int64)
    bits = max(1, min(16, KEY_BITS // dims))
    spread = max(1, int((high - low)[:dims].max()))
    shift = max(0, spread.bit_length() - bits)
    x = [((points[:, k] - low[k]) >> shift).astype(np.int64) for k in range(dims)]
    step = 1 << (bits - 1)
    while step > 1:
        mask = step - 1
        for k in range(dims):
            inverted = (x[k] & step) > 0
            swap = np.where(inverted, 0, (x[0] ^ x[k]) & mask)
            x[0] = np.where(inverted, x[0] ^ mask, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
        step >>= 1
    for k in range(1, dims):
        x[k] = x[k] ^ x[k - 1]
    flip, step = np.zeros(n, np.int64), 1 << (bits - 1)
    while step > 1:
        flip = np.where(x[-1] & step, flip ^ (step - 1), flip)
        step >>= 1
    key = np.zeros(n, np.int64)
    for bit in range(bits - 1, -1, -1):
        for k in range(dims):
            key = key << 1 | ((x[k] ^ flip) >> bit & 1)
    return key


def shortlist(entries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Indices of the entries that may be nearest to a point between low and high."""
    under, over = low - entries, entries - high
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=1)
    most = (np.maximum(np.abs(entries - low), np.abs(entries - high)) ** 2).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def nearest_entries(points: np.ndarray, entries: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest chosen entry of each point and its squared distance; ties to the lower index."""
    code, error = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
    some = entries[chosen]
    for a in range(0, len(points), KERNEL):
        block = points[a : a + KERNEL]
        apart = np.zeros((len(block), len(some)), np.int64)
        for k in range(points.shape[1]):
            apart += (block[:, k, None] - some[None, :, k]) ** 2
        at = apart.argmin(axis=1)
        code[a : a + KERNEL], error[a : a + KERNEL] = chosen[at], apart[np.arange(len(block)), at]
    return code, error


def integer_vectors(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """vectors with the column ints; rows without a whole finite vector go."""
    x = F.col(vector)
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(F.coalesce(whole, F.lit(False))).withColumn("ints", F.transform(x, lambda v: F.floor(v.cast("double") * scale)))


def _points(kept: DataFrame, parts: int, low: list[int], high: list[int]) -> DataFrame:
    """part, key, row, point of each part of the vectors of kept (row, ints)."""
    lo, hi = np.array(low, dtype=np.int64).reshape(parts, -1), np.array(high, dtype=np.int64).reshape(parts, -1)

    def split(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if len(batch):
                held = np.asarray(batch.column("ints").flatten()).reshape(len(batch), parts, -1)
                for part in range(parts):
                    own = np.ascontiguousarray(held[:, part], dtype="<i4")
                    width = own.shape[1] * 4
                    packed = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.arange(len(own) + 1, dtype=np.int32) * width), pa.py_buffer(own)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, np.int32)), pa.array(hilbert_keys(held[:, part], lo[part], hi[part])), batch.column("row"), packed], names=["part", "key", "row", "point"])

    return kept.select("row", "ints").mapInArrow(split, _POINTS)


def _blocks(points: DataFrame, width: int) -> DataFrame:
    """Flat blocks of the points in the order of their keys, for each part."""

    def pack(part: int, rows: np.ndarray, held: np.ndarray) -> list:
        return [part, len(rows), rows.astype("<i8").tobytes(), held.astype("<i4").tobytes(), held.min(axis=0).astype("<i8").tobytes(), held.max(axis=0).astype("<i8").tobytes(), held.sum(axis=0).astype("<i8").tobytes()]

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[int, np.ndarray, np.ndarray] | None = None
        for batch in found:
            out = []
            part, rows = batch.column("part").to_numpy(), batch.column("row").to_numpy()
            held = np.frombuffer(b"".join(batch.column("point").to_pylist()), "<i4").reshape(len(batch), width).astype(np.int64)
            for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)] if len(part) else np.zeros(1, int)), strict=True):
                if rest is not None and rest[0] != part[a]:
                    out.append(pack(*rest))
                    rest = None
                own = (rows[a:b], held[a:b]) if rest is None else (np.r_[rest[1], rows[a:b]], np.concatenate((rest[2], held[a:b])))
                whole = len(own[0]) // BLOCK * BLOCK
                out += [pack(int(part[a]), own[0][k : k + BLOCK], own[1][k : k + BLOCK]) for k in range(0, whole, BLOCK)]
                rest = (int(part[a]), own[0][whole:], own[1][whole:]) if whole < len(own[0]) else None
            if out:
                yield _packed(out)
        if rest is not None:
            yield _packed([pack(*rest)])

    def _packed(out: list) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "n", "rows", "points", "low", "high", "sums"])

    # equal points, however many, are dealt by their rows
    return points.repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key").mapInArrow(cut, _BLOCKS)


def _unpacked(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    for part, n, rows, points, *boxes in zip(*[batch.column(c).to_pylist() for c in ("part", "n", "rows", "points", "low", "high", "sums")], strict=True):
        yield part, n, rows, points, *[np.frombuffer(x, "<i8") for x in boxes]


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """books after one round: each entry the floored mean of the points nearest to it."""
    parts, entries, width = books.shape

    def assign(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in found:
            for part, n, _, points, low, high, total in _unpacked(batch, width):
                some = shortlist(books[part], low, high)
                if len(some) == 1:
                    sums[part, some[0]] += total
                    counts[part, some[0]] += n
                else:
                    held = np.frombuffer(points, "<i4").reshape(n, width).astype(np.int64)
                    code, _ = nearest_entries(held, books[part], some)
                    np.add.at(sums[part], code, held)
                    counts[part] += np.bincount(code, minlength=entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    found = blocks.mapInArrow(assign, "part int, entry int, n long, sums array<long>")
    # as many numbers as the codebooks have
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums"))
    out = books.copy()
    for part, entry, n, sums in total.collect():
        out[part, entry] = [s // n for s in sums]
    return out


def _assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """part, row, code, error of each point."""
    width = books.shape[2]

    def assign(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part, n, rows, points, low, high, _ in _unpacked(batch, width):
                held = np.frombuffer(points, "<i4").reshape(n, width).astype(np.int64)
                code, error = nearest_entries(held, books[part], shortlist(books[part], low, high))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.frombuffer(rows, "<i8")), pa.array(code), pa.array(error)], names=["part", "row", "code", "error"])

    return blocks.mapInArrow(assign, "part int, row long, code long, error long")


def _label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error; a frequent label meets its sum in as many tasks as there are salts."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.pmod(F.col("row"), F.lit(16)) == F.col("_salt"))
    return coded.join(salted, same).drop("_label", "_salt")


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 of each kept row of vectors.

    code: an index of two hexadecimal digits for each part; error: squared distances to the entries, summed over parts.
    entries: at most 256.
    """
    kept = integer_vectors(vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("x")), "x", scale)
    kept = stage_table(kept.select(F.monotonically_increasing_id().alias("row"), "id", "label", "ints"), "vectors")
    size = F.size("ints")
    most, least, length = kept.agg(F.max(size), F.min(size), F.max(F.array_max(F.transform("ints", F.abs)))).first()
    empty = kept.select(F.col("id").alias(key), F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    if most is None:
        return empty
    if most != least or most % parts:
        raise ValueError(f"vectors have {least} to {most} components; all need one length, a multiple of {parts}")
    if (length or 0) > 1 << COMPONENT_BITS:
        raise ValueError(f"{scale} times a component is {length}; at most 2^{COMPONENT_BITS} is exact")
    if not most:  # points without components are all alike
        return kept.select(F.col("id").alias(key), F.lit("00" * parts).alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    width = most // parts
    bounds = kept.agg(*[f(F.col("ints")[k]) for f in (F.min, F.max) for k in range(most)]).first()
    first = kept.orderBy(F.asc_nulls_last("id"), "ints").limit(entries).collect()
    books = np.array([r["ints"] for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()

    blocks = stage_table(_blocks(_points(kept, parts, list(bounds[:most]), list(bounds[most:])), width), "blocks")
    for _ in range(rounds):
        books = _round(blocks, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def digits(a: int, b: int) -> Column:
        inside = (F.col("part") >= a) & (F.col("part") < b)
        held = F.sum(F.when(inside, F.call_function("shiftleft", F.col("code"), ((b - 1 - F.col("part")) * 8).cast("int"))).otherwise(0))
        return F.lpad(F.lower(F.hex(held)), 2 * (b - a), "0")

    code = F.concat(*[digits(a, min(a + 7, parts)) for a in range(0, parts, 7)])
    coded = _assigned(blocks, books).groupBy("row").agg(code.alias("code"), F.sum("error").alias("error")).join(kept.select("row", "id", "label"), "row")
    coded = stage_table(coded, "codes")
    return _label_errors(coded).select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
