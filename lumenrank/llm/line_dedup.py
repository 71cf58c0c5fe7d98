"""Line dedup over a corpus: of the documents that hold a line, the one with the smallest id keeps it.

Keys (two 64-bit hashes of the stripped, lower-cased line) are range-partitioned together with
document and position, so a line that a third of all documents share is spread over partitions.
Each sorted partition streams by: the first document of a key keeps it, later ones lose it. A key
that began in an earlier partition takes its first document from there; one row a partition tells.
What comes back is a compressed bitmap of dropped lines for the documents that lose any.

Nulls: a null text is one empty line; a null doc_id counts as one document after all others.
Keys are only compared where they have ``min_chars`` code points or more. Rows that repeat a doc_id
are one document, told apart by their text for positions. Lines of very long texts are keyed in Spark; a text itself
must fit in a Python worker. An empty table gives no rows. Other columns, whatever their names, are kept.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.llm.common import free_names, small_batches
from lumenrank.llm.first_seen import LAST_DOC, rows_after_first

_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def _tag() -> Column:
    """Tells apart rows that share a doc_id."""
    return F.hash(F.coalesce("text", F.lit("")))


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc, tag, pos of every line long enough to be compared."""
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_DOC)).alias("doc"),
        _tag().alias("tag"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"),
    ).withColumn("key", line_key(F.col("line")))
    return lines.filter(F.char_length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc", "tag", "pos")


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc, tag and bitmap (compressed, one bit a line, set where it is dropped) of documents that lose lines."""
    lost = rows_after_first(line_keys(docs, min_chars), by_position=False, name="lines")
    return lost.groupBy("doc", "tag").agg(F.collect_set("pos").alias("pos")).mapInArrow(_bitmaps, "doc long, tag int, dropped binary")


def _bitmaps(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        packed = []
        for pos in batch.column("pos").to_pylist():
            bits = np.zeros(max(pos) + 1, dtype=np.uint8)
            bits[pos] = 1
            packed.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), pa.array(packed, pa.binary())], names=["doc", "tag", "dropped"])


def read_bitmap(packed: bytes | None, n: int) -> np.ndarray:
    """Which of n lines are dropped."""
    bits = np.zeros(n, dtype=bool)
    if packed:
        got = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8), bitorder="little")[:n]
        bits[: len(got)] = got
    return bits


def _kept(docs: DataFrame, min_chars: int, counted: bool) -> DataFrame:
    """docs with text cut to its kept lines; counted: with two more columns, its lines before and those dropped."""
    small_batches(docs.sparkSession)
    held = docs.columns
    doc, tag, dropped, n_lines, n_dropped = free_names(held, "doc", "tag", "dropped", "n_lines", "n_dropped")
    lost = dropped_lines(docs, min_chars).select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("dropped").alias(dropped))
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_DOC)), tag: _tag()})
    both = keyed.join(lost, [doc, tag], "left").drop(doc, tag)

    def keep(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts, total, gone = [], [], []
            for text, packed in zip(batch.column("text").to_pylist(), batch.column(dropped).to_pylist(), strict=True):
                if packed:
                    lines = text.split("\n")
                    bits = read_bitmap(packed, len(lines))
                    text = "\n".join(x for x, d in zip(lines, bits, strict=True) if not d)
                    total.append(len(lines))
                    gone.append(int(bits.sum()))
                else:
                    total.append((text or "").count("\n") + 1)
                    gone.append(0)
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in held]
            more = [pa.array(total, pa.int64()), pa.array(gone, pa.int64())] if counted else []
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*held, *([n_lines, n_dropped] if counted else [])])

    more = [T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())] if counted else []
    return both.mapInArrow(keep, T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in held), *more]))


def keep_first_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with text cut to its kept lines; other columns as they are."""
    return _kept(docs, min_chars, counted=False)


def line_dedup_digest(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    kept = _kept(docs.select("doc_id", "text"), min_chars, counted=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
