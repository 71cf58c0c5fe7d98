"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A shard file holds a run of documents in ascending doc_id order (null ids first, equal ids by text):

    magic "LRTS2\\0\\0\\0", then 64-bit little-endian: documents, those with null ids, token ids, bytes of one, least doc_id
    two Elias-Fano sequences: doc_id - least of the documents with an id; the boundaries, from 0 to the number of ids
    ids, 2 bytes each where every id of the shard is below 65,536, else 4

A sequence of n numbers is: 64-bit n, low bits l and bytes of the upper part | low parts, l bits each | upper part,
where bit (number >> l) + i is set for the i-th. ``EliasFano.select`` finds the i-th number from the places of every
``SELECT_STEP``-th set bit, which are kept in 32 bits; a reader takes the numbers in runs of that length, so no table of
64-bit offsets exists in the file or in memory.

Nulls: a null text is the empty text; a null doc_id is kept, as null, before all others. Empty
texts hold just the end id. Repeated rows are stored as often as they occur. An empty table makes
no file. A very long text makes a shard of its own, which must fit in a worker. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.common import new_path, small_batches
from lumenrank.llm.tokens import encoder

MAGIC = b"LRTS2\0\0\0"

#: A shard is closed once it holds so many ids.
SHARD_IDS = 8_000_000

#: Numbers between two entries of the select directory, and bytes of the upper part that are looked at in one go.
SELECT_STEP, WINDOW = 256, 4_096


def _ones(upper: bytes, bit: int) -> Iterator[np.ndarray]:
    """Places of the set bits from a place on, window by window."""
    for a in range(bit // 8, len(upper), WINDOW):
        at = np.flatnonzero(np.unpackbits(np.frombuffer(upper, np.uint8, min(WINDOW, len(upper) - a), a), bitorder="little")) + 8 * a
        yield at[at >= bit]


class EliasFano:
    """A non-decreasing sequence of whole numbers from 0 on, in about 2 + log2(last / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: bytes, upper: bytes):
        self.n, self.low_bits, self.low, self.upper = n, low_bits, low, upper
        kept, seen = [], 0
        for at in _ones(upper, 0):
            kept.append(at[-seen % SELECT_STEP :: SELECT_STEP])
            seen += len(at)
        places = np.concatenate([*kept, np.zeros(0, np.int64)])
        self._places = places.astype(np.uint32 if len(upper) < 1 << 29 else np.uint64)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (most // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((n, 0), dtype=np.uint64)
        upper = np.zeros((most >> low_bits) + n + 1, dtype=np.uint8)
        upper[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(upper, bitorder="little").tobytes())

    def _low(self, first: int, last: int) -> np.ndarray:
        """Low parts of a run."""
        a, b = first * self.low_bits, last * self.low_bits
        got = np.unpackbits(np.frombuffer(self.low, np.uint8, (b + 7) // 8 - a // 8, a // 8), bitorder="little")[a % 8 : a % 8 + b - a]
        return got.reshape(last - first, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def run(self, k: int) -> np.ndarray:
        """The k-th run of SELECT_STEP numbers."""
        first, last = k * SELECT_STEP, min(self.n, (k + 1) * SELECT_STEP)
        found, got = [], 0
        for at in _ones(self.upper, int(self._places[k])):
            found.append(at[: last - first - got])
            got += len(found[-1])
            if got == last - first:
                break
        high = (np.concatenate(found) - np.arange(first, last)).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._low(first, last) if self.low_bits else high

    def runs(self) -> Iterator[np.ndarray]:
        """All numbers, a run at a time."""
        return (self.run(k) for k in range(len(self._places)))

    def select(self, i: int) -> int:
        """The i-th number."""
        left = i % SELECT_STEP
        for at in _ones(self.upper, int(self._places[i // SELECT_STEP])):
            if left < len(at):
                high = int(at[left]) - i
                return high << self.low_bits | int(self._low(i, i + 1)[0]) if self.low_bits else high
            left -= len(at)
        raise IndexError(i)

    def encoded(self) -> bytes:
        return np.array([self.n, self.low_bits, len(self.upper)], dtype="<u8").tobytes() + self.low + self.upper

    @classmethod
    def decoded(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        """The sequence at a place of a file, and the place after it."""
        n, low_bits, n_upper = (int(x) for x in np.frombuffer(data, "<u8", 3, at))
        at, n_low = at + 24, (n * low_bits + 7) // 8
        end = at + n_low + n_upper
        return cls(n, low_bits, data[at : at + n_low], data[at + n_low : end]), end


class Shard:
    """A shard file: documents nulls + len(doc_ids), boundaries, ids."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.n, self.nulls, u, width = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
        self.least = int(np.frombuffer(data, "<i8", 1, 40)[0])
        self.doc_ids, at = EliasFano.decoded(data, 48)
        self.bounds, at = EliasFano.decoded(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", u, at)

    def documents(self) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """(doc_ids, boundaries, one more) of the documents, a run of boundaries at a time."""
        own = (self.least + int(d) for run in self.doc_ids.runs() for d in run)
        edge, done = np.zeros(0, dtype=np.int64), 0
        for run in self.bounds.runs():
            edge = np.concatenate((edge, run.astype(np.int64)))
            n = len(edge) - 1
            yield [None if done + i < self.nulls else next(own) for i in range(n)], edge
            edge, done = edge[-1:], done + n


def encode_shard(doc_ids: list[int | None], lengths: list[int], ids: bytes) -> bytes:
    """A shard file of documents in order: null ids first, then ascending ones."""
    own = [d for d in doc_ids if d is not None]
    least = own[0] if own else 0
    bounds = EliasFano.of(np.concatenate(([0], np.cumsum(np.array(lengths, dtype=np.int64)))))
    values = np.frombuffer(ids, dtype="<u4")
    width = 4 if len(values) and int(values.max()) >= 1 << 16 else 2
    head = np.array([len(doc_ids), len(doc_ids) - len(own), len(values), width], dtype="<u8").tobytes() + np.array([least], dtype="<i8").tobytes()
    return MAGIC + head + EliasFano.of(np.array([d - least for d in own], dtype=np.uint64)).encoded() + bounds.encoded() + values.astype(f"<u{width}").tobytes()


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _store(folder: str, name: str, data: bytes) -> None:
    """Write under a name of this attempt's own, then rename: a lost or repeated task leaves whole files only."""
    fs, base = _filesystem(folder)
    own = f"{base}/_{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, f"{base}/{name}")


_WRITTEN = "shard string, part int, seq int, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, kind: str = "word", end_id: int = 1, partitions: int | None = None) -> list[dict]:
    """Encode docs (doc_id, text) into shard files under folder; returns the shards in order, one entry each."""
    spark = docs.sparkSession
    small_batches(spark)
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder = TaskContext.get().partitionId(), encoder(kind, vocabulary)
        own, lengths, ids, seq, held = [], [], [], 0, 0

        def close():
            name = f"shard-{part:06d}-{seq:04d}.tok"
            _store(folder, name, encode_shard(own, lengths, b"".join(ids)))
            return pa.RecordBatch.from_pydict({"shard": [name], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(own)], "n_ids": [held]})

        for batch in found:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = coder.ids(text or "") + end
                own.append(doc)
                lengths.append(len(got) // 4)
                ids.append(got)
                held += len(got) // 4
                if held >= SHARD_IDS:
                    yield close()
                    own, lengths, ids, seq, held = [], [], [], seq + 1, 0
        if own:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, order[0]).sortWithinPartitions(*order)
    shards = [r.asDict() for r in ranged.mapInArrow(write, _WRITTEN).collect()]
    return sorted(shards, key=lambda s: (s["part"], s["seq"]))


def read_token_files(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """Each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows, start = [], 0
    for s in shards:
        rows.append((s["shard"], start))
        start += s["n_ids"]

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, base = _filesystem(folder)
                with fs.open_input_stream(f"{base}/{name}") as f:
                    shard = Shard(f.read())
                for own, edge in shard.documents():
                    ids = memoryview(shard.ids[edge[0] : edge[-1]].astype("<u4").tobytes())
                    at = 4 * (edge - edge[0])
                    crcs = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own, pa.int64()), "start": pa.array(edge[:-1] + before, pa.int64()), "n_tokens": pa.array(np.diff(edge), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    listed = spark.createDataFrame(rows, "shard string, start long")
    return listed.repartition(max(1, len(rows)), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write docs to token files in the shared folder and read them back."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    return read_token_files(spark, folder, write_token_files(docs, folder, vocabulary, end_id=end_id))
