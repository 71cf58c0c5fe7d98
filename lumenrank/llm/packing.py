"""Best-fit packing of token sequences in bulk-synchronous rounds.

Units (pieces, tiny ones bundled) and open gaps are tables. The longest units open as many sequences as all
tokens need at least. In each round units and gaps are range-sorted together by size, from the largest down, gaps
first among equals, and matched by a distributed successor sweep: every unit takes the smallest gap before it that no
longer unit has taken, just as a closing bracket meets its opening one. Ranges are matched apart; of what a range leaves
over, only counts pass through the driver, and the rank in the sorted order resolves all conflicts. What is left of a gap
is a smaller gap of the next round. When a round matches nothing, the longest units that are left open as many sequences as their
tokens need.

A round takes at most one unit for each gap; units have ``TINY`` tokens or more (but for one), so a sequence of
``capacity`` is full after capacity / TINY rounds, whatever the number of documents.

Nulls: a null text is the empty text (its document holds just the end id); a null doc_id is kept.
Repeated rows are packed as often as they occur; ties of length go by doc_id, piece and checksum, equal rows in any
order. A very long text is encoded at once, which must fit in a Python worker. An empty table gives no rows. Other
columns are ignored by ``pack_documents`` and kept by ``place_pieces``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.functions.ranks import global_row_number
from lumenrank.llm.common import free_names, small_batches, stage_table
from lumenrank.llm.tokens import encoder

#: Pieces of so many tokens or fewer are bundled, in order of length, into units of at least so many.
TINY = 32

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Token ids of each document with its end id; longer ones cut into pieces, the first of which may be shorter."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder("byte", vocabulary)
        for batch in found:
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = coder.ids(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for name, value in zip(out, (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()], names=list(out))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


def bundled(pieces: DataFrame, rank: str) -> DataFrame:
    """rank, unit, within (place in the unit), size (of the unit) of pieces with a rank by falling length.

    A longer piece is a unit of its own (its rank); tiny ones share one with their neighbours in rank.
    """
    tiny = stage_table(pieces.filter(F.col("length") <= TINY).select(rank, "length"), "tiny")
    alone = pieces.filter(F.col("length") > TINY).select(rank, F.col(rank).alias("unit"), F.lit(0).cast("long").alias("within"), F.col("length").alias("size"))
    # tokens before each tiny piece: they come last in rank, so ranges of ranks have them in order
    first = tiny.agg(F.min(rank)).first()[0]
    if first is None:
        return alone
    block = F.floor((F.col(rank) - first) / 65_536)
    sums = tiny.groupBy(block.alias("block")).agg(F.sum("length").alias("n"))
    blocks = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.sum("length").over(Window.partitionBy("block").orderBy(rank)) - F.col("length")
    # a row for each 65,536 pieces
    placed = tiny.withColumn("block", block).withColumn("inside", inside).join(F.broadcast(blocks), "block").withColumn("at", F.col("before") + F.col("inside"))
    placed = stage_table(placed.select(rank, "length", "at", F.floor(F.col("at") / TINY).alias("bundle")), "placed")
    # at most TINY pieces each
    bundles = placed.groupBy("bundle").agg(F.min(rank).alias("unit"), F.min("at").alias("start"), F.sum("length").alias("size"))
    shared = placed.join(bundles, "bundle").select(rank, "unit", (F.col("at") - F.col("start")).alias("within"), "size")
    return alone.unionByName(shared)


def _met(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches within a range of events: a unit takes the last gap of the range that is still open.

    Units that meet no gap of their range, and gaps that no unit of it takes, are numbered, in the order of the range. A last
    row without unit and sequence has the numbers of matches (place), of such units (size) and of such gaps (room).
    """
    part, lost, matches, opened = TaskContext.get().partitionId(), 0, 0, []
    for batch in found:
        out = []
        for id_, size, closes in zip(*[batch.column(c).to_pylist() for c in ("id", "size", "closes")], strict=True):
            if not closes:
                opened.append((id_, size))
            elif opened:
                out.append((part, None, id_, size, *opened.pop()))
                matches += 1
            else:
                out.append((part, lost, id_, size, None, None))
                lost += 1
        yield _events(out)
    for a in range(0, len(opened), 10_000):
        yield _events([(part, a + k, None, None, *gap) for k, gap in enumerate(opened[a : a + 10_000])])
    yield _events([(part, matches, None, lost, None, len(opened))])


def _events(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == 0 else pa.int64()) for k, v in enumerate(columns)], names=["part", "place", "unit", "size", "sequence", "room"])


def _across(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """part, first, last, other, top: units of part with places from first to before last take the gaps of an earlier range
    with place top - place. counts: part, units and gaps that its range left, in order. The open gaps are a stack of ranges."""
    stack, out = [], []
    for part, units, gaps in counts:
        at = 0
        while at < units and stack:
            other, n = stack.pop()
            taken = min(n, units - at)
            out.append((part, at, at + taken, other, n - 1 + at))
            if n > taken:
                stack.append((other, n - taken))
            at += taken
        if gaps:
            stack.append((part, gaps))
    return out


def matched(units: DataFrame, gaps: DataFrame) -> tuple[DataFrame, int, int]:
    """(unit, size, sequence, room of units (unit, size) and gaps (sequence, room), as tables; the numbers of matches and of
    units left).

    A row is a match, a unit without gap (its sequence is null) or a gap without unit. Going from the largest size down, a
    unit takes the last gap that is still open. Ranges are matched apart; what a range leaves over is counted, and only
    these counts (three numbers a range) pass through the driver to tell which range's gaps its units take.
    """
    spark = units.sparkSession
    order = [F.desc("size"), F.col("closes"), F.col("id")]
    events = gaps.select(F.col("sequence").alias("id"), F.col("room").alias("size"), F.lit(False).alias("closes")).unionByName(units.select(F.col("unit").alias("id"), "size", F.lit(True).alias("closes")))
    met = stage_table(events.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_met, "part int, place long, unit long, size long, sequence long, room long"), "met")
    told = met.filter("unit IS NULL AND sequence IS NULL").select("part", "place", "size", "room").collect()
    pieces = _across(sorted((r.part, r["size"], r.room) for r in told))
    columns = ["unit", "size", "sequence", "room"]
    whole = met.filter("unit IS NOT NULL AND sequence IS NOT NULL").select(*columns)
    lone, open_ = met.filter("unit IS NOT NULL AND sequence IS NULL"), met.filter("unit IS NULL AND sequence IS NOT NULL")
    taken = sum(last - first for _, first, last, _, _ in pieces)
    found, left = sum(r.place for r in told) + taken, sum(r["size"] for r in told) - taken
    if not pieces:
        return whole.unionByName(lone.select(*columns)).unionByName(open_.select(*columns)), found, left
    # at most two rows for each range
    across = F.broadcast(spark.createDataFrame(pieces, "_part int, first long, last long, other int, top long"))
    told_gap = lone.join(across, (F.col("part") == F.col("_part")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("last")), "left")
    sent = told_gap.filter("other IS NOT NULL").select("unit", "size", F.col("other").alias("part"), (F.col("top") - F.col("place")).alias("place"))
    joined = sent.join(open_.select("part", "place", "sequence", "room"), ["part", "place"], "full").select(*columns)
    rest = stage_table(joined.unionByName(told_gap.filter("other IS NULL").select(*columns)), "rest")
    return whole.unionByName(rest), found, left


def sweep(units: DataFrame, gaps: DataFrame) -> DataFrame:
    """unit, size, sequence, room: units matched with gaps (sequence, room), each gap once."""
    return matched(units, gaps)[0].filter("unit IS NOT NULL AND sequence IS NOT NULL")


def place_units(units: DataFrame, capacity: int) -> DataFrame:
    """unit, sequence, start of units (unit, size; a table): numbers by falling size, in rounds."""
    left, gaps, out, opened, n = units, None, None, 0, units.count()
    least = 0
    while n:
        state, met, rest = (None, 0, n) if gaps is None else matched(left, gaps.filter(F.col("room") >= least))
        if met:
            new = state.filter("unit IS NOT NULL AND sequence IS NOT NULL").select("unit", "sequence", (F.lit(capacity) - F.col("room")).cast("long").alias("start"))
            left, n = state.filter("unit IS NOT NULL AND sequence IS NULL").select("unit", "size"), rest
            gaps = state.filter("sequence IS NOT NULL").select("sequence", (F.col("room") - F.coalesce("size", F.lit(0))).alias("room"))
        else:
            tokens, least = left.agg(F.sum("size"), F.min("size")).first()
            k = -(-tokens // capacity)
            ranked = stage_table(global_row_number(left, [F.desc("size"), F.col("unit")], "k"), "ranked")
            longest = ranked.filter(F.col("k") <= k)
            new = longest.select("unit", (F.col("k") + opened).alias("sequence"), F.lit(0).cast("long").alias("start"))
            # no open gap holds even the shortest unit
            gaps = longest.select((F.col("k") + opened).alias("sequence"), (capacity - F.col("size")).alias("room"))
            left, opened, n = ranked.filter(F.col("k") > k).drop("k"), opened + k, max(0, n - k)
        out = new if out is None else out.unionByName(new)
    return out if out is not None else units.select("unit", F.lit(0).cast("long").alias("sequence"), F.lit(0).cast("long").alias("start"))


def place_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces (any columns with length from 1 to capacity, doc_id, piece, ids_crc32) with sequence_id and offset."""
    (rank,) = free_names([*pieces.columns, "length", "unit", "within", "size"], "rank")
    ranked = stage_table(global_row_number(pieces, [F.desc("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], rank), "pieces-ranked")
    units = stage_table(bundled(ranked, rank), "units")
    placed = place_units(stage_table(units.select("unit", "size").distinct(), "sizes"), capacity)
    at = units.join(placed, "unit").select(F.col(rank), F.col("sequence").alias("sequence_id"), (F.col("start") + F.col("within")).alias("offset"))
    return ranked.join(at, rank).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs."""
    pieces = stage_table(cut_pieces(docs, vocabulary, capacity, end_id), "pieces")
    return place_pieces(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
