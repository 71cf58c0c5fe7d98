"""Substring dedup: of repeated runs of words, all but the first occurrence go.

A window is ``window`` consecutive words. A word goes if a window that covers it has the same words
as a window that starts earlier (in a document with a smaller id, or earlier in the same one).

Each window selects its least ``GRAM``-word gram (a minimizer), so equal windows select equal grams at
the same place. A fragment is what all windows on one such gram span. Fragments are range-partitioned
by gram and content together with document and position, so a passage that a third of all documents
share is spread; sorted partitions stream by, and of equal fragments all but the first go whole.
Grams that occur in different fragments (next to edits, at the ends of shared passages) are settled
window by window, in the same manner.

The matching statistics against broadcast suffix automata of reference shards are in
``suffix_automaton.py``; they suit a reference of checked size. With the corpus as its own reference
every document would be streamed past every shard, which grows with the square of the corpus, so the
self-join here takes the route above (figures in the README).

Nulls: a null text has no words; a null doc_id counts as one document after all others. Rows that
repeat a doc_id at the same position do not make each other go. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import small_batches, stage_table
from lumenrank.llm.first_seen import LAST_DOC, rows_after_first
from lumenrank.llm.words import gram_hashes, mix, text_runs, word_hashes

#: Words in the grams that windows select.
GRAM = 6

_U = np.uint64


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (null ids last), tag (tells apart rows that share an id), text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_DOC)).alias("doc"), F.hash(F.coalesce("text", F.lit(""))).alias("tag"), "text")


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def fragments(words: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, hash of the gram, hash of the fragment) of the rows' fragments."""
    per = window - GRAM + 1
    if len(words) < window:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty.astype(_U), empty.astype(_U)
    grams = gram_hashes(words, GRAM)
    order = mix(grams ^ _U(0x5851F42D4C957F2D))
    least = _sliding_min(order, per)
    # the leftmost least gram of each window: where the window's least value was last set
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    m = len(words) - window + 1
    valid = row_of[:m] == row_of[window - 1 :]
    where = _leftmost(order, least, per)
    starts = np.flatnonzero(valid & np.concatenate(([True], (where[1:] != where[:-1]) | (row_of[1:m] != row_of[: m - 1]) | ~valid[:-1])))
    after = np.append(starts[1:], m)
    # windows of a fragment end where the next begins or the row ends
    counts = np.cumsum(np.concatenate(([0], valid)))
    n = counts[after] - counts[starts]
    gram = grams[where[starts]]
    # the fragment's content: its first and last window, its length and where the gram lies in it
    whole = gram_hashes(words, window)
    frag = mix(whole[starts] * _U(3) + whole[starts + n - 1] * _U(0x9E3779B97F4A7C15) + n.astype(_U) * _U(1_000_003) + (where[starts] - starts).astype(_U))
    row = row_of[starts]
    return row, starts - bounds[row], n, gram, frag


def _leftmost(order: np.ndarray, least: np.ndarray, per: int) -> np.ndarray:
    """Position of the leftmost gram that has the window's least value, for each window."""
    m = len(least)
    where = np.full(m, -1, dtype=np.int64)
    at = np.arange(m)
    for k in range(per - 1, -1, -1):
        hit = order[k : k + m] == least
        where[hit] = at[hit] + k
    return where


_FRAGMENT = "gram long, frag long, doc long, at long, n int"


def _fragment_rows(window: int):
    def rows(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for first, last, data, bounds in text_runs(batch.column("text")):
                words, cuts = word_hashes(data, bounds)
                row, start, n, gram, frag = fragments(words, cuts, window)
                row = row + first
                at = (start << 32) | (tag[row].astype(np.int64) & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(frag.view(np.int64)), pa.array(doc[row]), pa.array(at), pa.array(n.astype(np.int32))], names=["gram", "frag", "doc", "at", "n"])

    return rows


_SEEN = "gone boolean, doc long, at long, n int"


def _runs(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments sorted by gram: those after the first of their content (gone), and the firsts whose gram has others.

    The partition's first and last gram may go on in its neighbours, so their firsts are always returned.
    """
    names = ("gram", "frag", "doc", "at", "n")
    kept = {}
    head = None

    def settle(cols: dict, end: bool) -> pa.RecordBatch:
        gram, frag, doc, at = (cols[c] for c in names[:4])
        new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
        starts = new_gram | np.concatenate(([True], frag[1:] != frag[:-1]))
        where = np.flatnonzero(starts)
        run = np.cumsum(starts) - 1
        gone = (doc > doc[where][run]) | (at >> 32 > at[where][run] >> 32)
        several = np.bincount(np.cumsum(new_gram)[where])[np.cumsum(new_gram)] > 1
        asked = starts & (several | (gram == head) | (end & (gram == gram[-1])))
        told = gone | asked
        return pa.RecordBatch.from_arrays([pa.array(gone[told]), *(pa.array(cols[c][told]) for c in ("doc", "at", "n"))], names=["gone", "doc", "at", "n"])

    for batch in found:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy() for c in names}
        if kept:
            cols = {c: np.concatenate((kept[c], cols[c])) for c in names}
        gram = cols["gram"]
        head = gram[0] if head is None else head
        whole = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on in the next batch
        if whole:
            yield settle({c: v[:whole] for c, v in cols.items()}, False)
        kept = {c: v[whole:] for c, v in cols.items()}
    if kept:
        yield settle(kept, True)


def _window_keys(window: int):
    def rows(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            doc, tag, asked = batch.column("doc").to_numpy(), batch.column("tag").to_numpy(), batch.column("asked")
            for first, last, data, bounds in text_runs(batch.column("text")):
                words, cuts = word_hashes(data, bounds)
                one = gram_hashes(words, window)
                two = gram_hashes(mix(words ^ _U(0xA0761D6478BD642F)), window)
                for i in range(first, last):
                    ranges = asked[i].as_py()
                    pos = np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in ranges]))
                    at = pos + cuts[i - first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), pa.array(np.full(len(at), doc[i])), pa.array(np.full(len(at), tag[i])), pa.array(pos.astype(np.int32))],
                        names=["h1", "h2", "doc", "tag", "pos"],
                    )

    return rows


def repeated_ranges(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc, tag and ranges (array of first window and number of windows) that repeat earlier windows."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["gram", "frag", "doc", "at"]
    dealt = keyed.mapInArrow(_fragment_rows(window), _FRAGMENT).repartitionByRange(n, *order).sortWithinPartitions(*order)
    seen = stage_table(dealt.mapInArrow(_runs, _SEEN), "fragments")
    tag = F.shiftleft("at", 32).cast("long")
    seen = seen.select("gone", "doc", F.shiftright(tag, 32).cast("int").alias("tag"), F.shiftright("at", 32).cast("int").alias("start"), "n")
    asked = seen.filter(~F.col("gone")).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("asked"))
    keys = keyed.join(asked, ["doc", "tag"]).mapInArrow(_window_keys(window), "h1 long, h2 long, doc long, tag int, pos int")
    later = rows_after_first(keys, by_position=True, name="windows")
    ranges = seen.filter("gone").select("doc", "tag", "start", "n").unionByName(later.select("doc", "tag", F.col("pos").alias("start"), F.lit(1).alias("n")))
    return ranges.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))


def _covered(n: int, ranges: list[dict] | None, window: int) -> np.ndarray:
    """Which of n words lie in a window of the ranges."""
    edge = np.zeros(n + 1, dtype=np.int32)
    for r in ranges or ():
        edge[r["start"]] += 1
        edge[r["start"] + r["n"] + window - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) of each document."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs).withColumn("doc_id", F.when(F.col("doc") < LAST_DOC, F.col("doc")))
    both = keyed.join(repeated_ranges(docs, window), ["doc", "tag"], "left").select("doc_id", "text", "ranges")

    def keep(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            total, gone, kept = [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                words = (text or "").encode().split()
                lost = _covered(len(words), ranges, window)
                total.append(len(words))
                gone.append(int(lost.sum()))
                kept.append(b" ".join(words if not ranges else [w for w, x in zip(words, lost, strict=True) if not x]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")


def repeats_digest(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
