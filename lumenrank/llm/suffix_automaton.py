"""Matching statistics against suffix automata of reference shards.

For references of checked size (evaluation sets, licence texts): the reference is cut into shards, an
automaton of each is built once in every task that needs it, and documents stream past all of them. Spans
that match at least ``window`` words are removed. Work grows with documents times shards, so a
reference above ``MOST_WORDS`` is refused; ``substring.py`` dedups a corpus against itself.

Nulls: a null text has no words; null reference texts are skipped. An empty reference removes nothing.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import small_batches, word_count

#: Words of a reference that may be sent to every task, and of one automaton.
MOST_WORDS, SHARD_WORDS = 2_000_000, 200_000


class SuffixAutomaton:
    """The least automaton of all substrings of the sequences added to it."""

    def __init__(self) -> None:
        self.goes: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: Sequence) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _split(self, state: int, word, target: int) -> int:
        copy = len(self.goes)
        self.goes.append(dict(self.goes[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        self.link[target] = copy
        while state >= 0 and self.goes[state].get(word) == target:
            self.goes[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word) -> int:
        target = self.goes[last].get(word)
        if target is not None:  # a prefix of an earlier sequence, seen again
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = len(self.goes)
        self.goes.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = last
        while state >= 0 and word not in self.goes[state]:
            self.goes[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.goes[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return new

    def matching_statistics(self, words: Sequence) -> list[int]:
        """For each position, how many words up to it form a substring of the reference, at most."""
        state = matched = 0
        out = []
        for word in words:
            while state and word not in self.goes[state]:
                state = self.link[state]
                matched = self.length[state]
            target = self.goes[state].get(word)
            if target is not None:
                state, matched = target, matched + 1
            else:
                matched = 0
            out.append(matched)
        return out


def reference_shards(reference: DataFrame) -> list[list[list[bytes]]]:
    """The word sequences of a reference (column text), in shards; refused above MOST_WORDS."""
    total = reference.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    if total > MOST_WORDS:
        raise ValueError(f"a reference of {total} words is not sent to every task; at most {MOST_WORDS} are")
    shards, held = [[]], 0
    for row in reference.select("text").filter("text IS NOT NULL").collect():
        words = row[0].encode().split()
        if held and held + len(words) > SHARD_WORDS:
            shards.append([])
            held = 0
        shards[-1].append(words)
        held += len(words)
    return shards


def remove_reference_spans(docs: DataFrame, reference: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept: docs without spans of window words or more that the reference holds."""
    small_batches(docs.sparkSession)
    shards = docs.sparkSession.sparkContext.broadcast(reference_shards(reference))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for shard in shards.value:
            automata.append(SuffixAutomaton())
            for words in shard:
                automata[-1].add(words)
        for batch in found:
            total, gone, kept = [], [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for a in automata:
                    for i, n in enumerate(a.matching_statistics(words)):
                        if n >= window:
                            edge[i + 1 - n] += 1
                            edge[i + 1] -= 1
                lost = np.cumsum(edge[:-1]) > 0
                total.append(len(words))
                gone.append(int(lost.sum()))
                kept.append(b" ".join(w for w, x in zip(words, lost, strict=True) if not x).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
