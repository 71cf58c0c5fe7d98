"""Which rows come after the first of their key, over a whole table, whatever one key's share.

Keys are range-partitioned together with document and position, so a key that a third of all
documents share is spread over partitions. Each sorted partition streams by and compares rows with
the first of their key; a key that began in an earlier partition takes its first row from there, for
which one row a partition is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import stage_table

#: Rows with a null doc_id count as one document after all others.
LAST_DOC = (1 << 63) - 1

_STREAMED = "part int, kind int, alone boolean, head boolean, h1 long, h2 long, doc long, tag int, pos int, first_doc long, first_pos int"


def _stream(by_position: bool):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: rows that may come later than the first of their key. Kind 1: the partition's last key."""
        part, names = TaskContext.get().partitionId(), ("h1", "h2", "doc", "tag", "pos")
        head = last = None
        first_doc, first_pos = 0, 0

        def out(kind, alone, in_head, columns, docs, positions):
            n = len(docs)
            values = [np.full(n, part, np.int32), np.full(n, kind, np.int32), np.full(n, alone), in_head, *columns, docs, positions]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["part", "kind", "alone", "head", *names, "first_doc", "first_pos"])

        for batch in found:
            if not batch.num_rows:
                continue
            h1, h2, doc, tag, pos = (batch.column(c).to_numpy() for c in names)
            starts = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            starts[0] = last != (h1[0], h2[0])
            head = head or (h1[0], h2[0])
            run_of = np.cumsum(starts)
            docs = np.concatenate(([first_doc], doc[starts]))[run_of]
            positions = np.concatenate((np.array([first_pos], np.int32), pos[starts]))[run_of]
            in_head = (h1 == head[0]) & (h2 == head[1])
            later = in_head | (doc > docs) | (by_position & (pos > positions))
            last, first_doc, first_pos = (h1[-1], h2[-1]), docs[-1], positions[-1]
            yield out(0, False, in_head[later], [x[later] for x in (h1, h2, doc, tag, pos)], docs[later], positions[later])
        if last is not None:
            columns = [np.array([last[0]]), np.array([last[1]]), np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(1, np.int32)]
            yield out(1, last == head, np.ones(1, bool), columns, np.array([first_doc]), np.array([first_pos], np.int32))

    return run


def rows_after_first(keys: DataFrame, by_position: bool, name: str) -> DataFrame:
    """doc, tag, pos of the rows of keys (h1, h2, doc, tag, pos) after the first document of their key,
    or, by_position, after the first document and position."""
    spark = keys.sparkSession
    order = ["h1", "h2", "doc", "pos", "tag"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(n, *order).sortWithinPartitions(*order)
    seen = stage_table(dealt.mapInArrow(_stream(by_position), _STREAMED), name)
    carried, before = [], None
    for r in sorted(seen.filter("kind = 1").collect(), key=lambda r: r["part"]):
        if before:
            carried.append((r["part"], *before))
        if not (before and r["alone"] and before[:2] == (r["h1"], r["h2"])):
            before = (r["h1"], r["h2"], r["first_doc"], r["first_pos"])
    held = spark.createDataFrame(carried, "part int, c1 long, c2 long, c_doc long, c_pos int")
    same = F.col("head") & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))
    doc, pos = (F.when(same, F.col(a)).otherwise(F.col(b)) for a, b in (("c_doc", "first_doc"), ("c_pos", "first_pos")))
    later = F.col("doc") > doc
    if by_position:
        later = later | (F.col("doc") == doc) & (F.col("pos") > pos)
    # one row a partition: as many as the sort has tasks
    return seen.filter("kind = 0").join(F.broadcast(held), "part", "left").filter(later).select("doc", "tag", "pos")
