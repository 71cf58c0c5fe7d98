"""Preferences as a stream: each once, and the items' wins carried in state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lumenrank.schemas import PAIRWISE

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def preference_stream(spark: SparkSession, folder: str, watermark: str = "1 day") -> DataFrame:
    """Preference events of a folder of Parquet logs, each pair_id once within the watermark."""
    events = spark.readStream.schema(PAIRWISE).option("recursiveFileLookup", True).parquet(folder)
    return events.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["pair_id"])


class ItemRecord(StatefulProcessor):
    """Wins, ties and preferences of an item so far; a row for each item that a micro-batch touches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._record = handle.getValueState("record", "wins long, ties long, n_pairs long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        wins, ties, n = self._record.get() if self._record.exists() else (0, 0, 0)
        for some in rows:
            wins, ties, n = wins + int(some["won"].sum()), ties + int(some["tied"].sum()), n + len(some)
        self._record.update((wins, ties, n))
        yield pd.DataFrame({"image_id": [key[0]], "wins": [wins], "ties": [ties], "n_pairs": [n], "pairwise_win_rate": [(wins + 0.5 * ties) / n]})

    def close(self) -> None:
        pass


def running_win_rates(pairs: DataFrame) -> DataFrame:
    """image_id, wins, ties, n_pairs, pairwise_win_rate of each item that a micro-batch touches: the same as win_rate of all
    preferences so far. A null tie flag is a tie."""
    tie = F.coalesce(F.col("tie_flag"), F.lit(True))
    side = lambda c: F.struct(F.col(c).alias("image_id"), (~tie & F.coalesce(F.col("winner") == F.col(c), F.lit(False))).cast("int").alias("won"), tie.cast("int").alias("tied"))
    each = pairs.select(F.explode(F.array(side("left_image_id"), side("right_image_id"))).alias("x")).select("x.*").filter("image_id IS NOT NULL")
    return each.groupBy("image_id").transformWithStateInPandas(ItemRecord(), "image_id string, wins long, ties long, n_pairs long, pairwise_win_rate double", "Append", "None")


def keep_win_rates(pairs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand the rows of running_win_rates to sink, batch by batch; each holds totals, so a sink that upserts by item can be
    given a batch again. State lives in RocksDB: the session names that provider only while the query starts."""
    spark = pairs.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return running_win_rates(pairs).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
