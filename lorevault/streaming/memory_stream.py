"""Structured Streaming forms of the session event operators.

Each takes a streaming (or static) DataFrame; ``start`` runs one to a table or a
memory sink with a checkpoint. All state is keyed, so it spreads over executors
and survives their loss with the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def captured_once(events: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """The first delivery of each key; a repeat within ``delay`` is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def bursts(events: DataFrame, time: str, key: str, gap: str, delay: str = "0 seconds") -> DataFrame:
    """Debounce: one row per burst of a key's events, once no event came for ``gap``."""
    g = events.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("s"))
    return g.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n")).select(key, "first", "last", "n")


def accesses(events: DataFrame, key: str, time: str) -> DataFrame:
    """Running access count and newest access of each key (update mode)."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("accesses"), F.max(time).alias("last"))


def counts(events: DataFrame, time: str, width: str, slide: str | None, by: list[str], delay: str) -> DataFrame:
    """Counts in tumbling or sliding windows; rows later than ``delay`` are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *by, "n")


class Heartbeat(StatefulProcessor):
    """Counts a key's steps since its last write; fires at the threshold and starts again."""

    def __init__(self, threshold: int, key: str, order: list[str], write: str) -> None:
        self.threshold, self.key, self.order, self.write = threshold, key, order, write

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getValueState("steps", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.steps.get()[0] if self.steps.exists() else 0
        fired = []
        for row in pd.concat(list(rows)).sort_values(self.order).itertuples(index=False):
            if getattr(row, self.write):
                n = 0
                continue
            n += 1
            if n == self.threshold:
                fired.append(getattr(row, self.order[-1]))
                n = 0
        self.steps.update((n,))
        yield pd.DataFrame({self.key: [key[0]] * len(fired), "at": fired})

    def close(self) -> None:
        pass


def heartbeats(events: DataFrame, key: str, order: list[str], write: str, threshold: int) -> DataFrame:
    """key and the last column of ``order`` of the step at which each heartbeat fires.

    ``write`` is a boolean column. Within a batch a key's rows are put in order;
    needs the RocksDB state store (STATE_STORE).
    """
    kinds = dict(events.dtypes)
    return events.groupBy(key).transformWithStateInPandas(Heartbeat(threshold, key, order, write), f"{key} {kinds[key]}, at {kinds[order[-1]]}", "Append", "None")


def start(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", table_format: str = "parquet"):
    """Run ``stream`` over what is there now and stop: to files at ``sink``, or to memory if it has no slash."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if "/" in sink:
        return w.format(table_format).option("path", sink).start()
    return w.format("memory").queryName(sink).start()
