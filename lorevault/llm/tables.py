"""Count tables of fixed size, summed over all tasks in array blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 14


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum(np.stack(pdf["counts"].to_numpy()).astype(np.int64), axis=0)
    return pd.DataFrame({"name": pdf["name"].iloc[:1], "block": pdf["block"].iloc[:1], "counts": [total]})


def count_tables(df: DataFrame, sizes: dict[str, int], count: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, np.ndarray]]]) -> dict[str, np.ndarray]:
    """Sum of the tables that ``count`` yields in every task.

    ``count`` turns batches into tables of the given sizes (multiples of BLOCK).
    A task sends each block of its tables at most once, so what is shuffled
    depends on the number of tasks and what reaches the driver on the sizes only.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(n, np.int32) for k, n in sizes.items()}
        for tables in count(batches):
            for k, t in tables.items():
                total[k] += t.astype(np.int32)
        for k, t in total.items():
            blocks = np.flatnonzero(t.reshape(-1, BLOCK).any(axis=1))
            if len(blocks):
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(blocks) + 1) * BLOCK, pa.int32()), pa.array(t.reshape(-1, BLOCK)[blocks].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(blocks)), pa.array(blocks, pa.int32()), arrays], ["name", "block", "counts"])

    parts = df.mapInArrow(task, "name string, block int, counts array<int>")
    out = {k: np.zeros(n, np.int64) for k, n in sizes.items()}
    for r in parts.groupBy("name", "block").applyInPandas(_sum, "name string, block int, counts array<long>").toLocalIterator():
        out[r["name"]][r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = r["counts"]
    return out
