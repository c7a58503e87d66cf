"""Per-key results when a few keys hold most of the rows.

Each input split encodes its keys in a local dictionary and scatter-reduces its
rows into dense accumulator arrays with numpy, so a key that holds a third of
the table leaves a split as one entry. The entries are grouped in key blocks and
the block arrays of all splits are summed by a second, distributed reduction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

NO_TIME = np.iinfo(np.int64).min
#: Distinct keys a split holds before its arrays are sent on.
FLUSH_KEYS = 1 << 18


def _blocks(keys: np.ndarray, n_blocks: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) % n_blocks for k in keys), np.int64, len(keys))


def _split_arrays(batches: Iterator[pa.RecordBatch], n_blocks: int) -> Iterator[pa.RecordBatch]:
    """Dictionary-encode the split's keys; one row for each block of keys it met."""
    codes: dict[str, int] = {}
    rows = np.zeros(0, np.int64)
    newest = np.zeros(0, np.int64)

    def flush() -> pa.RecordBatch:
        keys = np.array(list(codes), dtype=object)
        block = _blocks(keys, n_blocks)
        order = np.argsort(block, kind="stable")
        used, first = np.unique(block[order], return_index=True)
        parts = np.split(order, first[1:])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int64()),
                pa.array([keys[p].tolist() for p in parts], pa.list_(pa.string())),
                pa.array([rows[p] for p in parts], pa.list_(pa.int64())),
                pa.array([newest[p] for p in parts], pa.list_(pa.int64())),
            ],
            ["block", "keys", "n_rows", "newest"],
        )

    for batch in batches:
        coded = pa.array(batch.column(0)).dictionary_encode()
        local = coded.dictionary.to_pylist()
        to_global = np.fromiter((codes.setdefault(k, len(codes)) for k in local), np.int64, len(local))
        size = len(codes)
        if size > len(rows):
            rows = np.concatenate([rows, np.zeros(size - len(rows), np.int64)])
            newest = np.concatenate([newest, np.full(size - len(newest), NO_TIME)])
        if len(local):
            at = to_global[coded.indices.to_numpy()]
            times = batch.column(1).fill_null(NO_TIME).to_numpy()
            rows += np.bincount(at, minlength=size)
            np.maximum.at(newest, at, times)
        if size >= FLUSH_KEYS:
            yield flush()
            codes, rows, newest = {}, rows[:0], newest[:0]
    if codes:
        yield flush()


def _sum_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Add up the arrays of one key block over all splits."""
    keys = np.concatenate(pdf["keys"].to_numpy())
    at, names = pd.factorize(keys)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, at, np.concatenate(pdf["n_rows"].to_numpy()))
    newest = np.full(len(names), NO_TIME)
    np.maximum.at(newest, at, np.concatenate(pdf["newest"].to_numpy()))
    return pd.DataFrame({"key_value": names, "n_rows": total, "newest": newest})


def per_key(df: DataFrame, key: str, time: str | Column, session: Column | None = None, n_blocks: int = 256) -> DataFrame:
    """Rows, newest time (microseconds) and distinct sessions of each key.

    Columns: key_value, n_rows, newest_us and, if ``session`` is given,
    n_sessions. Null keys are no key and give no row; an empty key is a key of
    its own; null times are ignored (newest_us null if a key has no other);
    null sessions aren't counted; repeated rows count each time; an empty table
    gives no rows. Other columns are never read. ``n_blocks`` only sets how the
    second reduction is spread: raise it with the number of distinct keys.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp")) if isinstance(time, str) else time
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), micros.alias("t"))
    split = rows.mapInArrow(lambda b: _split_arrays(b, n_blocks), "block long, keys array<string>, n_rows array<long>, newest array<long>")
    summed = split.groupBy("block").applyInPandas(_sum_block, "key_value string, n_rows long, newest long")
    out = summed.select("key_value", "n_rows", F.nullif(F.col("newest"), F.lit(int(NO_TIME))).alias("newest_us"))
    if session is None:
        return out
    # Distinct pairs spread by key and session together, so a heavy key is no single task.
    pairs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key_value"), session.alias("s")).where(F.col("s").isNotNull()).distinct()
    counts = pairs.groupBy("key_value").agg(F.count(F.lit(1)).alias("n"))
    return out.join(counts, "key_value", "left").select("key_value", "n_rows", "newest_us", F.coalesce("n", F.lit(0)).alias("n_sessions"))


def heavy_keys(df: DataFrame, key: str, time: str, share: float = 0.04) -> DataFrame:
    """Keys that hold at least ``share`` of all rows of the table: key_value, n_rows, table_rows."""
    total = df.agg(F.count(F.lit(1)).alias("table_rows"))
    return per_key(df, key, time).crossJoin(F.broadcast(total)).where(F.col("n_rows") >= share * F.col("table_rows")).select("key_value", "n_rows", "table_rows")
