"""Evaluation passages inside a training corpus, by suffix arrays of its shards.

Each task sorts the suffixes of its shard of documents (words as numbers) by
prefix doubling and binary-searches every suffix of the evaluation passages in
that order. A hit gives document, item, both places and the length of the
longest verbatim match there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lorevault.llm.common import words

#: Words of a shard whose suffixes are sorted together.
SHARD_WORDS = 1 << 20
#: Words of evaluation passages broadcast at once; a larger set is searched in several passes.
PASS_WORDS = 2_000_000


class Passages:
    """The evaluation passages as one array of word numbers, 0 between two of them."""

    def __init__(self, rows: list[tuple[str, list[str]]]) -> None:
        self.item = [r[0] for r in rows]
        vocabulary = dict.fromkeys(chain.from_iterable(w for _, w in rows))
        self.number = {w: i for i, w in enumerate(vocabulary, 1)}
        parts = [np.array([self.number[w] for w in found] + [0], np.int64) for _, found in rows]
        self.text = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
        starts = np.cumsum([0] + [len(p) for p in parts])[:-1] if parts else np.zeros(0, np.int64)
        self.start = starts[self.owner] if parts else starts


def _full_windows(text: np.ndarray, least: int) -> np.ndarray:
    """Places from which the next ``least`` words are all known (no 0 among them)."""
    if len(text) < least:
        return np.zeros(0, np.int64)
    zeros = np.concatenate([[0], np.cumsum(text == 0)])
    return np.flatnonzero(zeros[least:] == zeros[:-least])


def _ranks(text: np.ndarray, least: int) -> np.ndarray:
    """For each place, the rank of the ``least`` words from there among all places, by prefix doubling."""
    rank, width = text, 1
    while width < least:
        step = min(width, least - width)
        shifted = np.concatenate([rank[step:], np.zeros(step, np.int64)])
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + shifted, return_inverse=True)[1].astype(np.int64)
        width += step
    return rank


def _matches(shard: np.ndarray, p: Passages, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the shard and in the passages that begin maximal matches, and their lengths."""
    none = np.zeros(0, np.int64)
    at, of = _full_windows(shard, least), _full_windows(p.text, least)
    if not len(at) or not len(of):
        return none, none, none
    # Only the windows are ranked, so text made of unknown words costs nothing.
    keep = np.zeros(len(shard) + 1, bool)
    ends = np.zeros(len(shard) + 1, np.int64)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + least, -1)
    keep[:-1] = np.cumsum(ends[:-1]) > 0
    place = np.flatnonzero(keep)
    gap = np.concatenate([[True], np.diff(place) > 1])
    packed_place = place + 0
    slot = np.cumsum(gap) - 1 + np.arange(len(place)) + 1  # one 0 before each stretch
    packed = np.zeros(int(slot[-1]) + 2, np.int64)
    packed[slot] = shard[place]
    both = np.concatenate([packed, p.text])
    rank = _ranks(both, least)
    back = np.full(len(packed), -1)
    back[slot] = packed_place
    at = slot[np.searchsorted(place, at)]
    # The suffix array of the shard, and the run of each passage suffix in it.
    order = np.argsort(rank[at], kind="stable")
    suffixes, keys = at[order], rank[at][order]
    wanted = rank[len(packed) + of]
    lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    n = hi - lo
    q = np.repeat(of, n)
    s = suffixes[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    # Maximal matches only: the word before must differ on either side.
    first = (q == 0) | (packed[s - 1] == 0) | (p.text[q - 1] == 0) | (packed[s - 1] != p.text[q - 1])
    s, q = s[first], q[first]
    length = np.full(len(s), least)
    live = np.arange(len(s))
    while len(live):
        a, b = s[live] + length[live], q[live] + length[live]
        fits = (a < len(packed)) & (b < len(p.text))
        live, a, b = live[fits], a[fits], b[fits]
        live = live[(packed[a] == p.text[b]) & (packed[a] != 0)]
        length[live] += 1
    return back[s], q, length


def _search(batches: Iterator[pd.DataFrame], p: Passages, least: int) -> Iterator[pd.DataFrame]:
    ids: list = []
    numbers: list[list[int]] = []
    held = 0

    def flush() -> pd.DataFrame:
        sizes = np.array([len(x) for x in numbers])
        doc = np.repeat(np.arange(len(ids)), sizes)
        start = (np.cumsum(sizes) - sizes)[doc]
        shard = np.fromiter(chain.from_iterable(numbers), np.int64, int(sizes.sum()))
        s, q, length = _matches(shard, p, least)
        d, i = doc[s], p.owner[q]
        return pd.DataFrame({"doc_id": [ids[x] for x in d.tolist()], "item_id": [p.item[x] for x in i.tolist()], "doc_word": s - start[s], "item_word": q - p.start[q], "n_words": length})

    get = p.number.get
    for pdf in batches:
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            found = words(text)
            if len(found) < least:
                continue
            ids.append(doc_id)
            numbers.append([get(w, 0) for w in found] + [0])
            held += len(found)
            if held >= SHARD_WORDS:
                yield from filter(len, [flush()])
                ids, numbers, held = [], [], 0
    if ids:
        yield from filter(len, [flush()])


def leaks(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """Maximal runs of at least ``least`` words that a document shares with an evaluation passage.

    Columns: doc_id, item_id, doc_word and item_word (where the run begins,
    counted in words from 0) and n_words. Null, empty and shorter texts or
    passages match nothing; items with the same passage each give their own
    rows; repeated documents each give theirs; empty tables give no rows; other
    columns of either table are never read. The passages are broadcast in
    passes of at most PASS_WORDS words, whatever their number.
    """
    out, part, size = None, [], 0

    def searched(rows: list) -> DataFrame:
        p = documents.sparkSession.sparkContext.broadcast(Passages(rows))
        return documents.select("doc_id", "text").mapInPandas(lambda b: _search(b, p.value, least), schema)

    doc_kind, item_kind = dict(documents.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {doc_kind}, item_id {item_kind}, doc_word long, item_word long, n_words long"
    for item_id, passage in items.select("item_id", "passage").toLocalIterator():
        found = words(passage)
        if len(found) < least:
            continue
        part.append((item_id, found))
        size += len(found)
        if size >= PASS_WORDS:
            out = searched(part) if out is None else out.unionByName(searched(part))
            part, size = [], 0
    if part or out is None:
        out = searched(part) if out is None else out.unionByName(searched(part))
    return out


def leaked_documents(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """doc_id and item_id once for each item that leaked into a document, with the longest run in words."""
    return leaks(documents, items, least).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("longest"))


def without_leaks(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """The documents into which no item leaked, all columns kept."""
    return documents.join(leaks(documents, items, least).select("doc_id").distinct(), "doc_id", "left_anti")
