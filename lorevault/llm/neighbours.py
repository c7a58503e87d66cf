"""The most similar vectors of every vector, by cosine similarity.

Vectors are put into cells around centres that are fitted on a bounded sample
(SAMPLE rows). A vector is compared with all vectors of the cells whose centres
are most similar to it; how many cells that takes is measured by comparing QUERIES
of them with all rows, so that the wanted recall holds (a wanted recall of 1
searches all cells and is exact). Cells lie in groups of similar centres, and the
vectors that ask in slices. A task holds the vectors of a group and compares one
slice with them, as it streams by, in matrix products, cell by cell. So a vector is
sent to every slice of its own group and once to each group that it asks, as
16-bit numbers (similarities are right to about 0.00002).

There are about CELLS_A_ROOT times as many cells as the square root of the number of
vectors, at most MOST_CELLS. Up to there the share of the collection that a vector
is compared with falls as the collection grows; beyond (a million and a half
vectors) it stays the same.

The dealt method, incremental search in a kd-tree of low-dimensional stable
projections with a chi-square stopping test, is in ``stopping_share``: it gives
the share of the collection that this test lets a query verify, and what it finds.
On vectors without low intrinsic dimension that is a large part of all, or too
little is found; see the README.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lorevault.functions.vectors import cosine
from lorevault.session import stage

#: Rows on which the centres and the number of cells to search are fitted.
SAMPLE = 65_536
#: Bytes of the vectors of a group of cells, which a task holds.
GROUP_BYTES = 48 << 20
#: Tasks there are at least, if each has a few thousand vectors.
LEAST_TASKS = 12
#: Vectors sent together, at most.
BLOCK = 2048
#: Vectors compared at once with a group.
CHUNK = 16_384
CELLS_A_ROOT = 6.8
MOST_CELLS = 8192
RECALL = 0.93
#: Queries whose true neighbours among all rows tell how many cells to search.
QUERIES = 512
BUFFER = 300_000


@dataclass
class Index:
    """Centres (one row each), the group of each, cells to search, and a similarity that most k-th neighbours exceed."""

    centres: np.ndarray
    group: np.ndarray
    groups: int
    slices: int
    probes: int
    likely: float

    def least(self, s: np.ndarray) -> np.ndarray:
        """The similarity of each query to the last centre whose cell it searches, from those to all centres."""
        if self.probes >= s.shape[1]:
            return np.full(len(s), -2, np.float32)
        return np.partition(s, s.shape[1] - self.probes, axis=1)[:, s.shape[1] - self.probes]


def _homes(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The most similar centre of every vector."""
    return np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])


def _centres(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        home = _homes(x, c)
        order = np.argsort(home, kind="stable")
        used, first = np.unique(home[order], return_index=True)
        total = np.add.reduceat(x[order], first)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c[used] = np.where(norm > 0, total / np.maximum(norm, 1e-12), c[used])
    return c


def fit(sample: np.ndarray, total: int, seed: int = 3) -> Index:
    """An index for ``total`` vectors from a sample of them, all of length 1."""
    rng = np.random.default_rng(seed)
    n = max(1, min(MOST_CELLS, len(sample) // 8, 2 ** round(math.log2(max(total, 4) ** 0.5 * CELLS_A_ROOT))))
    c = _centres(sample, n, 6, rng)
    groups = min(n, max(1, math.ceil(total * sample.shape[1] * 4 / GROUP_BYTES)))
    tasks = min(LEAST_TASKS, math.ceil(total / 5_000))
    # Few tasks: groups and slices about as many, which needs the fewest copies.
    groups = min(n, max(groups, round((tasks * 0.75) ** 0.5)))
    # Groups hold about as many vectors each: cells in the order of their likeness to one another are dealt by their share of the sample.
    size = np.bincount(_homes(sample, c), minlength=n)
    order = np.lexsort((np.arange(n), _homes(c, _centres(c, groups, 6, rng))))
    group = np.zeros(n, np.int64)
    group[order] = np.minimum((np.cumsum(size[order]) - size[order]) * groups // max(int(size.sum()), 1), groups - 1)
    return Index(c.astype(np.float32), group, groups, max(1, math.ceil(tasks / groups)), n, -2.0)


def _rank_of_cells(index: Index, ask: np.ndarray) -> np.ndarray:
    """The place of every cell in the order in which each query searches them."""
    order = np.argsort(-(ask @ index.centres.T), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    return rank


def _true_ranks(batches: Iterator[pa.RecordBatch], index: Index, ask_ids: np.ndarray, ask: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """For each query the most similar rows of every batch, with the rank of their cell."""
    rank = _rank_of_cells(index, ask)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, x = batch.column(0).to_numpy(), _matrix(batch)
        s = ask @ x.T
        s[ask_ids[:, None] == ids[None, :]] = -2
        m = min(k, len(ids))
        near = np.argpartition(-s, m - 1, axis=1)[:, :m]
        used, back = np.unique(near, return_inverse=True)
        home = _homes(x[used], index.centres)[back.ravel()]
        q = np.repeat(np.arange(len(ask)), m)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int32()), pa.array(ids[near].ravel()), pa.array(rank[q, home], pa.int32()), pa.array(np.take_along_axis(s, near, 1).ravel())],
            ["q", "other", "cell_rank", "similarity"],
        )


def measured(reps: DataFrame, index: Index, ask_ids: np.ndarray, ask: np.ndarray, k: int, recall: float) -> Index:
    """The index with the number of cells to search at which queries ``ask`` find the wanted share of their true neighbours among all rows."""
    if recall >= 1 or not len(ask):
        return index
    spark = reps.sparkSession
    known = spark.sparkContext.broadcast((index, ask_ids, ask))
    near = reps.mapInArrow(lambda b: _true_ranks(b, *known.value, k), "q int, other long, cell_rank int, similarity float")
    best = near.groupBy("q").applyInPandas(lambda p: p.nlargest(k, "similarity"), near.schema).toPandas()
    kth = best.groupby("q")["similarity"].min()
    return replace(index, probes=int(np.quantile(best["cell_rank"], recall)) + 1, likely=float(kth.quantile(0.02)))


def usable(df: DataFrame, row: str, vector: str, dimension: int | None = None) -> DataFrame:
    """id and vector of the rows whose vector has the usual length, no null, NaN or infinity, and isn't all zero."""
    rows = df.select(F.col(row).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id is not null and v is not null")
    if dimension is None:
        first = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        dimension = first["n"] if first else 0
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 3e38))
    return rows.where((F.size("v") == dimension) & ~bad & F.exists("v", lambda x: x != 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


PLACED = "id long, home int, least float, scale float, v binary, asked binary"


def _fixed(column: pa.Array, kind: type) -> np.ndarray:
    """Binary values of one length as rows of a matrix."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def _place(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """The home cell of each vector, the similarity of the last centre whose cell it searches, the groups it asks, and itself as 16-bit numbers."""
    own = [np.flatnonzero(index.group == g) for g in range(index.groups)]
    for batch in batches:
        x = _matrix(batch) if batch.num_rows else None
        for i in range(0, batch.num_rows, BLOCK):
            part = x[i : i + BLOCK]
            s = part @ index.centres.T
            least = index.least(s)
            asked = np.stack([(s[:, c] >= least[:, None]).any(1) if len(c) else np.zeros(len(s), bool) for c in own], 1)
            scale = np.abs(part).max(1) / 32767
            short = np.rint(part / scale[:, None]).astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, BLOCK), pa.array(s.argmax(1).astype(np.int32)), pa.array(least), pa.array(scale), pa.array([r.tobytes() for r in short], pa.binary()), pa.array([r.tobytes() for r in asked], pa.binary())],
                ["id", "home", "least", "scale", "v", "asked"],
            )


BLOCKS = "part int, side int, ids binary, cells binary, least binary, scale binary, vectors binary"


def _send(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors for the tasks: side 0 the vectors at home in a group, for all its slices; side 1 those to be compared with them, for one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, home, least, scale = (batch.column(c).to_numpy() for c in range(4))
        short, asked = _fixed(batch.column(4), np.int16), _fixed(batch.column(5), np.bool_) & batch.column(6).to_numpy(zero_copy_only=False)[:, None]
        slice_of = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % index.slices
        out = []
        for g in range(index.groups):
            own = np.flatnonzero(index.group[home] == g)
            for t in range(index.slices):
                for side, rows in ((0, own), (1, np.flatnonzero(asked[:, g] & (slice_of == t)))):
                    out += [(g * index.slices + t, side, rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part for part, _, _ in out], pa.int32()),
                pa.array([side for _, side, _ in out], pa.int32()),
                *(pa.array([column[i].tobytes() for _, _, i in out], pa.binary()) for column in (ids, home, least, scale, short)),
            ],
            ["part", "side", "ids", "cells", "least", "scale", "vectors"],
        )


class _Best:
    """The k best of every query so far."""

    def __init__(self, n: int, k: int, likely: float) -> None:
        self.k, self.least = k, np.full(n, likely, np.float32)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.kept = 0

    def add(self, query: np.ndarray, other: np.ndarray, similarity: np.ndarray) -> None:
        self.held.append((query, other, similarity))
        self.size += len(query)
        if self.size > 2 * self.kept + BUFFER:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        q, o, s = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((o, -s, q))
        q, o, s = q[order], o[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        full = rank == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])
        keep = rank < self.k
        self.held, self.size = [(q[keep], o[keep], s[keep])], int(keep.sum())
        self.kept = self.size
        return self.held[0]


def _block(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """ids, cells, least similarity of a centre, and vectors of one row."""
    ids, cells, least, scale = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in ((2, np.int64), (3, np.int32), (4, np.float32), (5, np.float32)))
    x = np.frombuffer(batch.column(6)[i].as_buffer(), np.int16).reshape(len(ids), -1).astype(np.float32) * scale[:, None]
    return ids, cells, least, x


def _compare(batches: Iterator[pa.RecordBatch], index: Index, k: int, likely: float) -> Iterator[pa.RecordBatch]:
    """For every vector asked in this group its k most similar ones there, of more than the likely similarity.

    The group's own vectors come first and are held; those to compare stream by, CHUNK at a time.
    """
    held: list[tuple] = []
    asking: list[tuple] = []
    group: _Group | None = None

    def lists() -> Iterator[pa.RecordBatch]:
        ids, _, least, x = (np.concatenate(c) for c in zip(*asking))
        asking.clear()
        if group:
            yield _lists(ids, x, least, group, k, likely)

    for batch in batches:
        for i, side in enumerate(batch.column(1).to_pylist()):
            if side == 0:
                held.append(_block(batch, i))
                continue
            if held:
                ids, cell, _, x = (np.concatenate(c) for c in zip(*held))
                held.clear()
                group = _Group(ids, cell, x, index.centres)
                del ids, cell, x
            asking.append(_block(batch, i))
            if sum(len(block[0]) for block in asking) >= CHUNK:
                yield from lists()
    if asking:
        yield from lists()


class _Group:
    """The vectors of a group, cell by cell, and the centres of its cells."""

    def __init__(self, ids: np.ndarray, cell: np.ndarray, x: np.ndarray, centres: np.ndarray) -> None:
        order = np.argsort(cell, kind="stable")
        found, first = np.unique(cell[order], return_index=True)
        self.centres = centres[found]
        self.cells = [(ids[rows], np.ascontiguousarray(x[rows].T)) for rows in np.split(order, first[1:])]


def _lists(ids: np.ndarray, x: np.ndarray, least: np.ndarray, group: _Group, k: int, likely: float) -> pa.RecordBatch:
    c, rows_of = np.nonzero(group.centres @ x.T >= least - 1e-4)
    ends = np.searchsorted(c, np.arange(1, len(group.cells)))
    best = _Best(len(x), k, likely)
    for (other, y), rows in zip(group.cells, np.split(rows_of, ends)):
        if not len(rows):
            continue
        s = x[rows] @ y
        new = best.least[rows] < -1
        if s.shape[1] > k and new.any():
            # k others at least are as similar as the k + 1 best of a cell, the row itself among them or not.
            best.least[rows[new]] = np.partition(s[new], s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1] - 1e-6
        at = np.flatnonzero((s > best.least[rows][:, None]).ravel())
        i, j = at // s.shape[1], at % s.shape[1]
        apart = ids[rows[i]] != other[j]
        i, j = i[apart], j[apart]
        best.add(rows[i], other[j], s[i, j])
    q, o, s = best.shrink()
    return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(o), pa.array(s)], ["id", "other", "similarity"])


def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of every id, from rows that come ordered by id."""
    kept: list[np.ndarray] = []

    def best(rows: list[np.ndarray]) -> pa.RecordBatch:
        i, o, s = rows
        order = np.lexsort((o, -s, i))
        i, o, s = i[order], o[order], s[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i, "left") + 1
        keep = rank <= k
        return pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(o[keep]), pa.array(rank[keep].astype(np.int32)), pa.array(s[keep])], ["id", "other", "rank", "similarity"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in range(3)]
        if kept:
            rows = [np.concatenate(x) for x in zip(kept, rows)]
        # The last id may go on in the next batch.
        end = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        kept = [x[end:] for x in rows]
        if end:
            yield best([x[:end] for x in rows])
    if kept:
        yield best(kept)


LISTS = "id long, other long, rank int, similarity float"


def _best_of(found: DataFrame, buckets: int, k: int) -> DataFrame:
    spread = found.select("id", "other", "similarity").repartition(buckets, "id").sortWithinPartitions("id")
    return spread.mapInArrow(lambda b: _merge(b, k), LISTS)


def nearest(df: DataFrame, k: int, row: str = "rowid", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """The k most similar vectors of every usable vector: id, other, rank (from 1), similarity (cosine).

    Null, short (of another length than most), all-zero, NaN and infinite
    vectors take no part. Equal vectors are compared once and share their
    neighbours: the copies of a vector are each other's first neighbours, ties
    go to the lesser id. Fewer than k other vectors give shorter lists; an empty
    table gives no rows; other columns are never read.
    """
    spark = df.sparkSession
    rows = usable(df, row, vector)
    keyed = rows.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(9), "v").alias("h2"))
    several = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = stage(keyed.join(several, ["h1", "h2"]).select("id", "rep"), "near-copies")
    reps = stage(rows.join(copies.where("id <> rep").select("id"), "id", "left_anti"), "near-vectors")
    total = reps.count()
    share = SAMPLE / max(total, 1)
    sample = reps.where(F.pmod(F.xxhash64("id", F.lit(21)), F.lit(1_000_000)) < int(min(share, 1) * 1_000_000)).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], LISTS)
    taken = sample.combine_chunks().to_batches()[0]
    x, ids = _matrix(taken), taken.column(0).to_numpy()
    # Queries that the centres were not fitted on, as most vectors are.
    order = np.random.default_rng(4).permutation(len(x))
    ask, rest = np.split(order, [min(QUERIES, len(x) // 4)])
    index = spark.sparkContext.broadcast(measured(reps, fit(x[rest], total), ids[ask], x[ask], k, recall))
    buckets = max(8, math.ceil(total / 50_000))

    placed = stage(reps.mapInArrow(lambda b: _place(b, index.value), PLACED), "near-placed")

    def lists(asked: DataFrame, likely: float) -> DataFrame:
        blocks = asked.mapInArrow(lambda b: _send(b, index.value), BLOCKS)
        spread = blocks.repartitionById(index.value.groups * index.value.slices, "part").sortWithinPartitions("side")
        return _best_of(spread.mapInArrow(lambda b: _compare(b, index.value, k, likely), "id long, other long, similarity float"), buckets, k)

    # The likely similarity is a shortcut: who has fewer than k neighbours above it is compared again without it.
    first = stage(lists(placed.withColumn("asks", F.lit(True)), index.value.likely), "near-lists")
    enough = stage(first.where(F.col("rank") == k).select("id"), "near-enough")
    short = placed.join(enough.withColumn("asks", F.lit(False)), "id", "left").select(*placed.columns, F.coalesce("asks", F.lit(True)).alias("asks"))
    again = stage(lists(short, -2.0), "near-again")
    return _with_copies(first.join(enough, "id", "left_semi").unionByName(again), copies, k, buckets)


def _with_copies(lists: DataFrame, copies: DataFrame, k: int, buckets: int) -> DataFrame:
    """Lists of representatives turned into lists of all rows, with at most the k + 1 first copies of each vector."""
    # First within salted parts of a class, so that a class of any size is no single task.
    part = Window.partitionBy("rep", F.pmod(F.xxhash64("id"), F.lit(1024))).orderBy("id")
    first = copies.withColumn("n", F.row_number().over(part)).where(F.col("n") <= k + 1)
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1).select("id", "rep")
    # Each neighbour stands for its first copies; a row's own copies come before all others.
    others = lists.join(first.select(F.col("rep").alias("other"), F.col("id").alias("copy")), "other", "left").select("id", F.coalesce("copy", "other").alias("other"), "similarity")
    own = copies.select("id", "rep").join(first.select("rep", F.col("id").alias("other")), "rep").where("id <> other").select("id", "other", F.lit(1.0).cast("float").alias("similarity"))
    owners = copies.where("id <> rep").select(F.col("rep").alias("id"), F.col("id").alias("copy"))
    # Lists of rows without copies, and of representatives, stay; the other copies take their representative's.
    taken = others.join(owners, "id").select(F.col("copy").alias("id"), "other", "similarity")
    every = others.unionByName(taken).unionByName(own)
    return _best_of(every, buckets, k)


def mutual(lists: DataFrame, least: float, vectors: DataFrame, row: str = "rowid", vector: str = "embedding") -> DataFrame:
    """Pairs of at least this cosine similarity where each is in the other's list: id_a < id_b.

    Similarities of the lists within 0.0001 of ``least`` are computed again from the vectors.
    """
    near = 1e-4
    close = lists.where(F.col("similarity") >= least - near)
    a = close.where("id < other").select(F.col("id").alias("id_a"), F.col("other").alias("id_b"), "similarity")
    b = close.where("id > other").select(F.col("other").alias("id_a"), F.col("id").alias("id_b"))
    pairs = stage(a.join(b, ["id_a", "id_b"]), "near-mutual")
    unsure = pairs.where(F.col("similarity") < least + near).select("id_a", "id_b")
    v = vectors.select(F.col(row).cast("long").alias("id"), F.col(vector).alias("v"))
    both = unsure.join(v.select(F.col("id").alias("id_a"), F.col("v").alias("va")), "id_a").join(v.select(F.col("id").alias("id_b"), F.col("v").alias("vb")), "id_b")
    sure = both.where(F.round(cosine(F.col("va"), F.col("vb")), 9) >= least).select("id_a", "id_b")
    return pairs.where(F.col("similarity") >= least + near).select("id_a", "id_b").unionByName(sure)


def stopping_share(x: np.ndarray, k: int = 10, dimensions: int = 8, probability: float = 0.9, ratio: float = 1.0, queries: int = 200, seed: int = 5) -> tuple[float, float]:
    """Share of the collection that the projected search verifies before its chi-square test lets it stop, and the share of true neighbours it finds.

    With Gaussian projections the projected distance of a pair, squared and
    divided by its true one, is chi-square with ``dimensions`` degrees of
    freedom; a search may stop where all nearer than the k-th best so far,
    divided by ``ratio``, would have been met with the given probability.
    """
    rng = np.random.default_rng(seed)
    p = x @ rng.standard_normal((x.shape[1], dimensions)).astype(np.float32)
    bound = float(np.quantile(rng.chisquare(dimensions, 200_000), probability)) / ratio**2
    shares, found = [], []
    for q in rng.choice(len(x), min(queries, len(x)), replace=False):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        true = np.argsort(d)[: min(k, len(x) - 1)]
        seen = ((p - p[q]) ** 2).sum(1) <= bound * d[true[-1]]
        shares.append(float(seen.mean()))
        found.append(float(seen[true].mean()))
    return float(np.mean(shares)), float(np.mean(found))
