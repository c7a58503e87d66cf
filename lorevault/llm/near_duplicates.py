"""Near-duplicate texts by deletion-variant signatures of their word sets.

A text is a bit vector over the vocabulary, a bit for each distinct word. Two
texts of s and t words with similarity (words in both / words in either) of at
least J differ in at most D(s, t) bits. The vocabulary is cut into
m = D // 2 + 1 segments, so that some segment of the two differs by at most one
bit. A segment is signed by its rarest words, and also with each of these
deleted (one wildcard bit); if the segments differ by at most one bit, the plain
signature of one text is among the signatures of the other. Signatures meet in an
equality join, where candidates are filtered by a parity sketch whose distance
never exceeds the number of differing bits, and the word sets of what remains are
compared (words as 32-bit hashes, in which two words of one pair of texts of 30
words are confused in about one of ten million pairs).

A signature of frequent words only would meet too many texts; it is extended by
one word of the rest of the text, once for each of the rarest words there that
could suffice for a similar text to have one of them (prefix filter). Where
signature and word may still have more than MOST_MET texts in common, these are
dealt into blocks, and each pair of blocks meets by itself. So no bucket is capped, no
pair is lost, and what a task holds doesn't grow with the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorevault.llm.common import Ids, flat_words
from lorevault.llm.tables import count_tables
from lorevault.operators.graph import components
from lorevault.session import stage

#: Sizes, in bits, of the tables of word counts and signature counts; they grow with the number of texts within these bounds and
#: are broadcast (4 bytes an entry). Entries that collide make words and signatures look more frequent, which costs time only.
WORD_BITS = 18, 24
KEY_BITS = 20, 26
#: Only signatures whose words all occur in more texts than this are counted.
FREQUENT = 256
#: A signature that more texts have is extended.
HOT = 1000
#: Texts that can meet by one signature; more are dealt into blocks.
MOST_MET = 1 << 15
#: Signatures that one task joins.
BUCKET_ROWS = 3_000_000
#: Candidate pairs sent on together.
FOUND_PAIRS = 2_000_000
#: Texts signed together; their numbers fit 16 bits.
MOST_TEXTS = 1 << 14
NO_COUNT = np.iinfo(np.int64).max
#: Segment numbers in use; each text is cut for the few of them that its partners' sizes ask for.
GRID = sorted({math.ceil(1.4**k) for k in range(60)})
#: Bits of a sketch: LOW_BITS beside the number of words in one 64-bit number, the others in a second one.
LOW_BITS = 54
SKETCH_BITS = LOW_BITS + 64


def max_difference(s: int, t: int, tenths: int) -> int:
    """Most differing bits of two sets of s and t words that are similar enough."""
    both = -(-tenths * (s + t) // (10 + tenths))
    return s + t - 2 * both


@lru_cache(maxsize=100_000)
def segment_numbers(s: int, tenths: int) -> dict[int, int]:
    """Into how many segments a set of s words is cut, for all sizes of a partner; and how many of its words such a partner may lack."""
    out: dict[int, int] = {}
    for t in range(-(-tenths * s // 10), 10 * s // tenths + 1):
        d = max_difference(s, t, tenths)
        m = next(g for g in GRID if g > d // 2)
        out[m] = max(out.get(m, 0), (d + s - t) // 2)
    return out


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    h = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(32))
    return h


def _positions(start: np.ndarray, n: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of every word of ``texts``, and which of them it belongs to."""
    size = n[texts]
    of = np.repeat(np.arange(len(texts)), size)
    return np.arange(len(of)) + np.repeat(start[texts] - (np.cumsum(size) - size), size), of


class Texts:
    """A batch of word sets: runs of ``word``, each run ordered from rare to frequent."""

    def __init__(self, start: np.ndarray, n: np.ndarray, word: np.ndarray, count: np.ndarray, tenths: int) -> None:
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((word, count, owner))
        self.start, self.n, self.word, self.count = start, n, word[order], count[order]
        self.cuts = [segment_numbers(s, tenths) for s in n.tolist()]

    def signed(self) -> Iterator[tuple]:
        """For each kind of signature: segment number, keys, texts, segments, plain, count of its rarest word."""
        for m in sorted({x for cut in self.cuts for x in cut}):
            own = np.flatnonzero(np.fromiter((m in cut for cut in self.cuts), bool, len(self.cuts)))
            at, of = _positions(self.start, self.n, own)
            seg = (_mix(self.word[at], m) % np.uint64(m)).astype(np.int64)
            order = np.argsort(of * m + seg, kind="stable")
            w, c, group = self.word[at][order], self.count[at][order], (of * m + seg)[order]
            head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.append(head, len(group)))
            text, g = own[group[head] // m], group[head] % m

            def nth(k: int) -> tuple[np.ndarray, np.ndarray]:
                there = size > k
                i = np.where(there, head + k, head)
                return np.where(there, w[i], np.uint64(0)), np.where(there, c[i], NO_COUNT)

            (w0, c0), (w1, c1), (w2, _) = nth(0), nth(1), nth(2)
            # Plain, without the rarest, without the second rarest word.
            yield m, _mix(w0, w1, g, m), text, g, True, c0
            yield m, _mix(w1, w2, g, m), text, g, False, c1
            two = size > 1
            yield m, _mix(w0, w2, g, m)[two], text[two], g[two], False, c0[two]
            # Segments without a word: the plain signature of nothing.
            full = np.zeros(len(own) * m, bool)
            full[group[head]] = True
            i = np.flatnonzero(~full)
            none = np.zeros(len(i), np.uint64)
            yield m, _mix(none, none, i % m, m), own[i // m], i % m, True, np.full(len(i), NO_COUNT)

    def extended(self, m: int, key: np.ndarray, text: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each key with each of the rarest words outside its segment, one more than a similar text may lack: keys, their numbers before, counts of the words."""
        lacks = np.fromiter((self.cuts[t][m] for t in text.tolist()), np.int64, len(text))
        at, i = _positions(self.start, self.n, text)
        outside = (_mix(self.word[at], m) % np.uint64(m)).astype(np.int64) != seg[i]
        i, at = i[outside], at[outside]
        rest = np.bincount(i, minlength=len(key))
        rank = np.arange(len(i)) - np.repeat(np.cumsum(rest) - rest, rest)
        first = rank <= lacks[i]
        i, at = i[first], at[first]
        # A text with so few words outside may share none of them.
        few = np.flatnonzero(rest <= lacks)
        return np.concatenate([_mix(key[i], self.word[at]), _mix(key[few], 1)]), np.concatenate([i, few]), np.concatenate([self.count[at], np.full(len(few), NO_COUNT)])


def frequent_slots(texts: Texts, slots: int, frequent: int = FREQUENT) -> np.ndarray:
    """Slots of the signatures made of frequent words."""
    return np.concatenate([_slot(key[c > frequent], slots) for _, key, _, _, _, c in texts.signed()] or [np.zeros(0, np.int64)])


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    return (key >> np.uint64(20)).astype(np.int64) % slots


def _dealt(key: np.ndarray, most: np.ndarray, ids: np.ndarray, met: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that up to ``most`` texts have, once for every pair of blocks with the text's own block: keys, their numbers before."""
    blocks = np.where(most > met, -(-2 * most // met), 1)
    i = np.repeat(np.arange(len(key)), blocks)
    other = np.arange(len(i)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = (_mix(ids, 5) % blocks.astype(np.uint64)).astype(np.int64)[i]
    return np.where(blocks[i] > 1, _mix(key[i], np.minimum(own, other), np.maximum(own, other) + 2), key[i]), i


def signatures(texts: Texts, ids: np.ndarray, key_counts: np.ndarray, frequent: int = FREQUENT, hot: int = HOT, met: int = MOST_MET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, text number and whether it is a plain signature; keys that too many texts have are extended, and dealt into blocks if they may still have too many."""
    keys, owners, plains = [], [], []
    for m, key, text, seg, plain, count in texts.signed():
        n = key_counts[_slot(key, len(key_counts))].astype(np.int64)
        many = (count > frequent) & (n > hot)
        k, i, word_count = texts.extended(m, key[many], text[many], seg[many])
        t = text[many][i]
        k, j = _dealt(k, np.minimum(n[many][i], word_count), ids[t], met)
        keys += [key[~many], k]
        owners += [text[~many], t[j]]
        plains.append(np.full(len(key) - int(many.sum()) + len(k), plain))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(plains)


def _sketch(start: np.ndarray, n: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Parity of the words at each of SKETCH_BITS hashed bits, with the number of words (at most 1023) at the low end: two numbers a text."""
    place = _mix(word, 3) % np.uint64(SKETCH_BITS)
    low = place < LOW_BITS
    one = np.uint64(1)
    bits = np.stack([np.where(low, np.left_shift(one, place + np.uint64(10)), 0), np.where(low, 0, np.left_shift(one, place - np.uint64(LOW_BITS)))], 1).astype(np.uint64)
    parity = np.bitwise_xor.reduceat(bits, start) if len(start) else np.zeros((0, 2), np.uint64)
    parity[:, 0] |= np.minimum(n, 1023).astype(np.uint64)
    return parity.view(np.int64)


def _texts(batch: pa.RecordBatch, counts: np.ndarray, tenths: int) -> tuple[np.ndarray, Texts]:
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    word = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint32)
    return ids, Texts(offsets[:-1] - offsets[0], np.diff(offsets), word.astype(np.uint64), counts[word % len(counts)], tenths)


def _count_words(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        word = batch.column(0).flatten().to_numpy().view(np.uint32)
        yield {"words": np.bincount(word % slots, minlength=slots)}


def _count_keys(batches: Iterator[pa.RecordBatch], counts: np.ndarray, slots: int, tenths: int) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield {"keys": np.bincount(frequent_slots(_texts(batch, counts, tenths)[1], slots), minlength=slots)}


def _sign(batches: Iterator[pa.RecordBatch], counts: np.ndarray, key_counts: np.ndarray, tenths: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: its keys, for each key the text it is of, and these texts' ids and sketches."""
    for batch in (b.slice(i, MOST_TEXTS) for b in batches for i in range(0, b.num_rows, MOST_TEXTS)):
        ids, texts = _texts(batch, counts, tenths)
        key, text, plain = signatures(texts, ids, key_counts)
        sketch = _sketch(texts.start, texts.n, texts.word)
        bucket = ((key >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
        low = (key.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | plain
        order = np.lexsort((text, bucket))
        bucket, low, text = bucket[order], low[order].view(np.int32), text[order]
        used, first = np.unique(bucket, return_index=True)
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])])
        nth = np.cumsum(new) - 1
        at = nth - np.repeat(nth[first], np.diff(np.append(first, len(nth))))
        keys_to = pa.array(np.append(first, len(bucket)), pa.int32())
        ids_to = pa.array(np.append(nth[first], int(new.sum())), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()),
                pa.ListArray.from_arrays(keys_to, pa.array(low)),
                pa.ListArray.from_arrays(keys_to, pa.array(at.astype(np.int16))),
                pa.ListArray.from_arrays(ids_to, pa.array(ids[text[new]])),
                pa.ListArray.from_arrays(pa.array(ids_to.to_numpy() * 2, pa.int32()), pa.array(sketch[text[new]].ravel())),
            ],
            ["bucket", "keys", "texts", "ids", "sketches"],
        )


def _join_bucket(batches: Iterator[pa.RecordBatch], tenths: int) -> Iterator[pa.RecordBatch]:
    """Pairs of texts that share a key, one of them with its plain signature, and may be similar by their sketches; the batches are those of one bucket."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    n = 0
    for batch in batches:
        key, text, ids, sketch = (batch.column(c) for c in range(1, 5))
        sizes = np.diff(ids.offsets.to_numpy())
        first = n + np.cumsum(sizes) - sizes
        parts[0].append(key.flatten().to_numpy().view(np.uint32))
        parts[1].append(text.flatten().to_numpy().astype(np.int64) + np.repeat(first, np.diff(text.offsets.to_numpy())))
        parts[2].append(ids.flatten().to_numpy())
        parts[3].append(sketch.flatten().to_numpy().view(np.uint64).reshape(-1, 2))
        n += int(sizes.sum())
    if not n:
        return
    key, text, ids, sketch = map(np.concatenate, parts)
    parts.clear()
    order = np.argsort(key)
    key, text = key[order], text[order]
    sketch = sketch[text]
    plain, key = (key & np.uint32(1)).astype(bool), key >> np.uint32(1)
    words, parity, more = (sketch[:, 0] & np.uint64(1023)).astype(np.int16), sketch[:, 0] >> np.uint64(10), sketch[:, 1].copy()
    # Most differing bits by the words of both; a capped number of words says nothing, the sets are compared later.
    most = np.array([max_difference(0, t, tenths) if t < 1023 else SKETCH_BITS for t in range(2047)], np.int16)
    found: list[np.ndarray] = []

    def pairs() -> pa.RecordBatch:
        code = np.unique(np.concatenate(found))
        found.clear()
        x, y = ids[code // len(ids)], ids[code % len(ids)]
        other = x != y
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[other]), pa.array(np.maximum(x, y)[other])], ["a", "b"])

    i, step = np.arange(len(key)), 1
    while len(i):
        i = i[i + step < len(key)]
        j = i + step
        same = key[j] == key[i]
        i, j = i[same], j[same]
        one = plain[i] | plain[j]
        a, b = i[one], j[one]
        bound = most[words[a] + words[b]]
        differ = np.bitwise_count(parity[a] ^ parity[b])
        fits = differ <= bound
        a, b = a[fits], b[fits]
        fits = differ[fits] + np.bitwise_count(more[a] ^ more[b]) <= bound[fits]
        if fits.any():
            x, y = text[a[fits]], text[b[fits]]
            found.append(np.minimum(x, y) * len(ids) + np.maximum(x, y))
            if sum(map(len, found)) >= FOUND_PAIRS:
                yield pairs()
        step += 1
    if found:
        yield pairs()


def _word_sets(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    number = Ids()
    for batch in batches:
        found, owner, n = flat_words(batch.column(1).to_pylist())
        word = number(found, len(owner))
        order = np.lexsort((word, owner))
        word, owner = word[order], owner[order]
        first = np.ones(len(word), bool)
        first[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
        word, owner = word[first], owner[first]
        n = np.bincount(owner, minlength=len(n))
        enough = n >= least_words
        keep = enough[owner]
        word, n = word[keep], n[enough]
        if not len(n):
            continue
        start = np.cumsum(n) - n
        keys = [np.add.reduceat(_mix(word, seed), start).view(np.int64) for seed in (11, 12)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(word)), pa.int32()), pa.array((word >> np.uint64(32)).astype(np.uint32).view(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(enough)), pa.array(keys[0]), pa.array(keys[1]), lists], ["id", "k1", "k2", "words"])


def word_sets(df: DataFrame, row: str, text: str, least_words: int = 10) -> DataFrame:
    """id, a 128-bit key of the set (k1, k2) and the words as 32-bit numbers, of texts with enough distinct words."""
    rows = df.select(F.col(row).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    return rows.mapInArrow(lambda b: _word_sets(b, least_words), "id long, k1 long, k2 long, words array<int>")


def classes(df: DataFrame, row: str, text: str, least_words: int = 10) -> tuple[DataFrame, DataFrame]:
    """The classes of texts with equal word sets, however many they are.

    Two tables: rep (the least row id of a class) with its words; and id, rep of
    the rows of classes with several members.
    """
    keys = stage(word_sets(df, row, text, least_words).select("id", "k1", "k2"), "near-keys")
    several = keys.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stage(keys.join(several, ["k1", "k2"]).select("id", "rep"), "near-members")
    copies = members.where("id <> rep").select("id")
    sets = word_sets(df, row, text, least_words).select("id", "words").join(copies, "id", "left_anti")
    return stage(sets.select(F.col("id").alias("rep"), "words"), "near-sets"), members


def similar_classes(df: DataFrame, row: str, text: str, tenths: int = 7, least_words: int = 10) -> DataFrame:
    """All pairs of class representatives whose word sets are similar: a, b (a < b), shared, either.

    ``tenths`` is the similarity in tenths. Null and empty texts and those with
    fewer than ``least_words`` distinct words take no part, nor do rows without
    id; ties at the threshold belong to the result; an empty table gives no
    rows; other columns are never read.
    """
    return _similar(classes(df, row, text, least_words)[0], tenths)


def _table_size(n: int, bits: tuple[int, int]) -> int:
    return 1 << min(max(math.ceil(math.log2(2 * n + 2)), bits[0]), bits[1])


def _similar(sets: DataFrame, tenths: int) -> DataFrame:
    spark = sets.sparkSession
    n = sets.count()
    word_slots, key_slots = _table_size(n, WORD_BITS), _table_size(n, KEY_BITS)
    counts = spark.sparkContext.broadcast(count_tables(sets.select("words"), {"words": word_slots}, lambda b: _count_words(b, word_slots))["words"])
    found = count_tables(sets, {"keys": key_slots}, lambda b: _count_keys(b, counts.value, key_slots, tenths))["keys"]
    key_counts = spark.sparkContext.broadcast(np.minimum(found, np.iinfo(np.int32).max).astype(np.int32))
    n_buckets = max(1, math.ceil(n * 60 / BUCKET_ROWS))
    signed = sets.mapInArrow(
        lambda b: _sign(b, counts.value, key_counts.value, tenths, n_buckets),
        "bucket int, keys array<int>, texts array<short>, ids array<long>, sketches array<long>",
    )
    # Each bucket is a task of its own.
    pairs = signed.repartitionById(n_buckets, "bucket").mapInArrow(lambda b: _join_bucket(b, tenths), "a long, b long").distinct()
    a, b = sets.select(F.col("rep").alias("a"), F.col("words").alias("wa")), sets.select(F.col("rep").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("wa", "wb")).alias("shared"), (F.size("wa") + F.size("wb")).alias("sum"))
    return both.select("a", "b", "shared", (F.col("sum") - F.col("shared")).alias("either")).where(F.col("shared") * 10 >= F.col("either") * tenths)


def similar_pairs(df: DataFrame, row: str, text: str, tenths: int = 7, least_words: int = 10) -> DataFrame:
    """All pairs of rows that are similar, those of equal word sets included: id_a < id_b."""
    sets, members = classes(df, row, text, least_words)
    links = stage(_similar(sets, tenths).select("a", "b"), "near-links")

    def expanded(pairs: DataFrame, end: str) -> DataFrame:
        of = members.select(F.col("rep").alias(end), F.col("id").alias("member"))
        return pairs.join(of, end, "left").withColumn(end, F.coalesce("member", end)).drop("member")

    own = members.select("rep", F.col("id").alias("a"))
    same = own.join(own.withColumnRenamed("a", "b"), "rep").where("a < b").select("a", "b")
    both = expanded(expanded(links, "a"), "b").unionByName(same)
    return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def groups(df: DataFrame, row: str, text: str, tenths: int = 7, least_words: int = 10) -> DataFrame:
    """One row per text with enough words: id, rep (of its class of equal sets), group_id and the number of links of its class.

    group_id is the least representative reachable over similar pairs.
    """
    sets, members = classes(df, row, text, least_words)
    links = stage(_similar(sets, tenths).select("a", "b"), "near-links")
    found = components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    every = sets.select(F.col("rep").alias("id"), "rep").unionByName(members.where("id <> rep"))
    out = every.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
    return out.select("id", "rep", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
