"""Pages of repeated keywords, link lists or product tags.

Corpus counts of words and of neighbouring pairs give the pointwise mutual
information (PMI) of every pair and its burstiness: the share of the documents
with the pair that repeat it excessively. A collocation (high PMI) that is bursty
in the corpus, or repeated in the document itself, marks the words of a line as
keyword stuffing; lines of links and of tags are told by their form. A document
whose mean PMI is that of words thrown together is flagged as word salad.

All counts are exact (words and pairs are told apart by hashes of 64 bits). The
documents are cut into blocks by a hash of the row. A block sends the counts of
its pairs and words, as arrays, to buckets of the hash, where they are summed over
all blocks, and gets back those of its own; what a task holds depends on the size
of a block, not on the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lorevault.llm.common import WORD, Ids

#: Bytes of text in a block, at most about; smaller inputs are cut into some blocks for every core.
BLOCK_BYTES = 16 << 20
#: Documents whose words are held at once.
CHUNK = 500
#: A pair so often in one document, and with such a share of its pairs, is repeated excessively.
REPEATS = 3
REPEAT_SHARE = 0.01
URL = re.compile(r"(?:https?://|www\.)\S+")
TAG = re.compile(r"(?:^|\s)#[^\W\d_]\w*")
PIECES = re.compile(r"\s*(?:[,，、;；|/·•＃]|\s[-–—]\s|\s:\s)\s*")


class Lines:
    """The words of a batch of documents, with the document and line of each, and the form of every line.

    Without ``forms``, for counting, a document is one line.
    """

    def __init__(self, texts: list[str | None], ids: Ids, forms: bool = True) -> None:
        found, n_words, doc, form = [], [], [], []
        for d, text in enumerate(texts):
            lines = [(WORD.findall(x.lower()), x) for x in ((text or "").split("\n") if forms else [text or ""])]
            for w, kind in _merged(lines) if forms else [(w, TEXT) for w, _ in lines if w]:
                found.append(w)
                n_words.append(len(w))
                doc.append(d)
                form.append(kind)
        self.n = np.array(n_words, np.int64)
        self.line_doc = np.array(doc, np.int64)
        self.form = np.array(form, np.int64)
        total = int(self.n.sum())
        self.word = ids(found, total)
        if forms:
            self.number = np.fromiter((w[0].isdigit() for x in found for w in x), bool, total)
        self.line = np.repeat(np.arange(len(self.n)), self.n)
        self.doc = self.line_doc[self.line] if total else np.zeros(0, np.int64)
        # Neighbours in the same document, over the line's end too.
        self.left = np.flatnonzero(self.doc[1:] == self.doc[:-1])
        a, b = self.word[:-1][self.left], self.word[1:][self.left]
        h = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
        self.pair = h ^ (h >> np.uint64(29))
        # How often the pair is in its document.
        self.pair_doc = self.doc[self.left]
        order = np.lexsort((self.pair, self.pair_doc))
        p, d = self.pair[order], self.pair_doc[order]
        self.first = order[np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])])] if len(order) else order
        group = np.cumsum(np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])])) - 1 if len(order) else order
        self.times = np.zeros(len(order), np.int64)
        if len(order):
            self.times[order] = np.bincount(group)[group]
        # In a longer text a pair must be there more often to be repeated excessively.
        length = np.bincount(self.pair_doc, minlength=len(texts))
        self.often = self.times >= np.maximum(REPEATS, REPEAT_SHARE * length)[self.pair_doc]


#: Forms of a line: running text, a list of short pieces, links without explanation, tags.
TEXT, LIST, LINKS, TAGS = 0, 1, 2, 3


def _form(line: str, n: int) -> int:
    urls = URL.findall(line) if "://" in line or "www." in line else []
    if urls:
        rest = n - sum(len(WORD.findall(u.lower())) for u in urls)
        if rest <= 6 * len(urls):
            return LINKS
    tags = TAG.findall(line) if line.count("#") >= 3 else []
    if len(tags) >= 3 and 2 * len(tags) >= len(line.split()):
        return TAGS
    pieces = [p for p in PIECES.split(line) if p]
    return LIST if len(pieces) >= 4 and n <= 4 * len(pieces) else TEXT


def _merged(lines: list[tuple[list[str], str]]) -> list[tuple[list[str], int]]:
    """Words and form of each line; lines of a few words each, one after another, are one list."""
    out: list[tuple[list[str], int]] = []
    run: list[list[str]] = []

    def close() -> None:
        if len(run) >= 6:
            out.append(([w for x in run for w in x], LIST))
        else:
            out.extend((x, TEXT) for x in run)
        run.clear()

    for w, line in lines:
        if not w:
            continue
        kind = _form(line, len(w))
        if kind == TEXT and len(w) <= 4:
            run.append(w)
            continue
        close()
        out.append((w, kind))
    close()
    return out


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in ascending order and the sum of each count for them."""
    order = np.argsort(keys)
    k = keys[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else order
    return k[start], *(np.add.reduceat(c[order].astype(np.int64), start) if len(k) else np.zeros(0, np.int64) for c in counts)


def _count(key: tuple, pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Occurrences, documents and repeating documents of the pairs of a block; occurrences of its words.

    One row for each bucket, also an empty one: so every bucket sees the words of all blocks.
    """
    ids = Ids()
    pairs, words = [[np.zeros(0, np.uint64)], [], []], [[np.zeros(0, np.uint64)], []]
    texts = pdf["text"].tolist()
    for i in range(0, len(texts), CHUNK):
        x = Lines(texts[i : i + CHUNK], ids, forms=False)
        for k, v in zip(pairs, (x.pair[x.first], x.times[x.first], x.often[x.first])):
            k.append(v)
        for k, v in zip(words, np.unique(x.word, return_counts=True)):
            k.append(v)
    pair, *n = map(np.concatenate, pairs)
    pair = _summed(pair, n[0], np.ones(len(pair), np.int64), n[1])
    word = _summed(*map(np.concatenate, words))
    total = int(word[1].sum())
    out = {"block": key[0], "bucket": np.arange(buckets), "total": total}
    for names, (k, *n) in ((("pair", "n", "docs", "bursts"), pair), (("word", "word_n"), word)):
        at = (k % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(1, buckets))
        for name, v in zip(names, (k, *(c.astype(np.int32) for c in n))):
            out[name] = [p.tobytes() for p in np.split(v[order], ends)]
    return pd.DataFrame(out)


def _parts(column: pd.Series, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of all rows as one, and where each ends."""
    parts = [np.frombuffer(b, kind) for b in column]
    return np.concatenate(parts), np.cumsum([len(p) for p in parts])


def _corpus(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of one bucket over all blocks, for each block those of its pairs and words.

    Pairs of one document and words that are there once are left out: the
    document itself shows their counts, and they are not bursty.
    """
    pair, ends = _parts(pdf["pair"], np.uint64)
    known, n, docs, bursts = _summed(pair, *(_parts(pdf[c], np.int32)[0] for c in ("n", "docs", "bursts")))
    bursty = (bursts >= 3) & (bursts >= 0.25 * docs)
    word, word_ends = _parts(pdf["word"], np.uint64)
    known_word, word_n = _summed(word, _parts(pdf["word_n"], np.int32)[0])
    out = {"block": pdf["block"].to_numpy(), "total": int(pdf["total"].sum())}
    for names, keys, ends, found, keep, values in (
        (("pair", "n", "bursty"), pair, ends, known, docs >= 2, (n, bursty)),
        (("word", "word_n"), word, word_ends, known_word, word_n >= 2, (word_n,)),
    ):
        at = np.searchsorted(found, keys)
        kept = keep[at] if len(keys) else np.zeros(0, bool)
        ends = np.concatenate([[0], np.cumsum(kept)])[ends[:-1]]
        at = at[kept]
        for name, v in zip(names, (found, *values)):
            out[name] = [p.tobytes() for p in np.split(v[at], ends)]
    return pd.DataFrame(out)


class Counts:
    """What is known of the pairs and words of a block in the whole corpus."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.total = float(np.log(max(int(rows["total"].iloc[0]), 1)))
        pair, word = _parts(rows["pair"], np.uint64)[0], _parts(rows["word"], np.uint64)[0]
        order = np.argsort(pair)
        self.pair, self.n, self.bursty = pair[order], _parts(rows["n"], np.int64)[0][order], _parts(rows["bursty"], np.bool_)[0][order]
        order = np.argsort(word)
        self.word, self.word_n = word[order], _parts(rows["word_n"], np.int64)[0][order]

    @staticmethod
    def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
        return at[back], (known[at] == distinct)[back] if len(known) else np.zeros(len(keys), bool)

    def of_pairs(self, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log count of each pair and whether it is bursty."""
        at, found = self._find(self.pair, pair)
        n, bursty = times.copy(), np.zeros(len(pair), bool)
        n[found], bursty[found] = self.n[at[found]], self.bursty[at[found]]
        return np.log(n), bursty

    def of_words(self, word: np.ndarray) -> np.ndarray:
        at, found = self._find(self.word, word)
        n = np.ones(len(word), np.int64)
        n[found] = self.word_n[at[found]]
        return np.log(n)


def _judge(batches: Iterator[pd.DataFrame], counts: Counts, least_pmi: float, salad_pmi: float) -> Iterator[pd.DataFrame]:
    ids = Ids()
    for pdf in batches:
        x = Lines(pdf["text"].tolist(), ids)
        n_docs = len(pdf)
        left = x.left
        pairs, bursty = counts.of_pairs(x.pair, x.times)
        words = counts.of_words(x.word)
        pmi = pairs + counts.total - words[left] - words[left + 1]
        excess = (pmi >= least_pmi) & (bursty | x.often)
        excess &= (x.line[left] == x.line[left + 1]) & ~x.number[left] & ~x.number[left + 1]
        covered = np.zeros(len(x.word), bool)
        covered[left[excess]] = True
        covered[left[excess] + 1] = True
        share = np.bincount(x.line, covered, minlength=len(x.n)) / np.maximum(x.n, 1)
        burst = excess & bursty
        covered[:] = False
        covered[left[burst]] = True
        covered[left[burst] + 1] = True
        in_corpus = np.bincount(x.line, covered, minlength=len(x.n)) / np.maximum(x.n, 1)
        stuffed = ((x.form == TEXT) & (share >= 0.6) & (in_corpus >= 0.3)) | ((x.form == LIST) & ((in_corpus >= 0.12) | (share >= 0.5)))
        n = np.bincount(x.line_doc, x.n, minlength=n_docs)
        part = {k: np.bincount(x.line_doc, x.n * v, minlength=n_docs) for k, v in (("keywords", stuffed), ("links", x.form == LINKS), ("tags", x.form == TAGS))}
        n_pairs = np.bincount(x.pair_doc, minlength=n_docs)
        mean = np.bincount(x.pair_doc, pmi, minlength=n_docs) / np.maximum(n_pairs, 1)
        salad = (n_pairs >= 20) & (mean < salad_pmi)
        bad = sum(part.values())
        yield pd.DataFrame(
            {
                "doc_id": pdf["doc_id"].to_numpy(),
                "n_words": n.astype(np.int64),
                "mean_pmi": mean,
                **{f"{k}_share": v / np.maximum(n, 1) for k, v in part.items()},
                "salad": salad,
                "spam": (bad > 0.5 * n) | salad,
            }
        )


def judged(documents: DataFrame, least_pmi: float = 1.0, salad_pmi: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_words, mean_pmi, keywords_share, links_share, tags_share, salad, spam.

    The shares are of the document's words; spam: more than half of the words
    are repeated keywords, links or tags, or the text is word salad. Null,
    empty and wordless texts are no spam (all shares 0); repeated rows are each
    judged; an empty table gives no rows; other columns are never read.
    """
    d = documents.select("doc_id", "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = documents.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-size // BLOCK_BYTES), min(4 * cores, -(-size // (1 << 20))), 1)
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    counts = (
        d.groupBy("block")
        .applyInPandas(lambda key, pdf: _count(key, pdf, blocks), "block int, bucket int, total long, pair binary, n binary, docs binary, bursts binary, word binary, word_n binary")
        .groupBy("bucket")
        .applyInPandas(_corpus, "block int, total long, pair binary, n binary, bursty binary, word binary, word_n binary")
    )

    def judge(pdf: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        parts = (pdf.iloc[i : i + CHUNK] for i in range(0, len(pdf), CHUNK))
        return pd.concat(_judge(parts, Counts(rows), least_pmi, salad_pmi), ignore_index=True)

    kind = dict(documents.dtypes)["doc_id"]
    return d.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(
        judge,
        f"doc_id {kind}, n_words long, mean_pmi double, keywords_share double, links_share double, tags_share double, salad boolean, spam boolean",
    )
