"""Words and helpers shared by the operators on texts."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, functions as F

# Code point ranges of the Han script.
HAN = "\u2e80-\u2e99\u2e9b-\u2ef3\u2f00-\u2fd5\u3005\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufa6d\ufa70-\ufad9\U00020000-\U0003ffff"

WORD = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased; each Han character is a word of its own."""
    return WORD.findall(text.lower()) if text else []


def word_column(text: Column) -> Column:
    """``words`` as a column of built-in functions."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))


def flat_words(texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """The words of each text, the text number of every word, and the word count of each text."""
    found = [words(t) for t in texts]
    n = np.fromiter(map(len, found), np.int64, len(found))
    return found, np.repeat(np.arange(len(found)), n), n


class Ids:
    """A stable 64-bit number for each distinct word; equal in every task."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, found: list[list[str]], n: int) -> np.ndarray:
        known = self.known
        if len(known) > 2_000_000:
            known.clear()
        for w in set(chain.from_iterable(found)).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.uint64, n)
