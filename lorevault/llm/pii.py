"""Personal information in free text, by a linear-chain conditional random field.

Features are word shapes, words and endings of words around each token; the weights are trained
from a small labelled table, the best label sequence is found by Viterbi in
numpy over many texts at once. A text in which no token's score could pay for
leaving the label "other" is not decoded, as its best sequence is known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lorevault.llm.common import HAN
from lorevault.llm.pii_labels import FAMILY_ZH, GIVEN, KINDS, labelled

LABELS = ["other", *KINDS.values()]
MARKED = re.compile(r"\{([epian])\|([^}]*)\}")
#: Something@something is one token; so are a word with its hyphens and digits; a Han character; any other sign.
TOKEN = re.compile(rf"[^\s,;，。；！？!?()（）<>\[\]\"'/|{HAN}]*[@＠](?:[^\s,;，。；！？!?()（）<>\[\]\"'/|{HAN}]*[^\s,;，。；！？!?()（）<>\[\]\"'/|.:{HAN}])|[{HAN}]|\d+(?![^\W_{HAN}])|[^\W_{HAN}]+(?:[-'’_.][^\W\d_{HAN}]+)*|[^\w\s]|_|\n")
GIVEN_NAMES = frozenset(GIVEN)
WINDOW = 3
REPEATED = 2
#: Passes of the training over all rows, and rows of a step.
PASSES = 12
BATCH = 50
#: Penalty of large weights.
DECAY = 0.5


def shape(token: str) -> str:
    """Runs of capitals, small letters and digits (with their length), other signs as they are; addresses by their parts; marks for listed given and family names."""
    if "@" in token or "＠" in token:
        user, _, host = token.replace("＠", "@").partition("@")
        return "@" + ("u" if user else "") + (":" if ":" in host else "") + ("d" if re.match(r"v?\d", host) else "h" if "." in host else "w")
    if token.isdecimal():
        return f"d{min(len(token), 20)}"
    digits = re.findall(r"\d+", token)
    if digits:
        form = re.sub(r"[^\W\d_]+", lambda m: "X" * min(len(m[0]), 3) if m[0].isupper() else "x", token)
        return re.sub(r"\d+", f"d{min(len(token), 12)}" if len(digits) == 1 else "d", form)
    if not token[0].isalpha():
        return token
    if re.match(f"[{HAN}]", token):
        # Level 1 of the national standard has the common characters, level 2 the rarer ones.
        lead = token.encode("gb2312", "replace")[0]
        return ("H1" if 0xB0 <= lead <= 0xD7 else "H2" if 0xD8 <= lead <= 0xF7 else "H3") + ("s" if token in FAMILY_ZH else "")
    s = re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", token)
    return re.sub(r"(.)\1+", r"\1\1", s) + ("g" if token.capitalize() in GIVEN_NAMES else "")


def ending(token: str) -> str:
    """The last three letters of a longer word."""
    return token[-3:].lower() if len(token) > 5 and token.isalpha() and not re.match(f"[{HAN}]", token) else ""


def _tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


def _read(rows: list[str]) -> list[tuple[list[str], list[int]]]:
    """Labelled texts as tokens and labels; some in lower and some in upper case."""
    codes = list(KINDS)
    out = []
    for k, line in enumerate(rows):
        line = line.replace("\\n", "\n")
        # Names aren't told from other words where all are in one case.
        change = str if "{n|" in line else {0: str.lower, 1: str.upper}.get(k % 12, str)
        tokens: list[str] = []
        labels: list[int] = []
        at = 0
        for m in MARKED.finditer(line):
            for part, label in ((line[at : m.start()], 0), (m[2], 1 + codes.index(m[1]))):
                t = _tokens(change(part))
                tokens += t
                labels += [label] * len(t)
            at = m.end()
        t = _tokens(change(line[at:]))
        out.append((tokens + t, labels + [0] * len(t)))
    return out


def _gradient(w: np.ndarray, pairs: np.ndarray, used: np.ndarray, gold: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the negative log likelihood of some texts, for the weights of features and of label pairs."""
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    steps = int(n.max())
    live = np.arange(steps)[:, None] < n[None, :]
    inside = np.flatnonzero(text[1:] == text[:-1])
    e = np.zeros((steps, len(n), w.shape[1]))
    e[at, text] = w[used].sum(1)
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, steps):
        x = a[t - 1][:, :, None] + pairs[None]
        m = x.max(1)
        a[t] = np.where(live[t][:, None], np.log(np.exp(x - m[:, None]).sum(1)) + m + e[t], a[t - 1])
    for t in range(steps - 2, -1, -1):
        x = pairs[None] + (e[t + 1] + b[t + 1])[:, None, :]
        m = x.max(2)
        b[t] = np.where(live[t + 1][:, None], np.log(np.exp(x - m[:, :, None]).sum(2)) + m, 0)
    m = a[-1].max(1)
    z = np.log(np.exp(a[-1] - m[:, None]).sum(1)) + m
    p = np.exp(a[at, text] + b[at, text] - z[text][:, None])
    p[np.arange(len(gold)), gold] -= 1
    flat, size = used.ravel(), used.shape[1]
    g = np.stack([np.bincount(flat, np.repeat(p[:, k], size), minlength=len(w)) for k in range(w.shape[1])], 1)
    i, j = (at[inside], text[inside]), (at[inside + 1], text[inside + 1])
    gp = np.exp(a[i][:, :, None] + pairs[None] + (e[j] + b[j])[:, None, :] - z[text[inside]][:, None, None]).sum(0)
    np.subtract.at(gp, (gold[inside], gold[inside + 1]), 1)
    return g, gp


class Field:
    """Numbering of words, shapes and endings, weights of the features, weights of label pairs."""

    def __init__(self, labelled_rows: list[str] | None = None) -> None:
        rows = _read(labelled() if labelled_rows is None else labelled_rows)
        words: dict[str, int] = {}
        for tokens, _ in rows:
            for w in {t.lower() for t in tokens}:
                words[w] = words.get(w, 0) + 1
        # Words and endings of several rows have a weight of their own.
        self.word = {w: i for i, w in enumerate((w for w, n in words.items() if n >= REPEATED or not w[0].isalnum()), 3)}
        ends: dict[str, int] = {}
        for tokens, _ in rows:
            for e in {ending(t) for t in tokens} - {""}:
                ends[e] = ends.get(e, 0) + 1
        self.ending = {e: i for i, e in enumerate((e for e, n in ends.items() if n >= 2 * REPEATED), 2)}
        shapes = dict.fromkeys(shape(t) for tokens, _ in rows for t in tokens)
        self.shape = {s: i for i, s in enumerate(shapes, 3)}
        self.n_word, self.n_shape, self.n_ending = len(self.word) + 3, len(self.shape) + 3, len(self.ending) + 2
        self.known: dict[str, int] = {}
        n = self.n_word, self.n_shape
        # Word at each place of the window, shape at each, endings here and beside, and pairs of neighbours' shape and word.
        self.sizes = [n[0]] * (2 * WINDOW + 1) + [n[1]] * (2 * WINDOW + 1) + [self.n_ending] * 3 + [n[1] * n[0]] * 2 + [n[1] * n[1]] * 2
        self.start = np.cumsum([0, *self.sizes[:-1]])
        self._train(rows)

    def number(self, token: str) -> int:
        """Word, shape and ending in one number; 0 of each is beyond the text, 1 another one, 2 another Han character."""
        s = shape(token)
        word, form = self.word.get(token.lower(), 2 if s[0] == "H" and len(s) > 1 and s[1].isdecimal() else 1), self.shape.get(s, 1)
        return (word * self.n_shape + form) * self.n_ending + self.ending.get(ending(token), 1)

    def numbers(self, tokens: list[list[str]], total: int) -> np.ndarray:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        for t in set(chain.from_iterable(tokens)).difference(known):
            known[t] = self.number(t)
        return np.fromiter(map(known.__getitem__, chain.from_iterable(tokens)), np.int64, total)

    def features(self, numbers: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
        """For each feature the row of the weights, of every token in turn; texts are runs of n tokens."""
        pad = WINDOW
        place = np.arange(len(numbers)) + np.repeat(np.arange(len(n)) * pad + pad, n)
        size = len(numbers) + (len(n) + 1) * pad
        word, shapes, endings = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        endings[place] = numbers % self.n_ending
        word[place], shapes[place] = np.divmod(numbers // self.n_ending, self.n_shape)
        k = 0
        for table in (word, shapes):
            for o in range(-WINDOW, WINDOW + 1):
                yield table[place + o] + self.start[k]
                k += 1
        for o in (-1, 0, 1):
            yield endings[place + o] + self.start[k]
            k += 1
        here = shapes[place]
        for other, width, o in ((word, self.n_word, -1), (word, self.n_word, 1), (shapes, self.n_shape, -1), (shapes, self.n_shape, 1)):
            yield here * width + other[place + o] + self.start[k]
            k += 1

    def scores(self, numbers: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros((len(numbers), len(LABELS)), np.float32)
        for f in self.features(numbers, n):
            out += self.weight[f]
        return out

    def _train(self, rows: list, passes: int = PASSES, rate: float = 0.06, decay: float = DECAY, hidden: float = 0.4) -> None:
        """Maximum likelihood with a penalty, by forward and backward sums over BATCH rows at once.

        A share of the words beside places is hidden, so that places are known by their own form too, not by the words of the frames only.
        """
        rng = np.random.default_rng(1)
        n = np.array([len(t) for t, _ in rows])
        start = np.cumsum(n) - n
        numbers = self.numbers([t for t, _ in rows], int(n.sum()))
        gold = np.fromiter(chain.from_iterable(y for _, y in rows), np.int64, int(n.sum()))
        form, word = numbers % (self.n_shape * self.n_ending), numbers // (self.n_shape * self.n_ending)
        letters = np.fromiter((t[0].isalpha() for r, _ in rows for t in r), bool, len(numbers))
        having = np.repeat(np.add.reduceat(gold, start) > 0, n)
        hide = letters & (gold == 0) & having & (rng.random(len(numbers)) < hidden)
        numbers = np.where(hide, np.where(word == 2, 2, 1) * self.n_shape * self.n_ending + form, numbers)
        used = np.stack(list(self.features(numbers, n)), 1)
        rows_used, used = np.unique(used, return_inverse=True)[0], np.unique(used, return_inverse=True)[1].reshape(used.shape)
        w, pairs = np.zeros((len(rows_used), len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
        moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(pairs), np.zeros_like(pairs)]]
        batches = [b for _ in range(passes) for b in np.array_split(rng.permutation(len(n)), max(1, len(n) // BATCH))]
        for r, batch in enumerate(batches, 1):
            tokens = np.concatenate([np.arange(start[i], start[i] + n[i]) for i in batch])
            g, gp = _gradient(w, pairs, used[tokens], gold[tokens], n[batch])
            share = len(batch) / len(n)
            step = rate * (1 - 0.9 * r / len(batches))
            for v, grad, (m1, m2) in ((w, g + decay * share * w, moments[0]), (pairs, gp + decay * share * pairs, moments[1])):
                m1 *= 0.9
                m1 += 0.1 * grad
                m2 *= 0.99
                m2 += 0.01 * grad * grad
                v -= step * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
        self.weight = np.zeros((int(sum(self.sizes)), len(LABELS)), np.float32)
        self.weight[rows_used] = w
        self.pairs = pairs.astype(np.float32)
        self.known = {}

    def decode(self, scores: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The best label of every token, by Viterbi over all texts side by side."""
        order = np.argsort(-n, kind="stable")
        start = (np.cumsum(n) - n)[order]
        length = n[order]
        labels, steps = np.zeros(len(scores), np.int8), int(length[0]) if len(n) else 0
        back = []
        best = scores[start].copy() if len(n) else scores
        for t in range(1, steps):
            k = int(np.searchsorted(-length, -t, "left"))
            x = best[:k, :, None] + self.pairs[None]
            back.append(x.argmax(1).astype(np.int8))
            best[:k] = x.max(1) + scores[start[:k] + t]
        now = best.argmax(1).astype(np.int8)
        for t in range(steps - 1, -1, -1):
            k = int(np.searchsorted(-length, -t, "left"))
            labels[start[:k] + t] = now[:k]
            if t:
                now[:k] = back[t - 1][np.arange(k), now[:k]]
        return labels

    def label(self, texts: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
        """The number and labels of each text that has a label besides other."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        scores = self.scores(self.numbers(texts, int(n.sum())), n)
        # A place of L tokens has a way in, a way out and L - 1 steps; against staying "other" these can gain at most so much.
        # If even the best token and the larger of the ways and a step gain nothing together, no place can pay.
        more = self.pairs - self.pairs[0, 0]
        bonus = max(float(more[0, 1:].max() + more[1:, 0].max()), float(more[1:, 1:].max()), 0.0)
        gain = (scores[:, 1:].max(1) - scores[:, 0]) + bonus
        owner = np.repeat(np.arange(len(n)), n)
        maybe = np.flatnonzero(np.bincount(owner, gain > 0, minlength=len(n)) > 0)
        keep = np.zeros(len(n), bool)
        keep[maybe] = True
        labels = self.decode(scores[keep[owner]], n[maybe])
        ends = np.cumsum(n[maybe])
        for i, e, size in zip(maybe.tolist(), ends.tolist(), n[maybe].tolist()):
            found = labels[e - size : e]
            if found.any():
                yield i, found


@lru_cache(maxsize=1)
def field() -> Field:
    return Field()


def _plausible(kind: str, value: str) -> bool:
    """Whether a marked place has what its kind needs; addresses of repositories and packages are none."""
    digits = sum(c.isdecimal() for c in value)
    if kind == "email":
        return bool(re.search(r"[\w.+-]+\s*(?:@|＠|[(\[]\s*at\s*[)\]])\s*[\w-]+(?:\s*(?:\.|[(\[]\s*dot\s*[)\]])\s*[^\W\d][\w-]*)+", value, re.I)) and not re.search(r"@[\w.-]+:", value)
    if kind == "phone":
        return digits >= 7
    if kind == "identity_number":
        return digits >= 6
    if kind == "street_address":
        return digits >= 1 and any(c.isalpha() for c in value)
    # A single word of letters is no name; Chinese ones have two characters at least.
    han = len(re.findall(f"[{HAN}]", value))
    return not digits and "\n" not in value and (han >= 2 or han == 0 and len(re.findall(r"[^\W\d_]+", value)) >= 2)


def spans(text: str, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """Places of personal information: start, end, kind."""
    out: list[tuple[int, int, str]] = []
    last = -2
    for i, m in enumerate(TOKEN.finditer(text)):
        k = int(labels[i])
        if k:
            if last == i - 1 and out and out[-1][2] == LABELS[k]:
                out[-1] = (out[-1][0], m.end(), LABELS[k])
            else:
                out.append((m.start(), m.end(), LABELS[k]))
            last = i
    return [x for x in out if _plausible(x[2], text[x[0] : x[1]])]


#: Tokens scored together.
CHUNK_TOKENS = 400_000


def _found(texts: list[str | None], model: Field) -> Iterator[tuple[int, list[tuple[int, int, str]]]]:
    """Number and places of each text that holds personal information."""
    part: list[list[str]] = []
    numbers: list[int] = []
    size = 0
    for i, text in enumerate([*texts, None]):
        if text:
            t = _tokens(text)
            if t:
                part.append(t)
                numbers.append(i)
                size += len(t)
        if part and (size >= CHUNK_TOKENS or i == len(texts)):
            for j, labels in model.label(part):
                places = spans(texts[numbers[j]], labels)
                if places:
                    yield numbers[j], places
            part, numbers, size = [], [], 0


def personal(df: DataFrame, row: str, text: str) -> DataFrame:
    """row and pii_kind, once for each row and kind of personal information in its text.

    Null and empty texts hold none; repeated rows each give theirs; an empty
    table gives no rows; other columns are never read.
    """
    model = df.sparkSession.sparkContext.broadcast(field())
    kind = dict(df.dtypes)[row]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = pdf["row"].tolist()
            rows = [(keys[i], k) for i, places in _found(pdf["text"].tolist(), model.value) for k in dict.fromkeys(p[2] for p in places)]
            if rows:
                yield pd.DataFrame(rows, columns=["row", "pii_kind"])

    return df.selectExpr(f"`{row}` as row", f"`{text}` as text").where("text is not null").mapInPandas(find, f"row {kind}, pii_kind string")


def masked(df: DataFrame, row: str, text: str) -> DataFrame:
    """row, text with each place of personal information replaced by its kind in brackets, and the number of places.

    The rest of the text is unchanged; null stays null, empty stays empty.
    """
    model = df.sparkSession.sparkContext.broadcast(field())
    kind = dict(df.dtypes)[row]

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["text"].tolist()]
            n = [0] * len(texts)
            for i, places in list(_found(texts, model.value)):
                t = texts[i]
                for a, b, k in reversed(places):
                    t = f"{t[:a]}[{k.upper()}]{t[b:]}"
                texts[i], n[i] = t, len(places)
            yield pd.DataFrame({"row": pdf["row"], "text": pd.Series(texts, dtype=object), "n_places": n})

    return df.selectExpr(f"`{row}` as row", f"`{text}` as text").mapInPandas(mask, f"row {kind}, text string, n_places int")
