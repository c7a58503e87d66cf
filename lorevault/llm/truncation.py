"""Texts cut off by a length limit or in transfer.

Two kinds of evidence, both from statistics over the whole table. Length
histograms (characters and bytes) per source show spikes: many more values of
one length than of its neighbours; a value at a spike without terminal
punctuation was cut there. Cuts elsewhere show at the last line: a sign that the
rest was dropped, open mark-up, or an ending that is no ending: the way a line
may end is counted over all lines that are followed by another one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lorevault.llm.common import HAN

#: A word in at least this share of the texts stands for itself, any other for its kind.
COMMON_SHARE = 0.004
FLUSH = 500_000
TOKEN = re.compile(rf"[a-z]+://\S+|[{HAN}]|[^\W{HAN}]+(?:[-./@:]+[^\W{HAN}]+)*|[^\w\s]")
PLAIN = re.compile(rf"[{HAN}]|[^\W\d_{HAN}]+")
FULL_STOP = re.compile(r"[.!?。！？．]+$")
TERMINAL = re.compile(r"([.!?。！？．][\"')\]`*”’»」』）]*|`|^[(（].*[)）])$")
# What stands where the rest was dropped; other signs show as endings that no line has.
DROPPED = re.compile(r"(…|\.\.\.|�)[\])>}）】]?$")
PAIRS = (("(", ")"), ("[", "]"), ("（", "）"), ("【", "】"), ("“", "”"), ("「", "」"), ("{", "}"))


def kind(token: str, common: set[str]) -> str:
    """The token itself if it is common, else its kind; a part of a longer thing has another kind than the whole."""
    if token in common:
        return token
    if token.isdecimal():
        return "#"
    if "://" in token:
        return "U"
    if re.fullmatch(r"\d{4}(-\d*)*", token):
        return f"D{len(token)}"
    if re.fullmatch(r"\d+(\.\d+)+", token):
        return f"V{token.count('.')}"
    if re.fullmatch(r"[0-9a-f]+", token) and any(c.isdigit() for c in token):
        return f"h{len(token)}"
    if re.match(f"[{HAN}]", token):
        return "H"
    if "/" in token or "." in token:
        return "P" if token.rpartition(".")[2] in common else "P?"
    if "-" in token or "_" in token:
        return "N"
    return "X" if token[0].isalpha() else "Y" if token[0].isdigit() else token


def _ending(tokens: list[str], common: set[str]) -> list[str]:
    return ["^", "^", *(kind(t, common) for t in tokens)]


def _tokens(line: str) -> list[str]:
    return TOKEN.findall(FULL_STOP.sub("", line.strip()))


def _lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip()]


def _tail_key(word: str) -> str:
    return word[-3:] if len(word) > 3 else "^" + word


def _count(batches: Iterator[pd.DataFrame], common: set[str]) -> Iterator[pd.DataFrame]:
    """How often a token pair or triple, or the end of a rare word, ends and how often it goes on."""
    ends: Counter = Counter()
    goes_on: Counter = Counter()

    def flush() -> pd.DataFrame:
        keys = list(ends.keys() | goes_on.keys())
        return pd.DataFrame({"key": keys, "ends": [ends[k] for k in keys], "goes_on": [goes_on[k] for k in keys]})

    for pdf in batches:
        for text in pdf["text"]:
            for line in _lines(text)[:-1]:
                if line.startswith("#"):
                    continue
                k = _ending(_tokens(line), common)
                ends[" ".join(k[-3:])] += 1
                ends[" ".join(k[-2:])] += 1
                for i in range(3, len(k)):
                    goes_on[" ".join(k[i - 3 : i])] += 1
                    goes_on[" ".join(k[i - 2 : i])] += 1
                for w in PLAIN.findall(line):
                    if len(w) > 1 and w not in common:
                        ends["~" + _tail_key(w)] += 1
                        for i in range(1, len(w)):
                            goes_on["~" + _tail_key(w[:i])] += 1
        if len(ends) + len(goes_on) > FLUSH:
            yield flush()
            ends, goes_on = Counter(), Counter()
    if ends or goes_on:
        yield flush()


def _open(text: str, last: str) -> bool:
    plain = last.replace("```", "")
    if text.count("```") % 2 or plain.count("`") % 2 or last.count("**") % 2 or last.count('"') % 2:
        return True
    return any(last.count(a) > last.count(b) for a, b in PAIRS)


def _look(batches: Iterator[pd.DataFrame], common: set[str]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            last = _lines(text)[-1].strip()
            bare = last.rstrip()
            tokens = _tokens(last)
            k = _ending(tokens, common)
            word = re.search(rf"[^\W\d_{HAN}]+$", last)
            rare = word and word[0] not in common
            rows.append(
                (
                    bool(DROPPED.search(bare)),
                    _open(text, last),
                    last.startswith("#") or last in ("-", "*", "+"),
                    # An address tells nothing about its end; lists of links often close a text.
                    bool(TERMINAL.search(bare)) or k[-1] == "U",
                    k[-1] in ("V1", "P?") or (k[-1][:1] == "h" and k[-1][1:].isdecimal()) or (k[-1][:1] == "D" and k[-1] not in ("D4", "D10") and k[-1][1:].isdecimal()),
                    " ".join(k[-3:]),
                    " ".join(k[-2:]),
                    "~" + _tail_key(word[0]) if rare else None,
                )
            )
        out = pd.DataFrame(rows, columns=["dropped", "open", "heading", "terminal", "part", "triple", "pair", "tail"])
        yield pd.concat([pdf[["row", "source", "n_chars", "n_bytes"]].reset_index(drop=True), out], axis=1)


def spikes(lengths: DataFrame, width: int = 25, least: int = 5, times: float = 6.0) -> DataFrame:
    """Lengths that stand out of their neighbourhood: source, measure, length, n, expected.

    ``lengths`` has source, n_chars and n_bytes. A length is a spike if at least
    ``least`` values have it and at least ``times`` as many as its neighbours
    within ``width`` have on average. Null sources form one source of their own.
    """
    both = lengths.select("source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in ("n_chars", "n_bytes")])).alias("x")).select("source", "x.*")
    n = both.groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-width, width)
    out = n.withColumn("expected", (F.sum("n").over(near) - F.col("n")) / (2.0 * width))
    return out.where((F.col("n") >= least) & (F.col("n") >= times * F.greatest("expected", F.lit(0.1))))


def truncated(df: DataFrame, row: str, text: str, source: str) -> DataFrame:
    """One row per text with words: row, source, n_chars, n_bytes, at_spike, reason, cut.

    reason: ``dropped`` (a sign that the rest was dropped), ``open`` (mark-up,
    bracket or quotation left open), ``heading`` (a heading or bullet without
    its entry), ``spike`` (at a spike length without terminal punctuation),
    ``ending`` (no line of the table ends like this), ``word`` (stops inside a
    word), null if the text is whole. Null, empty and blank texts are no case
    and give no row. Repeated rows are judged each; a null source counts as one
    source; an empty table gives no rows; other columns are never read.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(row).alias("row"),
        F.col(source).cast("string").alias("source"),
        F.regexp_replace(text, r"(?U)\s+$", "").alias("text"),
        F.char_length(F.col(text)).alias("n_chars"),
        F.octet_length(F.col(text)).alias("n_bytes"),
    ).where("text <> ''")
    total = rows.count()
    # At most (mean distinct words of a text) / COMMON_SHARE words can be common, whatever the number of texts.
    plain = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{IsHan}|[\p{L}&&[^\p{IsHan}]]+"), F.lit(0)))
    frequent = rows.select(F.explode(plain).alias("w")).groupBy("w").count().where(F.col("count") >= max(5, COMMON_SHARE * total))
    common = spark.sparkContext.broadcast({r.w for r in frequent.collect()})
    stats = rows.select("text").mapInPandas(lambda b: _count(b, common.value), "key string, ends long, goes_on long")
    stats = stats.groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    kinds = dict(rows.dtypes)
    seen = rows.mapInPandas(
        lambda b: _look(b, common.value),
        f"row {kinds['row']}, source string, n_chars int, n_bytes int, dropped boolean, open boolean, heading boolean, terminal boolean, part boolean, triple string, pair string, tail string",
    )
    for c, short in (("triple", "3"), ("pair", "2"), ("tail", "t")):
        s = stats.select(F.col("key").alias(c), F.col("ends").alias(f"e{short}"), F.col("goes_on").alias(f"g{short}"))
        seen = seen.join(s, c, "left").fillna(0, [f"e{short}", f"g{short}"])
    sp = spikes(rows.select("source", "n_chars", "n_bytes"))

    def at(measure: str) -> DataFrame:
        return sp.where(F.col("measure") == measure).select(F.col("source").alias("s"), F.col("length").alias(f"l_{measure}"), F.lit(True).alias(f"at_{measure}"))

    for m in ("n_chars", "n_bytes"):
        x = at(m)
        seen = seen.join(x, seen["source"].eqNullSafe(x["s"]) & (seen[m] == x[f"l_{m}"]), "left").drop("s", f"l_{m}")
    spike = F.coalesce(F.col("at_n_chars"), F.col("at_n_bytes"), F.lit(False))

    def unlike(e: str, g: str, least: int) -> Column:
        return F.col(e) < F.greatest(F.lit(least), 0.02 * (F.col(e) + F.col(g)))

    ending = F.when(F.col("e3") + F.col("g3") >= 5, unlike("e3", "g3", 1)).otherwise(unlike("e2", "g2", 2))
    word = F.col("tail").isNotNull() & (F.col("et") + F.col("gt") >= 3) & (F.col("et") < 0.3 * (F.col("et") + F.col("gt")))
    reason = (
        F.when(F.col("dropped"), "dropped")
        .when(F.col("open"), "open")
        .when(F.col("heading"), "heading")
        .when(spike & ~F.col("terminal"), "spike")
        .when(~F.col("terminal") & ending, "ending")
        .when(F.col("part") & (F.col("e3") + F.col("e2") == 0), "ending")
        .when(~F.col("terminal") & word, "word")
    )
    return seen.select("row", "source", "n_chars", "n_bytes", spike.alias("at_spike"), reason.alias("reason")).withColumn("cut", F.col("reason").isNotNull())


def cut_shares(judged: DataFrame) -> DataFrame:
    """Per source: texts, cut texts and the share cut."""
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("cut").cast("long")).alias("n_cut")).withColumn("share_cut", F.col("n_cut") / F.col("n_texts"))
