"""Mixing sources to target shares by dependent rounding.

Every document of a source has the same number of copies to expect, a whole part
and a fraction. The fractions become 0 or 1 by pivotal rounding: two fractional
documents exchange mass, so that their tokens together stay the same and each
keeps its expectation, until one of them is integral. A task rounds a bucket and
leaves at most one fractional document, which the next level of a reduction tree
combines with those of other buckets.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import tiktoken
import xxhash
from pyspark.sql import DataFrame, functions as F

from lorevault.session import stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET_ROWS = 20_000
FAN_IN = 256


def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with n_tokens in place of the column ``text``; null and empty texts have 0."""
    rest = [c for c in df.columns if c != text]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(vocabulary)
        for pdf in batches:
            yield pdf[rest].assign(n_tokens=[len(encoding.encode_ordinary(t)) if t else 0 for t in pdf[text]])

    return df.mapInPandas(count, ", ".join(f"`{c}` {t}" for c, t in df.select(*rest).dtypes) + ", n_tokens long")


def source_name(c) -> F.Column:
    """Lower case, blanks around removed, hyphens and inner blanks as underscores; null stays null."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s\-]+", "_")


def _uniform(*key) -> float:
    return xxhash.xxh64_intdigest("|".join(map(str, key))) / 2.0**64


def pivot(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Round the fractions of one bucket; ``p`` of at most one row stays fractional."""
    pdf = pdf.sort_values(["n_tokens", "doc_id", "nth"], kind="stable").reset_index(drop=True)
    p, size, ids = pdf["p"].tolist(), pdf["n_tokens"].tolist(), pdf["doc_id"].tolist()
    held = None
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if held is None:
            held = j
            continue
        i, ratio = held, size[j] / size[held]
        up, down = min(1 - p[i], p[j] * ratio), min(p[i], (1 - p[j]) * ratio)
        move = up if _uniform(seed, ids[i], ids[j], j) * (up + down) < down else -down
        p[i] += move
        p[j] -= move / ratio
        for k in (i, j):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = float(round(p[k]))
        held = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else None
    return pdf.assign(p=p)


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: tokens there, tokens wanted and copies to expect of each document.

    Shares are taken among the targets that have documents with tokens. Without
    ``total_tokens`` the total is the largest at which every such source can
    give its share with max_repeats copies; a larger total is cut to that.
    Targets without documents have copies 0. A source that is listed twice is
    taken with its largest share and repeats.
    """
    t = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null")
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    t = t.join(have, "source", "left").fillna(0, ["n_docs", "tokens", "target_share", "max_repeats"])
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    whole = t.where(usable).agg(F.sum("target_share").alias("present"), F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("reach"))
    t = t.crossJoin(F.broadcast(whole))
    total = F.col("reach") * F.col("present")
    if total_tokens is not None:
        total = F.least(total, F.lit(float(total_tokens)))
    wanted = F.when(usable, total * F.col("target_share") / F.col("present")).otherwise(0.0)
    return t.select("source", "target_share", "max_repeats", "n_docs", "tokens", wanted.alias("wanted"), F.when(usable, F.least(wanted / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0).alias("copies"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """Documents to take and how often: doc_id, source, n_tokens, copies (at least 1).

    Sources are compared by ``source_name``. Documents of no target, with a null
    source or without tokens (null or empty text) aren't taken; repeated rows
    are each rounded; ties are ordered by doc_id; empty tables give no rows;
    other columns are never read. ``targets`` holds a row per source and is
    small against the documents. The tokens taken of a source miss the wanted
    ones by less than one document.
    """
    sizes = stage(token_counts(documents.select("doc_id", source_name(F.col("source")).alias("source"), "text"), "text", vocabulary).where("n_tokens > 0 and source is not null"), "mix-sizes")
    wanted = stage(plan(sizes, targets, total_tokens), "mix-plan")
    rows = sizes.join(wanted.where("copies > 0").select("source", "copies", "n_docs", "max_repeats"), "source")
    whole = F.floor("copies")
    spread = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS))
    rows = rows.select(
        "doc_id", "source", "n_tokens", F.lit(0).cast("long").alias("nth"), whole.alias("whole"),
        (F.col("copies") - whole).alias("p"), F.pmod(F.xxhash64("doc_id", "source"), spread).alias("bucket"),
    )
    schema = rows.schema

    def level(df: DataFrame) -> DataFrame:
        return df.groupBy("source", "bucket").applyInPandas(lambda pdf: pivot(pdf, seed), schema)

    rest, done = stage(level(rows), "mix-0"), []
    most = wanted.agg(F.max(F.ceil(F.col("n_docs") / BUCKET_ROWS))).first()[0] or 1
    n = 1
    while most > 1:
        done.append(rest.where("p = 0 or p = 1"))
        rest = stage(level(rest.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))), f"mix-{n}")
        most, n = -(-most // FAN_IN), n + 1
    # The last fraction of a source has no partner; it falls by its own chance.
    chance = F.pmod(F.xxhash64("doc_id", "source", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    out = rest.withColumn("p", F.when(F.col("p").isin(0.0, 1.0), F.col("p")).otherwise((chance < F.col("p")).cast("double")))
    for d in done:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("p").cast("long")).alias("copies")).where("copies > 0")


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, actual_share of all tokens taken, documents, copies, tokens and most copies of one."""
    per = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most"))
    t = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    total = per.agg(F.sum("tokens").alias("all_tokens"))
    out = t.join(per, "source", "left").fillna(0, ["n_docs", "copies", "tokens", "most"]).crossJoin(F.broadcast(total))
    return out.select("source", "target_share", (F.col("tokens") / F.col("all_tokens")).alias("actual_share"), "n_docs", "copies", "tokens", "most", "max_repeats")
