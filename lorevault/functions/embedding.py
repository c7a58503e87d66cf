"""Hashed features of a text as a vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lorevault.functions.text import HAN, terms


def features(text: Column) -> Column:
    """(name, weight) of every feature: words and their character n-grams up to 3, Han terms, and pairs and every second triple of all Han characters."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<string>")

    def named(prefix: str, names: Column, weight: float) -> Column:
        return F.transform(names, lambda c: F.struct(F.concat(F.lit(prefix), c).alias("name"), F.lit(weight).alias("weight")))

    def grams(r: Column, n: int, step: int = 1, least: int = 0) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - (n - 1), F.lit(1)), F.lit(step)), lambda i: F.substring(r, i, F.lit(n)))
        return F.when(F.length(r) >= F.lit(least or n + 1), every).otherwise(none)

    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    parts = F.flatten(F.transform(words, lambda w: F.concat(*[grams(w, n) for n in (1, 2, 3)])))
    han = F.regexp_replace(text, f"[^{HAN}]", "")
    return F.concat(
        named("w:", words, 1.0),
        named("c:", parts, 0.35),
        named("h:", F.filter(terms(text), lambda t: t.rlike(f"[{HAN}]")), 0.8),
        named("n2:", grams(han, 2, 1, 2), 0.3),
        named("n3:", grams(han, 3, 2, 3), 0.3),
    )


def hashed(df: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """doc, idx, value: the places that aren't 0 of the unit vector of each text; a text without features has none."""
    f = df.select(F.col(key).alias("doc"), F.explode(features(F.col(text))).alias("f"))
    h = F.crc32(F.encode("f.name", "UTF-8"))
    sign = F.when(F.shiftright(h, 16).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
    v = f.groupBy("doc", F.pmod(h, F.lit(dim)).cast("int").alias("idx")).agg(F.sum(sign * F.col("f.weight")).alias("value")).where("value <> 0")
    n = v.groupBy("doc").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return v.join(n, "doc").select("doc", "idx", (F.col("value") / F.col("norm")).alias("value"))
