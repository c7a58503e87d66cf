"""Text functions as column expressions: terms, names, hashes, templates, estimates."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window, functions as F

# Ranges of Han characters that are split into single characters and pairs.
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2fa1f}"
MOST_TERM_CHARS = 24
# English words that are no terms.
STOPWORDS = """a an the and or but if then else of to in on at by for with from as is are was were be been being it its this that these those i you he she they we me my your our their
what which who whom how when where why not no yes do does did done can could should would will shall may might must about into over under again more most other some such only own same so than too very just""".split()
# Tools that look at something and change nothing.
READ_ONLY_TOOLS = "read read_file grep glob list ls search web_search web_fetch todo_write todo_read skill memory_search memory_add browser_page remember recall view_image".split()
# Marks of the kinds of questions.
GLOBAL_MARKERS = ["总结", "概述", "整体", "汇总", "都有哪些", "全部", "概况", "summary", "overview", "overall", "all of", "in general"]
RELATIONAL_MARKERS = ["的关系", "什么关系", "之间", "影响", "导致", "依赖", "关联", "为什么", "如何影响", "relationship", "related", "connect", "why does", "leads to", "causes", "depends on", "between"]
TEMPORAL_MARKERS = ["以前", "之前", "当时", "历史", "曾经", "以前是", "后来", "之前是", "previously", "used to", "before", "earlier", "last year", "on "]


@lru_cache(maxsize=1)
def _compatible() -> tuple[str, str]:
    """Characters whose compatibility form is another single character, and these."""
    pairs = [(c, n) for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c]
    return "".join(c for c, _ in pairs), "".join(n for _, n in pairs)


def folded(text: Column) -> Column:
    """Lower case, with full-width forms and all else that has one character as its compatibility form replaced by it."""
    return F.lower(F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, *_compatible())).otherwise(text))


def runs(text: Column) -> Column:
    """Runs of one script: Han characters, or letters, digits and underscores."""
    return F.regexp_extract_all(folded(text), F.lit(rf"[{HAN}]+|[\p{{L}}\p{{N}}_&&[^{HAN}]]+"), F.lit(0))


def han_grams(run: Column) -> Column:
    """Every character of a Han run, then every pair of neighbours."""
    n = F.length(run)
    ones = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
    twos = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.concat(ones, twos)


def terms(text: Column) -> Column:
    """Terms in order, repeated ones kept: Han runs as characters and pairs, others unless stopwords or too long."""
    split = F.transform(runs(F.coalesce(text, F.lit(""))), lambda r: F.when(r.rlike(f"^[{HAN}]"), han_grams(r)).otherwise(F.array(r)))
    kept = F.flatten(split)
    return F.filter(kept, lambda t: (F.length(t) <= MOST_TERM_CHARS) & ~t.isin(STOPWORDS))


def estimate_tokens(text: Column) -> Column:
    """Han characters count as one token each, others as two sevenths; empty is 0."""
    han = F.length(F.regexp_replace(text, f"[^{HAN}]", ""))
    n = F.length(text)
    return F.when(text.isNull() | (n == 0), 0).otherwise(F.floor(han + (n - han) / 3.5).cast("int") + 1)


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last of them an ellipsis if something was cut."""
    t = F.trim(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(name)), r"[\s_]+", " ")


def relation_key(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), " -", "__")


def slug(text: Column, default: str = "skill") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^0-9a-z一-鿿]+", "-"), "^-+|-+$", "")
    return F.when(s == "", default).otherwise(s)


def project_slug(remote: Column) -> Column:
    """An id from a repository address or a path: no scheme, credentials or .git; the last 64 characters."""
    s = F.regexp_replace(F.lower(F.trim(remote)), r"\\", "/")
    s = F.regexp_replace(s, r"^[a-z][a-z0-9+.-]*://", "")
    s = F.regexp_replace(s, r"^[^/@]*@", "")
    s = F.regexp_replace(F.regexp_replace(s, r"/+$", ""), r"\.git$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[^0-9a-z]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "unknown").otherwise(F.right(s, F.lit(64)))


def summary_hash(text: Column) -> Column:
    return F.sha1(F.lower(squash(text)))


def template(args: Column) -> Column:
    """Quoted parts, paths, addresses and numbers as slots, at most 160 characters."""
    s = F.trim(args)
    # What a slot stands for, in the order of replacement.
    for slot, pattern in (
        ("<quoted>", r"\"[^\"]{1,120}\"|'[^']{1,120}'|`[^`]{1,120}`"),
        ("<path>", r"[A-Za-z]:\\[^\s\"']+|(?:\.{0,2}/[\w./\-]+)"),
        ("<url>", r"https?://\S+"),
        ("<number>", r"\b\d+(?:\.\d+)?\b"),
    ):
        s = F.regexp_replace(s, pattern, slot)
    return clip(F.regexp_replace(s, r"\s+", " "), 160)


def keywords(df: DataFrame, key: str, text: str, limit: int = 12) -> DataFrame:
    """key, keywords: the terms of most weight of each text, in order; chains of overlapping Han pairs become one keyword.

    A term weighs 1.6 for each time it is there, a single character 1. Ties go to
    the longer term, then by the alphabet. Texts without terms have no row.
    """
    n = df.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("weight", F.round(F.col("n") * F.when(F.length("term") >= 2, 1.6).otherwise(1.0), 6))
    w = Window.partitionBy(key).orderBy(F.desc("weight"), F.desc(F.length("term")), "term")
    best = n.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 3 * limit)
    ordered = best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "term"))), lambda x: x["term"]).alias("ts"))

    def chained(out: Column, t: Column) -> Column:
        last = F.element_at(out, -1)
        joins = (F.size(out) > 0) & t.rlike(f"^[{HAN}]{{2}}$") & last.rlike(f"^[{HAN}]{{2,}}$") & (F.right(last, F.lit(1)) == F.left(t, F.lit(1)))
        return F.when(joins, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(last, F.right(t, F.lit(1)))))).otherwise(F.concat(out, F.array(t)))

    return ordered.select(key, F.slice(F.aggregate("ts", F.array().cast("array<string>"), chained), 1, limit).alias("keywords"))


def route(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind (point, relational, global or temporal) and temporal (a hint at a time) of each question."""
    q = F.lower(F.trim(text))

    def any_of(markers: list[str]) -> Column:
        return F.coalesce(F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(q, m)), F.lit(False))

    dense = keywords(df, key, text).select(key, (F.size("keywords") >= 6).alias("dense"))
    temporal = any_of(TEMPORAL_MARKERS)
    kind = F.when(any_of(GLOBAL_MARKERS) | F.coalesce(F.endswith(q, F.lit("有哪些")), F.lit(False)), "global").when(any_of(RELATIONAL_MARKERS), "relational").when(temporal, "temporal").when(F.col("dense"), "relational").otherwise("point")
    return df.join(dense, key, "left").select(key, kind.alias("kind"), temporal.alias("temporal"))


def without_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def match_expression(text: Column) -> Column:
    """Distinct terms, quoted and joined by OR."""
    return F.array_join(F.transform(F.array_distinct(terms(text)), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), 1, n), "-")
