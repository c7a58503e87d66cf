"""BM25 over a postings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window, functions as F

from lorevault.functions.text import terms
from lorevault.session import stage

# Fixed values of the ranking.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Batch scores are spread from BEST down to WORST.
BEST, WORST = 0.9, 0.45


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, limit: int) -> DataFrame:
    """The best documents of each query: query, doc, bm25 (higher is better), place.

    Statistics are over all documents. Ties are ordered by doc.
    """
    q = queries.select(F.col(query_key).alias("query"), F.explode(F.array_distinct(terms(F.col(query_text)))).alias("term"))
    # One pass over the texts: lengths are observed while the postings of query terms, which are used twice, are written.
    cores = docs.sparkSession.sparkContext.defaultParallelism
    spread_out = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    if spread_out.rdd.getNumPartitions() < cores:
        spread_out = spread_out.repartition(cores)
    seen = Observation()
    t = spread_out.select("doc", terms(F.col("text")).alias("ts")).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.size("ts")).alias("length"))
    t = t.select("doc", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    p = stage(t.join(q.select("term").distinct(), "term", "left_semi").groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    n_docs = seen.get["n"]
    stats = {"n_docs": F.lit(n_docs), "avgdl": F.lit(float(seen.get["length"] or 0) / max(n_docs, 1))}
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = p.join(df, "term").join(q, "term").withColumns(stats)
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    s = hits.groupBy("query", "doc").agg(F.round(F.sum(part), 9).alias("bm25"))
    w = Window.partitionBy("query").orderBy(F.desc("bm25"), "doc")
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def spread(hits: DataFrame, score: str, by: str = "query") -> DataFrame:
    """``lexical``: the batch of each query spread linearly from BEST to WORST; a batch of equal scores gets BEST."""
    w = Window.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn("lexical", F.when(hi == lo, F.lit(BEST)).otherwise(WORST + (BEST - WORST) * (F.col(score) - lo) / (hi - lo)))


def fused(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query, doc, place, weight): query, doc, fused."""
    return lists.groupBy("query", "doc").agg(F.round(F.sum(F.col("weight") / (k + F.col("place"))), 9).alias("fused"))
