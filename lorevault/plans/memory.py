"""Composite retrieval, entity resolution, communities and the folds of the write path."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lorevault.functions import decay, embedding, text as T
from lorevault.operators import graph, knn
from lorevault.plans.catalog import Catalog, Tables
from lorevault.plans.episodes import visible, with_retention
from lorevault.plans.retrieval import _keywords, _BELIEF, _EDGES, _LEX, _SEEDS, _VALID, _COS, beliefs, edges, lexical_hits, questions, seeds

C = Catalog()
queries, oracle_sql = C.queries, C.oracle_sql



@C.query("FLT10", f"select distinct digest_id, coalesce(len(sources) > 0 and len(sources) = n_lost, false) as lost from (select distinct digest_id, sources, (select count(*) from unnest(sources) as u(m) where m in (select memory_id from l2_episodes where forgotten_at is not null or superseded_by is not null)) as n_lost from memory_digests)")
def flt10(t: Tables) -> DataFrame:
    """Digests that have sources, all of which are forgotten or replaced."""
    d = t.memory_digests.select("digest_id", "sources").distinct()
    gone = t.l2_episodes.where("forgotten_at is not null or superseded_by is not null").select(F.col("memory_id").alias("m"), F.lit(True).alias("gone"))
    e = d.select("digest_id", F.explode("sources").alias("m")).join(gone, "m", "left").groupBy("digest_id").agg(F.every(F.coalesce("gone", F.lit(False))).alias("all_gone"))
    return d.select("digest_id").distinct().join(e, "digest_id", "left").select("digest_id", F.coalesce("all_gone", F.lit(False)).alias("lost"))


@C.query("FLT11", f"with {_EDGES}, registry(relation, w) as (values ('part_of', 0.9), ('is_a', 0.9), ('uses', 1.0)) select head, tail, w from edges join registry using (relation)")
def flt11(t: Tables) -> DataFrame:
    """Edges of registered relations only."""
    registry = t.spark.createDataFrame([("part_of", 0.9), ("is_a", 0.9), ("uses", 1.0)], "relation string, w double")
    return edges(t).join(F.broadcast(registry), "relation").select("head", "tail", "w")


@C.query("JOI01", _LEX + " select query, doc, e.project_id from l join l2_episodes e on e.memory_id = doc")
def joi01(t: Tables) -> DataFrame:
    return lexical_hits(t).join(t.l2_episodes.select(F.col("memory_id").alias("doc"), "project_id"), "doc").select("query", "doc", "project_id")


@C.query("JOI04", "select anchor_id, seq from anchors where session_key in (select session_key from l2_episodes where event_type = 'incident')")
def joi04(t: Tables) -> DataFrame:
    wanted = t.l2_episodes.where("event_type = 'incident'").select("session_key")
    return t.anchors.select("anchor_id", "seq", "session_key").join(wanted, "session_key", "left_semi").select("anchor_id", "seq")


_VECQ = f"v as (select memory_id as doc, embedding::double[] as v from vectors join l2_episodes on ord = rowid where {_VALID}), qv as (select vec_id as query, embedding::double[] as v from embeddings where vec_id % 20 = 0), near as (select *, row_number() over (partition by query order by similarity desc, doc) as place from (select b.query, a.doc, round({_COS}, 9) as similarity from v a, qv b))"


def vector_hits(t: Tables, k: int) -> DataFrame:
    v = t.vectors.join(t.l2_episodes.select(F.col("ord").alias("rowid"), "memory_id"), "rowid").select("memory_id", "embedding")
    return knn.nearest(v, "memory_id", "embedding", t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", k)


@C.query("TOP05", f"with {_VECQ} select query, doc, place from near where place <= 24")
def top05(t: Tables) -> DataFrame:
    return vector_hits(t, 24).select("query", "doc", "place")


_RECENT = "rec as (select memory_id as doc, row_number() over (order by created_at desc, memory_id) as place from l2_episodes where forgotten_at is null and superseded_by is null)"


@C.query("JOI10", f"with {_VECQ}, {_RECENT} select query, doc, round(max(s), 6) as best from (select query, doc, similarity as s from near where place <= 24 union all select query, doc, 0.9 - place / 100.0 from rec, (select distinct query from qv) where place <= 24) group by 1, 2")
def joi10(t: Tables) -> DataFrame:
    """Two candidate lists of each query as one, with the better value of what is in both."""
    recent = visible(t.l2_episodes).select("memory_id", "created_at").orderBy(F.desc("created_at"), "memory_id").limit(24)
    recent = recent.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"), "memory_id"))).select(F.col("memory_id").alias("doc"), (0.9 - F.col("place") / 100.0).alias("similarity"))
    a = vector_hits(t, 24).select("query", "doc", "similarity")
    b = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query")).crossJoin(F.broadcast(recent))
    return a.unionByName(b).groupBy("query", "doc").agg(F.round(F.max("similarity"), 6).alias("best"))


@C.query("SET04", f"with {_VECQ}, {_RECENT} select query, doc from near where place <= 24 union select query, doc from rec, (select distinct query from qv) where place <= 24")
def set04(t: Tables) -> DataFrame:
    return joi10(t).select("query", "doc")


def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).lower())


@C.query("STR01")
def str01(t: Tables) -> DataFrame:
    """Compatibility form in lower case of every summary, null of null; only texts with other than ASCII characters go through Python."""
    e = t.l2_episodes.select("ord", "summary")
    other = F.col("summary").rlike(r"[^\x00-\x7f]")
    plain = e.where(~F.coalesce(other, F.lit(False))).select("ord", F.lower("summary").alias("folded"))
    return plain.unionByName(e.where(other).select("ord", F.pandas_udf(_folded, "string")("summary").alias("folded")))


@C.query("STR03", r"select ord, r as run, array_to_string(list_transform(range(1, length(r)), lambda i: substring(r, i, 2)), '|') as pairs from (select ord, unnest(regexp_extract_all(summary, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]+')) as r from l2_episodes) where length(r) > 1")
def str03(t: Tables) -> DataFrame:
    e = t.l2_episodes.select("ord", F.explode(F.filter(T.runs(F.col("summary")), lambda r: r.rlike(f"^[{T.HAN}]"))).alias("run")).where("length(run) > 1")
    return e.select("ord", "run", F.array_join(F.filter(T.han_grams(F.col("run")), lambda g: F.length(g) == 2), "|").alias("pairs"))


@C.query("STR15", r"select distinct digest_id, case when length(digest_id) > 24 then left(digest_id, 6) || '…' || right(digest_id, 17) else digest_id end as label, replace(replace(coalesce(scope_ref, ''), '|', '\|'), '*', '\*') as escaped from memory_digests")
def str15(t: Tables) -> DataFrame:
    d = t.memory_digests
    label = F.when(F.length("digest_id") > 24, F.concat(F.left("digest_id", F.lit(6)), F.lit("…"), F.right("digest_id", F.lit(17)))).otherwise(F.col("digest_id"))
    return d.select("digest_id", label.alias("label"), F.replace(F.replace(F.coalesce("scope_ref", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("*"), F.lit("\\*")).alias("escaped")).distinct()


@C.query("STR16", r"select distinct digest_id, trim(regexp_replace(regexp_replace(trim(content), '^```[A-Za-z]*\s*', ''), '\s*```$', '')) as body from memory_digests")
def str16(t: Tables) -> DataFrame:
    return t.memory_digests.select("digest_id", T.without_fences(F.col("content")).alias("body")).distinct()


_GLOBAL = "总结|概述|整体|汇总|都有哪些|全部|概况|summary|overview|overall|all of|in general|有哪些$"
_RELATIONAL = "的关系|什么关系|之间|影响|导致|依赖|关联|为什么|如何影响|relationship|related|connect|why does|leads to|causes|depends on|between"
_TEMPORAL = "以前|之前|当时|历史|曾经|以前是|后来|之前是|previously|used to|before|earlier|last year|on "
_ROUTE = f"""(select i.item_id, coalesce(regexp_matches(q, '{_TEMPORAL}'), false) as temporal, case when regexp_matches(q, '{_GLOBAL}') then 'global' when regexp_matches(q, '{_RELATIONAL}') then 'relational' when regexp_matches(q, '{_TEMPORAL}') then 'temporal' when len(keywords) >= 6 then 'relational' else 'point' end as kind
from (select item_id, lower(trim(coalesce(instruction, passage))) as q from eval_items) i left join {_keywords('eval_items', 'item_id', 'coalesce(instruction, passage)')} k using (item_id))"""


@C.query("STR22", f"select item_id, kind, temporal from {_ROUTE}")
def str22(t: Tables) -> DataFrame:
    return T.route(questions(t), "item_id", "question")


@C.query("MTH01", "select event_id, case when value is null or isnan(value) then 0.5 else least(1.0, greatest(0.05, value / 100)) end as importance from events")
def mth01(t: Tables) -> DataFrame:
    return t.events.select("event_id", decay.importance(F.col("value") / 100).alias("importance"))


@C.query("MTH02", "select event_id, case when value is null or isnan(value) then 0.8 else least(1.0, value / 100) end as confidence from events")
def mth02(t: Tables) -> DataFrame:
    return t.events.select("event_id", decay.confidence(F.col("value") / 100).alias("confidence"))


@C.query("MTH04", "select memory_id, least(500, greatest(1, access_count * 60)) as clamped, coalesce(lower(outcome) in ('success', 'yes', 'true', '1'), false) as truthy from l2_episodes")
def mth04(t: Tables) -> DataFrame:
    return t.l2_episodes.select("memory_id", F.least(F.lit(500), F.greatest(F.lit(1), F.col("access_count") * 60)).alias("clamped"), F.coalesce(F.lower("outcome").isin("success", "yes", "true", "1"), F.lit(False)).alias("truthy"))


@C.query("VEC04")
def vec04(t: Tables) -> DataFrame:
    """Hashed vectors of the document titles."""
    return embedding.hashed(t.documents, "doc_id", "title")


@C.query("JSN02", "select anchor_id, to_json({'agent': agent, 'seq': seq}) as encoded from anchors where agent is not null and seq is not null")
def jsn02(t: Tables) -> DataFrame:
    return t.anchors.where("agent is not null and seq is not null").select("anchor_id", F.to_json(F.struct("agent", "seq")).alias("encoded"))


@C.query("GRA14", f"with {_BELIEF} select o_orderkey, head from b where tail in ('1-URGENT') or head in (select 'en_c' || c_custkey from customer where c_mktsegment = 'MACHINERY')")
def gra14(t: Tables) -> DataFrame:
    """Audit rows that touch a tail or any of a set of heads."""
    heads = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("en_c"), "c_custkey").alias("head"), F.lit(True).alias("wanted"))
    b = beliefs(t).select("o_orderkey", "head", "tail").join(heads, "head", "left")
    return b.where("wanted or tail = '1-URGENT'").select("o_orderkey", "head")


@C.query("BUD04", "with d as (select project_id, memory_id, length(summary) as cost, created_at, ord from l2_episodes where summary is not null and project_id is not null), n as (select count(distinct project_id) as n from d) select project_id, memory_id, used from (select project_id, memory_id, sum(cost) over (partition by project_id order by created_at desc, ord desc)::bigint as used from d) where used <= 200000 // (select n from n)")
def bud04(t: Tables) -> DataFrame:
    """Materials of a digest: an equal share of the budget to each project, newest first."""
    from lorevault.operators import budget

    d = t.l2_episodes.where("summary is not null and project_id is not null").select("project_id", "memory_id", F.char_length("summary").alias("cost"), "created_at", "ord")
    share = d.agg(F.floor(F.lit(200_000) / F.countDistinct("project_id")).alias("share"))
    d = d.crossJoin(F.broadcast(share))
    kept = budget.prefix(d, "cost", F.col("share"), ["project_id"], -F.unix_date(F.to_date("created_at")), [F.desc("created_at"), F.desc("ord")])
    return kept.select("project_id", "memory_id", "used")


@C.query("WRT21", "select k, min(created_at) is not null as kept, count(*) as n from (select case when session_id is not null and seq is not null then lower(trim(session_id)) || '#' || seq when session_id is not null and quote is not null then lower(trim(session_id)) || '#' || sha1(quote) end as k, created_at from anchors) where k is not null group by 1")
def wrt21(t: Tables) -> DataFrame:
    """Idempotent capture: by (session, seq), else by session and text, else not kept."""
    s = F.lower(F.trim("session_id"))
    k = F.when(F.col("session_id").isNotNull() & F.col("seq").isNotNull(), F.concat(s, F.lit("#"), F.col("seq").cast("string"))).when(F.col("session_id").isNotNull() & F.col("quote").isNotNull(), F.concat(s, F.lit("#"), F.sha1("quote")))
    return t.anchors.select(k.alias("k"), "created_at").where("k is not null").groupBy("k").agg(F.min("created_at").isNotNull().alias("kept"), F.count(F.lit(1)).alias("n"))


@C.query("SNK12", "select 'l2' as kind, count(*) filter (embedding is null or len(embedding) <> 64) as n_to_embed, count(*) as n from vectors")
def snk12(t: Tables) -> DataFrame:
    return t.vectors.agg(F.count_if(F.col("embedding").isNull() | (F.size("embedding") != 64)).alias("n_to_embed"), F.count(F.lit(1)).alias("n")).select(F.lit("l2").alias("kind"), "n_to_embed", "n")
