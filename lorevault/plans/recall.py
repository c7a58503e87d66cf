"""Recall: episodes and facts for questions, all questions of the evaluation items in one job.

A question's vector is the embedding whose id is its place among the items;
nations and suppliers are entities with vectors. Facts are edges of the trade graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lorevault.functions import text as T
from lorevault.operators import budget, graph, knn, lexical
from lorevault.plans.catalog import Catalog, Tables
from lorevault.plans.episodes import _STATE, _RET, visible, with_retention
from lorevault.plans.memory import _ROUTE
from lorevault.plans.retrieval import _COS, _EDGES, _LEX, _VALID, edges, lexical_hits, questions
from lorevault.session import stage

C = Catalog()
queries, oracle_sql = C.queries, C.oracle_sql

# Fixed values of recall.
CANDIDATES, LEAST_SIMILARITY = 24, 0.12
SEEDS, LEAST_SEED, NAMED = 8, 0.08, 0.85
EPISODES, FACTS, RANKED_NODES, RANKED_FACTS = 6, 8, 400, 20
FAST, DEEP = 1.0, 0.8


def question_vectors(t: Tables) -> DataFrame:
    q = t.eval_items.select(F.col("item_id").alias("query"), (F.row_number().over(Window.orderBy("item_id")) - 1).alias("vec_id"))
    return q.join(t.embeddings.select("vec_id", "embedding"), "vec_id").select("query", "embedding")


_QV = "qv as (select item_id as query, embedding::double[] as v from (select item_id, row_number() over (order by item_id) - 1 as vec_id from eval_items) join embeddings using (vec_id))"
_NEAR = f"""{_QV}, dv as (select memory_id as doc, embedding::double[] as v from vectors join l2_episodes on ord = rowid where {_VALID} and project_id is not null),
near as (select *, row_number() over (partition by query order by similarity desc, doc) as place from (select b.query, a.doc, round({_COS}, 9) as similarity from dv a, qv b))"""


def vector_hits(t: Tables) -> DataFrame:
    """The most similar episodes of each question, among those of some project: query, doc, similarity, place."""
    e = t.l2_episodes.where("project_id is not null").select(F.col("ord").alias("rowid"), "memory_id")
    v = t.vectors.select("rowid", "embedding").join(e, "rowid").select("memory_id", "embedding")
    return knn.nearest(v, "memory_id", "embedding", question_vectors(t), "query", "embedding", CANDIDATES)


_HYBRID = f"""{_LEX}, {_NEAR}, cand as (select query, doc, max(s) as similarity, bool_or(lex) as lex from (select query, doc, similarity as s, false as lex from near where place <= {CANDIDATES} union all select query, doc, lexical, true from l) group by 1, 2),
ep as (select memory_id as doc, summary, created_at, {_RET} as ret, {_STATE} as live from l2_episodes where forgotten_at is null and superseded_by is null and project_id is not null),
hyb as (select query, doc, summary, score, similarity, row_number() over (partition by query order by score desc, created_at desc, doc) as place from (select query, doc, summary, created_at, similarity, round(similarity * (0.2 + 0.8 * ret), 9) as score from cand join ep using (doc) where (lex or similarity >= {LEAST_SIMILARITY}) and live in ('active', 'dormant', 'archived')))"""


def hybrid(t: Tables) -> DataFrame:
    """Episodes for each question: the better of vector and lexical similarity, weighted by what is retained: query, doc, summary, score, place.

    Lexical hits need no least similarity. Forgotten and replaced episodes don't
    take part; archived ones do, as nearly all of the tables are by the clock of the queries.
    """
    both = vector_hits(t).select("query", "doc", "similarity", F.lit(False).alias("lex"))
    both = both.unionByName(lexical.spread(lexical_hits(t), "bm25").select("query", "doc", F.col("lexical").alias("similarity"), F.lit(True).alias("lex")))
    c = both.groupBy("query", "doc").agg(F.max("similarity").alias("similarity"), F.bool_or("lex").alias("lex")).where(F.col("lex") | (F.col("similarity") >= LEAST_SIMILARITY))
    e = with_retention(visible(t.l2_episodes.where("project_id is not null"))).select(F.col("memory_id").alias("doc"), "summary", "retention", "created_at")
    h = c.join(e, "doc").withColumn("score", F.round(F.col("similarity") * (0.2 + 0.8 * F.col("retention")), 9))
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("created_at"), "doc")
    return h.withColumn("place", F.row_number().over(w))


@C.query("HYB01", f"{_HYBRID} select query, doc, place, round(score, 6) as score from hyb where place <= 8")
def hyb01(t: Tables) -> DataFrame:
    return hybrid(t).where("place <= 8").select("query", "doc", "place", F.round("score", 6).alias("score"))


# Seeds of a question: entities by their vectors or by a word of their name.
_NAMES = "names as (select 'en_n' || n_nationkey as node, n_name as name from nation union all select 'en_r' || r_regionkey, r_name from region union all select 'en_s' || s_suppkey, s_name from supplier union all select 'en_c' || c_custkey, c_name from customer)"
_VSEEDS = f"""{_QV}, ev as (select case when vec_id < 265 then 'en_n' || (vec_id - 240) else 'en_s' || (vec_id - 265) end as node, embedding::double[] as v from embeddings where vec_id >= 240),
vs as (select query, node, similarity as sim from (select *, row_number() over (partition by query order by similarity desc, node) as place from (select b.query, a.node, round({_COS}, 9) as similarity from (select * from ev where node in (select node from names)) a, qv b)) where place <= {SEEDS} and similarity > {LEAST_SEED})"""


def names(t: Tables) -> DataFrame:
    parts = [df.select(F.concat(F.lit(p), k).alias("node"), F.col(n).alias("name")) for p, df, k, n in (("en_n", t.nation, "n_nationkey", "n_name"), ("en_r", t.region, "r_regionkey", "r_name"), ("en_s", t.supplier, "s_suppkey", "s_name"), ("en_c", t.customer, "c_custkey", "c_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def vector_seeds(t: Tables) -> DataFrame:
    """The entities most similar to each question: query, node, sim."""
    i = F.col("vec_id")
    v = t.embeddings.where("vec_id >= 240").select(F.when(i < 265, F.concat(F.lit("en_n"), (i - 240).cast("string"))).otherwise(F.concat(F.lit("en_s"), (i - 265).cast("string"))).alias("node"), "embedding")
    near = knn.nearest(v.join(names(t).select("node"), "node", "left_semi"), "node", "embedding", question_vectors(t), "query", "embedding", SEEDS)
    return near.where(F.col("similarity") > LEAST_SEED).select("query", F.col("doc").alias("node"), F.col("similarity").alias("sim"))


_TERM = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_SEEDS_OF = f"""{_NAMES}, {_VSEEDS}, ls as (select query, node, {NAMED} as sim from (select query, node, row_number() over (partition by query order by count(*) desc, node) as place from (select item_id as query, unnest(list_distinct({_TERM.format('answer')})) as w from eval_items) join (select node, unnest(list_distinct({_TERM.format('name')})) as w from names) using (w) group by 1, 2) where place <= {SEEDS}),
sd as (select query, node, max(sim) as sim from (select * from vs union all select * from ls) group by 1, 2)"""


def seeds_of(t: Tables, vector: DataFrame) -> DataFrame:
    """Vector seeds and entities that share words of their name with the answer, the better of both: query, node, sim."""

    def words(c: str) -> F.Column:
        return F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w")

    shared = t.eval_items.select(F.col("item_id").alias("query"), words("answer")).join(names(t).select("node", words("name")), "w").groupBy("query", "node").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("query").orderBy(F.desc("n"), "node")
    named = shared.withColumn("place", F.row_number().over(w)).where(F.col("place") <= SEEDS).select("query", "node", F.lit(NAMED).alias("sim"))
    return vector.unionByName(named).groupBy("query", "node").agg(F.max("sim").alias("sim"))


@C.query("GRA02", f"with {_SEEDS_OF} select query, node, round(sim, 6) as sim from sd")
def gra02(t: Tables) -> DataFrame:
    return seeds_of(t, vector_seeds(t)).select("query", "node", F.round("sim", 6).alias("sim"))


def _best(facts: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "head", "tail")
    return facts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


_FAST = f"""{_EDGES}, {_SEEDS_OF}, adj as (select head as node, tail as other, head, tail, confidence, weight from edges union all select tail, head, head, tail, confidence, weight from edges),
f0 as (select query, node, max(sim) as attained from sd group by 1, 2),
direct as (select query, head, tail, round(sim * confidence * case when tail = node then 1.0 else 0.85 end, 9) as score from sd join adj using (node)),
s1 as (select query, adj.*, round(attained * 0.55 * weight, 12) as v from f0 join adj using (node) where round(attained * 0.55 * weight, 12) >= 0.05), f1 as (select query, other as node, max(v) as attained from s1 where (query, other) not in (select (query, node) from f0) group by 1, 2),
s2 as (select query, adj.*, round(attained * power(0.55, 2) * weight, 12) as v from f1 join adj using (node) where round(attained * power(0.55, 2) * weight, 12) >= 0.05),
fast as (select *, row_number() over (partition by query order by score desc, head, tail) as place from (select query, head, tail, max(score) as score from (select * from direct union all select query, head, tail, round(confidence * v / sqrt(2), 9) from s1 union all select query, head, tail, round(confidence * v / sqrt(3), 9) from s2) group by 1, 2, 3))"""


def fast_facts(e: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges at the seeds and within two hops of them, each with its best score, the best 32: query, head, tail, score, place."""
    at = seeds.join(graph.both_ways(e.withColumn("ends", F.struct("head", "tail"))), "node")
    direct = at.select("query", "ends.head", "ends.tail", F.round(F.col("sim") * F.col("confidence") * F.when(F.col("ends.tail") == F.col("node"), 1.0).otherwise(0.85), 9).alias("score"))
    every = direct.unionByName(graph.expansion(e, seeds, by=("query",)))
    return _best(every.groupBy("query", "head", "tail").agg(F.max("score").alias("score")), 4 * SEEDS)


@C.query("GRA03", f"with {_FAST} select query, head, tail, round(max(score), 6) as score from direct group by 1, 2, 3")
def gra03(t: Tables) -> DataFrame:
    """Edges at the seeds of each question; more if the seed is the tail."""
    at = seeds_of(t, vector_seeds(t)).join(graph.both_ways(edges(t).withColumn("ends", F.struct("head", "tail"))), "node")
    score = F.col("sim") * F.col("confidence") * F.when(F.col("ends.tail") == F.col("node"), 1.0).otherwise(0.85)
    return at.groupBy("query", "ends.head", "ends.tail").agg(F.round(F.max(F.round(score, 9)), 6).alias("score"))


def _ranked_sql(rounds: int) -> str:
    parts = ["tot as (select node, sum(weight) as total from adj group by 1), flow as materialized (select node, other, weight / total as share from adj join tot using (node)), rs as materialized (select query, node, sim / sum(sim) over (partition by query) as r from vs where query in (select item_id from deep)), m0 as (select query, node, r as mass from rs)"]
    for i in range(rounds):
        parts.append(f"m{i + 1} as materialized (select query, node, sum(mass) as mass from (select query, other as node, 0.85 * mass * share as mass from m{i} join flow using (node) union all select query, node, 0.15 * r from rs) group by 1, 2)")
    return ", ".join(parts)


_DEEP = f"""{_FAST}, deep as (select item_id from {_ROUTE} where kind in ('relational', 'global') union select item_id from eval_items where item_id not in (select query from fast where place >= 3)), {_ranked_sql(24)},
top as (select query, node, mass from (select *, row_number() over (partition by query order by round(mass, 12) desc, node) as place from m24) where place <= {RANKED_NODES}),
ppr as (select *, row_number() over (partition by query order by score desc, head, tail) as place from (select query, head, tail, round(sum(mass) * any_value(confidence), 9) as score from (select query, head, tail, confidence, mass from top join edges on head = node union all select query, head, tail, confidence, mass from top join edges on tail = node and head <> tail) group by 1, 2, 3)),
lead as (select query, node from (select *, row_number() over (partition by query order by sim desc, node) as place, count(*) over (partition by query) as n from vs where query in (select item_id from deep)) where place <= 4 and n >= 2),
tied as (select distinct a.query from lead a join adj on a.node = adj.node join lead b on b.query = a.query and b.node = other where a.node <> b.node),
rewritten as (select *, row_number() over (partition by query order by score desc, head, tail) as place from (select distinct query, head, tail, round(0.5 * confidence, 9) as score from lead join adj using (node) where query not in (select query from tied))),
fused as (select query, head, tail, round(sum(w / (60 + place)), 9) as fused, max(score) as score from (select query, head, tail, score, place, {FAST} as w from fast where place <= 32 union all select query, head, tail, score, place, {DEEP} from ppr where place <= {RANKED_FACTS} union all select query, head, tail, score, place, {DEEP} from rewritten) group by 1, 2, 3),
facts as (select *, row_number() over (partition by query order by fused desc, score desc, head, tail) as place from fused)"""


def deep_questions(t: Tables, fast: DataFrame) -> DataFrame:
    """Questions routed to the deep path, and those with fewer than three facts."""
    routed = T.route(questions(t), "item_id", "question").where("kind in ('relational', 'global')").select(F.col("item_id").alias("query"))
    thin = t.eval_items.select(F.col("item_id").alias("query")).join(fast.where("place >= 3").select("query"), "query", "left_anti")
    return routed.unionByName(thin).distinct()


def ranked_facts(e: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges by the PageRank of their ends, the best 20: query, head, tail, score, place."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round("mass", 12)), "node")
    top = graph.personalised_rank(e, seeds, by=("query",)).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= RANKED_NODES).select("query", "node", "mass")
    at = e.join(top.withColumnRenamed("node", "head"), "head").unionByName(e.where("head <> tail").join(top.withColumnRenamed("node", "tail"), "tail").select(*e.columns, "query", "mass"))
    return _best(at.groupBy("query", "head", "tail").agg(F.round(F.sum("mass") * F.any_value("confidence"), 9).alias("score")), RANKED_FACTS)


def rewritten_facts(e: DataFrame, seeds: DataFrame) -> DataFrame:
    """All edges at the four best seeds of questions whose best seeds aren't neighbours: query, head, tail, score, place."""
    w = Window.partitionBy("query")
    lead = seeds.withColumn("nth", F.row_number().over(w.orderBy(F.desc("sim"), "node"))).withColumn("n", F.count(F.lit(1)).over(w)).where("nth <= 4 and n >= 2").select("query", "node")
    at = lead.join(graph.both_ways(e.withColumn("ends", F.struct("head", "tail"))), "node")
    tied = at.where("node <> other").join(lead.withColumnRenamed("node", "other"), ["query", "other"], "left_semi").select("query").distinct()
    found = at.join(tied, "query", "left_anti").select("query", "ends.head", "ends.tail", F.round(0.5 * F.col("confidence"), 9).alias("score")).distinct()
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "head", "tail")))


@C.query("GRA06", f"with {_DEEP} select query, head, tail, round(score, 6) as score from rewritten")
def gra06(t: Tables) -> DataFrame:
    fast = fast_facts(edges(t), seeds_of(t, vector_seeds(t)))
    return rewritten_facts(edges(t), vector_seeds(t).join(deep_questions(t, fast), "query", "left_semi")).select("query", "head", "tail", F.round("score", 6).alias("score"))


def facts(t: Tables) -> DataFrame:
    """Facts for each question, fused from the fast and the deep path: query, head, tail, fused, place."""
    # Seeds and the fast path are used several times.
    e, near = edges(t), stage(vector_seeds(t), "seeds")
    fast = stage(fast_facts(e, seeds_of(t, near)), "fast")
    deep = stage(near.join(deep_questions(t, fast), "query", "left_semi"), "deep")
    lists = fast.withColumn("weight", F.lit(FAST)).unionByName(ranked_facts(e, deep).withColumn("weight", F.lit(DEEP))).unionByName(rewritten_facts(e, deep).withColumn("weight", F.lit(DEEP)))
    f = lists.groupBy("query", "head", "tail").agg(F.round(F.sum(F.col("weight") / (60 + F.col("place"))), 9).alias("fused"), F.max("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("fused"), F.desc("score"), "head", "tail")
    return f.withColumn("place", F.row_number().over(w))


@C.query("FUS01", f"with {_DEEP} select query, head, tail, round(fused, 7) as fused from facts where place <= {FACTS}")
def fus01(t: Tables) -> DataFrame:
    """Reciprocal rank fusion of the fact lists."""
    return facts(t).where(F.col("place") <= FACTS).select("query", "head", "tail", F.round("fused", 7).alias("fused"))


def _kept_sql(most: int) -> str:
    return f"""item as (select query, 'fact' as kind, head || ' ' || tail as item, place, floor(length(head || ' ' || tail) / 3.5)::int + 1 as cost from facts where place <= {FACTS} union all
select query, 'episode', doc, place, case when summary is null or summary = '' then 0 else floor(h + (length(summary) - h) / 3.5)::int + 1 end from (select *, length(regexp_replace(summary, '[^\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{20000}}-\\x{{2fa1f}}]', '', 'g')) as h from hyb where place <= {EPISODES})),
sized as (select *, count(*) filter (kind = 'fact') over (partition by query) as f, count(*) filter (kind = 'episode') over (partition by query) as e from item),
turn as (select *, case when place > least(e, f) then least(e, f) + place when kind = 'fact' then 2 * place else 2 * place - 1 end as turn from sized)
select query, kind, item, place from (select *, sum(cost) over (partition by query order by turn) as used from turn) where used <= {most}"""


def _recalled(t: Tables) -> DataFrame:
    f = facts(t).where(F.col("place") <= FACTS)
    text = F.concat_ws(" ", "head", "tail")
    f = f.select("query", F.lit("fact").alias("kind"), text.alias("item"), "place", T.estimate_tokens(text).alias("cost"))
    e = hybrid(t).where(F.col("place") <= EPISODES).select("query", F.lit("episode").alias("kind"), F.col("doc").alias("item"), "place", T.estimate_tokens(F.col("summary")).alias("cost"))
    return f.unionByName(e)


@C.query("BUD01", f"{_HYBRID}, {_DEEP.replace(_QV + ', ', '', 1)}, {_kept_sql(120)}")
def bud01(t: Tables) -> DataFrame:
    """What is recalled within 120 tokens: the last of the longer list leaves until all fits."""
    return budget.alternating(_recalled(t), 120).select("query", "kind", "item", "place")


@C.query("RET01", f"{_HYBRID}, {_DEEP.replace(_QV + ', ', '', 1)}, {_kept_sql(2000)}")
def ret01(t: Tables) -> DataFrame:
    """End-to-end recall for all questions: episodes, facts of the fast and, where routed, the deep path, fused and cut to 2000 tokens."""
    return budget.alternating(_recalled(t), 2000).select("query", "kind", "item", "place")
