"""Claims and what becomes of them: the gate, conflict policies, strengthening, retraction; communities of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lorevault.functions import vectors as V
from lorevault.operators import graph
from lorevault.operators.running import running
from lorevault.plans.catalog import Catalog, Tables
from lorevault.plans.retrieval import _BELIEF, _EDGES, beliefs, edges
from lorevault.plans.skills import _SKILLS, skills
from lorevault.session import stage

C = Catalog()
queries, oracle_sql = C.queries, C.oracle_sql

_ENCODED = "round(confidence * 1000000)::bigint * 100000000000 + epoch(recorded_at)::bigint"
_JUDGED = f"""{_BELIEF}, o as (select *, max({_ENCODED}) over (partition by head order by o_orderkey rows between unbounded preceding and 1 preceding) as best, {_ENCODED} as own from b),
judged as (select o_orderkey, head, tail, valid_from, case when best is null or own // 100000000000 > best // 100000000000 then 'accepted' when own // 100000000000 < best // 100000000000 then 'weaker_evidence' when own >= best then 'accepted' else 'older_than_incumbent' end as verdict from o)"""


def judged(t: Tables) -> DataFrame:
    """Claims in the order they arrive: weaker ones than the incumbent are rejected, and of equal strength older ones.

    The incumbent is the strongest and then latest claim so far, as all others were rejected.
    """
    b = beliefs(t).withColumn("own", F.struct(F.round(F.col("confidence") * 1_000_000).cast("long").alias("strength"), F.col("recorded_at").alias("at")))
    b = running(b, "best", F.col("own"), "max", ["head"], F.floor(F.col("o_orderkey") / 5000), [F.col("o_orderkey")], before=True)
    same = F.col("own.strength") == F.col("best.strength")
    verdict = F.when(F.col("best").isNull() | (F.col("own.strength") > F.col("best.strength")) | (same & (F.col("own.at") >= F.col("best.at"))), "accepted").when(same, "older_than_incumbent").otherwise("weaker_evidence")
    return b.withColumn("verdict", verdict)


@C.query("STM08", f"with {_JUDGED} select o_orderkey, verdict from judged")
def stm08(t: Tables) -> DataFrame:
    return judged(t).select("o_orderkey", "verdict")


@C.query("AGG02", f"with {_JUDGED}, cl as (select head, valid_from, count(distinct tail) as tails, count(*) as n from b group by 1, 2) select (select count(*) from (select head from b union select tail from b)) as n_entities, (select count(*) from iv where valid_to is null) as n_current, (select count(*) from iv) as n_total, (select count(*) from iv where valid_to is not null) as n_closed, (select sum(n) from cl where tails > 1)::bigint as n_disputed, (select count(*) from judged) as n_changes, (select count(*) from judged where verdict <> 'accepted') as n_conflicts, round((select count(*) filter (verdict <> 'accepted') / count(*) from judged), 6) as conflict_rate")
def agg02(t: Tables) -> DataFrame:
    """Entities, current, closed and disputed beliefs (other tails of a head at the same time), changes and the share in conflict."""
    b = beliefs(t)
    ends = b.select(F.col("head").alias("e")).unionByName(b.select(F.col("tail").alias("e"))).distinct().agg(F.count(F.lit(1)).alias("n_entities"))
    edges_ = b.agg(F.count_if(F.col("valid_to").isNull()).alias("n_current"), F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("valid_to").isNotNull()).alias("n_closed"))
    disputed = b.groupBy("head", "valid_from").agg(F.countDistinct("tail").alias("tails"), F.count(F.lit(1)).alias("n")).agg(F.sum(F.when(F.col("tails") > 1, F.col("n"))).alias("n_disputed"))
    rejected = F.count_if(F.col("verdict") != "accepted")
    v = judged(t).agg(F.count(F.lit(1)).alias("n_changes"), rejected.alias("n_conflicts"), F.round(rejected / F.count(F.lit(1)), 6).alias("conflict_rate"))
    return ends.crossJoin(edges_).crossJoin(disputed).crossJoin(v)


@C.query("WRT08", f"with {_BELIEF} select head, arg_max(tail, (valid_from, o_orderkey)) as last_write, arg_max(tail, (confidence, recorded_at, o_orderkey)) as evidence, case when count(distinct tail) > 1 then count(distinct tail) else 0 end as disputed, count(*) as n_claims from b group by 1")
def wrt08(t: Tables) -> DataFrame:
    """What holds of each head by the three policies: the last write, the best evidence (then the latest), or all as disputed."""
    n = F.countDistinct("tail")
    return beliefs(t).groupBy("head").agg(F.max_by("tail", F.struct("valid_from", "o_orderkey")).alias("last_write"), F.max_by("tail", F.struct("confidence", "recorded_at", "o_orderkey")).alias("evidence"), F.when(n > 1, n).otherwise(0).alias("disputed"), F.count(F.lit(1)).alias("n_claims"))


@C.query("WRT09", f"""with {_BELIEF}, s as (select *, tail is distinct from lag(tail) over (partition by head order by valid_from, o_orderkey) as starts from b)
select head, tail, count(*) filter (starts) - 1 as n_reopened, round(least(0.99, arg_min(confidence, (valid_from, o_orderkey)) + 0.02 * (count(distinct recorded_at) - 1)), 6) as confidence, count(*) as n_evidence from s group by 1, 2""")
def wrt09(t: Tables) -> DataFrame:
    """Beliefs that were closed and claimed again are reopened; new evidence strengthens a belief by 0.02, to 0.99 at most."""
    w = Window.partitionBy("head").orderBy("valid_from", "o_orderkey")
    b = beliefs(t).withColumn("starts", ~F.col("tail").eqNullSafe(F.lag("tail").over(w)))
    raised = F.min_by("confidence", F.struct("valid_from", "o_orderkey")) + 0.02 * (F.countDistinct("recorded_at") - 1)
    return b.groupBy("head", "tail").agg((F.count_if("starts") - 1).alias("n_reopened"), F.round(F.least(F.lit(0.99), raised), 6).alias("confidence"), F.count(F.lit(1)).alias("n_evidence"))


@C.query("WRT10", f"with {_SKILLS} select doc_id, name, array_to_string(list_sort(list_intersect(tools, ['query_store', 'grep_tree'])), ',') as lost from sk where scope_kind = 'project' and list_has_any(tools, ['query_store', 'grep_tree'])")
def wrt10(t: Tables) -> DataFrame:
    """Beliefs observed with tools that are gone: skills of projects that name one of them."""
    lost = F.array_intersect("tools", F.array(F.lit("query_store"), F.lit("grep_tree")))
    return skills(t).where((F.col("scope_kind") == "project") & (F.size(lost) > 0)).select("doc_id", "name", F.array_join(F.array_sort(lost), ",").alias("lost"))


# Facts: what an episode says of its project, in relations that are known; one of them holds once.
_GATE = """f as (select ord, created_at, project_id as head, event_type as relation, outcome as tail, case when importance is null or isnan(importance) then 0.8 else least(1.0, importance) end as confidence, anchor_id from l2_episodes),
g as (select f.*, first_value(ord) over (partition by head, relation, tail order by created_at, ord) as first_same, first_value(ord) over (partition by head, relation order by created_at, ord) as first_any from f
  where relation in (select event_type from l2_episodes group by 1 having count(*) >= 20) and confidence >= 0.2 and trim(coalesce(head, '')) <> '' and trim(coalesce(tail, '')) <> '' and (anchor_id is null or anchor_id in (select anchor_id from anchors)))
select ord, case when relation is null or relation not in (select event_type from l2_episodes where event_type is not null group by 1 having count(*) >= 20) then 'unknown_relation' when confidence < 0.2 then 'low_confidence' when trim(coalesce(head, '')) = '' or trim(coalesce(tail, '')) = '' then 'empty_endpoint'
  when anchor_id is not null and anchor_id not in (select anchor_id from anchors where anchor_id is not null) then 'needs_evidence' when first_same <> ord then 'duplicate' when first_any <> ord and relation = (select min(event_type) from l2_episodes) then 'conflict' else 'accepted' end as decision from (select f.*, first_same, first_any from f left join g using (ord))"""


@C.query("WRT07", f"with {_GATE}")
def wrt07(t: Tables) -> DataFrame:
    """The ordered gate for facts: known relation, confidence, both ends, evidence that exists, no duplicate, no conflict.

    A fact is what an episode says (event type and outcome) of its project, its evidence the
    anchor. Relations are known if twenty facts have them; the first by name holds once.
    Only facts that pass the first checks make others duplicates or conflicts; the first fact is the oldest.
    """
    f = t.l2_episodes.select("ord", "created_at", F.col("project_id").alias("head"), F.col("event_type").alias("relation"), F.col("outcome").alias("tail"), F.when(F.col("importance").isNull() | F.isnan("importance"), 0.8).otherwise(F.least(F.lit(1.0), "importance")).alias("confidence"), "anchor_id")
    known = f.where("relation is not null").groupBy("relation").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("relation", F.lit(True).alias("known"))
    once = f.agg(F.min("relation").alias("once"))
    anchors = t.anchors.where("anchor_id is not null").select("anchor_id").distinct().withColumn("there", F.lit(True))

    def blank(c: str):
        return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""

    first = F.when(F.col("known").isNull(), "unknown_relation").when(F.col("confidence") < 0.2, "low_confidence").when(blank("head") | blank("tail"), "empty_endpoint").when(F.col("anchor_id").isNotNull() & F.col("there").isNull(), "needs_evidence")
    f = stage(f.join(F.broadcast(known), "relation", "left").join(anchors, "anchor_id", "left").withColumn("decision", first), "facts")
    # Partial minima, so that a project with most of the facts is no single task.
    passed = f.where("decision is null")
    oldest = F.min(F.struct("created_at", "ord")).getField("ord")
    same = passed.groupBy("head", "relation", "tail").agg(oldest.alias("first_same"))
    every = passed.groupBy("head", "relation").agg(oldest.alias("first_any"))
    rest = passed.join(same, ["head", "relation", "tail"]).join(every, ["head", "relation"]).crossJoin(F.broadcast(once))
    decision = F.when(F.col("first_same") != F.col("ord"), "duplicate").when((F.col("first_any") != F.col("ord")) & (F.col("relation") == F.col("once")), "conflict").otherwise("accepted")
    return f.where("decision is not null").select("ord", "decision").unionByName(rest.select("ord", decision.alias("decision")))


# Communities of the trade graph, without disputed edges: a fixed number of rounds of label propagation, all nodes at once.
_ROUNDS = 6


def _labels_sql() -> str:
    parts = ["ce as (select head, tail, confidence from edges where confidence >= 0.6)", "ca as materialized (select head as node, tail as other, confidence as w from ce where head <> tail union all select tail, head, confidence from ce where head <> tail)", "cv as materialized (select * from ca union all select node, node, max(w) from ca group by node)", "c0 as (select distinct node, node as label from ca)"]
    for i in range(_ROUNDS):
        parts.append(f"c{i + 1} as materialized (select node, label from (select node, label, row_number() over (partition by node order by v desc, label) as rn from (select cv.node, label, round(sum(w), 9) as v from cv join c{i} l on l.node = cv.other group by 1, 2)) where rn = 1)")
    return ", ".join(parts)


_COMMUNITIES = f"""with {_EDGES}, {_labels_sql()}, member as (select node, label as community, count(*) over (partition by label) as size from c{_ROUNDS}), inner_ as (select a.community, head, tail, confidence, row_number() over (partition by a.community order by confidence desc, head, tail) as rn from ce join member a on a.node = head join member b on b.node = tail and a.community = b.community),
deg as (select node, count(*) as degree from (select head as node from ce union all select tail from ce) group by 1), top as (select community, node as label_node from (select community, node, row_number() over (partition by community order by degree desc, node) as rn from member join deg using (node)) where rn = 1),
com as (select community, size, label_node, left(sha1(m), 16) as signature, facts from (select community, any_value(size) as size, string_agg(node, '|' order by node) as m from member where size >= 3 group by 1) join top using (community) left join (select community, string_agg(head || ' ' || tail, '; ' order by rn) as facts from inner_ where rn <= 6 group by 1) using (community))"""


def members(t: Tables) -> DataFrame:
    """node, community, over the edges that aren't disputed (of confidence 0.6 and more)."""
    return stage(graph.communities(_trusted(t), _ROUNDS).select("node", F.col("label").alias("community")), "members")


def _trusted(t: Tables) -> DataFrame:
    return edges(t).where(F.col("confidence") >= 0.6).select("head", "tail", F.col("confidence").alias("weight"))


def communities(t: Tables) -> DataFrame:
    """Communities of three and more: size, the member of most edges, the six best edges inside, and a signature of the members."""
    m, e = members(t), _trusted(t)
    degree = graph.both_ways(e).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    top = m.join(degree, "node").groupBy("community").agg(F.min(F.struct(-F.col("degree"), "node")).getField("node").alias("label_node"))
    inside = e.join(m.select(F.col("node").alias("head"), "community"), "head").join(m.select(F.col("node").alias("tail"), "community"), ["tail", "community"])
    w = Window.partitionBy("community").orderBy(F.desc("weight"), "head", "tail")
    best = inside.withColumn("rn", F.row_number().over(w)).where("rn <= 6").groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "head", "tail"))), lambda x: F.concat_ws(" ", x["head"], x["tail"])), "; ").alias("facts"))
    # The signature is of all members, as their list is the text that is hashed.
    every = m.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.left(F.sha1(F.array_join(F.array_sort(F.collect_list("node")), "|")), F.lit(16)).alias("signature")).where("size >= 3")
    return every.join(top, "community").join(best, "community", "left").select("community", "size", "label_node", "signature", "facts")


@C.query("GRA08", f"{_COMMUNITIES} select * from com")
def gra08(t: Tables) -> DataFrame:
    return communities(t)


@C.query("GRA09", f"{_COMMUNITIES} select node, community from member where size >= 3")
def gra09(t: Tables) -> DataFrame:
    """Rebuilt membership: which community each node is of, of those that are stored."""
    m = members(t)
    size = m.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("community")
    return m.join(size, "community", "left_semi").select("node", "community")


_TEXTS = """ct as (select community, list_distinct(regexp_extract_all(lower(label_node || ' ' || coalesce(facts, '')), '[a-z0-9_]+')) as words from com), cq as (select o_orderkey, list_distinct(['en_c' || o_custkey, 'en_n' || c_nationkey, 'en_n' || (o_orderkey % 25)]) as words, o_orderkey % 500 as vec_id from orders join customer on c_custkey = o_custkey where o_orderkey % 20 = 0),
sc as (select o_orderkey, community, round(0.6 * least(1.0, n / 4.0) + 0.4 * greatest(0.0, coalesce(sim, 0.0)), 9) as score from (select o_orderkey, community, count(*) as n, any_value(q.vec_id) as vec_id from (select o_orderkey, vec_id, unnest(words) as w from cq) q join (select community, unnest(words) as w from ct) using (w) group by 1, 2)
  left join (select a.vec_id, 'en_n' || b.vec_id as community, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) as sim from (select vec_id, embedding::double[] as v from embeddings) a, (select vec_id, embedding::double[] as v from embeddings where vec_id < 25) b) using (vec_id, community))"""


def scored(t: Tables) -> DataFrame:
    """Communities by the words they share with a question and the likeness of their vectors, at least 0.15: o_orderkey, community, score.

    A question is an order whose key is divisible by 20: it names its customer and two nations.
    The vector of a community is that of the nation it is named after, if it is.
    """
    c = communities(t)
    words = c.select("community", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "label_node", F.coalesce("facts", F.lit("")))), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("w"))
    q = t.orders.where("o_orderkey % 20 = 0").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    named = F.array_distinct(F.array(F.concat(F.lit("en_c"), "o_custkey"), F.concat(F.lit("en_n"), "c_nationkey"), F.concat(F.lit("en_n"), F.pmod("o_orderkey", F.lit(25)))))
    q = q.select("o_orderkey", F.pmod("o_orderkey", F.lit(500)).alias("vec_id"), F.explode(named).alias("w"))
    shared = q.join(words, "w").groupBy("o_orderkey", "vec_id", "community").agg(F.count(F.lit(1)).alias("n"))
    v = t.embeddings.select("vec_id", "embedding")
    own = F.broadcast(v.where("vec_id < 25").select(F.concat(F.lit("en_n"), F.col("vec_id").cast("string")).alias("community"), F.col("embedding").alias("e")))
    near = shared.join(v, "vec_id", "left").join(own, "community", "left")
    score = 0.6 * F.least(F.lit(1.0), F.col("n") / 4.0) + 0.4 * F.greatest(F.lit(0.0), F.coalesce(F.round(V.cosine(F.col("embedding"), F.col("e")), 9), F.lit(0.0)))
    return near.select("o_orderkey", "community", F.round(score, 9).alias("score")).where("score >= 0.15")


@C.query("GRA10", f"{_COMMUNITIES}, {_TEXTS} select o_orderkey, community, round(score, 6) as score from sc where score >= 0.15")
def gra10(t: Tables) -> DataFrame:
    return scored(t).select("o_orderkey", "community", F.round("score", 6).alias("score"))


@C.query("TOP06", f"{_COMMUNITIES}, {_TEXTS} select o_orderkey, community, place from (select *, row_number() over (partition by o_orderkey order by score desc, community) as place from sc where score >= 0.15) where place <= 3")
def top06(t: Tables) -> DataFrame:
    """The three best communities of each question."""
    w = Window.partitionBy("o_orderkey").orderBy(F.desc("score"), "community")
    return scored(t).withColumn("place", F.row_number().over(w)).where("place <= 3").select("o_orderkey", "community", "place")


@C.query("AGG13", f"with {_EDGES} select count(*) as n, round(sum(confidence), 4) as confidence, count(*) filter (confidence < 0.6) as n_disputed, (select sum(length(array_to_string(sources, ',')))::bigint from memory_digests) as evidence_length, (select count(*) from l2_episodes where forgotten_at is not null) as n_forgotten from edges")
def agg13(t: Tables) -> DataFrame:
    """The stamp that tells whether a cached graph still holds: number and confidence of edges, disputed ones, length of the evidence, forgotten sources."""
    e = edges(t).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"), F.count_if(F.col("confidence") < 0.6).alias("n_disputed"))
    d = t.memory_digests.agg(F.sum(F.length(F.array_join("sources", ","))).alias("evidence_length"))
    f = t.l2_episodes.agg(F.count_if(F.col("forgotten_at").isNotNull()).alias("n_forgotten"))
    return e.crossJoin(d).crossJoin(f)


@C.query("FLT08", f"with {_BELIEF} select o_orderkey, direction from (select *, unnest(['out', 'in']) as direction from iv) where valid_from <= timestamp '1998-02-15' and (valid_to is null or valid_to > timestamp '1998-02-15') and recorded_at <= timestamp '1998-02-15' and confidence >= 0.6 and ((direction = 'out' and head in (select 'en_c' || c_custkey from customer where c_mktsegment = 'BUILDING')) or (direction = 'in' and tail in ('1-URGENT', '2-HIGH')))")
def flt08(t: Tables) -> DataFrame:
    """Beliefs of some heads (direction out) or about some tails (in), true and recorded by a time, without disputed ones."""
    at = F.lit("1998-02-15").cast("timestamp_ntz")
    b = beliefs(t).where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)) & (F.col("recorded_at") <= at) & (F.col("confidence") >= 0.6))
    heads = t.customer.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("en_c"), "c_custkey").alias("head"))
    out = b.join(heads, "head", "left_semi").select("o_orderkey", F.lit("out").alias("direction"))
    return out.unionByName(b.where(F.col("tail").isin("1-URGENT", "2-HIGH")).select("o_orderkey", F.lit("in").alias("direction")))
