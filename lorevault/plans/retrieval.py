"""Text, lexical, vector and fused retrieval; graph queries over the trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lorevault.functions import text as T, vectors as V
from lorevault.operators import graph, knn, lexical
from lorevault.plans.catalog import Catalog, Tables

C = Catalog()
queries, oracle_sql = C.queries, C.oracle_sql

_HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2fa1f}"
_STOP = ", ".join(f"'{w}'" for w in "a an the and or but if then else of to in on at by for with from as is are was were be been being it its this that these those i you he she they we me my your our their what which who whom how when where why not no yes do does did done can could should would will shall may might must about into over under again more most other some such only own same so than too very just".split())
# Compatibility forms: full-width digits and letters, ordinals.
_WIDE, _NARROW = (end + "".join(chr(c + shift) for c in (*range(48, 58), *range(65, 91), *range(97, 123))) for shift, end in ((0xFEE0, "ºª"), (0, "oa")))


def _runs(c: str) -> str:
    """Runs of one script, in SQL."""
    return rf"regexp_extract_all(regexp_replace(lower(translate({c}, '{_WIDE}', '{_NARROW}')), '([{_HAN}]+)', ' \1 ', 'g'), '[\p{{L}}\p{{N}}_]+')"


def _terms(c: str) -> str:
    """Han runs as characters and pairs, others unless stopwords or too long, in SQL."""
    runs = _runs(c)
    grams = f"case when regexp_matches(r, '^[{_HAN}]') then list_concat(list_transform(range(1, length(r) + 1), lambda i: substring(r, i, 1)), list_transform(range(1, length(r)), lambda i: substring(r, i, 2))) else [r] end"
    return f"list_filter(flatten(list_transform({runs}, lambda r: {grams})), lambda t: length(t) <= 24 and t not in ({_STOP}))"


def _keywords(source: str, key: str, text: str, limit: int = 12) -> str:
    """Table of key and keywords, in SQL."""
    return f"""(select {key}, list_slice(string_split(list_reduce(ts, lambda a, t: case when regexp_full_match(t, '[{_HAN}]{{2}}') and regexp_full_match(split_part(a, '|', -1), '[{_HAN}]{{2,}}') and right(a, 1) = left(t, 1) then a || right(t, 1) else a || '|' || t end), '|'), 1, {limit}) as keywords
from (select {key}, list(term order by rn) as ts from (select {key}, term, row_number() over (partition by {key} order by weight desc, length(term) desc, term) as rn from (select {key}, term, round(count(*) * case when length(term) >= 2 then 1.6 else 1.0 end, 6) as weight from (select {key}, unnest({_terms(text)}) as term from {source}) group by {key}, term)) where rn <= {3 * limit} group by {key}))"""


@C.query("STR02", f"select ord, array_to_string({_runs('summary')}, '|') as runs from l2_episodes")
def str02(t: Tables) -> DataFrame:
    return t.l2_episodes.select("ord", F.array_join(T.runs(F.col("summary")), "|").alias("runs"))


@C.query("STR04", f"select ord, array_to_string({_terms('summary')}, '|') as terms from l2_episodes")
def str04(t: Tables) -> DataFrame:
    return t.l2_episodes.select("ord", F.array_join(T.terms(F.col("summary")), "|").alias("terms"))


@C.query("STR05", f"select ord, array_to_string(keywords, '|') as keywords from {_keywords('l2_episodes', 'ord', 'summary')}")
def str05(t: Tables) -> DataFrame:
    """The keywords of each summary."""
    return T.keywords(t.l2_episodes, "ord", "summary").select("ord", F.array_join("keywords", "|").alias("keywords"))


@C.query("STR06", f"select digest_id, content, case when content is null or content = '' then 0 else floor(h + (length(content) - h) / 3.5)::int + 1 end as tokens from (select *, length(regexp_replace(content, '[^{_HAN}]', '', 'g')) as h from memory_digests)")
def str06(t: Tables) -> DataFrame:
    return t.memory_digests.select("digest_id", "content", T.estimate_tokens(F.col("content")).alias("tokens"))


@C.query("STR07", "select ord, case when length(trim(summary)) <= 60 then trim(summary) else rtrim(substring(trim(summary), 1, 59)) || '…' end as clipped from l2_episodes")
def str07(t: Tables) -> DataFrame:
    return t.l2_episodes.select("ord", T.clip(F.col("summary"), 60).alias("clipped"))


@C.query("STR08", r"select distinct display_name, regexp_replace(trim(lower(display_name)), '[\s_]+', ' ', 'g') as name_key from projects")
def str08(t: Tables) -> DataFrame:
    return t.projects.select("display_name", T.name_key(F.col("display_name")).alias("name_key")).distinct()


@C.query("STR09", "select distinct source, replace(replace(lower(trim(source)), ' ', '_'), '-', '_') as source_key from documents")
def str09(t: Tables) -> DataFrame:
    return t.documents.select("source", T.relation_key(F.col("source")).alias("source_key")).distinct()


@C.query("STR10", r"select doc_id, case when s = '' then 'skill' else s end as slug from (select doc_id, regexp_replace(regexp_replace(lower(title), '[^0-9a-z\x{4e00}-\x{9fff}]+', '-', 'g'), '^-+|-+$', '', 'g') as s from documents)")
def str10(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.slug(F.col("title")).alias("slug"))


@C.query("STR11", r"select url, case when s = '' then 'unknown' else right(s, 64) end as project_slug from (select distinct url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^[^/@]*@', ''), '/+$', ''), '\.git$', ''), '[^0-9a-z]+', '-', 'g'), '^-+|-+$', '', 'g') as s from documents)")
def str11(t: Tables) -> DataFrame:
    return t.documents.select("url").distinct().select("url", T.project_slug(F.col("url")).alias("project_slug"))


@C.query("STR12", r"select ord, h, h = lower(summary_hash) as fresh from (select *, sha1(lower(trim(regexp_replace(summary, '\s+', ' ', 'g')))) as h from l2_episodes)")
def str12(t: Tables) -> DataFrame:
    """The hash of each summary, and whether the stored one still is of this text."""
    h = T.summary_hash(F.col("summary"))
    return t.l2_episodes.select("ord", h.alias("h"), (h == F.lower("summary_hash")).alias("fresh"))


_TEMPLATE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(quote), '"[^"]{1,120}"|''[^'']{1,120}''|`[^`]{1,120}`', '<quoted>', 'g'), '[A-Za-z]:\\[^\s"'']+|(?:\.{0,2}/[\w./\-]+)', '<path>', 'g'), 'https?://\S+', '<url>', 'g'), '\b\d+(?:\.\d+)?\b', '<number>', 'g'), '\s+', ' ', 'g')"""


@C.query("STR14", f"select anchor_id, case when length(trim(s)) <= 160 then trim(s) else rtrim(substring(trim(s), 1, 159)) || '…' end as template from (select anchor_id, {_TEMPLATE} as s from anchors where event_type = 'tool_call')")
def str14(t: Tables) -> DataFrame:
    return t.anchors.where("event_type = 'tool_call'").select("anchor_id", T.template(F.col("quote")).alias("template"))


@C.query("STR17", f"select ord, coalesce((select string_agg('\"' || x || '\"', ' OR ' order by i) from (select x, min(i) as i from (select unnest(ts) as x, generate_subscripts(ts, 1) as i) group by x)), '') as expression from (select ord, {_terms('summary')} as ts from l2_episodes where ord % 1 = 0)".replace(" where ord % 1 = 0", ""))
def str17(t: Tables) -> DataFrame:
    return t.l2_episodes.select("ord", T.match_expression(F.col("summary")).alias("expression"))


@C.query("STR18", "select ord, array_to_string(list_slice(regexp_extract_all(lower(summary), '[a-z0-9]+'), 1, 4), '-') as name from l2_episodes")
def str18(t: Tables) -> DataFrame:
    return t.l2_episodes.select("ord", T.first_words(F.col("summary"), 4).alias("name"))


@C.query("STR19", "select distinct project_id, regexp_full_match(project_id, '[a-z0-9]+(?:-[a-z0-9]+)*') as valid from documents where project_id is not null")
def str19(t: Tables) -> DataFrame:
    return t.documents.where("project_id is not null").select("project_id").distinct().withColumn("valid", F.col("project_id").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"))


@C.query("STR20", "select doc_id, regexp_matches(lower(text), 'project|repo|workspace|c:/|/users/') as specific from documents where text is not null")
def str20(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.lower("text").rlike("project|repo|workspace|c:/|/users/").alias("specific"))


@C.query("STR23", "select digest_id, content, n_lines from (select digest_id, content, len(list_filter(string_split(content, chr(10)), lambda l: trim(l) <> '' and not starts_with(l, '#'))) as n_lines from memory_digests)")
def str23(t: Tables) -> DataFrame:
    kept = F.filter(F.split("content", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    return t.memory_digests.select("digest_id", "content", F.when(F.col("content").isNotNull(), F.size(kept)).alias("n_lines"))


_VALID = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_COS = "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))"


@C.query("VEC01", "with v as (select vec_id, embedding::double[] as v from embeddings) select a.vec_id, round(" + _COS + ", 6) as to_first from v a, v b where b.vec_id = 0")
def vec01(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", "embedding")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(first)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("to_first"))


@C.query("VEC02", f"with v as (select rowid as id, embedding::double[] as v from vectors where {_VALID}), q as (select vec_id, embedding::double[] as v from embeddings where vec_id % 20 = 0), s as (select b.vec_id as query, a.id as doc, round({_COS}, 9) as similarity from v a, q b) select query, doc, place, round(similarity, 6) as similarity from (select *, row_number() over (partition by query order by similarity desc, doc) as place from s) where place <= 10")
def vec02(t: Tables) -> DataFrame:
    """The 10 vectors of the store most similar to each embedding whose id is divisible by 20."""
    q = t.embeddings.where("vec_id % 20 = 0")
    return knn.nearest(t.vectors, "rowid", "embedding", q, "vec_id", "embedding", 10).select("query", "doc", "place", F.round("similarity", 6).alias("similarity"))


@C.query("VEC03", f"select rowid as vec_rowid, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 4) as norm from vectors where {_VALID}")
def vec03(t: Tables) -> DataFrame:
    v = t.vectors.where("size(embedding) = 64").where(V.finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    return v.select(F.col("rowid").alias("vec_rowid"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@C.query("JOI09", f"with v as (select rowid as id, project_id as p, embedding::double[] as v from vectors join l2_episodes on ord = rowid where {_VALID} and project_id is not null) select b.id as id_a, a.id as id_b, round({_COS}, 6) as similarity from v a join v b on b.id % 20 = 0 and a.p <> b.p where round({_COS}, 9) >= 0.85")
def joi09(t: Tables) -> DataFrame:
    """Counterparts of the episodes whose id is divisible by 20 in other projects, at least this similar."""
    p = t.l2_episodes.where("project_id is not null").select(F.col("ord").alias("rowid"), "project_id")
    v = t.vectors.select("rowid", "embedding").repartition("rowid").join(p, "rowid")
    near = knn.across(v, "rowid", "project_id", "embedding", 64, "rowid % 20 = 0", 0.85)
    return near.select(F.col("query").alias("id_a"), F.col("doc").alias("id_b"), F.round("similarity", 6).alias("similarity"))


_BM25 = f"""with d as (select memory_id as doc, {_terms('summary')} as ts from l2_episodes), q as (select item_id as query, unnest(list_distinct({_terms('coalesce(instruction, passage)')})) as term from eval_items),
p as (select doc, len(ts) as dl, unnest(ts) as term from d), tf as (select doc, dl, term, count(*) as tf from p group by all), df as (select term, count(*) as df from tf group by 1),
st as (select count(*) as n, avg(len(ts)) as a from (select coalesce(ts, []) as ts from d)),
s as (select query, doc, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) as bm25 from tf join df using (term) join q using (term), st group by 1, 2),
r as (select *, row_number() over (partition by query order by bm25 desc, doc) as place from s)"""


@C.query("LEX01", _BM25 + " select query, doc, place, round(bm25, 5) as bm25 from r where place <= 24")
def lex01(t: Tables) -> DataFrame:
    return lexical_hits(t).select("query", "doc", "place", F.round("bm25", 5).alias("bm25"))


def lexical_hits(t: Tables) -> DataFrame:
    return lexical.bm25(t.l2_episodes, "memory_id", "summary", questions(t), "item_id", "question", 24)


def questions(t: Tables) -> DataFrame:
    """The items with what they ask: the instruction, where there is none the passage."""
    return t.eval_items.withColumn("question", F.coalesce("instruction", "passage"))


_LEX = _BM25 + ", l as (select *, case when max(bm25) over w = min(bm25) over w then 0.9 else 0.45 + 0.45 * (bm25 - min(bm25) over w) / (max(bm25) over w - min(bm25) over w) end as lexical from r where place <= 24 window w as (partition by query))"


@C.query("LEX02", _LEX + " select query, doc, round(lexical, 4) as lexical from l")
def lex02(t: Tables) -> DataFrame:
    return lexical.spread(lexical_hits(t), "bm25").select("query", "doc", F.round("lexical", 4).alias("lexical"))


# Graph: places of trade as entities; part_of and located_in edges, uses edges from orders of parts.
_EDGES = """edges as (select 'en_n' || n_nationkey as head, 'part_of' as relation, 'en_r' || n_regionkey as tail, 0.9 as confidence, 0.9 as weight from nation
union all select 'en_c' || c_custkey, 'located_in', 'en_n' || c_nationkey, 0.5 + (c_custkey % 50) / 100.0, 1.0 from customer
union all select 'en_s' || s_suppkey, 'located_in', 'en_n' || s_nationkey, 0.5 + (s_suppkey % 50) / 100.0, 1.0 from supplier)"""


def edges(t: Tables) -> DataFrame:
    def e(df: DataFrame, head: str, h: str, relation: str, tail: str, k: str, confidence, weight: float) -> DataFrame:
        return df.select(F.concat(F.lit(head), F.col(h)).alias("head"), F.lit(relation).alias("relation"), F.concat(F.lit(tail), F.col(k)).alias("tail"), confidence.alias("confidence"), F.lit(weight).alias("weight"))

    n = e(t.nation, "en_n", "n_nationkey", "part_of", "en_r", "n_regionkey", F.lit(0.9), 0.9)
    c = e(t.customer, "en_c", "c_custkey", "located_in", "en_n", "c_nationkey", 0.5 + F.pmod("c_custkey", F.lit(50)) / 100.0, 1.0)
    s = e(t.supplier, "en_s", "s_suppkey", "located_in", "en_n", "s_nationkey", 0.5 + F.pmod("s_suppkey", F.lit(50)) / 100.0, 1.0)
    return n.unionByName(c).unionByName(s)


@C.query("FLT09", f"with {_EDGES} select distinct head, relation, tail from edges where head in ('en_n3', 'en_r1') or tail in ('en_n3', 'en_r1')")
def flt09(t: Tables) -> DataFrame:
    e = edges(t)
    return e.where(F.col("head").isin("en_n3", "en_r1") | F.col("tail").isin("en_n3", "en_r1")).select("head", "relation", "tail").distinct()


@C.query("JOI03", f"with {_EDGES} select head, tail, n_name, r_name from edges join nation on head = 'en_n' || n_nationkey join region on tail = 'en_r' || r_regionkey")
def joi03(t: Tables) -> DataFrame:
    n = t.nation.select(F.concat(F.lit("en_n"), "n_nationkey").alias("head"), "n_name")
    r = t.region.select(F.concat(F.lit("en_r"), "r_regionkey").alias("tail"), "r_name")
    return edges(t).select("head", "tail").join(n, "head").join(r, "tail").select("head", "tail", "n_name", "r_name")


@C.query("AGG12", f"with {_EDGES} select node, count(*) as degree from (select head as node from edges union all select tail from edges) group by 1")
def agg12(t: Tables) -> DataFrame:
    return graph.both_ways(edges(t).select("head", "tail")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


@C.query("GRA01", f"with {_EDGES} select node, other, relation from (select head as node, tail as other, relation from edges union all select tail, head, relation from edges)")
def gra01(t: Tables) -> DataFrame:
    return graph.both_ways(edges(t).select("head", "tail", "relation")).select("node", "other", "relation")


_SEEDS = "seeds as (select 'en_c' || c_custkey as node, 0.3 + (c_custkey % 7) / 10.0 as sim from customer where c_mktsegment = 'BUILDING')"


def seeds(t: Tables) -> DataFrame:
    return t.customer.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("en_c"), "c_custkey").alias("node"), (0.3 + F.pmod("c_custkey", F.lit(7)) / 10.0).alias("sim"))


@C.query(
    "GRA04",
    f"""with {_EDGES}, {_SEEDS}, adj as (select head as node, tail as other, * from edges union all select tail, head, * from edges), f0 as (select node, max(sim) as attained from seeds group by 1),
s1 as (select a.*, round(attained * 0.55 * weight, 12) as v from f0 join adj a using (node) where round(attained * 0.55 * weight, 12) >= 0.05), f1 as (select other as node, max(v) as attained from s1 where other not in (select node from f0) group by 1),
s2 as (select a.*, round(attained * power(0.55, 2) * weight, 12) as v from f1 join adj a using (node) where round(attained * power(0.55, 2) * weight, 12) >= 0.05)
select head, tail, round(max(s), 8) as score from (select head, tail, confidence * v / sqrt(2) as s from s1 union all select head, tail, confidence * v / sqrt(3) from s2) group by 1, 2""",
)
def gra04(t: Tables) -> DataFrame:
    """Edges met within two hops of the seeds, each with its best score."""
    return graph.expansion(edges(t), seeds(t)).select("head", "tail", F.round("score", 8).alias("score"))


def _rank_sql(rounds: int) -> str:
    parts = [f"with {_EDGES}, {_SEEDS}, adj as (select head as node, tail as other, weight from edges union all select tail, head, weight from edges), tot as (select node, sum(weight) as total from adj group by 1), flow as materialized (select node, other, weight / total as share from adj join tot using (node)), r as materialized (select node, sim / (select sum(sim) from seeds) as r from seeds), m0 as (select node, r as mass from r)"]
    for i in range(rounds):
        parts.append(f"m{i + 1} as materialized (select coalesce(a.node, r.node) as node, 0.85 * coalesce(m, 0.0) + 0.15 * coalesce(r, 0.0) as mass from (select other as node, sum(mass * share) as m from m{i} join flow using (node) group by 1) a full join r on a.node = r.node)")
    return ", ".join(parts) + f" select node, round(mass, 7) as mass from m{rounds}"


@C.query("GRA05", _rank_sql(24))
def gra05(t: Tables) -> DataFrame:
    """Personalised PageRank from the seeds, 24 rounds."""
    return graph.personalised_rank(edges(t), seeds(t)).select("node", F.round("mass", 7).alias("mass"))


@C.query("GRA07", None)
def gra07(t: Tables) -> DataFrame:
    """Communities of the trade graph by label propagation."""
    return graph.communities(edges(t).select("head", "tail", F.col("confidence").alias("weight")))


@C.query("GRA11", "with recursive n as (select distinct s_nationkey as head, c_nationkey as tail from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey), w(a, b) as (select head, tail from n union select a, tail from w join n on head = b) select head, tail from n where (tail, head) in (select (a, b) from w)")
def gra11(t: Tables) -> DataFrame:
    """Trade between nations, over all of lineitem, that closes a cycle of any length."""
    n = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.on_cycles(n.select(F.col("s_nationkey").alias("head"), F.col("c_nationkey").alias("tail")))


@C.query("GRA13", "select d.digest_id, e.memory_id, a.anchor_id, a.session_id from (select distinct digest_id, unnest(sources) as memory_id from memory_digests) d join l2_episodes e using (memory_id) join (select distinct anchor_id, session_id from anchors) a on a.anchor_id = e.anchor_id")
def gra13(t: Tables) -> DataFrame:
    """Provenance: from digests over episodes to the anchors they came from."""
    d = t.memory_digests.select("digest_id", F.explode("sources").alias("memory_id")).distinct()
    a = t.anchors.select("anchor_id", "session_id").distinct()
    return d.join(t.l2_episodes.select("memory_id", "anchor_id"), "memory_id").join(a, "anchor_id").select("digest_id", "memory_id", "anchor_id", "session_id")


_BELIEF = "b as (select 'en_c' || o_custkey as head, o_orderpriority as tail, o_orderdate::timestamp as valid_from, o_orderdate::timestamp + to_days((o_orderkey % 5)::int) as recorded_at, 0.5 + (o_orderkey % 50) / 100.0 as confidence, o_orderkey from orders), iv as (select *, lead(valid_from) over (partition by head order by valid_from, o_orderkey) as valid_to from b)"


def beliefs(t: Tables) -> DataFrame:
    """What each customer prefers, closed by the next preference."""
    b = t.orders.select(
        F.concat(F.lit("en_c"), "o_custkey").alias("head"), F.col("o_orderpriority").alias("tail"), F.col("o_orderdate").cast("timestamp_ntz").alias("valid_from"),
        F.expr("cast(o_orderdate as timestamp_ntz) + make_dt_interval(cast(o_orderkey % 5 as int))").alias("recorded_at"), (0.5 + F.pmod("o_orderkey", F.lit(50)) / 100.0).alias("confidence"), "o_orderkey",
    )
    return b.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("head").orderBy("valid_from", "o_orderkey")))


@C.query("WIN03", f"with {_BELIEF} select o_orderkey, head, strftime(valid_to, '%Y-%m-%d') as valid_to from iv")
def win03(t: Tables) -> DataFrame:
    return beliefs(t).select("o_orderkey", "head", F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"))


@C.query("FLT07", f"with {_BELIEF} select head, tail, o_orderkey from iv where valid_from <= timestamp '1998-02-15' and (valid_to is null or valid_to > timestamp '1998-02-15')")
def flt07(t: Tables) -> DataFrame:
    return beliefs(t).where("valid_from <= timestamp_ntz'1998-02-15' and (valid_to is null or valid_to > timestamp_ntz'1998-02-15')").select("head", "tail", "o_orderkey")


@C.query("JOI07", f"with {_BELIEF} select c_custkey, tail as preferred from customer left join iv on head = 'en_c' || c_custkey and valid_from <= timestamp '1999-06-01' and (valid_to is null or valid_to > timestamp '1999-06-01')")
def joi07(t: Tables) -> DataFrame:
    """As-of join: what each customer preferred at a time."""
    at = beliefs(t).where("valid_from <= timestamp_ntz'1999-06-01' and (valid_to is null or valid_to > timestamp_ntz'1999-06-01')").select("head", F.col("tail").alias("preferred"))
    return t.customer.select("c_custkey", F.concat(F.lit("en_c"), "c_custkey").alias("head")).join(at, "head", "left").select("c_custkey", "preferred")


@C.query("JOI11", f"with {_BELIEF} select a.o_orderkey as key_a, b.o_orderkey as key_b from iv a join iv b on a.head = b.head and a.valid_from = b.valid_from and a.o_orderkey < b.o_orderkey and a.tail <> b.tail")
def joi11(t: Tables) -> DataFrame:
    """Beliefs of one head that claim different tails from the same time on."""
    b = beliefs(t).select("head", "valid_from", "tail", "o_orderkey")
    a = b.select("head", "valid_from", F.col("tail").alias("ta"), F.col("o_orderkey").alias("key_a"))
    c = b.select("head", "valid_from", F.col("tail").alias("tb"), F.col("o_orderkey").alias("key_b"))
    return a.join(c, ["head", "valid_from"]).where("key_a < key_b and ta <> tb").select("key_a", "key_b")


@C.query("TOP09", f"with {_BELIEF} select head, o_orderkey, rn from (select head, o_orderkey, row_number() over (partition by head order by recorded_at, o_orderkey) as rn from b) where rn <= 50")
def top09(t: Tables) -> DataFrame:
    w = Window.partitionBy("head").orderBy("recorded_at", "o_orderkey")
    return beliefs(t).select("head", "o_orderkey", F.row_number().over(w).alias("rn")).where("rn <= 50")
