"""The write path and upkeep of the store: duplicates, entities by name, snapshots, feedback, re-embedding, disclosure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lorevault.functions import text as T
from lorevault.operators import budget, knn
from lorevault.operators.near_rows import most_similar_before
from lorevault.plans.catalog import Catalog, Tables
from lorevault.plans.episodes import _IMP, _RET, _VISIBLE, visible, with_retention
from lorevault.plans.retrieval import _BELIEF, _COS, _VALID, _keywords, beliefs
from lorevault.plans.skills import _SKILLS, matched, skills, _MATCHED

C = Catalog()
queries, oracle_sql = C.queries, C.oracle_sql

_TOKENS = "case when summary is null or summary = '' then 0 else floor(h + (length(summary) - h) / 3.5)::int + 1 end"
_HAN_CLASS = "[^\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{2fa1f}]"


@C.query(
    "WRT01",
    f"""with h as (select ord, project_id, content_key, state, {_TOKENS} as tokens, sha1(lower(trim(regexp_replace(summary, '\\s+', ' ', 'g')))) as sh from (select *, length(regexp_replace(summary, '{_HAN_CLASS}', '', 'g')) as h from l2_episodes)),
k as (select *, case when content_key is not null then min(ord) over (partition by project_id, content_key) else ord end as by_key, max(ord) over (partition by project_id, sh order by ord rows between unbounded preceding and 1 preceding) as by_hash from h),
lv as (select ord, project_id, embedding::double[] as v, row_number() over (partition by project_id order by ord) as place from (select rowid as ord, embedding from vectors where {_VALID}) join h using (ord) where state <> 'archived' and tokens >= 12 and project_id is not null),
nd as (select ord, arg_max(other, (sim, other)) as near from (select b.ord, a.ord as other, round({_COS}, 9) as sim from lv b join lv a on a.project_id = b.project_id and a.place < b.place and a.place >= b.place - 2000) where sim >= 0.95 group by 1)
select ord, case when by_key < ord then by_key when by_hash < ord then by_hash else coalesce(near, ord) end as kept_ord, case when by_key < ord then 'content_key' when by_hash < ord then 'summary_hash' when near is not null then 'near_duplicate' else 'new' end as reason from k left join nd using (ord)""",
)
def wrt01(t: Tables) -> DataFrame:
    """What an episode repeats of its project: by content key, by the hash of the text (the newest), or by a vector of at least 0.95 among the 2000 live rows before it."""
    e = t.l2_episodes.select("ord", "project_id", "content_key", "state", T.estimate_tokens(F.col("summary")).alias("tokens"), T.summary_hash(F.col("summary")).alias("h"))
    by_key = F.when(F.col("content_key").isNotNull(), F.min("ord").over(Window.partitionBy("project_id", "content_key"))).otherwise(F.col("ord"))
    by_hash = F.max("ord").over(Window.partitionBy("project_id", "h").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumns({"by_key": by_key, "by_hash": by_hash})
    usable = t.vectors.where(F.size("embedding") == 64).where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))
    live = e.where("state <> 'archived' and tokens >= 12 and project_id is not null").select("ord", "project_id").join(usable.select(F.col("rowid").alias("ord"), "embedding"), "ord")
    near = most_similar_before(live, "project_id", "ord", "embedding", 2000, 0.95).select(F.col("row").alias("ord"), F.col("before").alias("near"))
    e = e.join(near, "ord", "left")
    kept = F.when(F.col("by_key") < F.col("ord"), F.col("by_key")).when(F.col("by_hash") < F.col("ord"), F.col("by_hash")).otherwise(F.coalesce("near", "ord"))
    reason = F.when(F.col("by_key") < F.col("ord"), "content_key").when(F.col("by_hash") < F.col("ord"), "summary_hash").when(F.col("near").isNotNull(), "near_duplicate").otherwise("new")
    return e.select("ord", kept.alias("kept_ord"), reason.alias("reason"))


# Entities: projects have a type, organisations are things; names of orders of words like theirs are resolved to them.
_ENTITIES = r"""en as (select project_id as entity, 'project' as type, regexp_replace(trim(lower(display_name)), '[\s_]+', ' ', 'g') as name from projects where display_name is not null union all select distinct org_id, 'thing', regexp_replace(trim(lower(org_id)), '[\s_]+', ' ', 'g') from projects where org_id is not null
union all select distinct project_id, 'alias', lower(project_id) from projects),
mn as (select distinct coalesce(project_id, 'none') as mention, case when length(project_id) % 2 = 0 then 'project' else 'thing' end as type from documents union select distinct display_name, 'project' from projects where display_name is not null union select distinct org_id, 'project' from projects where org_id is not null)"""


@C.query("WRT06", f"with {_ENTITIES}, r as (select mention, mn.type, entity, case when en.type = mn.type then 1 when en.type = 'thing' then 2 when en.type <> 'alias' then 3 else 4 end as step from mn join en on en.name = regexp_replace(trim(lower(mention)), '[\\s_]+', ' ', 'g')) select mn.mention, mn.type, coalesce(entity, 'en_' || left(sha1(lower(mn.mention)), 12)) as entity, coalesce(step, 5) as step, coalesce(step = 2 and mn.type <> 'thing', false) as upgraded from mn left join (select mention, type, arg_min(entity, (step, entity)) as entity, min(step) as step from r group by 1, 2) using (mention, type)")
def wrt06(t: Tables) -> DataFrame:
    """Names resolved to entities: by name and type, by name (things first), by alias, else a new one; a thing takes on a declared type."""
    p = t.projects
    e = p.where("display_name is not null").select(F.col("project_id").alias("entity"), F.lit("project").alias("etype"), T.name_key(F.col("display_name")).alias("name"))
    e = e.unionByName(p.where("org_id is not null").select(F.col("org_id").alias("entity"), F.lit("thing").alias("etype"), T.name_key(F.col("org_id")).alias("name")).distinct())
    e = e.unionByName(p.select(F.col("project_id").alias("entity"), F.lit("alias").alias("etype"), F.lower("project_id").alias("name")).distinct())
    kind = F.when(F.pmod(F.length("project_id"), F.lit(2)) == 0, "project").otherwise("thing")
    m = t.documents.select(F.coalesce("project_id", F.lit("none")).alias("mention"), kind.alias("type"))
    m = m.union(p.where("display_name is not null").select("display_name", F.lit("project"))).union(p.where("org_id is not null").select("org_id", F.lit("project"))).distinct()
    step = F.when(F.col("etype") == F.col("type"), 1).when(F.col("etype") == "thing", 2).when(F.col("etype") != "alias", 3).otherwise(4)
    r = m.withColumn("name", T.name_key(F.col("mention"))).join(F.broadcast(e), "name").groupBy("mention", "type").agg(F.min(F.struct(step.alias("step"), "entity")).alias("r"))
    out = m.join(r, ["mention", "type"], "left")
    new = F.concat(F.lit("en_"), F.left(F.sha1(F.lower("mention")), F.lit(12)))
    return out.select("mention", "type", F.coalesce("r.entity", new).alias("entity"), F.coalesce("r.step", F.lit(5)).alias("step"), F.coalesce((F.col("r.step") == 2) & (F.col("type") != "thing"), F.lit(False)).alias("upgraded"))


@C.query("WRT16", "select project_id, h, state, first_ord, n, row_number() over (partition by project_id, state order by first_ord) as version, not h_live as orphaned from (select project_id, lower(summary_hash) as h, state, min(ord) as first_ord, count(*) as n, bool_or(forgotten_at is null) as h_live from l2_episodes where project_id is not null and summary_hash is not null group by 1, 2, 3)")
def wrt16(t: Tables) -> DataFrame:
    """One snapshot of each (project, hash, state), numbered in order; orphaned if every row behind it is forgotten."""
    e = t.l2_episodes.where("project_id is not null and summary_hash is not null")
    g = e.groupBy("project_id", F.lower("summary_hash").alias("h"), "state").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("forgotten_at").isNull()).alias("live"))
    w = Window.partitionBy("project_id", "state").orderBy("first_ord")
    return g.select("project_id", "h", "state", "first_ord", "n", F.row_number().over(w).alias("version"), (~F.col("live")).alias("orphaned"))


@C.query("WRT23", "select anchor_id, coalesce(agent, 'host') || ':' || coalesce(lower(trim(session_id)), '-') as session_key, feedback.status as status, feedback.note as note from (select *, row_number() over (partition by anchor_id order by created_at desc, coalesce(seq, -1) desc, coalesce(quote, '') desc) as rn from anchors where anchor_id is not null) where rn = 1 and feedback.status in ('confirmed', 'stale', 'unresolvable')")
def wrt23(t: Tables) -> DataFrame:
    """The last delivery of each anchor replaces the others; its key and valid feedback."""
    w = Window.partitionBy("anchor_id").orderBy(F.desc("created_at"), F.desc(F.coalesce("seq", F.lit(-1))), F.desc(F.coalesce("quote", F.lit(""))))
    a = t.anchors.where("anchor_id is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1 and feedback.status in ('confirmed', 'stale', 'unresolvable')")
    key = F.concat(F.coalesce("agent", F.lit("host")), F.lit(":"), F.coalesce(F.lower(F.trim("session_id")), F.lit("-")))
    return a.select("anchor_id", key.alias("session_key"), F.col("feedback.status").alias("status"), F.col("feedback.note").alias("note"))


@C.query("STM01", "select anchor_id, seq, case event_type when 'session_start' then 'begin' when 'tool_call' then 'step' when 'tool_result' then 'result' when 'assistant_message' then 'turn_end' when 'user_message' then 'turn_start' end as handler from anchors where event_type in ('session_start', 'tool_call', 'tool_result', 'assistant_message', 'user_message') and session_id is not null")
def stm01(t: Tables) -> DataFrame:
    """Which handler takes each event of a session; others are dropped."""
    e = F.col("event_type")
    handler = F.when(e == "session_start", "begin").when(e == "tool_call", "step").when(e == "tool_result", "result").when(e == "assistant_message", "turn_end").when(e == "user_message", "turn_start")
    return t.anchors.where("session_id is not null").select("anchor_id", "seq", handler.alias("handler")).where("handler is not null")


@C.query("SNK04", "select rowid as vec_rowid, case when embedding is null then 'delete' when len(embedding) <> 64 then 'wrong_dimension' when len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0 then 'not_finite' else 'upsert' end as action from vectors")
def snk04(t: Tables) -> DataFrame:
    """What a vector write does with each row: only vectors of the right dimension and with finite elements get in."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return t.vectors.select(F.col("rowid").alias("vec_rowid"), F.when(F.col("embedding").isNull(), "delete").when(F.size("embedding") != 64, "wrong_dimension").when(bad, "not_finite").otherwise("upsert").alias("action"))


@C.query("AGG09", f"with s as (select project_id, sum(v) as evidence from (select project_id, v, row_number() over (partition by project_id order by v desc) as rn from (select project_id, {_IMP} * (0.5 + 0.5 * {_RET}) as v from l2_episodes where {_VISIBLE})) where rn <= 3 group by 1), c as (select project_id, avg(case when importance is null or isnan(importance) then 0.8 else least(1.0, importance) end) as confidence from l2_episodes group by 1) select p.project_id, round(coalesce(confidence, 0.8) * case when evidence is null then 1.0 else 0.25 + evidence end + 1e-9, 6) as strength from projects p left join s using (project_id) left join c using (project_id)")
def agg09(t: Tables) -> DataFrame:
    """Strength of a belief about each project: its confidence, raised by the three best pieces of evidence by what is retained of them.

    A billionth is added before rounding, as means of two decimals often lie just between two results.
    """
    v = with_retention(visible(t.l2_episodes)).select("project_id", (F.col("imp") * (0.5 + 0.5 * F.col("retention"))).alias("v"))
    w = Window.partitionBy("project_id").orderBy(F.desc("v"))
    s = v.withColumn("rn", F.row_number().over(w)).where("rn <= 3").groupBy("project_id").agg(F.sum("v").alias("evidence"))
    own = F.when(F.col("importance").isNull() | F.isnan("importance"), 0.8).otherwise(F.least(F.lit(1.0), "importance"))
    c = t.l2_episodes.groupBy("project_id").agg(F.avg(own).alias("confidence"))
    out = t.projects.select("project_id").join(s, "project_id", "left").join(c, "project_id", "left")
    return out.select("project_id", F.round(F.coalesce("confidence", F.lit(0.8)) * F.when(F.col("evidence").isNull(), 1.0).otherwise(0.25 + F.col("evidence")) + 1e-9, 6).alias("strength"))


@C.query("SRC04", f"with {_BELIEF} select o_orderkey, head, tail, valid_to is null as is_current, valid_from <= timestamp '1998-02-15' and (valid_to is null or valid_to > timestamp '1998-02-15') as held from iv where head in (select 'en_c' || c_custkey from customer where c_nationkey in (1, 3))")
def src04(t: Tables) -> DataFrame:
    """The edges of some partitions (nations), which are current and which held at a time."""
    scope = t.customer.where("c_nationkey in (1, 3)").select(F.concat(F.lit("en_c"), "c_custkey").alias("head"))
    at = F.lit("1998-02-15").cast("timestamp_ntz")
    held = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
    return beliefs(t).join(scope, "head", "left_semi").select("o_orderkey", "head", "tail", F.col("valid_to").isNull().alias("is_current"), held.alias("held"))


_W = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'))"
_SHARED = f"sh as (select doc_id, project_id, count(*) as n from (select doc_id, unnest({_W.format('title')}) as w from documents) join (select project_id, unnest({_W.format('display_name')}) as w from projects) using (w) group by 1, 2), lx as (select *, row_number() over (partition by doc_id order by n desc, project_id) as place from sh)"


def _words(c: str):
    return F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w")


def named(t: Tables) -> DataFrame:
    """Entities that share words of their name with a title, ordered: doc_id, project_id, n, place."""
    n = t.documents.select("doc_id", _words("title")).join(F.broadcast(t.projects.select("project_id", _words("display_name"))), "w").groupBy("doc_id", "project_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "project_id")))


@C.query("LEX03", f"with {_SHARED} select doc_id, project_id, 0.85 as sim from lx where place <= 8")
def lex03(t: Tables) -> DataFrame:
    """Entities by the words of their name, all with the same similarity; found by equal words."""
    return named(t).where("place <= 8").select("doc_id", "project_id", F.lit(0.85).alias("sim"))


_KEY = r"regexp_replace(trim(lower({0})), '[\s_]+', ' ', 'g')"
_PV = "pv as (select project_id, embedding::double[] as v from (select project_id, row_number() over (order by project_id) - 1 as vec_id from projects) join embeddings using (vec_id))"


@C.query("HYB02", f"""with {_SHARED}, {_PV}, dv as (select doc_id, embedding::double[] as v from documents join vectors on rowid = doc_id where {_VALID}),
st as (select doc_id, projects.project_id, 1 as stage, 0.0 as score from documents join projects on {_KEY.format('title')} = {_KEY.format('display_name')} union all
select doc_id, projects.project_id, 1, 0.0 from (select doc_id, unnest(keywords) as w from {_keywords('documents', 'doc_id', 'title')}) join projects on w = {_KEY.format('display_name')} union all
select doc_id, project_id, 2, n from lx where place <= 5 union all select a.doc_id, b.project_id, 3, round({_COS}, 9) from dv a, pv b where round({_COS}, 9) >= 0.35)
select doc_id, project_id, stage from (select *, row_number() over (partition by doc_id order by stage, score desc, project_id) as rn from (select doc_id, project_id, min(stage) as stage, arg_min(score, stage) as score from st group by 1, 2)) where rn <= 5""")
def hyb02(t: Tables) -> DataFrame:
    """Entities of a title, at most five: by the whole name or a keyword, then by shared words, then by vectors of similarity 0.35 and more."""
    name = t.projects.select("project_id", T.name_key(F.col("display_name")).alias("name")).where("name is not null")
    whole = t.documents.select("doc_id", T.name_key(F.col("title")).alias("name")).join(F.broadcast(name), "name")
    kw = T.keywords(t.documents, "doc_id", "title").select("doc_id", F.explode("keywords").alias("name")).join(F.broadcast(name), "name")
    one = whole.select("doc_id", "project_id").unionByName(kw.select("doc_id", "project_id")).select("doc_id", "project_id", F.lit(1).alias("stage"), F.lit(0.0).alias("score"))
    two = named(t).where("place <= 5").select("doc_id", "project_id", F.lit(2).alias("stage"), F.col("n").cast("double").alias("score"))
    v = t.projects.select("project_id", (F.row_number().over(Window.orderBy("project_id")) - 1).alias("vec_id")).join(t.embeddings.select("vec_id", "embedding"), "vec_id")
    d = t.vectors.select(F.col("rowid").alias("doc_id"), "embedding").join(t.documents.select("doc_id"), "doc_id")
    near = knn.within(d, "doc_id", "embedding", v, "project_id", "embedding", 0.35)
    three = near.select(F.col("doc").alias("doc_id"), F.col("query").alias("project_id"), F.lit(3).alias("stage"), F.col("similarity").alias("score"))
    best = one.unionByName(two).unionByName(three).groupBy("doc_id", "project_id").agg(F.min(F.struct("stage", F.col("score"))).alias("s"))
    w = Window.partitionBy("doc_id").orderBy("s.stage", F.desc("s.score"), "project_id")
    return best.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("doc_id", "project_id", F.col("s.stage").alias("stage"))


@C.query("FLT13", "select anchor_id, seq from anchors where list_contains(keywords, (select min(k) from (select unnest(keywords) as k from anchors)))")
def flt13(t: Tables) -> DataFrame:
    """Exact members of a list of names: here the first keyword of all."""
    first = t.anchors.select(F.explode("keywords").alias("k")).agg(F.min("k").alias("k"))
    return t.anchors.crossJoin(F.broadcast(first)).where(F.array_contains("keywords", F.col("k"))).select("anchor_id", "seq")


@C.query("JOI05", "select distinct anchor_id from anchors where anchor_id is not null and anchor_id not in (select anchor_id from l2_episodes where anchor_id is not null)")
def joi05(t: Tables) -> DataFrame:
    """Anchors that no episode came from."""
    return t.anchors.where("anchor_id is not null").select("anchor_id").join(t.l2_episodes.select("anchor_id"), "anchor_id", "left_anti").distinct()


@C.query("STR21", f"with {_SKILLS} select doc_id, '- ' || name || ' [' || scope_kind || case when hard then ', hard' else '' end || ']: ' || array_to_string(tools, ', ') as line from sk")
def str21(t: Tables) -> DataFrame:
    """The index line of each skill."""
    return skills(t).select("doc_id", _line().alias("line"))


def _line():
    return F.concat(F.lit("- "), "name", F.lit(" ["), "scope_kind", F.when(F.col("hard"), ", hard").otherwise(""), F.lit("]: "), F.array_join("tools", ", "))


@C.query("BUD03", f"{_MATCHED}, ln as (select request, doc_id, place, '- ' || name || ' [' || scope_kind || case when hard then ', hard' else '' end || ']: ' || array_to_string(tools, ', ') as line from m join sk using (doc_id) where place <= 12), cs as (select *, floor(length(line) / 3.5)::int + 1 as cost, 4 * (floor(length(line) / 3.5)::int + 1) as detail from ln where not regexp_matches(line, '[\\x{{3400}}-\\x{{9fff}}]')), od as (select request, doc_id, level, rank, cost from (select request, doc_id, 'index' as level, place as rank, cost from cs union all select request, doc_id, 'detail', place + 100, detail from cs where place <= 2)) select request, doc_id, level from (select *, sum(cost) over (partition by request order by rank) as used from od) where used <= 330")
def bud03(t: Tables) -> DataFrame:
    """What a turn discloses within its ceiling: the index lines of the matches in order, then the details of the first two; details leave first, from the last, then lines."""
    m = matched(t).where("place <= 12").select("request", "doc_id", "place").join(skills(t), "doc_id").select("request", "doc_id", "place", _line().alias("line")).where(~F.col("line").rlike(r"[\x{3400}-\x{9fff}]"))
    cost = T.estimate_tokens(F.col("line"))
    rows = m.select("request", "doc_id", F.lit("index").alias("level"), F.col("place").alias("rank"), cost.alias("cost"))
    rows = rows.unionByName(m.where("place <= 2").select("request", "doc_id", F.lit("detail").alias("level"), (F.col("place") + 100).alias("rank"), (4 * cost).alias("cost")))
    # What leaves last comes first, so what stays is a running sum.
    return budget.prefix(rows, "cost", 330, ["request"], F.lit(0), [F.col("rank")]).select("request", "doc_id", "level")


@C.query("WRT11", "select e.memory_id, 'ch_' || left(sha1(e.memory_id || '|' || coalesce(e.outcome, '')), 12) as change_id, coalesce(e.superseded_by, e.memory_id) as evidence from l2_episodes e where e.project_id is not null")
def wrt11(t: Tables) -> DataFrame:
    """An episode and its fact as one change; without other evidence the fact rests on the episode itself."""
    e = t.l2_episodes.where("project_id is not null")
    return e.select("memory_id", F.concat(F.lit("ch_"), F.left(F.sha1(F.concat("memory_id", F.lit("|"), F.coalesce("outcome", F.lit("")))), F.lit(12))).alias("change_id"), F.coalesce("superseded_by", "memory_id").alias("evidence"))


@C.query("WRT20", """with d as (select * from (select *, row_number() over (partition by scope_ref order by created_at desc, digest_id) as rn from memory_digests where scope_ref is not null) where rn = 1),
s as (select project_id, count(*) as n_sources, left(sha1(string_agg(memory_id, '|' order by memory_id)), 16) as plan from (select project_id, memory_id, row_number() over (partition by project_id order by created_at desc, memory_id) as rn from l2_episodes where forgotten_at is null and superseded_by is null and project_id is not null) where rn <= 160 group by 1)
select project_id, n_sources, plan, least(200000, greatest(20000, 8 * coalesce(requested_chars, 800))) as budget, case when content is null or trim(content) = '' then 'empty' when error is not null then 'error' else 'ok' end as commit_status from s left join d on scope_ref = project_id""")
def wrt20(t: Tables) -> DataFrame:
    """The plan of each project's next digest: its newest 160 sources, their hash, the budget of characters; and what the last one came to."""
    w = Window.partitionBy("project_id").orderBy(F.desc("created_at"), "memory_id")
    e = visible(t.l2_episodes.where("project_id is not null")).select("project_id", "memory_id", "created_at").withColumn("rn", F.row_number().over(w)).where("rn <= 160")
    s = e.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_sources"), F.left(F.sha1(F.array_join(F.array_sort(F.collect_list("memory_id")), "|")), F.lit(16)).alias("plan"))
    last = Window.partitionBy("scope_ref").orderBy(F.desc("created_at"), "digest_id")
    d = t.memory_digests.where("scope_ref is not null").withColumn("rn", F.row_number().over(last)).where("rn = 1").select(F.col("scope_ref").alias("project_id"), "requested_chars", "content", "error")
    status = F.when(F.col("content").isNull() | (F.trim("content") == ""), "empty").when(F.col("error").isNotNull(), "error").otherwise("ok")
    budget_ = F.least(F.lit(200_000), F.greatest(F.lit(20_000), 8 * F.coalesce("requested_chars", F.lit(800))))
    return s.join(d, "project_id", "left").select("project_id", "n_sources", "plan", budget_.alias("budget"), status.alias("commit_status"))
