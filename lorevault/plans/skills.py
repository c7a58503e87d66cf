"""Skills: matching, tiers and precedence, over the skill cards among the documents; requests are the newest episodes of the projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorevault.functions import text as T
from lorevault.operators import knn
from lorevault.plans.catalog import Catalog, Tables
from lorevault.plans.retrieval import _COS, _VALID, _keywords

C = Catalog()
queries, oracle_sql = C.queries, C.oracle_sql

# Fixed values of matching: weights of intent, prerequisites, meaning and success; least score; most matches; least meaning without an intent.
WEIGHTS = 0.4, 0.3, 0.2, 0.1
LEAST_SCORE, MATCHES, LEAST_MEANING = 0.25, 12, 0.35
#: Tools a request has at hand.
AT_HAND = ["apply_patch", "fetch_page", "list_dir", "read_file", "write_note"]
_TOOL = "apply_patch|edit_file|fetch_page|grep_tree|list_dir|open_ticket|query_store|read_file|run_terminal|write_note"

_SKILLS = f"""sk as (select doc_id, lower(title) as name, case when project_id is null then 'sys' when n_chars % 3 = 0 then 'org' else 'project' end as scope_kind, case when project_id is null then 1 when n_chars % 3 = 0 then 2 else 3 end as scope_rank, n_chars % 5 = 0 as hard,
list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) as labels, regexp_extract(lower(title), '([\\p{{L}}\\p{{N}}]+)[^\\p{{L}}\\p{{N}}]*$', 1) as trigger_word, list_sort(list_distinct(regexp_extract_all(text, '{_TOOL}'))) as tools, collected_at
from documents where replace(replace(lower(trim(source)), ' ', '_'), '-', '_') in ('skill_cards', 'design_docs', 'work_logs') and title is not null)"""


def skills(t: Tables) -> DataFrame:
    """doc_id, name, scope (a document without project is of the system), hard, labels, trigger_word, tools it needs."""
    d = t.documents.where(T.relation_key(F.col("source")).isin("skill_cards", "design_docs", "work_logs") & F.col("title").isNotNull())
    title = F.lower("title")
    org = F.pmod("n_chars", F.lit(3)) == 0
    return d.select(
        "doc_id",
        title.alias("name"),
        F.when(F.col("project_id").isNull(), "sys").when(org, "org").otherwise("project").alias("scope_kind"),
        F.when(F.col("project_id").isNull(), 1).when(org, 2).otherwise(3).alias("scope_rank"),
        (F.pmod("n_chars", F.lit(5)) == 0).alias("hard"),
        F.array_distinct(F.regexp_extract_all(title, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("labels"),
        F.regexp_extract(title, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1).alias("trigger_word"),
        F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({_TOOL})"), F.lit(1)))).alias("tools"),
        "collected_at",
    )


_REQUESTS = """rq as (select project_id as request, ord, summary, regexp_extract(lower(display_name), '([\\p{L}\\p{N}]+)[^\\p{L}\\p{N}]*$', 1) as label from (select *, row_number() over (partition by project_id order by created_at desc, ord desc) as rn from l2_episodes where project_id is not null and summary is not null) join projects using (project_id) where rn = 1)"""


def requests(t: Tables) -> DataFrame:
    """The newest episode of each project, with the last word of its name as the wanted intent: request, ord, summary, label."""
    w = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("ord"))
    e = t.l2_episodes.where("project_id is not null and summary is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("project_id", "ord", "summary")
    p = t.projects.select("project_id", F.regexp_extract(F.lower("display_name"), r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1).alias("label"))
    return e.join(p, "project_id").select(F.col("project_id").alias("request"), "ord", "summary", "label")


_INTENT = f"""{_SKILLS}, {_REQUESTS}, lab as (select request, doc_id, 1.0 as intent from rq join (select doc_id, unnest(labels) as l from sk) on l = label),
rw as (select request, unnest(list_distinct(regexp_extract_all(lower(summary), '[\\p{{L}}\\p{{N}}]+'))) as w from rq), trg as (select request, doc_id, least(1.0, 0.8 + 0.1 * count(*)) as intent from rw join sk on w = trigger_word group by 1, 2),
kws as (select request, unnest(keywords) as w from {_keywords('rq', 'request', 'summary', 16)}), kw as (select distinct request, doc_id, 0.6 as intent from kws join (select doc_id, unnest(labels) as w from sk) using (w)),
it as (select request, doc_id, max(intent) as intent from (select * from lab union all select * from trg union all select * from kw where (request, doc_id) not in (select (request, doc_id) from trg)) group by 1, 2)"""


def intents(t: Tables) -> DataFrame:
    """How well a skill's purpose meets a request: 1 for a wanted label, 0.8 and more for triggers, 0.6 for a keyword: request, doc_id, intent."""
    s, r = skills(t), requests(t)
    label = s.select("doc_id", F.explode("labels").alias("w"))
    wanted = r.select("request", F.col("label").alias("w")).join(label, "w").select("request", "doc_id", F.lit(1.0).alias("intent"))
    words = r.select("request", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("summary"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w"))
    triggered = words.join(s.select("doc_id", F.col("trigger_word").alias("w")), "w").groupBy("request", "doc_id").agg(F.least(F.lit(1.0), 0.8 + 0.1 * F.count(F.lit(1))).alias("intent"))
    kw = T.keywords(r, "request", "summary", 16).select("request", F.explode("keywords").alias("w")).join(label, "w").select("request", "doc_id").distinct()
    kw = kw.join(triggered, ["request", "doc_id"], "left_anti").select("request", "doc_id", F.lit(0.6).alias("intent"))
    return wanted.unionByName(triggered).unionByName(kw).groupBy("request", "doc_id").agg(F.max("intent").alias("intent"))


@C.query("MAT01", f"with {_INTENT} select request, doc_id, round(intent, 6) as intent from it")
def mat01(t: Tables) -> DataFrame:
    return intents(t).select("request", "doc_id", F.round("intent", 6).alias("intent"))


_HAND = "['" + "', '".join(AT_HAND) + "']"


def prerequisites() -> Column:
    """Share of the needed tools that are at hand; 1 if none is needed."""
    hand = F.array(*map(F.lit, AT_HAND))
    return F.when(F.size("tools") == 0, 1.0).otherwise(F.size(F.array_intersect("tools", hand)) / F.size("tools"))


@C.query("MAT02", f"with {_SKILLS} select doc_id, round(p, 6) as prereq, case when p < 0.5 then 0.45 else 1.0 end as factor from (select doc_id, case when len(tools) = 0 then 1.0 else len(list_intersect(tools, {_HAND})) / len(tools) end as p from sk)")
def mat02(t: Tables) -> DataFrame:
    p = prerequisites()
    return skills(t).select("doc_id", F.round(p, 6).alias("prereq"), F.when(p < 0.5, 0.45).otherwise(1.0).alias("factor"))


_MEANING = f"""sv as (select doc_id, embedding::double[] as v from sk join vectors on rowid = doc_id where {_VALID}), rv as (select request, embedding::double[] as v from rq join vectors on rowid = ord where {_VALID}),
mn as (select b.request, a.doc_id, round({_COS}, 9) as meaning from sv a, rv b)"""


def _skill_vectors(t: Tables) -> DataFrame:
    return t.vectors.select(F.col("rowid").alias("doc_id"), "embedding").join(skills(t).select("doc_id"), "doc_id")


def _request_vectors(t: Tables) -> DataFrame:
    return t.vectors.join(requests(t).select("request", F.col("ord").alias("rowid")), "rowid").select("request", "embedding")


def meanings(t: Tables) -> DataFrame:
    """Cosine similarity of every skill that is scored and each request, where positive: request, doc_id, meaning."""
    near = knn.within(_skill_vectors(t), "doc_id", "embedding", _request_vectors(t), "request", "embedding", 1e-9)
    return near.select(F.col("query").alias("request"), F.col("doc").alias("doc_id"), F.col("similarity").alias("meaning"))


@C.query("MAT05", f"with {_SKILLS}, {_REQUESTS}, {_MEANING} select request, doc_id, round(meaning, 6) as meaning from mn where meaning >= 1e-9")
def mat05(t: Tables) -> DataFrame:
    """Candidates are scored directly, so that no other skill crowds them out."""
    return meanings(t).select("request", "doc_id", F.round("meaning", 6).alias("meaning"))


@C.query("MAT06", f"with {_SKILLS}, {_REQUESTS}, {_MEANING} select request, doc_id, place, round(meaning, 6) as meaning from (select *, row_number() over (partition by request order by meaning desc, doc_id) as place from mn join sk using (doc_id) where scope_kind = 'project') where place <= 5")
def mat06(t: Tables) -> DataFrame:
    """The five most similar skills of projects: the scope first, then the ranking."""
    v = _skill_vectors(t).join(skills(t).where("scope_kind = 'project'").select("doc_id"), "doc_id", "left_semi")
    near = knn.nearest(v, "doc_id", "embedding", _request_vectors(t), "request", "embedding", 5)
    return near.select(F.col("query").alias("request"), F.col("doc").alias("doc_id"), "place", F.round("similarity", 6).alias("meaning"))


_RATES = "rt as (select user_id, (count(*) filter (event_type <> 'error') + 1) / (count(*) + 2) as rate from events group by 1)"
_MATCHED = f"""with {_INTENT}, {_MEANING}, {_RATES}, c as (select request, doc_id from it union select request, doc_id from mn where meaning >= {LEAST_MEANING}),
x as (select c.request, c.doc_id, scope_rank, coalesce(intent, 0.0) as intent, case when len(tools) = 0 then 1.0 else len(list_intersect(tools, {_HAND})) / len(tools) end as prereq, coalesce(greatest(meaning, 0.0), 0.0) as near, coalesce(rate, 0.5) as rate
  from c join sk on sk.doc_id = c.doc_id left join it on it.request = c.request and it.doc_id = c.doc_id left join mn on mn.request = c.request and mn.doc_id = c.doc_id left join rt on rt.user_id = c.doc_id % 150),
y as (select *, case when intent > 0 or prereq >= 1 then near else 0.0 end as semantic from x),
z as (select *, round((0.4 * intent + 0.3 * prereq + 0.2 * semantic + 0.1 * rate) * case when prereq < 0.5 then 0.45 else 1.0 end, 9) as score from y where intent > 0 or semantic >= {LEAST_MEANING}),
m as (select *, row_number() over (partition by request order by score desc, scope_rank desc, doc_id) as place from z where score >= {LEAST_SCORE})"""


def matched(t: Tables) -> DataFrame:
    """Score of every skill that meets a request by its intent or its meaning."""
    keys = ["request", "doc_id"]
    i, m = intents(t), meanings(t)
    rate = t.events.groupBy("user_id").agg(((F.count_if(F.col("event_type") != "error") + 1) / (F.count(F.lit(1)) + 2)).alias("rate"))
    c = i.join(m, keys, "full").where(F.col("intent").isNotNull() | (F.col("meaning") >= LEAST_MEANING))
    x = c.join(skills(t).select("doc_id", "scope_rank", prerequisites().alias("prereq"), F.pmod("doc_id", F.lit(150)).alias("user_id")), "doc_id").join(F.broadcast(rate), "user_id", "left")
    x = x.fillna({"intent": 0.0, "meaning": 0.0, "rate": 0.5})
    # The meaning counts only where the intent or all prerequisites are met.
    x = x.withColumn("semantic", F.when((F.col("intent") > 0) | (F.col("prereq") >= 1), F.col("meaning")).otherwise(0.0)).where((F.col("intent") > 0) | (F.col("semantic") >= LEAST_MEANING))
    a, b, c4, d = WEIGHTS
    score = (a * F.col("intent") + b * F.col("prereq") + c4 * F.col("semantic") + d * F.col("rate")) * F.when(F.col("prereq") < 0.5, 0.45).otherwise(1.0)
    x = x.withColumn("score", F.round(score, 9)).where(F.col("score") >= LEAST_SCORE)
    w = Window.partitionBy("request").orderBy(F.desc("score"), F.desc("scope_rank"), "doc_id")
    return x.withColumn("place", F.row_number().over(w))


@C.query("MAT03", f"{_MATCHED} select request, doc_id, round(semantic, 6) as semantic from z where semantic > 0")
def mat03(t: Tables) -> DataFrame:
    """The part of the meaning in a score; none for skills that meet neither intent nor prerequisites."""
    i, m = intents(t), meanings(t)
    x = m.join(i, ["request", "doc_id"], "left").join(skills(t).select("doc_id", prerequisites().alias("prereq")), "doc_id")
    x = x.where(F.col("intent").isNotNull() | ((F.col("prereq") >= 1) & (F.col("meaning") >= LEAST_MEANING)))
    return x.select("request", "doc_id", F.round("meaning", 6).alias("semantic"))


@C.query("MAT04", f"{_MATCHED} select request, doc_id, round(score, 6) as score from m where place <= {MATCHES}")
def mat04(t: Tables) -> DataFrame:
    """The best twelve skills of each request."""
    return matched(t).where(F.col("place") <= MATCHES).select("request", "doc_id", F.round("score", 6).alias("score"))


@C.query("TOP08", f"{_MATCHED} select request, doc_id, scope_rank, place from m where place <= {MATCHES}")
def top08(t: Tables) -> DataFrame:
    """The order of matches: score, then the narrower scope."""
    return matched(t).where(F.col("place") <= MATCHES).select("request", "doc_id", "scope_rank", "place")


_USAGE = "us as (select user_id, count(*) as used from events where ts >= timestamp '2024-01-15' group by 1)"


@C.query("WIN06", f"with {_SKILLS}, {_USAGE}, o as (select doc_id, hard, scope_kind, coalesce(used, 0) as used, row_number() over (order by coalesce(used, 0) desc, scope_rank desc, name, doc_id) as place from sk left join us on user_id = doc_id % 150) select doc_id, case when place <= 20 and used >= 3 then 'hot' when used >= 1 or scope_kind <> 'sys' or hard then 'warm' else 'cold' end as tier from o")
def win06(t: Tables) -> DataFrame:
    """Hot: the 20 skills used most in the last days, with three uses at least; cold: unused ones of the system that aren't hard.

    As the order is by use, the first 20 are the first 20 with enough use.
    """
    used = t.events.where("ts >= timestamp_ntz'2024-01-15'").groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))
    s = skills(t).withColumn("user_id", F.pmod("doc_id", F.lit(150))).join(F.broadcast(used), "user_id", "left").fillna({"used": 0})
    top = s.where("used >= 3").orderBy(F.desc("used"), F.desc("scope_rank"), "name", "doc_id").limit(20).select("doc_id", F.lit(True).alias("top"))
    tier = F.when(F.col("top"), "hot").when((F.col("used") >= 1) | (F.col("scope_kind") != "sys") | F.col("hard"), "warm").otherwise("cold")
    return s.join(F.broadcast(top), "doc_id", "left").select("doc_id", tier.alias("tier"))


@C.query("WIN07", f"with {_SKILLS} select name, doc_id, scope_kind from (select *, row_number() over (partition by name order by (hard and scope_kind = 'sys') desc, scope_rank desc, doc_id) as rn from sk) where rn = 1")
def win07(t: Tables) -> DataFrame:
    """One skill of each name: a hard one of the system before all, then project, organisation, system."""
    w = Window.partitionBy("name").orderBy(F.desc(F.col("hard") & (F.col("scope_kind") == "sys")), F.desc("scope_rank"), "doc_id")
    return skills(t).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("name", "doc_id", "scope_kind")


_KNN = f"""{_SKILLS}, {_REQUESTS}, {_MEANING}, near as (select *, row_number() over (partition by request order by meaning desc, doc_id) as place from mn)"""


@C.query("JOI08", f"with {_KNN} select request, doc_id, place from near where place <= 10")
def joi08(t: Tables) -> DataFrame:
    """Each request with its ten nearest skills."""
    near = knn.nearest(_skill_vectors(t), "doc_id", "embedding", _request_vectors(t), "request", "embedding", 10)
    return near.select(F.col("query").alias("request"), F.col("doc").alias("doc_id"), "place")


@C.query("WRT17", f"with {_KNN} select request, doc_id, case when meaning > 0.85 then 'reference' when meaning >= 0.6 then 'similar' else 'new' end as verdict from rq left join near using (request) where place = 1 or place is null")
def wrt17(t: Tables) -> DataFrame:
    """Whether a request repeats a known skill, resembles one or is new, by the nearest one."""
    near = knn.nearest(_skill_vectors(t), "doc_id", "embedding", _request_vectors(t), "request", "embedding", 1)
    s = F.col("similarity")
    out = requests(t).select("request").join(near.withColumnRenamed("query", "request"), "request", "left")
    return out.select("request", F.col("doc").alias("doc_id"), F.when(s > 0.85, "reference").when(s >= 0.6, "similar").otherwise("new").alias("verdict"))


@C.query("WRT19", f"with {_SKILLS}, lr as (select user_id, max(ts) as last_run from events group by 1) select doc_id, last_run is null as never_run from sk left join lr on user_id = doc_id % 400 where (last_run is null or last_run < timestamp '2024-01-30') and collected_at < timestamptz '2026-03-01 00:00:00+00'")
def wrt19(t: Tables) -> DataFrame:
    """Skills to retire: never run or not lately, and not changed lately."""
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last_run"))
    s = skills(t).withColumn("user_id", F.pmod("doc_id", F.lit(400))).join(F.broadcast(last), "user_id", "left")
    return s.where("(last_run is null or last_run < timestamp_ntz'2024-01-30') and collected_at < timestamp'2026-03-01 00:00:00'").select("doc_id", F.col("last_run").isNull().alias("never_run"))


@C.query("WRT15", "select event_id, n_last, rate, n_last = 10 and rate < 0.5 as retired from (select event_id, count(*) over w as n_last, round(avg((event_type not in ('error', 'view', 'click'))::int) over w, 6) as rate from events window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row))")
def wrt15(t: Tables) -> DataFrame:
    """After each recorded run: the rate of the last ten, and whether it retires the skill."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    n, rate = F.count(F.lit(1)).over(w), F.avg((~F.col("event_type").isin("error", "view", "click")).cast("int")).over(w)
    return t.events.select("event_id", n.alias("n_last"), F.round(rate, 6).alias("rate"), ((n == 10) & (F.round(rate, 6) < 0.5)).alias("retired"))


@C.query("AGG04", "select coalesce(status, 'none') as status, coalesce(generator, 'restored') as generator, count(*) as n from memory_digests group by 1, 2")
def agg04(t: Tables) -> DataFrame:
    """Counts by status and origin."""
    return t.memory_digests.groupBy(F.coalesce("status", F.lit("none")).alias("status"), F.coalesce("generator", F.lit("restored")).alias("generator")).agg(F.count(F.lit(1)).alias("n"))


_CHECKS = """array_to_string(list_filter([case when title is null or length(trim(title)) = 0 then 'title' end, case when length(title) > 30 then 'long_title' end, case when len(tools) not between 1 and 40 then 'steps' end, case when n_chars % 5 = 0 and not contains(lower(coalesce(text, '')), 'use it when') then 'criteria' end], lambda x: x is not null), ',')"""


@C.query("MAT08", f"select doc_id, {_CHECKS} as failed from (select *, regexp_extract_all(coalesce(text, ''), '{_TOOL}') as tools from documents where replace(replace(lower(trim(source)), ' ', '_'), '-', '_') = 'skill_cards')")
def mat08(t: Tables) -> DataFrame:
    """The rules that a skill card breaks: a title of at most 30 characters, 1 to 40 steps, criteria if it is hard."""
    d = t.documents.where(T.relation_key(F.col("source")) == "skill_cards")
    steps = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({_TOOL})"), F.lit(1)))
    checks = [
        F.when(F.col("title").isNull() | (F.length(F.trim("title")) == 0), "title"),
        F.when(F.length("title") > 30, "long_title"),
        F.when(~steps.between(1, 40), "steps"),
        F.when((F.pmod("n_chars", F.lit(5)) == 0) & ~F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("use it when")), "criteria"),
    ]
    return d.select("doc_id", F.array_join(F.array_compact(F.array(*checks)), ",").alias("failed"))
