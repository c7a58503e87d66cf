"""Scans, filters, projections, joins, aggregates, windows and top-k over episodes, anchors and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorevault.functions import decay
from lorevault.operators import graph
from lorevault.plans.catalog import Catalog, Tables

C = Catalog()
queries, oracle_sql = C.queries, C.oracle_sql

#: The clock of the queries.
NOW = "2026-04-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")



_NOW = f"timestamptz '{NOW}+00'"
_LAST = "coalesce(last_access, created_at)"
_IMP = "case when importance is null or isnan(importance) then 0.5 else least(1.0, greatest(0.05, importance)) end"
_STAB = f"24.0 * greatest({_IMP}, 1e-6) * (1 + 0.5 * ln(1 + greatest(access_count, 0)))"
_RET = f"exp(-greatest(0.0, (epoch_us({_NOW}) - epoch_us({_LAST})) / 3.6e9) / ({_STAB}))"
_STATE = f"case when {_RET} >= 0.30 then 'active' when {_RET} >= 0.05 then 'dormant' else 'archived' end"
_VISIBLE = "forgotten_at is null and superseded_by is null"


def with_retention(e: DataFrame) -> DataFrame:
    imp = decay.importance(F.col("importance"))
    r = decay.retention(imp, F.col("access_count"), F.coalesce("last_access", "created_at"), now())
    return e.withColumns({"imp": imp, "retention": r}).withColumn("live_state", decay.state(F.col("retention")))


def visible(e: DataFrame) -> DataFrame:
    return e.where("forgotten_at is null and superseded_by is null")


@C.query("SRC01", "select memory_id, project_id, event_type, importance, access_count from l2_episodes")
def src01(t: Tables) -> DataFrame:
    return t.l2_episodes.select("memory_id", "project_id", "event_type", "importance", "access_count")


@C.query("SRC02", "select memory_id, ord from l2_episodes where memory_id in (select superseded_by from l2_episodes)")
def src02(t: Tables) -> DataFrame:
    e = t.l2_episodes
    wanted = e.where("superseded_by is not null").select(F.col("superseded_by").alias("memory_id"))
    return e.select("memory_id", "ord").join(wanted, "memory_id", "left_semi")


@C.query("SRC03", "select rowid as vec_rowid, memory_id from vectors join l2_episodes on ord = rowid where embedding is not null")
def src03(t: Tables) -> DataFrame:
    v = t.vectors.where("embedding is not null").select(F.col("rowid").alias("vec_rowid"))
    return v.join(t.l2_episodes.select("ord", "memory_id"), F.col("ord") == F.col("vec_rowid")).select("vec_rowid", "memory_id")


_LAST_ANCHOR = "select * from (select *, row_number() over (partition by anchor_id order by created_at desc, event_ts desc, seq desc, quote desc) as rn from anchors where anchor_id is not null) where rn = 1"


def last_anchor(t: Tables, *columns: str) -> DataFrame:
    """The last delivery of every anchor; a redelivered row replaces the earlier one."""
    order = [F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) if c == "quote" else F.col(c) for c in ("created_at", "event_ts", "seq", "quote")])]
    return t.anchors.where("anchor_id is not null").groupBy("anchor_id").agg(*[F.max_by(c, order[0]).alias(c) for c in columns])


@C.query("SNK03", "select anchor_id, seq, event_type, epoch_us(created_at) as created_us from (" + _LAST_ANCHOR.replace("seq desc, quote desc", "coalesce(seq, -1) desc, coalesce(quote, '') desc") + ")")
def snk03(t: Tables) -> DataFrame:
    key = F.struct(F.col("created_at"), F.col("event_ts"), F.coalesce("seq", F.lit(-1)), F.coalesce("quote", F.lit("")))
    return t.anchors.where("anchor_id is not null").groupBy("anchor_id").agg(F.max_by(F.struct("seq", "event_type", "created_at"), key).alias("m")).select("anchor_id", "m.seq", "m.event_type", F.unix_micros("m.created_at").alias("created_us"))


@C.query("SRC13", "select session_key, max(seq) as latest_seq, count(*) as n_anchors, arg_max(anchor_id, (seq, anchor_id)) as latest_anchor from anchors where session_key is not null and seq is not null group by session_key")
def src13(t: Tables) -> DataFrame:
    a = t.anchors.where("session_key is not null and seq is not null")
    return a.groupBy("session_key").agg(F.max("seq").alias("latest_seq"), F.count(F.lit(1)).alias("n_anchors"), F.max_by("anchor_id", F.struct("seq", "anchor_id")).alias("latest_anchor"))


@C.query(
    "SNK02",
    """with seen as (select project_id, min(created_at) as first_seen, max(created_at) as last_seen from l2_episodes where project_id is not null group by 1)
select coalesce(p.project_id, s.project_id) as project_id, display_name, org_id, epoch_us(least(p.created_at, s.first_seen)) as created_us, epoch_us(greatest(p.last_seen_at, s.last_seen)) as seen_us
from projects p full join seen s on p.project_id = s.project_id""",
)
def snk02(t: Tables) -> DataFrame:
    seen = t.l2_episodes.where("project_id is not null").groupBy("project_id").agg(F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    return t.projects.join(seen, "project_id", "full").select("project_id", "display_name", "org_id", F.unix_micros(F.least("created_at", "first_seen")).alias("created_us"), F.unix_micros(F.greatest("last_seen_at", "last_seen")).alias("seen_us"))


@C.query(
    "SNK05",
    """with w as (select distinct project_id, strftime(created_at, '%Y-%m-%d') as day from l2_episodes where forgotten_at is null), h as (select distinct project_id, strftime(updated_at, '%Y-%m-%d') as day from l2_episodes)
select coalesce(w.project_id, h.project_id) as project_id, coalesce(w.day, h.day) as day, case when h.day is null then 'create' when w.day is null then 'delete' else 'keep' end as action
from w full join h on w.project_id = h.project_id and w.day = h.day""",
)
def snk05(t: Tables) -> DataFrame:
    e = t.l2_episodes
    w = e.where("forgotten_at is null").select("project_id", F.date_format("created_at", "yyyy-MM-dd").alias("day")).distinct().withColumn("wanted", F.lit(True))
    h = e.select("project_id", F.date_format("updated_at", "yyyy-MM-dd").alias("day")).distinct().withColumn("there", F.lit(True))
    return w.join(h, ["project_id", "day"], "full").select("project_id", "day", F.when(F.col("there").isNull(), "create").when(F.col("wanted").isNull(), "delete").otherwise("keep").alias("action"))


@C.query(
    "SNK06",
    f"""with r as (select project_id, strftime(created_at, '%Y-%m-%d') as day, strftime(created_at, '%H:%M') as hm, summary, ord, row_number() over (partition by project_id, strftime(created_at, '%Y-%m-%d') order by created_at desc, ord desc) as rn from l2_episodes where {_VISIBLE})
select project_id, day, count(*) as n_entries, string_agg('- ' || hm || ' ' || coalesce(summary, ''), chr(10) order by rn) as body from r where rn <= 300 group by 1, 2""",
)
def snk06(t: Tables) -> DataFrame:
    day = F.date_format("created_at", "yyyy-MM-dd")
    w = Window.partitionBy("project_id", "day").orderBy(F.desc("created_at"), F.desc("ord"))
    r = visible(t.l2_episodes).select("project_id", day.alias("day"), "created_at", "summary", "ord").withColumn("rn", F.row_number().over(w)).where("rn <= 300")
    line = F.concat(F.lit("- "), F.date_format("created_at", "HH:mm"), F.lit(" "), F.coalesce("summary", F.lit("")))
    return r.groupBy("project_id", "day").agg(F.count(F.lit(1)).alias("n_entries"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))


@C.query("SNK10", f"select project_id, memory_id, rn as place from (select project_id, memory_id, row_number() over (partition by project_id order by created_at desc, ord desc) as rn from l2_episodes where {_VISIBLE}) where rn <= 500")
def snk10(t: Tables) -> DataFrame:
    w = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("ord"))
    return visible(t.l2_episodes).select("project_id", "memory_id", "created_at", "ord").withColumn("place", F.row_number().over(w)).where("place <= 500").select("project_id", "memory_id", "place")


@C.query("FLT01", "select memory_id, ord from l2_episodes where project_id in (select project_id from projects where org_id = 'org-mill')")
def flt01(t: Tables) -> DataFrame:
    return t.l2_episodes.select("memory_id", "ord", "project_id").join(t.projects.where("org_id = 'org-mill'").select("project_id"), "project_id", "left_semi").select("memory_id", "ord")


@C.query("FLT02", "select memory_id from l2_episodes e left join projects p on e.project_id = p.project_id where e.project_id = 'proj-havalor' or p.org_id = 'org-mill' or e.event_type = 'preference'")
def flt02(t: Tables) -> DataFrame:
    e = t.l2_episodes.select("memory_id", "project_id", "event_type").join(t.projects.select("project_id", "org_id"), "project_id", "left")
    return e.where("project_id = 'proj-havalor' or org_id = 'org-mill' or event_type = 'preference'").select("memory_id")


@C.query("FLT03", f"select memory_id, event_type from l2_episodes where {_VISIBLE} and event_type in ('fix', 'decision', 'incident') and created_at >= timestamptz '2025-11-01 00:00:00+00' and created_at <= timestamptz '2026-02-01 00:00:00+00'")
def flt03(t: Tables) -> DataFrame:
    since, until = F.lit("2025-11-01 00:00:00").cast("timestamp"), F.lit("2026-02-01 00:00:00").cast("timestamp")
    return visible(t.l2_episodes).where(F.col("event_type").isin("fix", "decision", "incident") & F.col("created_at").between(since, until)).select("memory_id", "event_type")


@C.query("FLT04", f"select memory_id, {_STATE} as live_state from l2_episodes where {_VISIBLE} and {_RET} >= 0.05")
def flt04(t: Tables) -> DataFrame:
    return with_retention(visible(t.l2_episodes)).where("live_state in ('active', 'dormant')").select("memory_id", "live_state")


@C.query("FLT05", "select ord, sim, lexical from (select ord, importance as sim, coalesce(contains(lower(summary), 'index'), false) as lexical from l2_episodes) where sim >= 0.45 or lexical")
def flt05(t: Tables) -> DataFrame:
    e = t.l2_episodes.select("ord", F.col("importance").alias("sim"), F.coalesce(F.lower("summary").contains("index"), F.lit(False)).alias("lexical"))
    return e.where("sim >= 0.45 or lexical")


@C.query("FLT06", "select memory_id, meta['origin'] as origin from l2_episodes where forgotten_at is null and meta['origin'] is not null")
def flt06(t: Tables) -> DataFrame:
    return t.l2_episodes.where("forgotten_at is null").select("memory_id", F.try_element_at("meta", F.lit("origin")).alias("origin")).where("origin is not null")


@C.query("FLT12", "select memory_id from l2_episodes where (summary like '%queue%' or event_type like '%queue%') and state <> 'archived'")
def flt12(t: Tables) -> DataFrame:
    return t.l2_episodes.where((F.col("summary").contains("queue") | F.col("event_type").contains("queue")) & (F.col("state") != "archived")).select("memory_id")


@C.query("FLT14", "select memory_id from l2_episodes where coalesce(event_type, '') not in ('preference', 'user_message')")
def flt14(t: Tables) -> DataFrame:
    return t.l2_episodes.where(~F.coalesce("event_type", F.lit("")).isin("preference", "user_message")).select("memory_id")


@C.query("FLT15", "select rowid as vec_rowid from vectors where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0")
def flt15(t: Tables) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return t.vectors.where(F.col("embedding").isNotNull()).where(~bad & F.exists("embedding", lambda x: x != 0)).select(F.col("rowid").alias("vec_rowid"))


@C.query("PRJ01", "select anchor_id, coalesce(len(keywords), 0) as n_keywords, coalesce(extra['host'], 'unknown') as host, coalesce(feedback.status, 'none') as feedback_status from anchors")
def prj01(t: Tables) -> DataFrame:
    return t.anchors.select("anchor_id", F.when(F.col("keywords").isNull(), 0).otherwise(F.size("keywords")).alias("n_keywords"), F.coalesce(F.try_element_at("extra", F.lit("host")), F.lit("unknown")).alias("host"), F.coalesce("feedback.status", F.lit("none")).alias("feedback_status"))


@C.query("PRJ02", f"select memory_id, round({_IMP}, 4) as importance4, round({_RET}, 6) as retention6 from l2_episodes")
def prj02(t: Tables) -> DataFrame:
    return with_retention(t.l2_episodes).select("memory_id", F.round("imp", 4).alias("importance4"), F.round("retention", 6).alias("retention6"))


@C.query("JOI02", "select d.digest_id, e.memory_id, e.project_id from (select distinct digest_id, unnest(sources) as memory_id from memory_digests) d join l2_episodes e using (memory_id)")
def joi02(t: Tables) -> DataFrame:
    d = t.memory_digests.select("digest_id", F.explode("sources").alias("memory_id")).distinct()
    return d.join(t.l2_episodes.select("memory_id", "project_id"), "memory_id").select("digest_id", "memory_id", "project_id")


@C.query("JOI06", "select project_id, max(created_at) is not null as has_any, epoch_us(max(created_at)) as newest_us from projects p left join (select project_id, created_at as created_at from l2_episodes where event_type = 'incident') e using (project_id) group by project_id".replace("max(created_at)", "max(e.created_at)"))
def joi06(t: Tables) -> DataFrame:
    newest = t.l2_episodes.where("event_type = 'incident'").groupBy("project_id").agg(F.max("created_at").alias("newest"))
    return t.projects.select("project_id").join(newest, "project_id", "left").select("project_id", F.col("newest").isNotNull().alias("has_any"), F.unix_micros("newest").alias("newest_us"))


@C.query(
    "JOI12",
    """with u as (select session_key, created_at, null as memory_id, seq, 0 as side from anchors where seq is not null and session_key is not null union all select session_key, created_at, memory_id, null, 1 from l2_episodes where session_key is not null)
select memory_id, latest_seq from (select *, max(seq) over (partition by session_key order by created_at, side rows between unbounded preceding and current row) as latest_seq from u) where side = 1""",
)
def joi12(t: Tables) -> DataFrame:
    """The latest sequence number a session had reached when each episode was written.

    A running maximum over anchors and episodes within each day of a session
    key, so that a heavy key is no single task, and over the maxima of its days
    before.
    """
    day = F.to_date("created_at")
    a = t.anchors.where("seq is not null and session_key is not null").select("session_key", day.alias("day"), "created_at", F.lit(None).cast("string").alias("memory_id"), "seq", F.lit(0).alias("side"))
    e = t.l2_episodes.where("session_key is not null").select("session_key", day.alias("day"), "created_at", "memory_id", F.lit(None).cast("int").alias("seq"), F.lit(1).alias("side"))
    within = Window.partitionBy("session_key", "day").orderBy("created_at", "side").rowsBetween(Window.unboundedPreceding, 0)
    days = a.groupBy("session_key", "day").agg(F.max("seq").alias("most")).unionByName(e.select("session_key", "day", F.lit(None).cast("int").alias("most")).distinct())
    before = Window.partitionBy("session_key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.groupBy("session_key", "day").agg(F.max("most").alias("most")).withColumn("earlier", F.max("most").over(before)).drop("most")
    both = a.unionByName(e).withColumn("today", F.max("seq").over(within)).where("side = 1")
    return both.join(days, ["session_key", "day"]).select("memory_id", F.greatest("today", "earlier").alias("latest_seq"))


@C.query("AGG01", f"select {_STATE} as live_state, count(*) as n, round(avg({_IMP}), 6) as mean_importance, round(avg(case when {_STATE} = 'archived' then 1.0 else 0.0 end), 6) as archive_rate from l2_episodes group by 1")
def agg01(t: Tables) -> DataFrame:
    return with_retention(t.l2_episodes).groupBy("live_state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("imp"), 6).alias("mean_importance"), F.round(F.avg(F.when(F.col("live_state") == "archived", 1.0).otherwise(0.0)), 6).alias("archive_rate"))


@C.query("AGG03", "select state, event_type, grouping(event_type)::int as is_total, count(*) as n from l2_episodes group by rollup (state, event_type)")
def agg03(t: Tables) -> DataFrame:
    return t.l2_episodes.rollup("state", "event_type").agg(F.grouping("event_type").cast("int").alias("is_total"), F.count(F.lit(1)).alias("n"))


@C.query("AGG08", f"select project_id, round(sum(v), 6) as strength from (select project_id, v, row_number() over (partition by project_id order by v desc) as rn from (select project_id, {_IMP} * (0.5 + 0.5 * {_RET}) as v from l2_episodes where {_VISIBLE})) where rn <= 3 group by 1")
def agg08(t: Tables) -> DataFrame:
    v = with_retention(visible(t.l2_episodes)).select("project_id", (F.col("imp") * (0.5 + 0.5 * F.col("retention"))).alias("v"))
    w = Window.partitionBy("project_id").orderBy(F.desc("v"))
    return v.withColumn("rn", F.row_number().over(w)).where("rn <= 3").groupBy("project_id").agg(F.round(F.sum("v"), 6).alias("strength"))


@C.query("AGG15", "select distinct project_id, strftime(created_at, '%Y-%m-%d') as day from l2_episodes")
def agg15(t: Tables) -> DataFrame:
    return t.l2_episodes.select("project_id", F.date_format("created_at", "yyyy-MM-dd").alias("day")).distinct()


@C.query("AGG16", "select project_id, count(*) filter (state = 'active') as n_active, count(*) filter (state = 'active') > 200 as over_cap from l2_episodes group by 1")
def agg16(t: Tables) -> DataFrame:
    n = F.count_if(F.col("state") == "active")
    return t.l2_episodes.groupBy("project_id").agg(n.alias("n_active"), (n > 200).alias("over_cap"))


@C.query("AGG17", "select kind, count(*) as n, count(embedding) as n_vectors, count(*) filter (len(embedding) = 64) as n_fit from vectors group by 1")
def agg17(t: Tables) -> DataFrame:
    return t.vectors.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("n_vectors"), F.count_if(F.col("embedding").isNotNull() & (F.size("embedding") == 64)).alias("n_fit"))


@C.query("AGG18", "select project_id, sum(length(summary))::bigint as n_chars, count(*) as n_episodes, count(distinct session_key) as n_sessions from l2_episodes group by 1")
def agg18(t: Tables) -> DataFrame:
    return t.l2_episodes.groupBy("project_id").agg(F.sum(F.char_length("summary")).alias("n_chars"), F.count(F.lit(1)).alias("n_episodes"), F.countDistinct("session_key").alias("n_sessions"))


@C.query("AGG14", f"select project_id, count(*) as n_day from l2_episodes where created_at > {_NOW} - interval 24 hours and created_at <= {_NOW} group by 1")
def agg14(t: Tables) -> DataFrame:
    return t.l2_episodes.where((F.col("created_at") > now() - F.expr("interval 24 hours")) & (F.col("created_at") <= now())).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_day"))


@C.query("WIN04", "select project_id, memory_id from (select *, row_number() over (partition by project_id order by created_at desc, ord desc) as rn from l2_episodes where coalesce(event_type, '') not in ('preference', 'user_message')) where rn <= 160")
def win04(t: Tables) -> DataFrame:
    w = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("ord"))
    e = t.l2_episodes.where(~F.coalesce("event_type", F.lit("")).isin("preference", "user_message")).select("project_id", "memory_id", "created_at", "ord")
    return e.withColumn("rn", F.row_number().over(w)).where("rn <= 160").select("project_id", "memory_id")


@C.query("WIN05", "select project_id, strftime(created_at, '%Y-%m-%d') as day, epoch_us(max(created_at)) as stamp_us from l2_episodes group by 1, 2")
def win05(t: Tables) -> DataFrame:
    return t.l2_episodes.groupBy("project_id", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.unix_micros(F.max("created_at")).alias("stamp_us"))


@C.query("WIN11", "select scope, scope_ref, arg_max(digest_id, (created_at, digest_id)) as digest_id from memory_digests where status in ('ok', 'truncated') group by 1, 2")
def win11(t: Tables) -> DataFrame:
    return t.memory_digests.where("status in ('ok', 'truncated')").groupBy("scope", "scope_ref").agg(F.max_by("digest_id", F.struct("created_at", "digest_id")).alias("digest_id"))


@C.query("TOP01", f"select memory_id, place from (select memory_id, row_number() over (order by s desc, created_at desc, ord) as place from (select *, round({_IMP} * (0.2 + 0.8 * {_RET}), 9) as s from l2_episodes where {_VISIBLE})) where place <= 24")
def top01(t: Tables) -> DataFrame:
    e = with_retention(visible(t.l2_episodes)).withColumn("s", F.round(decay.score(F.col("imp"), F.col("retention")), 9))
    top = e.select("memory_id", "s", "created_at", "ord").orderBy(F.desc("s"), F.desc("created_at"), "ord").limit(24)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("s"), F.desc("created_at"), "ord"))).select("memory_id", "place")


@C.query("TOP02", "select memory_id from l2_episodes where last_access is not null order by last_access, ord limit 6400")
def top02(t: Tables) -> DataFrame:
    return t.l2_episodes.where("last_access is not null").select("memory_id", "last_access", "ord").orderBy("last_access", "ord").limit(6400).select("memory_id")


@C.query("TOP03", f"select memory_id from l2_episodes where {_VISIBLE} order by created_at desc, ord desc limit 50")
def top03(t: Tables) -> DataFrame:
    return visible(t.l2_episodes).select("memory_id", "created_at", "ord").orderBy(F.desc("created_at"), F.desc("ord")).limit(50).select("memory_id")


@C.query("TOP04", f"select memory_id, (select count(*) from l2_episodes where {_VISIBLE}) as total from l2_episodes where {_VISIBLE} order by created_at desc, ord desc limit 100 offset 200")
def top04(t: Tables) -> DataFrame:
    e = visible(t.l2_episodes).select("memory_id", "created_at", "ord")
    page = e.orderBy(F.desc("created_at"), F.desc("ord")).offset(200).limit(100).select("memory_id")
    return page.crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("total"))))


@C.query(
    "SET01",
    """with b as (select row_number() over () as rid, anchor_id, list_concat(coalesce(keywords, []), coalesce(provided, [])) as l from anchors),
f as (select rid, x, min(i) as i from (select rid, unnest(l) as x, generate_subscripts(l, 1) as i from b) group by all), r as (select *, row_number() over (partition by rid order by i) as rn from f)
select b.anchor_id, coalesce(string_agg(x, '|' order by rn) filter (where rn <= 8), '') as merged from b left join r using (rid) group by b.rid, b.anchor_id""",
)
def set01(t: Tables) -> DataFrame:
    none = F.array().cast("array<string>")
    k = F.array_distinct(F.concat(F.coalesce("keywords", none), F.coalesce("provided", none)))
    return t.anchors.select("anchor_id", F.array_join(F.slice(k, 1, 8), "|").alias("merged"))


@C.query("SET02", "select anchor_id, list_has_any(keywords, participants) as meets from anchors join (select anchor_id, participants from l2_episodes where len(participants) > 0) using (anchor_id) where len(keywords) > 0")
def set02(t: Tables) -> DataFrame:
    e = t.l2_episodes.where("size(participants) > 0").select("anchor_id", "participants")
    return t.anchors.where("size(keywords) > 0").select("anchor_id", "keywords").join(e, "anchor_id").select("anchor_id", F.arrays_overlap("keywords", "participants").alias("meets"))


@C.query("SET03", "select distinct d.digest_id, s.source as missing from memory_digests d, unnest(d.sources) as s(source) where s.source not in (select memory_id from l2_episodes where forgotten_at is null)")
def set03(t: Tables) -> DataFrame:
    d = t.memory_digests.select("digest_id", F.explode("sources").alias("missing")).distinct()
    return d.join(t.l2_episodes.where("forgotten_at is null").select(F.col("memory_id").alias("missing")), "missing", "left_anti").select("digest_id", "missing")


@C.query("SET05", "with s as (select scope_ref, digest_id, created_at, list_sort(list_distinct(sources)) as now, lag(list_sort(list_distinct(sources))) over (partition by scope_ref order by created_at, digest_id) as before from (select distinct scope_ref, digest_id, created_at, sources from memory_digests where scope_ref is not null)) select digest_id, coalesce(now = before, false) as unchanged from s")
def set05(t: Tables) -> DataFrame:
    d = t.memory_digests.where("scope_ref is not null").select("scope_ref", "digest_id", "created_at", "sources").distinct()
    now_ = F.sort_array(F.array_distinct("sources"))
    w = Window.partitionBy("scope_ref").orderBy("created_at", "digest_id")
    return d.select("digest_id", F.coalesce(now_ == F.lag(now_).over(w), F.lit(False)).alias("unchanged"))


@C.query("DEC01", f"select memory_id, round({_STAB}, 6) as stability from l2_episodes")
def dec01(t: Tables) -> DataFrame:
    e = t.l2_episodes
    return e.select("memory_id", F.round(decay.stability(decay.importance(F.col("importance")), F.col("access_count")), 6).alias("stability"))


@C.query("DEC02", f"select memory_id, round({_RET}, 6) as retention from l2_episodes where {_VISIBLE}")
def dec02(t: Tables) -> DataFrame:
    return with_retention(visible(t.l2_episodes)).select("memory_id", F.round("retention", 6).alias("retention"))


@C.query("DEC03", f"select memory_id, {_STATE} as live_state from l2_episodes")
def dec03(t: Tables) -> DataFrame:
    return with_retention(t.l2_episodes).select("memory_id", "live_state")


@C.query("DEC04", f"select memory_id, round({_IMP} * (0.2 + 0.8 * {_RET}), 6) as score from l2_episodes")
def dec04(t: Tables) -> DataFrame:
    return with_retention(t.l2_episodes).select("memory_id", F.round(decay.score(F.col("imp"), F.col("retention")), 6).alias("score"))


@C.query("WRT03", f"select state as before, {_STATE} as after, count(*) as n from l2_episodes where {_VISIBLE} and state is distinct from {_STATE} group by 1, 2")
def wrt03(t: Tables) -> DataFrame:
    e = with_retention(visible(t.l2_episodes)).where(~F.col("state").eqNullSafe(F.col("live_state")))
    return e.groupBy(F.col("state").alias("before"), F.col("live_state").alias("after")).agg(F.count(F.lit(1)).alias("n"))


@C.query("WRT02", "select e.memory_id, e.access_count + coalesce(n, 0) as access_count, epoch_us(greatest(e.last_access, a.last)) as last_us from l2_episodes e left join (select memory_id, count(*)::int as n, max(created_at) as last from (select distinct digest_id, created_at, unnest(sources) as memory_id from memory_digests) group by 1) a using (memory_id)")
def wrt02(t: Tables) -> DataFrame:
    """Access counts and times folded from a log of accesses (the sources of digests)."""
    log = t.memory_digests.select("digest_id", "created_at", F.explode("sources").alias("memory_id")).distinct()
    a = log.groupBy("memory_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("created_at").alias("last"))
    e = t.l2_episodes.select("memory_id", "access_count", "last_access").join(a, "memory_id", "left")
    return e.select("memory_id", (F.col("access_count") + F.coalesce("n", F.lit(0))).alias("access_count"), F.unix_micros(F.greatest("last_access", "last")).alias("last_us"))


@C.query(
    "WRT04",
    """with recursive c(memory_id, target, depth) as (select memory_id, memory_id, 0 from l2_episodes where superseded_by is not null union all select c.memory_id, e.superseded_by, depth + 1 from c join l2_episodes e on e.memory_id = c.target where e.superseded_by is not null and depth < 12)
select memory_id, arg_max(target, depth) as final_id, max(depth) as hops from c group by 1""",
)
def wrt04(t: Tables) -> DataFrame:
    """The last episode of each chain of replacements of any length; null where it is a cycle.

    The SQL follows 12 steps.
    """
    return graph.chain_ends(t.l2_episodes, "memory_id", "superseded_by")


@C.query("ID01", "select memory_id, 'ep_' || left(sha256(coalesce(project_id, '') || '|' || coalesce(summary, '')), 16) as stable_id from l2_episodes")
def id01(t: Tables) -> DataFrame:
    key = F.concat(F.coalesce("project_id", F.lit("")), F.lit("|"), F.coalesce("summary", F.lit("")))
    return t.l2_episodes.select("memory_id", F.concat(F.lit("ep_"), F.left(F.sha2(key, 256), F.lit(16))).alias("stable_id"))


@C.query("DAT01", "select memory_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as iso from l2_episodes")
def dat01(t: Tables) -> DataFrame:
    return t.l2_episodes.select("memory_id", F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("iso"))


@C.query("DAT02", f"select memory_id, round(greatest(0.0, (epoch_us({_NOW}) - epoch_us({_LAST})) / 3.6e9), 6) as hours from l2_episodes")
def dat02(t: Tables) -> DataFrame:
    return t.l2_episodes.select("memory_id", F.round(decay.elapsed_hours(F.coalesce("last_access", "created_at"), now()), 6).alias("hours"))


@C.query("DAT03", "select strftime(created_at, '%Y-%m-%d') as day, strftime(created_at, '%H:%M') as hm, count(*) as n from anchors group by all")
def dat03(t: Tables) -> DataFrame:
    return t.anchors.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), F.date_format("created_at", "HH:mm").alias("hm")).agg(F.count(F.lit(1)).alias("n"))


@C.query("MTH03", "select digest_id, least(3000, greatest(300, requested_chars)) as coerced, arg_min(p, (abs(p - requested_chars), p)) as preset from (select distinct digest_id, requested_chars from memory_digests where requested_chars is not null), unnest([500, 1000, 2000]) as u(p) group by all")
def mth03(t: Tables) -> DataFrame:
    d = t.memory_digests.where("requested_chars is not null").select("digest_id", "requested_chars").distinct()
    best = F.array_min(F.array(*[F.struct(F.abs(F.lit(p) - F.col("requested_chars")), F.lit(p).alias("p")) for p in (500, 1000, 2000)]))["p"]
    return d.select("digest_id", F.least(F.lit(3000), F.greatest(F.lit(300), "requested_chars")).alias("coerced"), best.alias("preset"))


@C.query("ARR01", "select anchor_id, array_to_string(list_slice(keywords, 1, 2), ',') as first2, len(provided) as n_provided from anchors where keywords is not null")
def arr01(t: Tables) -> DataFrame:
    return t.anchors.where("keywords is not null").select("anchor_id", F.array_join(F.slice("keywords", 1, 2), ",").alias("first2"), F.when(F.col("provided").isNotNull(), F.size("provided")).alias("n_provided"))


@C.query("MAP01", "select p.project_id, coalesce(m.origin, p.stats['sessions'], 'none') as first_value from projects p left join (select project_id, min(meta['origin']) as origin from l2_episodes where meta['origin'] is not null group by 1) m using (project_id)")
def map01(t: Tables) -> DataFrame:
    """The first of two maps that has the value wins."""
    m = t.l2_episodes.select("project_id", F.try_element_at("meta", F.lit("origin")).alias("origin")).groupBy("project_id").agg(F.min("origin").alias("origin"))
    p = t.projects.join(m, "project_id", "left")
    return p.select("project_id", F.coalesce("origin", F.try_element_at("stats", F.lit("sessions")), F.lit("none")).alias("first_value"))


@C.query(
    "MAP02",
    f"""with e as (select memory_id, state, outcome, event_type, {_STATE} as live from l2_episodes)
select memory_id, 'state' as attribute, state as before, live as after from e where state is distinct from live
union all select memory_id, 'outcome', outcome, event_type from e where outcome is distinct from event_type""",
)
def map02(t: Tables) -> DataFrame:
    e = with_retention(t.l2_episodes)
    before, after = F.create_map(F.lit("state"), F.col("state"), F.lit("outcome"), F.col("outcome")), F.create_map(F.lit("state"), F.col("live_state"), F.lit("outcome"), F.col("event_type"))
    both = F.map_zip_with(before, after, lambda k, a, b: F.struct(a.alias("before"), b.alias("after")))
    changed = F.map_filter(both, lambda k, v: ~v["before"].eqNullSafe(v["after"]))
    return e.select("memory_id", F.explode(changed).alias("attribute", "v")).select("memory_id", "attribute", "v.before", "v.after")


@C.query("JSN01", "select event_id, (props->>'$.k')::int as k from events where (props->>'$.k')::int > 90")
def jsn01(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k > 90")
