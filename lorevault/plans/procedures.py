"""Runs, trajectories and sessions: rates, windows, sequences, budgets and batch twins of the streams, over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorevault.functions import sequences, text as T
from lorevault.operators import budget
from lorevault.plans.catalog import Catalog, Tables
from lorevault.session import stage

C = Catalog()
queries, oracle_sql = C.queries, C.oracle_sql

_RUNS = "runs as (select 'sk_' || (user_id % 40) as skill_id, user_id as session_key, event_type <> 'error' as success, ts, event_id, value from events)"


def runs(t: Tables) -> DataFrame:
    return t.events.select(F.concat(F.lit("sk_"), F.pmod("user_id", F.lit(40))).alias("skill_id"), F.col("user_id").alias("session_key"), (F.col("event_type") != "error").alias("success"), "ts", "event_id", "value")


@C.query("AGG05", f"with {_RUNS} select skill_id, count(*) as n, round((count(*) filter (success) + 1) / (count(*) + 2), 6) as smoothed from runs group by 1")
def agg05(t: Tables) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if("success")
    return runs(t).groupBy("skill_id").agg(n.alias("n"), F.round((ok + 1) / (n + 2), 6).alias("smoothed"))


@C.query("AGG06", f"with {_RUNS} select skill_id, count(*) as n_runs, count(*) filter (success) as n_ok, count(distinct session_key) as n_sessions from runs group by 1 having count(*) >= 20 and count(*) filter (success) >= 0.9 * count(*)")
def agg06(t: Tables) -> DataFrame:
    g = runs(t).groupBy("skill_id").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("success").alias("n_ok"), F.countDistinct("session_key").alias("n_sessions"))
    return g.where("n_runs >= 20 and n_ok >= 0.9 * n_runs")


@C.query("AGG07", f"with {_RUNS} select skill_id, count(*) as used from runs where ts >= timestamp '2024-01-15' group by 1")
def agg07(t: Tables) -> DataFrame:
    return runs(t).where("ts >= timestamp_ntz'2024-01-15'").groupBy("skill_id").agg(F.count(F.lit(1)).alias("used"))


@C.query("AGG11", "select user_id, event_type as modal from (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, min((ts, event_id))) as rn from events group by 1, 2) where rn = 1")
def agg11(t: Tables) -> DataFrame:
    """The most frequent kind of event of each user; of equally frequent ones the one seen first."""
    g = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "first")
    return g.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", F.col("event_type").alias("modal"))


@C.query("WIN01", f"with {_RUNS} select event_id, rn as place from (select event_id, row_number() over (partition by skill_id order by value desc, event_id) as rn from runs)")
def win01(t: Tables) -> DataFrame:
    w = Window.partitionBy("skill_id").orderBy(F.desc("value"), "event_id")
    return runs(t).select("event_id", F.row_number().over(w).alias("place"))


@C.query("WIN02", f"with {_RUNS} select skill_id, count(*) as n_last, round(avg(success::int), 6) as rate, count(*) = 10 and avg(success::int) < 0.5 as failing from (select *, row_number() over (partition by skill_id order by ts desc, event_id desc) as rn from runs) where rn <= 10 group by 1")
def win02(t: Tables) -> DataFrame:
    """Rate of the last ten runs of each skill; failing only with ten of them."""
    w = Window.partitionBy("skill_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = runs(t).withColumn("rn", F.row_number().over(w)).where("rn <= 10")
    rate, n = F.avg(F.col("success").cast("int")), F.count(F.lit(1))
    return last.groupBy("skill_id").agg(n.alias("n_last"), F.round(rate, 6).alias("rate"), ((n == 10) & (rate < 0.5)).alias("failing"))


@C.query("WIN08", "select event_id, used from (select event_id, sum((value * 100)::bigint) over (partition by user_id order by ts, event_id)::bigint as used from events) where used <= 30000")
def win08(t: Tables) -> DataFrame:
    """The events of each user up to a running budget."""
    e = t.events.select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cost"))
    return budget.prefix(e, "cost", 30_000, ["user_id"], F.to_date("ts"), [F.col("ts"), F.col("event_id")]).select("event_id", "used")


@C.query("WIN09", "select event_id, event_type from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where event_type is distinct from before")
def win09(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("before", F.lag("event_type").over(w)).where(~F.col("event_type").eqNullSafe(F.col("before"))).select("event_id", "event_type")


@C.query("WIN10", f"with {_RUNS} select event_id, round(case when hi = lo then 0.9 else 0.45 + 0.45 * (value - lo) / (hi - lo) end, 6) as spread from (select event_id, value, min(value) over (partition by skill_id) as lo, max(value) over (partition by skill_id) as hi from runs)")
def win10(t: Tables) -> DataFrame:
    from lorevault.operators.lexical import spread

    return spread(runs(t), "value", "skill_id").select("event_id", F.round("lexical", 6).alias("spread"))


_TRAJ = "tj as (select user_id, strftime(ts, '%Y-%m-%d') as day, list(case event_type when 'view' then 'read' else event_type end order by ts, event_id) as steps, bool_and(event_type <> 'error') as success from events group by 1, 2)"


def trajectories(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("l"))
    # Looking at something is what the tool named read does.
    steps = F.transform("l", lambda x: F.when(x["event_type"] == "view", "read").otherwise(x["event_type"]))
    return g.select("user_id", "day", steps.alias("steps"), F.forall(steps, lambda s: s != "error").alias("success"))


_READ_ONLY = "('read', 'read_file', 'grep', 'glob', 'list', 'ls', 'search', 'web_search', 'web_fetch', 'todo_write', 'todo_read', 'skill', 'memory_search', 'memory_add', 'browser_page', 'remember', 'recall', 'view_image')"
_CHANGING = f"list_filter(steps, lambda s: s not in {_READ_ONLY})"


def changing(steps: str = "steps") -> Column:
    """The steps that change something."""
    return F.filter(steps, lambda s: ~s.isin(T.READ_ONLY_TOOLS))


@C.query("SEQ01", f"with {_TRAJ} select user_id, day, array_to_string(steps, '>') as variant, array_to_string({_CHANGING}, '>') as signature, success from tj where len(steps) >= 2")
def seq01(t: Tables) -> DataFrame:
    """Signature (changing steps) and variant (all steps) of each day's trajectory."""
    tj = trajectories(t).where("size(steps) >= 2")
    return tj.select("user_id", "day", F.array_join("steps", ">").alias("variant"), F.array_join(changing(), ">").alias("signature"), "success")


_RECORDED = f"""rec as (select user_id, day, steps, success, left(sha1(array_to_string(steps, '>')), 10) as variant, left(sha1('|' || case when len({_CHANGING}) = 0 then 'noop' else array_to_string({_CHANGING}, '>') end), 12) as signature from tj where len({_CHANGING}) >= 2 or not success)"""


def recorded(t: Tables) -> DataFrame:
    """Trajectories worth keeping: failed ones and those with two changing steps at least; with the hashes of all and of the changing steps."""
    c = changing()
    body = F.when(F.size(c) == 0, "noop").otherwise(F.array_join(c, ">"))
    tj = trajectories(t).where((F.size(c) >= 2) | ~F.col("success"))
    return tj.select("user_id", "day", "steps", "success", F.left(F.sha1(F.array_join("steps", ">")), F.lit(10)).alias("variant"), F.left(F.sha1(F.concat(F.lit("|"), body)), F.lit(12)).alias("signature"))


@C.query("WRT12", f"with {_TRAJ}, {_RECORDED} select user_id, day, variant, signature, success from rec")
def wrt12(t: Tables) -> DataFrame:
    return recorded(t).select("user_id", "day", "variant", "signature", "success")


@C.query("STR13", f"with {_TRAJ}, {_RECORDED} select distinct signature, variant from rec")
def str13(t: Tables) -> DataFrame:
    return recorded(t).select("signature", "variant").distinct()


# The longest common subsequence of two lists, a row of the table at a time: every entry is the largest so far of a match and the row before.
_GRADED = f"""with recursive {_TRAJ}, {_RECORDED}, base as (select *, bool_or(success) over (partition by signature) as any_ok from rec), used as (select * from base where success or not any_ok),
modal as (select signature, steps as modal from (select signature, steps, row_number() over (partition by signature order by count(*) desc, min((day, user_id))) as rn from used group by 1, 2) where rn = 1),
pairs as (select distinct u.signature, u.steps as a, m.modal as b from used u join modal m using (signature)),
lcs(signature, a, b, i, row) as (select signature, a, b, 0, list_transform(range(0, len(b) + 1), lambda x: 0) from pairs union all
  select signature, a, b, i + 1, list_concat([0], list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: case when b[k] = a[i + 1] then row[k] + 1 else row[k + 1] end)))) from lcs where i < len(a)),
likeness as (select signature, a, row[-1] / greatest(len(a), len(b)) as l from lcs where i = len(a)),
g as (select signature, count(*) as n_runs, count(*) filter (success) as n_ok, count(distinct user_id) as n_sessions from rec group by 1),
c as (select used.signature, round(avg(l), 6) as consistency from used join likeness on likeness.signature = used.signature and a = steps group by 1),
graded as (select signature, n_runs, n_ok, n_sessions, consistency, array_to_string(list_filter([case when n_ok < 3 then 'insufficient_successes' end, case when n_ok / n_runs < 0.8 then 'success_rate' end, case when n_sessions < 2 then 'insufficient_sessions' end, case when consistency < 0.7 then 'step_consistency' end], lambda x: x is not null), ',') as failed from g join c using (signature))"""


def graded(t: Tables) -> DataFrame:
    """Runs, successes, sessions (users) and mean likeness to the modal sequence of every signature, and the checks that it fails.

    Likeness is the longest common subsequence over the longer length; it is over successful
    runs where there are any. Of equally frequent sequences the one seen first is modal.
    """
    r = stage(recorded(t), "recorded")
    g = r.groupBy("signature").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("success").alias("n_ok"), F.countDistinct("user_id").alias("n_sessions"))
    used = r.join(g.select("signature", "n_ok"), "signature").where("success or n_ok = 0")
    # Equal sequences are compared once.
    n = used.groupBy("signature", "steps").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("day", "user_id")).alias("first"))
    w = Window.partitionBy("signature").orderBy(F.desc("n"), "first")
    modal = n.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("signature", F.col("steps").alias("modal"))
    c = n.join(modal, "signature").withColumn("l", sequences.lcs_ratio(F.col("steps"), F.col("modal")))
    c = c.groupBy("signature").agg(F.round(F.sum(F.col("l") * F.col("n")) / F.sum("n"), 6).alias("consistency"), F.any_value("modal").alias("modal"))
    failed = [F.when(F.col("n_ok") < 3, "insufficient_successes"), F.when(F.col("n_ok") / F.col("n_runs") < 0.8, "success_rate"), F.when(F.col("n_sessions") < 2, "insufficient_sessions"), F.when(F.col("consistency") < 0.7, "step_consistency")]
    return g.join(c, "signature").withColumn("failed", F.array_join(F.array_compact(F.array(*failed)), ","))


@C.query("AGG10", f"{_GRADED} select * from graded")
def agg10(t: Tables) -> DataFrame:
    return graded(t).drop("modal")


@C.query("TOP07", f"{_GRADED} select * from graded order by failed = '' desc, n_ok / n_runs desc, n_runs desc, signature limit 20")
def top07(t: Tables) -> DataFrame:
    """Mature signatures first, then by rate and runs."""
    return agg10(t).orderBy(F.desc(F.col("failed") == ""), F.desc(F.col("n_ok") / F.col("n_runs")), F.desc("n_runs"), "signature").limit(20)


@C.query("WRT13", f"{_GRADED} select signature, case when failed = '' then 'draft' else 'immature' end as decision, array_to_string(list_slice(list_transform(list_filter(list_zip({_CHANGING.replace('steps', 'modal')}, range(1, len({_CHANGING.replace('steps', 'modal')}) + 1)), lambda x: x[2] = 1 or x[1] <> {_CHANGING.replace('steps', 'modal')}[x[2] - 1]), lambda x: x[1]), 1, 20), '>') as draft from graded join modal using (signature)")
def wrt13(t: Tables) -> DataFrame:
    """What becomes of each signature, and its draft: the changing steps of the modal sequence, repeats as one, at most 20."""
    draft = F.slice(sequences.collapsed(changing("modal")), 1, 20)
    return graded(t).select("signature", F.when(F.col("failed") == "", "draft").otherwise("immature").alias("decision"), F.array_join(draft, ">").alias("draft"))


@C.query("SEQ02")
def seq02(t: Tables) -> DataFrame:
    """Likeness of each day's steps to the user's day before, by longest common subsequence."""
    w = Window.partitionBy("user_id").orderBy("day")
    tj = trajectories(t).withColumn("before", F.lag("steps").over(w)).where("before is not null")
    return tj.select("user_id", "day", F.round(sequences.lcs_ratio(F.col("steps"), F.col("before")), 6).alias("likeness"))


@C.query("BUD02")
def bud02(t: Tables) -> DataFrame:
    """The newest summaries of each project that fit into 500 tokens; longer ones are skipped."""
    e = t.l2_episodes.select("project_id", "memory_id", "created_at", "ord", T.estimate_tokens(F.col("summary")).alias("cost")).withColumn("age", -F.unix_micros("created_at"))
    return budget.greedy(e, "memory_id", "cost", 500, ["project_id"], ["age", "ord"])


@C.query("BUD05", "select project_id, memory_id, used from (select project_id, memory_id, sum(length(summary)) over (partition by project_id order by created_at desc, ord desc)::bigint as used from l2_episodes where summary is not null) where used <= 4000")
def bud05(t: Tables) -> DataFrame:
    e = t.l2_episodes.where("summary is not null").select("project_id", "memory_id", "created_at", "ord", F.char_length("summary").alias("cost"))
    return budget.prefix(e, "cost", 4000, ["project_id"], -F.unix_date(F.to_date("created_at")), [F.desc("created_at"), F.desc("ord")]).select("project_id", "memory_id", "used")


# Batch twins of the streams in lorevault.streaming.


@C.query("STM02", "select session_id, seq, arg_min(anchor_id, (created_at, anchor_id)) as anchor_id, count(*) as n_deliveries from anchors where session_id is not null and seq is not null group by 1, 2")
def stm02(t: Tables) -> DataFrame:
    """The first delivery of each (session, seq)."""
    a = t.anchors.where("session_id is not null and seq is not null")
    return a.groupBy("session_id", "seq").agg(F.min_by("anchor_id", F.struct("created_at", "anchor_id")).alias("anchor_id"), F.count(F.lit(1)).alias("n_deliveries"))


@C.query("STM03", "with s as (select *, sum(new) over (partition by user_id order by ts, event_id) as nth from (select *, (ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 12 hours)::int as new from events)) select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as end_us, count(*) as n from s group by user_id, coalesce(nth, 0)")
def stm03(t: Tables) -> DataFrame:
    """Bursts of a user's events with no gap of twelve hours: a new event re-arms the timer."""
    e = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("user_id", F.session_window("ts", "12 hours").alias("s")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.unix_micros("first").alias("start_us"), F.unix_micros("last").alias("end_us"), "n")


@C.query("STM04", "with w as (select *, count(*) filter (event_type = 'purchase') over (partition by user_id order by ts, event_id) as block from events), s as (select *, row_number() over (partition by user_id, block order by ts, event_id) as n from w where event_type <> 'purchase') select event_id, user_id from s where n % 3 = 0")
def stm04(t: Tables) -> DataFrame:
    """Heartbeat: fires at every third step since the user's last write (purchase)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.withColumn("block", F.count_if(F.col("event_type") == "purchase").over(w))
    n = F.row_number().over(Window.partitionBy("user_id", "block").orderBy("ts", "event_id"))
    return e.where("event_type <> 'purchase'").withColumn("n", n).where("n % 3 = 0").select("event_id", "user_id")


@C.query("STM09", "select user_id, count(*) as accesses, epoch_us(max(ts)) as last_us from events group by 1")
def stm09(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("accesses"), F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("last_us"))


@C.query("STM11", "select anchor_id, coalesce(agent, 'host') || ':' || lower(trim(session_id)) as stream_key, coalesce(seq, -1) as place from anchors where session_id is not null")
def stm11(t: Tables) -> DataFrame:
    return t.anchors.where("session_id is not null").select("anchor_id", F.concat(F.coalesce("agent", F.lit("host")), F.lit(":"), F.lower(F.trim("session_id"))).alias("stream_key"), F.coalesce("seq", F.lit(-1)).alias("place"))


@C.query("EXT01", "select epoch_us(time_bucket(interval 1 hour, ts)) as hour_us, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def ext01(t: Tables) -> DataFrame:
    """Our own: hourly counts."""
    e = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.unix_micros("w.start").alias("hour_us"), "event_type", "n", "mean")
