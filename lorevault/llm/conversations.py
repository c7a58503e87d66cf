"""Conversations from message rows: order, roles, and the ones to drop.

Rows are partitioned by conversation and ordered by sequence number; a
finite-state automaton over the roles finds empty and unanswered turns. A long
conversation is cut into chunks of sequence numbers: the automaton runs in each
chunk, and its summaries (first and last message, an unanswered turn inside) are
run through it again, so no task holds more than a chunk of one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Event types and speakers of each role, lower case.
EVENT_ROLES = {"user_message": "user", "assistant_message": "assistant", "tool_call": "tool", "tool_result": "tool", "session_start": "system"}
SPEAKER_ROLES = {
    "user": ["user", "human", "visitor", "customer", "operator", "用户", "benutzer", "nutzer", "usuario"],
    "assistant": ["assistant", "ai", "agent", "bot", "model", "助手", "assistent", "asistente"],
    "tool": ["tool", "function", "工具", "werkzeug", "herramienta"],
    "system": ["system", "host", "系统", "sistema"],
}
CHUNK = 4096
BLANK_ENDS = r"(?U)^[\s\u200b\u2060\ufeff]+|[\s\u200b\u2060\ufeff]+$"


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def clean(c: Column) -> Column:
    """Lower case, without white space of any kind around."""
    return F.lower(F.regexp_replace(c, BLANK_ENDS, ""))


def role(event_type: Column, speaker: Column) -> Column:
    """user, assistant, tool or system; null where neither event type nor speaker tells."""
    by_event, by_speaker = _lookup(EVENT_ROLES), _lookup({s: r for r, names in SPEAKER_ROLES.items() for s in names})
    return F.coalesce(F.try_element_at(by_event, F.coalesce(clean(event_type), F.lit(""))), F.try_element_at(by_speaker, F.coalesce(clean(speaker), F.lit(""))))


def has_text(c: Column) -> Column:
    """Whether anything but white space is there; non-breaking, ideographic and zero-width blanks are white space."""
    return F.coalesce(c.rlike(r"(?U)[^\s\u200b\u2060\ufeff]"), F.lit(False))


def messages(anchors: DataFrame) -> DataFrame:
    """One row per (session_id, seq): session_id cleaned, role, quotes that differ, and the message's code.

    ``code`` is U for a user message with text, A for an assistant message with
    text and '' otherwise. Rows that repeat session, seq and quote count once
    (null is a quote of its own); rows without session_id or seq are left out.
    """
    rows = anchors.select(
        clean(F.col("session_id")).alias("session_id"),
        F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.xxhash64("quote", F.lit(1)), F.lit(0)).alias("q"),
        role(F.col("event_type"), F.col("speaker")).alias("role"),
        has_text(F.col("quote")).alias("said"),
    ).where("session_id <> '' and seq is not null")
    # A known role wins over none; among several, user then assistant, to be the same on every run.
    rank = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).when(F.col("role") == "tool", 3).when(F.col("role") == "system", 4).otherwise(5)
    one = rows.groupBy("session_id", "seq").agg(F.min(F.struct(rank.alias("rank"), "role", "said")).alias("m"), (F.min("q") != F.max("q")).alias("differs"))
    code = F.when(F.col("m.said") & (F.col("m.role") == "user"), "U").when(F.col("m.said") & (F.col("m.role") == "assistant"), "A").otherwise("")
    return one.select("session_id", "seq", F.col("m.role").alias("role"), "differs", code.alias("code"))


def verdicts(anchors: DataFrame) -> DataFrame:
    """One row per conversation: session_id, n_messages, gap, conflict, empty, unanswered, dropped.

    gap: seq doesn't run 1, 2, ... ; conflict: one seq holds differing quotes;
    empty: no user message has text; unanswered: a user message with text isn't
    followed by an assistant message with text before the next one or the end.
    An empty table gives no rows; other columns are never read.
    """
    m = messages(anchors)
    chunk = m.groupBy("session_id", F.floor(F.col("seq") / CHUNK).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("seq").alias("lo"),
        F.max("seq").alias("hi"),
        F.max("differs").alias("differs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("code") != "", F.struct("seq", "code")))), lambda x: x["code"]), "").alias("run"),
    )
    chunk = chunk.select("session_id", "chunk", "n", "lo", "hi", "differs", F.col("run").contains("U").alias("asked"), F.col("run").contains("UU").alias("bad"), F.when(F.col("run") != "", F.struct("chunk", F.left("run", F.lit(1)).alias("first"), F.right("run", F.lit(1)).alias("last"))).alias("ends"))
    s = chunk.groupBy("session_id").agg(F.sum("n").alias("n_messages"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("differs").alias("conflict"), F.max("asked").alias("asked"), F.max("bad").alias("bad"), F.array_sort(F.collect_list("ends")).alias("ends"))
    pairs = F.zip_with(F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), F.slice("ends", 2, F.greatest(F.size("ends"), F.lit(1))), lambda a, b: (a["last"] == "U") & (b["first"] == "U"))
    unanswered = F.col("bad") | F.exists(pairs, lambda x: F.coalesce(x, F.lit(False))) | F.coalesce(F.try_element_at("ends", F.lit(-1))["last"] == "U", F.lit(False))
    out = s.select("session_id", "n_messages", ((F.col("lo") != 1) | (F.col("hi") != F.col("n_messages"))).alias("gap"), "conflict", (~F.col("asked")).alias("empty"), unanswered.alias("unanswered"))
    return out.withColumn("dropped", F.col("gap") | F.col("conflict") | F.col("empty") | F.col("unanswered"))


def conversations(anchors: DataFrame) -> DataFrame:
    """The messages of the kept conversations in order: session_id, seq, role, quote.

    One row per message, sorted by (session_id, seq) over the partitions, so a
    conversation of any length is read in order without being held whole. Tool
    and system rows stay in their place; the role is null where nothing tells it.
    """
    kept = verdicts(anchors).where(~F.col("dropped")).select("session_id")
    rows = anchors.select(clean(F.col("session_id")).alias("session_id"), F.col("seq").cast("long").alias("seq"), role(F.col("event_type"), F.col("speaker")).alias("role"), "quote").where("session_id <> '' and seq is not null")
    one = rows.join(kept, "session_id", "left_semi").groupBy("session_id", "seq").agg(F.min(F.struct(F.col("role").isNull().alias("untold"), F.when(F.col("role") == "user", 0).otherwise(1).alias("r"), "role", "quote")).alias("m"))
    return one.select("session_id", "seq", F.col("m.role").alias("role"), F.col("m.quote").alias("quote")).repartitionByRange("session_id", "seq").sortWithinPartitions("session_id", "seq")
