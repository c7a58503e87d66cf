"""Queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorevault.llm import conversations, keyword_spam, leaks, mixing, near_duplicates, neighbours, pii, truncation
from lorevault.session import table


PERSONAL = (("anchors", "anchor_id", "quote"), ("l2_episodes", "memory_id", "summary"), ("memory_digests", "digest_id", "content"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.similar_pairs(table(spark, sf, "l2_episodes"), "ord", "summary").select(F.col("id_a").alias("ord_a"), F.col("id_b").alias("ord_b"))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf, "l2_episodes"), "ord", "summary")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.verdicts(table(spark, sf, "anchors")).where("dropped").select("session_id")


def p3_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.verdicts(table(spark, sf, "anchors"))


def p3_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.conversations(table(spark, sf, "anchors"))


def _digests(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(table(spark, sf, "memory_digests"), "digest_id", "content", "generator")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _digests(spark, sf).where("cut").select(F.col("row").alias("digest_id")).distinct()


def p2_shares(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_shares(_digests(spark, sf))


def p2_spikes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "memory_digests").where("content <> ''")
    return truncation.spikes(d.select(F.col("generator").alias("source"), F.char_length("content").alias("n_chars"), F.octet_length("content").alias("n_bytes")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        pii.personal(table(spark, sf, name), key, text).select(F.lit(name).alias("table_name"), F.col("row").alias("row_key"), "pii_kind")
        for name, key, text in PERSONAL
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def p5_masked(spark: SparkSession, sf: str) -> DataFrame:
    parts = [pii.masked(table(spark, sf, name), key, text).select(F.lit(name).alias("table_name"), F.col("row").alias("row_key"), "text", "n_places") for name, key, text in PERSONAL]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vectors")
    return neighbours.mutual(neighbours.nearest(v, k=5), 0.9, v).select(F.col("id_a").alias("rowid_a"), F.col("id_b").alias("rowid_b"))


def p6_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "vectors"), k=10)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_documents(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.without_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "source", "n_chars")


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.report(p8_mix(spark, sf), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_spam.judged(table(spark, sf, "documents")).where("spam").select("doc_id")


def p9_judged(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_spam.judged(table(spark, sf, "documents"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1].isdigit()}


_ROLE = """case when e = 'user_message' then 'user' when e = 'assistant_message' then 'assistant' when e in ('tool_call', 'tool_result') then 'tool' when e = 'session_start' then 'system'
  when s in ('user', 'human', 'visitor', 'customer', 'operator', '用户', 'benutzer', 'nutzer', 'usuario') then 'user' when s in ('assistant', 'ai', 'agent', 'bot', 'model', '助手', 'assistent', 'asistente') then 'assistant'
  when s in ('tool', 'function', '工具', 'werkzeug', 'herramienta') then 'tool' when s in ('system', 'host', '系统', 'sistema') then 'system' end"""
_BLANK = r"[\s\x{00a0}\x{3000}\x{200b}\x{2060}\x{feff}\x{2000}-\x{200a}\x{202f}\x{205f}\x{1680}\x{85}\x{2028}\x{2029}]"


def _stripped(c: str) -> str:
    return f"lower(regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g'))"



_MESSAGES = f"""
with r as (select {_stripped('session_id')} session_id, seq, quote, {_stripped('event_type')} e, {_stripped('speaker')} s from anchors where seq is not null),
d as (select distinct session_id, seq, quote, {_ROLE} as role, coalesce(regexp_replace(quote, '{_BLANK}', '', 'g'), '') <> '' as said from r where session_id <> ''),
m as (select session_id, seq, count(distinct coalesce('q' || quote, '')) > 1 as differs, arg_min(role, k) as role, arg_min(said, k) as said, any_value(quote) as quote
  from (select *, (case role when 'user' then 1 when 'assistant' then 2 when 'tool' then 3 when 'system' then 4 else 5 end) * 2 + said::int as k from d) group by session_id, seq)"""
_VERDICTS = _MESSAGES + """,
t as (select *, lead(role) over (partition by session_id order by seq) as next from m where said and role in ('user', 'assistant')),
u as (select session_id, bool_or(role = 'user' and next is distinct from 'assistant') as unanswered, bool_or(role = 'user') as asked from t group by session_id),
v as (select session_id, count(*) as n_messages, min(seq) <> 1 or max(seq) <> count(*) as gap, bool_or(differs) as conflict from m group by session_id)
select v.*, not coalesce(asked, false) as empty, coalesce(unanswered, false) as unanswered, gap or conflict or not coalesce(asked, false) or coalesce(unanswered, false) as dropped from v left join u using (session_id)"""

_WORDS = r"regexp_extract_all(regexp_replace(lower({0}), '(\p{{Han}})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"
_LEAKED = f"""with d as (select doc_id, {_WORDS.format('text')} as w from documents), e as (select item_id, {_WORDS.format('passage')} as w from eval_items),
dg as (select doc_id, array_to_string(w[i:i+11], ' ') as g from d, unnest(range(1, len(w) - 10)) as u(i)), eg as (select distinct item_id, array_to_string(w[i:i+11], ' ') as g from e, unnest(range(1, len(w) - 10)) as u(i))
select distinct doc_id, item_id from dg join eg using (g)"""

_SIMILAR = f"""with s as (select ord, list_distinct({_WORDS.format('summary')}) as w from l2_episodes), t as (select * from s where len(w) >= 10),
x as (select ord, unnest(w) as v from t), p as (select a.ord as ord_a, b.ord as ord_b, count(*) as n from x a join x b on a.v = b.v and a.ord < b.ord group by all)
select ord_a, ord_b from p join t a on a.ord = ord_a join t b on b.ord = ord_b where n * 10 >= 7 * (len(a.w) + len(b.w) - n)"""


def oracle_sql():
    return {
        "p1_found": _SIMILAR,
        "p3_verdicts": _VERDICTS,
        "p3_found": f"select session_id from ({_VERDICTS}) where dropped",
        "p2_spikes": """with l as (select generator as source, unnest([{'measure': 'n_chars', 'length': length(content)}, {'measure': 'n_bytes', 'length': octet_length(encode(content))}]) as x from memory_digests where content <> ''),
n as (select source, x.measure as measure, x.length as length, count(*) as n from l group by all),
e as (select *, (sum(n) over (partition by source, measure order by length range between 25 preceding and 25 following) - n) / 50.0 as expected from n)
select * from e where n >= 5 and n >= 6 * greatest(expected, 0.1)""",
        "p7_found": _LEAKED,
        "p7_clean": f"select doc_id, source, n_chars from documents where doc_id not in (select doc_id from ({_LEAKED}))",
        "p3_conversations": f"{_MESSAGES}, k as (select session_id from ({_VERDICTS}) where not dropped) select session_id, seq, role, quote from m where session_id in (select session_id from k)",
    }
