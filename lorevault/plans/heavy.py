"""p4: results per project and per session key, and the keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorevault.operators.heavy_keys import heavy_keys, per_key
from lorevault.session import table

SESSION = "lower(trim(both from {0}))"


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("table_name", F.lit(name))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    a = _named(heavy_keys(table(spark, sf, "anchors"), "session_key", "created_at"), "anchors")
    e = _named(heavy_keys(table(spark, sf, "l2_episodes"), "project_id", "created_at"), "l2_episodes")
    return a.unionByName(e).select("table_name", "key_value")


def p4_per_key(spark: SparkSession, sf: str) -> DataFrame:
    session = F.nullif(F.lower(F.trim("session_id")), F.lit(""))
    a = _named(per_key(table(spark, sf, "anchors"), "session_key", "created_at", session), "anchors")
    e = _named(per_key(table(spark, sf, "l2_episodes"), "project_id", "created_at", F.col("session_key")), "l2_episodes")
    return a.unionByName(e)


def queries():
    return {"p4_found": p4_found, "p4_per_key": p4_per_key}


def oracle_sql():
    found = """
select '{t}' as table_name, {k} as key_value from {t} where {k} is not null
group by {k} having count(*) >= 0.04 * (select count(*) from {t})"""
    per = """
select {k} as key_value, count(*) as n_rows, max(epoch_us(created_at)) as newest_us,
  count(distinct {s}) as n_sessions, '{t}' as table_name from {t} where {k} is not null group by {k}"""
    a, e = {"t": "anchors", "k": "session_key", "s": "nullif(lower(trim(session_id)), '')"}, {"t": "l2_episodes", "k": "project_id", "s": "session_key"}
    return {
        "p4_found": found.format(**a) + " union all " + found.format(**e),
        "p4_per_key": per.format(**a) + " union all " + per.format(**e),
    }
