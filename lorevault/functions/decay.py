"""Exponential forgetting with access reinforcement, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the forgetting model.
BASE_HOURS, REINFORCEMENT = 24.0, 0.5
ACTIVE, DORMANT, FLOOR = 0.30, 0.05, 0.20
LEAST_IMPORTANCE, USUAL_IMPORTANCE, USUAL_CONFIDENCE = 0.05, 0.5, 0.8


def importance(c: Column) -> Column:
    """Between LEAST_IMPORTANCE and 1; null, NaN and what is no number become the usual importance."""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x), USUAL_IMPORTANCE).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(LEAST_IMPORTANCE), x)))


def confidence(c: Column) -> Column:
    """At most 1; null and NaN become the usual confidence; minus infinity stays."""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x), USUAL_CONFIDENCE).otherwise(F.least(F.lit(1.0), x))


def elapsed_hours(last: Column, now: Column) -> Column:
    """Hours since ``last``, never negative."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(last)) / 3.6e9)


def stability(imp: Column, accesses: Column) -> Column:
    return BASE_HOURS * F.greatest(imp, F.lit(1e-6)) * (1 + REINFORCEMENT * F.log1p(F.greatest(accesses, F.lit(0)).cast("double")))


def retention(imp: Column, accesses: Column, last: Column, now: Column) -> Column:
    return F.exp(-elapsed_hours(last, now) / stability(imp, accesses))


def state(r: Column) -> Column:
    return F.when(r >= ACTIVE, "active").when(r >= DORMANT, "dormant").otherwise("archived")


def score(similarity: Column, r: Column) -> Column:
    return similarity * (FLOOR + (1 - FLOOR) * r)
