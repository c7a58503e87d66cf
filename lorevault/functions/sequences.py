"""Sequence functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def collapsed(steps: Column) -> Column:
    """Neighbouring repeats as one."""
    return F.filter(steps, lambda x, i: (i == 0) | (x != F.get(steps, i - 1)))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by one pass over ``a`` that carries a row of the table."""
    zero = F.array_repeat(F.lit(0), F.size(b) + 1)

    def row(prev: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            F.array(F.lit(0)),
            lambda out, j: F.concat(out, F.array(F.when(F.element_at(b, j) == x, F.element_at(prev, j) + 1).otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(out, -1))))),
        )

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.element_at(F.aggregate(a, zero, row), -1))


def lcs_ratio(a: Column, b: Column) -> Column:
    """LCS length over the longer length; 1 for two empty sequences, 0 for one."""
    n = F.greatest(F.size(a), F.size(b))
    return F.when(n == 0, 1.0).otherwise(lcs_length(a, b) / n)
