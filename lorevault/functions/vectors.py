"""Vector functions as column expressions, computed in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def finite(a: Column) -> Column:
    """Whether no element is null, NaN or infinite."""
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def cosine(a: Column, b: Column) -> Column:
    """Between -1 and 1; 0 for vectors without length or with elements that aren't finite, null for other dimensions."""
    n = norm(a) * norm(b)
    c = F.when(~finite(a) | ~finite(b) | (n == 0), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(n, F.lit(0.0)))))
    return F.when(F.size(a) == F.size(b), c)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))
