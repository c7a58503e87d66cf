"""Running sums and maxima over groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def running(df: DataFrame, out: str, value: Column, how: str, by: list[str], block: Column, order: list[Column], before: bool = False) -> DataFrame:
    """``df`` with a running 'sum' or 'max' of ``value`` within ``by``, in the order of ``block`` and then ``order``.

    ``block`` cuts a group into parts (days, say) that come one after the other. Only
    the totals of the parts of a group come together, the rows of one part at most in one task.
    ``before`` leaves the row itself out. Nulls in ``by`` form a group, null values don't count;
    before the first value a maximum is null and a sum 0.
    """
    f = {"sum": F.sum, "max": F.max}[how]
    rows = df.withColumns({"_block": block, "_value": value})
    parts = rows.groupBy(*by, "_block").agg(f("_value").alias("_part"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_block").alias("_at"), f("_part").over(earlier).alias("_earlier"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("_block").eqNullSafe(F.col("_at"))])
    inner = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    rows = rows.join(parts, same).withColumn("_inner", f("_value").over(inner))
    both = F.coalesce("_earlier", F.lit(0)) + F.coalesce("_inner", F.lit(0)) if how == "sum" else F.greatest("_earlier", "_inner")
    return rows.withColumn(out, both).select(*df.columns, out)
