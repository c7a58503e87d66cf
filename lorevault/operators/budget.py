"""Selection under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorevault.operators.running import running


def prefix(df: DataFrame, cost: str, budget: int | Column, by: list[str], block: Column, order: list[Column]) -> DataFrame:
    """The rows of each group, in the order of ``block`` and ``order``, up to the first one that no longer fits; ``used`` is what is spent so far.

    A block is a part of a group that one task sums up, a day say; see ``running``.
    """
    return running(df, "used", F.col(cost), "sum", by, block, order).where(F.col("used") <= budget)


def greedy(df: DataFrame, key: str, cost: str, budget: int, by: list[str], order: list[str]) -> DataFrame:
    """The rows of each group that fit when taken in order and those that don't fit are skipped: by, key, used.

    Rows that alone cost more than the budget, or less than 1, leave first. What
    is spent only grows, so a row that doesn't fit leaves no room for later ones
    of the same cost: those taken of one cost are its first ones, budget / cost
    at most, and only they are looked at.
    """
    rows = df.where((F.col(cost) <= budget) & (F.col(cost) >= 1)).select(*dict.fromkeys([*by, *order, key]), F.col(cost).cast("long").alias("_cost"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_cost").orderBy(*order))).where(F.col("_nth") * F.col("_cost") <= budget)
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("_nth").alias("nth"), F.col(key).alias("k"), F.col("_cost").alias("c")))).alias("l"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<k:string,used:bigint>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        used = acc["used"] + x["c"]
        taken = F.concat(acc["taken"], F.array(F.struct(x["k"].cast("string").alias("k"), used.alias("used"))))
        return F.when(used <= budget, F.struct(used.alias("used"), taken.alias("taken"))).otherwise(acc)

    return lists.select(*by, F.explode(F.aggregate("l", start, step)["taken"]).alias("t")).select(*by, F.col("t.k").alias(key), F.col("t.used").alias("used"))


def alternating(items: DataFrame, most: int) -> DataFrame:
    """Facts and episodes of each query that fit into ``most`` when the last of the longer list leaves first, the fact of lists equally long.

    ``items`` has query, kind ('fact' or 'episode'), place (from 1) and cost. What stays are the
    first n of an order that takes both lists in turn, then the rest of the longer one.
    """
    w = Window.partitionBy("query")
    f, e = (F.count_if(F.col("kind") == k).over(w) for k in ("fact", "episode"))
    short = F.least(f, e)
    turn = F.when(F.col("place") > short, short + F.col("place")).when(F.col("kind") == "fact", 2 * F.col("place")).otherwise(2 * F.col("place") - 1)
    return items.withColumn("turn", turn).withColumn("used", F.sum("cost").over(w.orderBy("turn"))).where(F.col("used") <= most)
