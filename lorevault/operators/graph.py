"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lorevault.session import stage


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components: node, component (its least node).

    Alternates large-star and small-star steps, which halve the depth of the
    trees in a logarithmic number of rounds; each round is written to the shared
    folder. More than ``max_rounds`` (enough for 2 ** 30 nodes in a row) is an error. Loops and repeated edges do no harm, null ends are left out, an
    empty table gives no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    before = None
    for _ in range(max_rounds):
        # Large star: larger neighbours go to the least neighbour of a node.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: smaller neighbours and the node itself go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = stage(small.where("u <> v").distinct(), "components")
        # Both sums change unless nothing does: every step only lowers the targets.
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components haven't settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (head, tail, ...) from each end: node, other; loops appear twice."""
    rest = [c for c in edges.columns if c not in ("head", "tail")]
    forth = edges.select(F.col("head").alias("node"), F.col("tail").alias("other"), *rest)
    return forth.unionByName(edges.select(F.col("tail").alias("node"), F.col("head").alias("other"), *rest))


def expansion(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.55, least: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """Best score of every edge met from the seeds: head, tail, score; for every set of seeds told apart by the columns ``by``.

    ``edges`` has head, tail, confidence, weight; ``seeds`` node, sim. A node is
    attained with the best value over its paths; each hop multiplies it by
    decay ** hop and the weight of the relation, values under ``least`` end.
    """
    adjacent = both_ways(edges.withColumn("edge", F.struct("head", "tail")))
    front = seeds.groupBy(*by, "node").agg(F.max("sim").alias("attained"))
    seen, scored = front.select(*by, "node"), None
    for hop in range(1, hops + 1):
        step = front.join(adjacent, "node").withColumn("value", F.round(F.col("attained") * decay**hop * F.col("weight"), 12)).where(F.col("value") >= least)
        s = step.select(*by, "edge", (F.col("confidence") * F.col("value") / (hop + 1) ** 0.5).alias("score"))
        scored = s if scored is None else scored.unionByName(s)
        front = step.groupBy(*by, F.col("other").alias("node")).agg(F.max("value").alias("attained")).join(seen, [*by, "node"], "left_anti")
        seen = seen.unionByName(front.select(*by, "node"))
    return scored.groupBy(*by, "edge").agg(F.max("score").alias("score")).select(*by, "edge.head", "edge.tail", F.round("score", 9).alias("score"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, rounds: int = 24, stage_every: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """Personalised PageRank with restart to the seeds: node, mass; for every set of seeds told apart by the columns ``by``.

    Undirected, weighted by ``weight``; a fixed number of rounds; the mass of a
    node without edges is lost. What is restarted joins the sums of a round as rows, so a
    round is a join and one aggregation; lineage is cut every few rounds.
    """
    adjacent = both_ways(edges.select("head", "tail", "weight"))
    out = adjacent.groupBy("node").agg(F.sum("weight").alias("total"))
    flow = stage(adjacent.join(out, "node").select("node", "other", (F.col("weight") / F.col("total")).alias("share")), "rank-flow")
    total = F.sum("sim").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    restart = stage(seeds.groupBy(*by, "node").agg(F.sum("sim").alias("sim")).select(*by, "node", (F.col("sim") / total).alias("mass")), "rank-restart")
    again = restart.select(*by, "node", (alpha * F.col("mass")).alias("mass"))
    mass = restart
    for i in range(rounds):
        moved = mass.join(flow, "node").select(*by, F.col("other").alias("node"), ((1 - alpha) * F.col("mass") * F.col("share")).alias("mass"))
        mass = moved.unionByName(again).groupBy(*by, "node").agg(F.sum("mass").alias("mass"))
        if (i + 1) % stage_every == 0:
            mass = stage(mass, "rank")
    return mass


def communities(edges: DataFrame, rounds: int = 12) -> DataFrame:
    """Label propagation: node, label.

    All nodes take at once the label of most weight (``weight``) among their
    neighbours and themselves, ties the least; stops when nothing changes or
    after ``rounds``. A node counts itself with its strongest edge, which keeps two
    nodes from swapping labels for ever.
    """
    adjacent = stage(both_ways(edges.select("head", "tail", "weight")).where("node <> other"), "labels-edges")
    own = adjacent.groupBy("node").agg(F.max("weight").alias("weight")).select("node", F.col("node").alias("other"), "weight")
    votes = stage(adjacent.unionByName(own), "labels-votes")
    labels = votes.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        count = votes.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.round(F.sum("weight"), 9).alias("v"))
        best = count.groupBy("node").agg(F.min(F.struct(-F.col("v"), F.col("label"))).getField("label").alias("label"))
        best = stage(best, "labels")
        same = best.join(labels.withColumnRenamed("label", "before"), "node").where("label <> before").isEmpty()
        labels = best
        if same:
            break
    return labels


def on_cycles(edges: DataFrame) -> DataFrame:
    """Edges (head, tail) that lie on a cycle of any length; loops are cycles.

    The paths double in length, written each round, until none is new. They are
    pairs of nodes, so edges that can't lie on a cycle, as nothing comes before
    or after them, leave first. Null ends are left out.
    """
    e = stage(edges.select("head", "tail").where("head is not null and tail is not null").distinct(), "cycles")
    n = e.count()
    while True:
        e = stage(e.join(e.select(F.col("tail").alias("head")).distinct(), "head", "left_semi").join(e.select(F.col("head").alias("tail")).distinct(), "tail", "left_semi").select("head", "tail"), "cycles")
        n, before = e.count(), n
        if n == before:
            break
    paths = e
    while True:
        further = paths.join(paths.select(F.col("head").alias("tail"), F.col("tail").alias("end")), "tail").select("head", F.col("end").alias("tail"))
        paths = stage(paths.unionByName(further).distinct(), "cycles")
        n, before = paths.count(), n
        if n == before:
            break
    return e.join(paths.select(F.col("tail").alias("head"), F.col("head").alias("tail")), ["head", "tail"], "left_semi")


def chain_ends(steps: DataFrame, a: str, b: str) -> DataFrame:
    """The end of the chain that starts at each ``a``, and its length: a, final_id, hops.

    The steps (a to b) double in length, written each round, until none goes on.
    A chain that runs into a cycle has no end: final_id and hops are null. Null
    ends are left out.
    """
    rows = steps.select(F.col(a), F.col(b).alias("final_id"), F.lit(1).cast("long").alias("hops"), F.lit(True).alias("moved"))
    chain = stage(rows.where(f"{a} is not null and final_id is not null"), "chains")
    most, covered = chain.count(), 1
    while True:
        following = chain.select(F.col(a).alias("final_id"), F.col("final_id").alias("next"), F.col("hops").alias("more"))
        chain = chain.join(following, "final_id", "left").select(a, F.coalesce("next", "final_id").alias("final_id"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("moved"))
        chain = stage(chain, "chains")
        # More steps than there are: what still moves goes round.
        if covered >= most or chain.where("moved").isEmpty():
            break
        covered *= 2
    return chain.select(a, F.when(~F.col("moved"), F.col("final_id")).alias("final_id"), F.when(~F.col("moved"), F.col("hops")).cast("int").alias("hops"))
