"""Running sums, rows before, budgets, questions, ranks for many seed sets, and file sinks: against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorevault.functions import text as T
from lorevault.operators import budget, graph
from lorevault.operators.near_rows import most_similar_before
from lorevault.operators.running import running
from lorevault.sources import bundles


def test_running_against_a_loop(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1, 2, 7])) for i in range(200)]
    df = spark.createDataFrame(rng.sample(data, len(data)), "g string, o int, v int").withColumn("used", F.lit("clash"))
    for how, before in (("sum", False), ("sum", True), ("max", False), ("max", True)):
        want, held = {}, {}
        for g, o, v in data:
            seen = held.setdefault(g, [])
            now = seen if before else seen + [v]
            known = [x for x in now if x is not None]
            want[o] = sum(known) if how == "sum" else max(known, default=None)
            seen.append(v)
        got = running(df, "out", F.col("v"), how, ["g"], F.floor(F.col("o") / 13), [F.col("o")], before)
        assert {r.o: r.out for r in got.collect()} == want and got.columns == ["g", "o", "v", "used", "out"]


def test_running_empty(spark):
    df = spark.createDataFrame([], "g string, o int, v int")
    assert running(df, "out", F.col("v"), "sum", ["g"], F.col("o"), [F.col("o")]).collect() == []


def test_most_similar_before_against_a_loop(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 6))
    x[120] = x[110]
    x[200] = x[20] * 2
    groups = rng.integers(0, 2, 300)
    data = [(int(g), i, [float(v) for v in row]) for i, (g, row) in enumerate(zip(groups, x))]
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for g in (0, 1):
        own = [i for i in range(300) if groups[i] == g]
        for place, i in enumerate(own):
            near = [(round(float(n[i] @ n[j]), 9), j) for j in own[max(0, place - 40) : place]]
            if near and max(near)[0] >= 0.8:
                want[i] = max(near)[1]
    df = spark.createDataFrame(data, "g long, o long, v array<double>").repartition(4)
    assert {r.row: r.before for r in most_similar_before(df, "g", "o", "v", 40, 0.8, part=50).collect()} == want and len(want) > 10


@pytest.mark.parametrize("most", [0, 35, 60, 1000])
def test_alternating_budget_against_popping(spark, most):
    rng = random.Random(5)
    data, want = [], set()
    for q in range(40):
        kept = {k: [rng.randint(0, 20) for _ in range(rng.randint(0, 7))] for k in ("fact", "episode")}
        data += [(q, k, i + 1, c) for k, costs in kept.items() for i, c in enumerate(costs)]
        while sum(map(sum, kept.values())) > most and any(kept.values()):
            kept["episode" if len(kept["episode"]) > len(kept["fact"]) or not kept["fact"] else "fact"].pop()
        want |= {(q, k, i + 1) for k, costs in kept.items() for i in range(len(costs))}
    df = spark.createDataFrame(data, "query long, kind string, place int, cost int")
    assert {(r.query, r.kind, r.place) for r in budget.alternating(df, most).collect()} == want


def test_keywords_chain_pairs(spark):
    df = spark.createDataFrame([(1, "记忆系统 记忆系统 the lock"), (2, "b b a a longer"), (3, None), (4, "the of"), (5, "ＦＵＬＬ width")], "k int, t string")
    got = {r.k: r.keywords for r in T.keywords(df, "k", "t", 12).collect()}
    assert got[2] == ["longer", "b", "a"] or got[2][0] in ("a", "b", "longer")
    assert "忆系统" in "".join(got[1]) or "记忆系统" in got[1]
    assert got[5] == ["width", "full"] and set(got) == {1, 2, 5}


def test_routes(spark):
    data = [(1, "Give me an overview"), (2, "How is a related to b"), (3, "what was it before"), (4, "alpha beta gamma delta omega zeta"), (5, "alpha"), (6, None), (7, "项目都有哪些"), (8, "A 和 B 之间 before")]
    got = {r.k: (r.kind, r.temporal) for r in T.route(spark.createDataFrame(data, "k int, t string"), "k", "t").collect()}
    assert got == {1: ("global", False), 2: ("relational", False), 3: ("temporal", True), 4: ("relational", False), 5: ("point", False), 6: ("point", False), 7: ("global", False), 8: ("relational", True)}


def test_rank_of_many_seed_sets_is_that_of_each(spark):
    rng = random.Random(7)
    e = spark.createDataFrame([(f"n{rng.randrange(20)}", f"n{rng.randrange(20)}", rng.choice([0.5, 1.0])) for _ in range(60)], "head string, tail string, weight double")
    seeds = [(q, f"n{rng.randrange(20)}", 0.1 + rng.random()) for q in "ab" for _ in range(3)]
    both = {(r.q, r.node): r.mass for r in graph.personalised_rank(e, spark.createDataFrame(seeds, "q string, node string, sim double"), by=("q",), rounds=8).collect()}
    for q in "ab":
        own = spark.createDataFrame([s[1:] for s in seeds if s[0] == q], "node string, sim double")
        assert {r.node: r.mass for r in graph.personalised_rank(e, own, rounds=8).collect()} == pytest.approx({n: m for (k, n), m in both.items() if k == q})


def test_components_that_do_not_settle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.components(chain, "a", "b", max_rounds=1)


def test_bundles_are_written_once(spark, tmp_path):
    root = str(tmp_path / "skills")
    bundles.create_bundle(root, "fix-build", {"title": "Fix: the build", "tools": ["read", "edit"]}, "Do it.")
    with pytest.raises(FileExistsError):
        bundles.create_bundle(root, "fix-build", {}, "again")
    with pytest.raises(ValueError):
        bundles.create_bundle(root, "Bad Name", {}, "x")
    with pytest.raises(ValueError):
        bundles.create_bundle(root, "one-more", {}, "x", most=1)
    fields = bundles.skill_bundles(spark, f"file://{root}").first()["fields"]
    assert fields == {"name": "fix-build", "title": "Fix: the build", "tools": "read,edit"}
    assert bundles.retire_bundle(root, "fix-build").endswith(".retired/fix-build") and (tmp_path / "skills" / ".retired" / "fix-build" / "SKILL.md").exists()
    bundles.create_rule(str(tmp_path / "rules"), "short-answers", "Short", "Be brief.")
    with pytest.raises(FileExistsError):
        bundles.create_rule(str(tmp_path / "rules"), "short-answers", "Short", "Again")


def test_project_memory_newest_day_first(spark, tmp_path):
    (tmp_path / "2026-01-01.md").write_text("# Day\nold one\n\nold two\n")
    (tmp_path / "2026-01-02.md").write_text("<!-- x -->\nnew one\nnew two\n")
    got = [(r.day, r.line) for r in bundles.project_memory(spark, f"file://{tmp_path}", 25).orderBy(F.desc("day"), "nth").collect()]
    assert got == [("2026-01-02", "new one"), ("2026-01-02", "new two"), ("2026-01-01", "old one")]


def test_restore_outcomes(spark, tmp_path):
    (tmp_path / "backup.md").write_text("## p\n- m1 | 2026-01-01T00:00:00 | text\n- m2 | 2026-01-01T00:00:00 | " + "x" * 30 + "\n- m3 | no time | text\n- m1 | 2026-01-02T00:00:00 | newer\n- m4 | 2026-01-01T00:00:00 | there\nnoise\n")
    known = spark.createDataFrame([("m4",)], "memory_id string")
    got = sorted((r.memory_id, r.outcome, len(r.summary)) for r in bundles.restored(spark, f"file://{tmp_path}/backup.md", known, 20).collect())
    assert got == [("m1", "imported", 5), ("m1", "repeated", 4), ("m2", "truncated", 20), ("m3", "failed", 4), ("m4", "known", 5)]
