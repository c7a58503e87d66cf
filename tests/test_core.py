import datetime as dt
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorevault.functions import decay, sequences, text as T, vectors as V
from lorevault.operators import budget, graph, heavy_keys, knn, lexical
from lorevault.plans import episodes, memory, retrieval
from lorevault.sources import bundles
from lorevault.streaming import memory_stream as ms


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Heavy keys


def rows(spark, data):
    return spark.createDataFrame(data, "k string, at timestamp, s string, n_rows string, keys string, newest long")


def test_per_key_cases(spark):
    t = dt.datetime(2026, 1, 1)
    data = [("a", t, "s1", "x", "y", 1), ("a", t, "s1", "x", "y", 1), ("a", None, "s2", None, None, None), ("", t, None, "x", "y", 1), (None, t, "s", "x", "y", 1), ("b", None, None, "x", "y", 1)]
    out = {r.key_value: (r.n_rows, r.newest_us, r.n_sessions) for r in heavy_keys.per_key(rows(spark, data), "k", "at", F.col("s")).collect()}
    us = int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert out == {"a": (3, us, 2), "": (1, us, 0), "b": (1, None, 0)}


def test_per_key_empty(spark):
    assert heavy_keys.per_key(rows(spark, []), "k", "at", F.col("s")).collect() == []
    assert heavy_keys.heavy_keys(rows(spark, []), "k", "at").collect() == []


def test_one_key_holds_most(spark):
    df = spark.range(60_000, numPartitions=6).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), F.lit(None).cast("timestamp").alias("at"))
    per = heavy_keys.per_key(df, "k", "at")
    assert per.agg(F.sum("n_rows"), F.max("n_rows"), F.count("*")).first() == (60_000, 40_000, 20_001)
    assert [(r.key_value, r.n_rows, r.table_rows) for r in heavy_keys.heavy_keys(df, "k", "at", 0.5).collect()] == [("hot", 40_000, 60_000)]


def test_split_sends_on_many_keys(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(heavy_keys, "FLUSH_KEYS", 10)
    batches = [pa.RecordBatch.from_arrays([pa.array([f"k{i % 25}" for i in range(50)]), pa.array(range(50), pa.int64())], ["k", "t"])] * 2
    total = {}
    for b in heavy_keys._split_arrays(iter(batches), 4):
        for keys, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            for k, x in zip(keys, n):
                total[k] = total.get(k, 0) + x
    assert total == {f"k{i}": 4 for i in range(25)}


# Decay


def test_retention_of_a_day(spark):
    at, now = F.lit("2026-01-01").cast("timestamp"), F.lit("2026-01-02").cast("timestamp")
    assert one(spark, decay.stability(F.lit(0.9), F.lit(0))) == pytest.approx(21.6)
    assert one(spark, decay.retention(F.lit(0.9), F.lit(0), at, now)) == pytest.approx(math.exp(-24 / 21.6))
    assert one(spark, decay.retention(F.lit(0.9), F.lit(0), now, at)) == 1.0


def test_states_in_order(spark):
    at = F.lit("2026-01-01").cast("timestamp")
    states = [one(spark, decay.state(decay.retention(F.lit(0.2), F.lit(0), at, at + F.expr(f"interval {h} hours")))) for h in (0, 24, 200)]
    assert states[0] == "active" and states[-1] == "archived"


@pytest.mark.parametrize(("value", "importance", "confidence"), [(None, 0.5, 0.8), (float("nan"), 0.5, 0.8), (7.0, 1.0, 1.0), (-1.0, 0.05, -1.0), (0.4, 0.4, 0.4)])
def test_coercion(spark, value, importance, confidence):
    assert one(spark, decay.importance(F.lit(value).cast("double"))) == importance
    assert one(spark, decay.confidence(F.lit(value).cast("double"))) == confidence


# Text


def test_terms(spark):
    assert one(spark, T.terms(F.lit("The Lock_order of 会话回放 is x"))) == ["lock_order", "会", "话", "回", "放", "会话", "话回", "回放", "x"]
    assert one(spark, T.terms(F.lit(None).cast("string"))) == []
    assert one(spark, T.terms(F.lit("a" * 30))) == []


def test_small_text_functions(spark):
    assert one(spark, T.estimate_tokens(F.lit(""))) == 0
    assert one(spark, T.estimate_tokens(F.lit("abcdefg"))) == 3
    assert one(spark, T.estimate_tokens(F.lit("记忆"))) == 3
    assert one(spark, T.clip(F.lit("  abcdef  "), 4)) == "abc…"
    assert one(spark, T.clip(F.lit("abc"), 4)) == "abc"
    assert one(spark, T.slug(F.lit("Fix: the Build!"))) == "fix-the-build"
    assert one(spark, T.slug(F.lit("!!"))) == "skill"
    assert one(spark, T.project_slug(F.lit("https://me:pw@host.example/a/b.git"))) == "host-example-a-b"
    assert one(spark, T.project_slug(F.lit("git@host.example:a/b.git"))) == "host-example-a-b"
    assert one(spark, T.relation_key(F.lit(" Depends-On x"))) == "depends_on_x"
    assert one(spark, T.template(F.lit("open '/a b' /tmp/x 42"))) == "open <quoted> <path> <number>"
    assert one(spark, T.without_fences(F.lit("```json\n{}\n```"))) == "{}"


# Vectors and ranking


def test_cosine(spark):
    a = F.array(F.lit(1.0), F.lit(2.0), F.lit(0.0))
    assert one(spark, V.cosine(a, a)) == pytest.approx(1)
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, V.cosine(a, F.array(F.lit(float("nan")), F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, V.cosine(a, F.array(F.lit(1.0)))) is None


def test_nearest_cuts_ties_by_id(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)] + [(20, [0.0, 1.0]), (21, None), (22, [0.0, 0.0]), (23, [1.0])], "id long, v array<float>").repartition(5)
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0])], "q long, w array<float>")
    assert sorted((r.query, r.doc, r.place) for r in knn.nearest(v, "id", "v", q, "q", "w", 3).collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]
    assert knn.nearest(v, "id", "v", q.limit(0), "q", "w", 3).collect() == []


def test_within_where_a_batch_has_no_hit(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 == 1 else [0.0, 1.0]) for i in range(9)], "id long, v array<float>").coalesce(1)
    q = spark.createDataFrame([("a", [2.0, 0.0])], "q string, w array<float>")
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert sorted((r.query, r.doc) for r in knn.within(v, "id", "v", q, "q", "w", 0.85).collect()) == [("a", 1), ("a", 4), ("a", 7)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


@pytest.mark.parametrize("passes", [1, 3])
def test_counterparts_where_batches_have_no_hit(spark, tmp_path, monkeypatch, passes):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 64))
    # Rows below 300 are like no row of another project, the others like every fortieth, some of them just at the limit.
    data = [(i, (rng.normal(size=64) if i < 300 else base[i % 40] + rng.normal(size=64) * (0.3, 0.6)[i % 2]).tolist()) for i in range(600)]
    odd = [None, [], [1.0] * 63, [0.0] * 64, [float("nan")] * 64, [float("inf")] * 64, [None] * 64]
    data += [(600 + 20 * k, x) for k, x in enumerate(odd)] + [(-20, data[580][1]), (None, data[580][1]), (900, data[580][1])]
    spark.createDataFrame(data, "rowid long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/vectors.parquet")
    # An episode of two projects, some of none.
    owners = [(i, f"p{i % 7}" if i % 11 else None) for i in range(-20, 800)] + [(580, "q"), (590, "q")]
    spark.createDataFrame(owners, "ord long, project_id string").write.parquet(f"{tmp_path}/l2_episodes.parquet")
    if passes > 1:
        monkeypatch.setattr(knn, "ACROSS_QUERIES", 10)
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = sorted((r.id_a, r.id_b, r.similarity) for r in retrieval.queries()["JOI09"](spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    c = duckdb.connect()
    for name in ("vectors", "l2_episodes"):
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(c.execute("select id_a, id_b, similarity from (" + retrieval.oracle_sql()["JOI09"] + ")").fetchall())
    assert len(want) > 100 and got == want


@pytest.mark.parametrize("length", [1, 2, 3, 64])
def test_across_against_all_pairs(spark, length):
    """Vectors of few directions and of all, many of them in a line, of very unlike norms."""
    rng = np.random.default_rng(length)
    x = rng.normal(size=(1500, length)) * (10.0 ** -np.arange(length).clip(0, 3)) * 10.0 ** rng.integers(-15, 15, size=(1500, 1))
    x[::3] = x[0] * rng.uniform(0.5, 2, size=(500, 1))
    x = x.astype(np.float32)
    v = spark.createDataFrame([(i, f"g{i % 4}", r.tolist()) for i, r in enumerate(x)], "id long, g string, v array<float>")
    got = sorted((r.query, r.doc) for r in knn.across(v, "id", "g", "v", length, "id % 5 = 0", 0.9).collect())
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    i, j = np.nonzero(np.round(u @ u.T, 9) >= 0.9)
    assert got == [(a, b) for a, b in zip(i.tolist(), j.tolist()) if a % 5 == 0 and a % 4 != b % 4] and len(got) > 1000


def test_counterparts_are_rounded_once(spark):
    """The cosine, 0.8500005 less 2e-10, is below the middle of two values of six places, but not when rounded to nine first."""
    cos = 0.8500005 - 2e-10
    v = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [cos, math.sqrt(1 - cos * cos)])], "id long, g string, v array<double>")
    r = knn.across(v, "id", "g", "v", 2, "id = 0", 0.85).select("doc", F.round("similarity", 6).alias("s")).collect()
    assert [(x.doc, x.s) for x in r] == [(1, 0.85)]


def test_fusion_prefers_what_both_lists_have(spark):
    lists = spark.createDataFrame([(1, "x", 1, 1.0), (1, "y", 2, 1.0), (1, "y", 1, 1.0), (1, "z", 2, 1.0)], "query long, doc string, place int, weight double")
    assert lexical.fused(lists).orderBy(F.desc("fused")).first()["doc"] == "y"


def test_bm25_against_the_formula(spark):
    docs = [(1, "alpha beta beta"), (2, "alpha gamma"), (3, None), (4, "delta delta delta delta")]
    d = spark.createDataFrame(docs, "id long, t string")
    q = spark.createDataFrame([(9, "beta delta")], "q long, t string")
    n, avg = 4, (3 + 2 + 0 + 4) / 4
    idf = max(1e-6, math.log((n - 1 + 0.5) / 1.5))
    want = {1: idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg)), 4: idf * 4 * 2.2 / (4 + 1.2 * (0.25 + 0.75 * 4 / avg))}
    got = {r.doc: r.bm25 for r in lexical.bm25(d, "id", "t", q, "q", "t", 5).collect()}
    assert got == pytest.approx(want, abs=1e-8)


def test_lcs(spark):
    rng = random.Random(3)

    def lcs(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    data = [([rng.choice("abc") for _ in range(rng.randint(0, 7))], [rng.choice("abc") for _ in range(rng.randint(0, 7))]) for _ in range(40)]
    df = spark.createDataFrame(data, "a array<string>, b array<string>")
    for r in df.select("a", "b", sequences.lcs_length(F.col("a"), F.col("b")).alias("n"), sequences.lcs_ratio(F.col("a"), F.col("b")).alias("r")).collect():
        assert r.n == lcs(r.a, r.b)
        n = max(len(r.a), len(r.b))
        assert r.r == pytest.approx(r.n / n if n else 1.0)
    assert spark.createDataFrame([(["x", "x", "y", "x"],)], "a array<string>").select(sequences.collapsed(F.col("a"))).first()[0] == ["x", "y", "x"]


# Graph


def test_components_against_union_find(spark):
    rng = random.Random(5)
    e = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in e:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def test_components_empty(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_communities_split_two_cliques(spark):
    clique = lambda n: [(f"{n}{i}", f"{n}{j}", 1.0) for i in range(4) for j in range(i)]
    e = spark.createDataFrame(clique("a") + clique("b") + [("a0", "b0", 0.1)], "head string, tail string, weight double")
    labels = {r.node: r.label for r in graph.communities(e).collect()}
    assert {labels[f"a{i}"] for i in range(4)} == {"a0"} and {labels[f"b{i}"] for i in range(4)} == {"b0"}


def closing(edges):
    """Brute force: edges from whose tail the head is reached."""
    out = set()
    for head, tail in edges:
        seen, front = {tail}, [tail]
        while front:
            at = front.pop()
            for b in {b for a, b in edges if a == at} - seen:
                seen.add(b)
                front.append(b)
        if head in seen:
            out.add((head, tail))
    return out


def test_cycles_of_any_length(spark):
    rng = random.Random(3)
    ring = [(f"r{i}", f"r{(i + 1) % 11}") for i in range(11)]
    pairs = ring + [("r0", "x0"), ("x0", "x1"), ("x1", "x2"), ("e", "e")] + [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)]
    out = [tuple(r) for r in graph.on_cycles(spark.createDataFrame(pairs + ring[:2] + [(None, "r0")], "head string, tail string")).select("head", "tail").collect()]
    assert set(out) == closing(set(pairs)) and len(out) == len(set(out))


def test_cycles_of_all_trade(spark):
    sf = "/root/testdata/sf0.001"
    trade = set(duckdb.sql(f"select s_nationkey, c_nationkey from '{sf}/lineitem.parquet' join '{sf}/orders.parquet' on l_orderkey = o_orderkey join '{sf}/customer.parquet' on o_custkey = c_custkey join '{sf}/supplier.parquet' on l_suppkey = s_suppkey").fetchall())
    assert {tuple(r) for r in retrieval.queries()["GRA11"](spark, sf).select("head", "tail").collect()} == closing(trade)


def test_chains_of_any_length(spark, tmp_path):
    names = [f"c{i}" for i in range(31)]
    data = list(zip(names, names[1:])) + [("b", "c4"), ("x", "gone"), ("y", "z0"), ("z0", "z1"), ("z1", "z2"), ("z2", "z0"), ("self", "self"), ("c30", None)]
    spark.createDataFrame(data, "memory_id string, superseded_by string").write.parquet(f"{tmp_path}/l2_episodes.parquet")
    want = {n: ("c30", 30 - i) for i, n in enumerate(names[:30])} | {"b": ("c30", 27), "x": ("gone", 1)} | dict.fromkeys(["y", "z0", "z1", "z2", "self"], (None, None))
    assert {r.memory_id: (r.final_id, r.hops) for r in episodes.queries()["WRT04"](spark, str(tmp_path)).collect()} == want


def test_chains_empty(spark):
    assert graph.chain_ends(spark.createDataFrame([], "a string, b string"), "a", "b").collect() == []


def test_folded_summaries_of_all_rows(spark, tmp_path):
    data = [(1, "Plain ASCII"), (2, "\uff26\uff35\uff2c\uff2c Width \ufb01ne"), (3, None), (4, ""), (5, "Caf\u00c9\nline"), (5, "Caf\u00c9\nline")]
    spark.createDataFrame(data, "ord long, summary string").write.parquet(f"{tmp_path}/l2_episodes.parquet")
    out = sorted((r.ord, r.folded) for r in memory.queries()["STR01"](spark, str(tmp_path)).collect())
    assert out == [(1, "plain ascii"), (2, "full width fine"), (3, None), (4, ""), (5, "caf\u00e9\nline"), (5, "caf\u00e9\nline")]


# Budgets


def test_budgets(spark):
    df = spark.createDataFrame([("p", "a", 30, 1), ("p", "b", 90, 2), ("p", "c", 60, 3), ("p", "d", 20, 4), ("q", "e", 200, 1)], "g string, k string, cost int, o int")
    assert [r.k for r in budget.prefix(df, "cost", 100, ["g"], F.floor(F.col("o") / 2), [F.col("o")]).orderBy("o").collect()] == ["a"]
    assert sorted((r.k, r.used) for r in budget.greedy(df, "k", "cost", 100, ["g"], ["o"]).collect()) == [("a", 30), ("c", 90)]


def test_greedy_budget_of_a_large_group(spark):
    rng = random.Random(4)
    data = [("p", f"p{i}", 60, i) for i in range(2500)] + [("p", "cheap", 5, 2500)]
    data += [("q", f"q{i}", min(120, 3 + int(rng.expovariate(0.02))), i) for i in range(2500)] + [("q", "q_1", 1, 2501), ("q", "q_2", 1, 2502), ("q", "q_3", 0, 2503)]
    want, spent = set(), {"p": 0, "q": 0}
    for g, k, cost, _ in data:
        if cost >= 1 and spent[g] + cost <= 100:
            spent[g] += cost
            want.add((k, spent[g]))
    df = spark.createDataFrame(rng.sample(data, len(data)), "g string, k string, cost int, o int")
    assert ("cheap", 65) in want
    assert {(r.k, r.used) for r in budget.greedy(df, "k", "cost", 100, ["g"], ["o"]).collect()} == want


# Sources


def test_frontmatter():
    fields, body, problem = bundles.frontmatter("---\nname: fix-build\ntools: [read, 'edit']\nmetadata:\n  scope: org\n---\nDo it.\n")
    assert (fields, body, problem) == ({"name": "fix-build", "tools": "read,edit", "metadata.scope": "org"}, "Do it.\n", None)
    assert bundles.frontmatter("plain")[2] == "no header"
    assert bundles.frontmatter(None) == ({}, "", "no header")
    assert bundles.frontmatter("---\nname: x\n")[2] == "header isn't closed"


def test_bundles_rules_and_ledger(spark, tmp_path):
    for name, text in (("one", "---\nname: one\n---\nbody"), ("two", "broken"), (".hidden", "---\nname: h\n---\n")):
        (tmp_path / "skills" / name).mkdir(parents=True)
        (tmp_path / "skills" / name / "SKILL.md").write_text(text)
    got = {r.bundle: (r.fields.get("name"), r.problem) for r in bundles.skill_bundles(spark, f"file://{tmp_path}/skills").collect()}
    assert got == {"one": ("one", None), "two": (None, "no header")}
    (tmp_path / "rules").mkdir()
    for name, text in (("a.md", "12345"), ("b.md", "  "), ("c.md", "123"), ("d.md", "1234567")):
        (tmp_path / "rules" / name).write_text(text)
    assert [r.name for r in bundles.rules(spark, f"file://{tmp_path}/rules", 5, 10).collect()] == ["a.md", "c.md", "d.md"]
    assert bundles.rules(spark, f"file://{tmp_path}/rules", 5, 10).where("name = 'd.md'").first()["body"] == "12\n… see d.md"
    (tmp_path / "runs.json").write_text('{"skill":"s","outcome":"ok","started_at":"2026-01-01"}\nnot json\n{"skill":"s","outcome":"bad","started_at":"2026-01-02"}\n')
    r = bundles.last_rates(bundles.run_ledger(spark, f"file://{tmp_path}/runs.json"), 1).first()
    assert (r.skill, r.total, r.n_last, r.rate) == ("s", 2, 1, 0.0)


def test_markdown_round_trip(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/l2_episodes.parquet").select("project_id", "memory_id", "created_at", "summary")
    bundles.export_markdown(e, f"file://{tmp_path}/backup")
    back = bundles.import_markdown(spark, f"file://{tmp_path}/backup")
    key = lambda df: df.select("project_id", "memory_id", F.regexp_replace(F.coalesce("summary", F.lit("")), r"\s+", " ").alias("s"))
    assert key(e).exceptAll(key(back)).count() == 0 and back.count() == e.count()


def test_days_written_again_leave_the_others(spark, tmp_path):
    path = f"file://{tmp_path}/days"
    bundles.write_days(spark.createDataFrame([("2026-01-01", "a"), ("2026-01-02", "b")], "day string, body string"), path)
    bundles.write_days(spark.createDataFrame([("2026-01-02", "c")], "day string, body string"), path)
    assert sorted((str(r.day), r.value) for r in spark.read.text(path).collect()) == [("2026-01-01", "a"), ("2026-01-02", "c")]


# Streams


@pytest.fixture
def stream(spark):
    files = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(files).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))


def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def run(spark, df, name, tmp_path, mode):
    ms.start(df, name, str(tmp_path / name), mode).awaitTermination()
    return spark.table(name)


def test_stream_accesses(spark, stream, tmp_path):
    got = run(spark, ms.accesses(stream, "user_id", "ts"), "accesses", tmp_path, "complete")
    want = ms.accesses(events(spark), "user_id", "ts")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_stream_bursts(spark, stream, tmp_path):
    got = {tuple(r) for r in run(spark, ms.bursts(stream, "ts", "user_id", "12 hours"), "bursts", tmp_path, "append").collect()}
    want = {tuple(r) for r in ms.bursts(events(spark), "ts", "user_id", "12 hours").collect()}
    # Bursts that could still go on at the watermark aren't closed.
    end = max(r[2] for r in want)
    assert got <= want and all(r[2] > end - dt.timedelta(hours=12) for r in want - got)


def test_stream_once(spark, stream, tmp_path):
    twice = stream.unionByName(stream)
    got = run(spark, ms.captured_once(twice, "ts", "1 hour", ["event_id"]), "once", tmp_path, "append")
    assert got.count() == events(spark).count() == got.select("event_id").distinct().count()


def test_stream_heartbeat(spark, stream, tmp_path):
    s = stream.withColumn("write", F.col("event_type") == "purchase").select("user_id", "ts", "event_id", "write")
    got = sorted(tuple(r) for r in run(spark, ms.heartbeats(s, "user_id", ["ts", "event_id"], "write", 3), "beats", tmp_path, "append").collect())
    from lorevault.plans.catalog import Tables
    from lorevault.plans.procedures import stm04

    assert got == sorted((r.user_id, r.event_id) for r in stm04(Tables(spark, "/root/testdata/sf0.001")).collect())


def test_stream_windows(spark, stream, tmp_path):
    got = run(spark, ms.counts(stream, "ts", "1 day", None, ["event_type"], "0 seconds"), "days", tmp_path, "complete")
    assert got.agg(F.sum("n")).first()[0] == events(spark).count()


def test_hashed_vectors(spark):
    import zlib

    from lorevault.functions import embedding

    docs = [(1, "Fix build"), (2, "记忆x系统"), (3, None), (4, "")]
    got = {}
    for r in embedding.hashed(spark.createDataFrame(docs, "id long, t string"), "id", "t", 64).collect():
        got.setdefault(r.doc, np.zeros(64))[r.idx] = r.value
    for doc, names in ((1, [("w:fix", 1), ("w:build", 1)] + [(f"c:{w[i : i + n]}", 0.35) for w in ("fix", "build") for n in (1, 2, 3) if len(w) > n for i in range(len(w) - n + 1)]), (2, [("w:x", 1), *((f"h:{t}", 0.8) for t in ("记", "忆", "记忆", "系", "统", "系统")), ("n2:记忆", 0.3), ("n2:忆系", 0.3), ("n2:系统", 0.3), ("n3:记忆系", 0.3)])):
        want = np.zeros(64)
        for name, weight in names:
            h = zlib.crc32(name.encode())
            want[h % 64] += weight * (1 if h >> 16 & 1 else -1)
        assert got[doc] == pytest.approx(want / np.linalg.norm(want))
    assert set(got) == {1, 2}
