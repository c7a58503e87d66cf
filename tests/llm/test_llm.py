"""Operators on training text: against brute force on small data, and the cases their docstrings define."""

import datetime as dt
import random
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorevault.llm import conversations, keyword_spam, leaks, mixing, near_duplicates, neighbours, pii, pii_labels, queries, truncation
from lorevault.llm.common import words
from verify import plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    sql = queries.oracle_sql().get(name)
    if sql:
        c = duckdb.connect()
        c.execute("set timezone='UTC'")
        for p in Path(SF).glob("*.parquet"):
            c.execute(f"create view {p.stem} as select * from '{p}'")
        cur = c.execute(sql)
        order = [[d[0] for d in cur.description].index(x) for x in cols]
        assert got == Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def test_words():
    assert words("Ab_c 记忆x9  Ärger-2") == ["ab", "c", "记", "忆", "x9", "ärger", "2"]
    assert words(None) == words("") == words(" _ ") == []


# Near-duplicates


def similar_brute(texts, tenths=7, least=10):
    sets = {i: set(words(t)) for i, t in texts if i is not None}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 10 >= tenths * len(sets[a] | sets[b])}


def edited(rng, base, vocabulary):
    w = list(base)
    for _ in range(rng.randint(0, 5)):
        k = rng.random()
        if k < 0.4:
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif k < 0.7:
            w.insert(rng.randrange(len(w)), rng.choice(vocabulary))
        elif len(w) > 9:
            w.pop(rng.randrange(len(w)))
    rng.shuffle(w)
    return " ".join(w)


@pytest.mark.parametrize(("frequent", "hot", "met"), [(256, 1000, 1 << 15), (0, 0, 1 << 15), (2, 3, 1 << 15), (0, 0, 4), (2, 3, 2)])
def test_similar_pairs_against_all_pairs(spark, monkeypatch, frequent, hot, met):
    """Also where every signature is taken for a frequent one and is extended, and where those are dealt into blocks."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "and", "记", "忆"]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(9, 40))]
        texts += [edited(rng, base, vocabulary) for _ in range(rng.randint(1, 6))]
    texts += [texts[0], texts[0].upper(), None, "", "too short", "x " * 5000 + texts[3]]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    slots = 1 << 20

    def found(rows):
        # The same steps as in the tasks, here with other bounds.
        ids = [i for i, t in rows if i is not None and len(set(words(t))) >= 10]
        sets = [sorted({hash(w) & 0xFFFFFFFF for w in words(dict(rows)[i])}) for i in ids]
        n = np.array([len(s) for s in sets])
        start, word = np.cumsum(n) - n, np.array([w for s in sets for w in s], np.uint64)
        count = np.bincount((word % 4096).astype(int), minlength=4096)[(word % 4096).astype(int)].astype(np.int64)
        t = near_duplicates.Texts(start, n, word, count, 7)
        counts = np.bincount(near_duplicates.frequent_slots(t, slots, frequent), minlength=slots)
        key, text, plain_ = near_duplicates.signatures(t, np.array(ids), counts, frequent, hot, met)
        low = (key.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | plain_
        columns = {"bucket": [0], "keys": [low.view(np.int32)], "texts": [text.astype(np.int16)], "ids": [np.array(ids)], "sketches": [near_duplicates._sketch(t.start, t.n, t.word).ravel()]}
        batch = pa.RecordBatch.from_pydict(columns)
        return {(r["a"], r["b"]) for out in near_duplicates._join_bucket(iter([batch]), 7) for r in out.to_pylist()}

    want = similar_brute([(i, t) for i, t in data if t])
    assert want <= found([(i, t) for i, t in data if t])
    if frequent == 256:
        df = spark.createDataFrame(data, "ord long, summary string").withColumns({"id": F.lit("x"), "words": F.lit(1), "rep": F.lit(2), "a": F.lit(3)})
        assert {tuple(r) for r in near_duplicates.similar_pairs(df, "ord", "summary").collect()} == want
        groups = {r.id: r.group_id for r in near_duplicates.groups(df, "ord", "summary").collect()}
        assert all(groups[a] == groups[b] for a, b in want)
        assert set(groups) == {i for i, t in data if i is not None and len(set(words(t))) >= 10}


def test_segments_hold_the_bound():
    for s in range(10, 60):
        for t in range(-(-7 * s // 10), 10 * s // 7 + 1):
            d = near_duplicates.max_difference(s, t, 7)
            both = (s + t - d) // 2
            assert both * 10 >= 7 * (s + t - both) and (both - 1) * 10 < 7 * (s + t - both + 1)
            m = next(g for g in near_duplicates.GRID if g > d // 2)
            assert m in near_duplicates.segment_numbers(s, 7) and m in near_duplicates.segment_numbers(t, 7) and 2 * m > d


def test_similar_empty(spark):
    df = spark.createDataFrame([], "ord long, summary string")
    assert near_duplicates.similar_pairs(df, "ord", "summary").collect() == []
    assert near_duplicates.groups(df, "ord", "summary").collect() == []


# Truncation


def digests():
    rng = random.Random(2)
    names = [f"{a}{b}{c}" for a in ("mal", "tor", "ven") for b in ("a", "o", "i") for c in ("dor", "vik", "gim")]
    line = lambda: rng.choice(["The queue in {} grew by {} rows", "Nobody owns the note of {} since {}", "Ticket {} waits for {} pages"]).format(rng.choice(names), rng.randint(10, 9999))
    out = []
    for i in range(300):
        text = "\n".join(f"- {line()}" + rng.choice([".", ""]) for _ in range(rng.randint(3, 9)))
        out.append((f"d{i}", text, "a" if i % 2 else None, False))
    cut = []
    for i in range(60):
        text = "\n".join(f"- {line()}." for _ in range(12))
        cut.append((f"c{i}", text[:240], "a", True))
    return out, cut


def test_truncation(spark):
    whole, cut = digests()
    odd = [("n", None, "a", False), ("e", "", "a", False), ("b", " \n　", "a", False), ("s", whole[0][1] + "\n- The queue …", "b", True), ("m", whole[0][1] + "\n- The `queue in", "b", True), ("h", whole[0][1] + "\n## Next", "b", True), ("l", whole[0][1] + "\n" + "- Ticket x waits for 3 pages.\n" * 3000, "b", False)]
    df = spark.createDataFrame([(i, t, g) for i, t, g, _ in whole + cut + odd + cut[:3]], "digest_id string, content string, generator string").withColumns({"row": F.lit(1), "source": F.lit(2), "reason": F.lit("x")})
    judged = truncation.truncated(df, "digest_id", "content", "generator")
    got = {r.row: r for r in judged.collect()}
    assert not {"n", "e", "b"} & set(got)
    assert {r.row for r in got.values() if r.reason == "dropped"} == {"s"} and got["m"].reason == "open" and got["h"].reason == "heading" and not got["l"].cut
    assert np.mean([got[i].cut for i, *_ in cut]) > 0.8
    assert np.mean([got[i].cut for i, *_ in whole]) < 0.02
    s = {(r.source, r.measure, r.length) for r in truncation.spikes(df.select(F.col("generator").alias("source"), F.char_length("content").alias("n_chars"), F.octet_length("content").alias("n_bytes"))).collect()}
    assert ("a", "n_chars", 240) in s
    shares = {r.source: r.n_texts for r in truncation.cut_shares(judged).collect()}
    assert shares[None] == 150 and shares["a"] == 150 + 63


def test_truncation_empty(spark):
    df = spark.createDataFrame([], "digest_id string, content string, generator string")
    assert truncation.truncated(df, "digest_id", "content", "generator").collect() == []


# Conversations


def anchor_rows(sessions):
    out = []
    for session, messages in sessions.items():
        for seq, event, speaker, quote in messages:
            out.append((f"{session}{seq}", session, seq, event, speaker, quote, "x"))
    return out


ANCHORS = "anchor_id string, session_id string, seq int, event_type string, speaker string, quote string, role string"


def test_conversations(spark):
    u, a, t = "user_message", "assistant_message", "tool_call"
    sessions = {
        "good": [(1, "session_start", "system", None), (2, u, "user", "hi"), (3, t, "tool", None), (4, "unknown", "助手", "yes")],
        " GOOD2 ": [(1, "unknown", "Human ", "hi"), (2, u, None, " 　​"), (3, a, None, "ok"), (3, a, None, "ok")],
        "gap": [(1, u, None, "hi"), (3, a, None, "ok")],
        "late": [(2, u, None, "hi"), (3, a, None, "ok")],
        "conflict": [(1, u, None, "hi"), (2, a, None, "ok"), (2, a, None, "other")],
        "nullconflict": [(1, u, None, "hi"), (2, a, None, "ok"), (2, a, None, None)],
        "silent": [(1, u, None, "  "), (2, a, None, "ok")],
        "unanswered": [(1, u, None, "hi"), (2, u, None, "there"), (3, a, None, "ok")],
        "open": [(1, u, None, "hi"), (2, a, None, "ok"), (3, u, None, "more"), (4, a, None, "")],
        "": [(1, u, None, "hi")],
        None: [(1, u, None, "hi")],
        "nothing": [(None, u, None, "hi")],
    }
    df = spark.createDataFrame(anchor_rows(sessions), ANCHORS)
    got = {r.session_id: r for r in conversations.verdicts(df).collect()}
    assert {k for k, r in got.items() if not r.dropped} == {"good", "good2"}
    assert set(got) == {"good", "good2", "gap", "late", "conflict", "nullconflict", "silent", "unanswered", "open"}
    assert got["gap"].gap and got["late"].gap and got["conflict"].conflict and got["nullconflict"].conflict and got["silent"].empty and got["unanswered"].unanswered and got["open"].unanswered
    kept = [(r.session_id, r.seq, r.role) for r in conversations.conversations(df).collect()]
    assert sorted(kept) == [("good", 1, "system"), ("good", 2, "user"), ("good", 3, "tool"), ("good", 4, "assistant"), ("good2", 1, "user"), ("good2", 2, "user"), ("good2", 3, "assistant")]


def test_conversations_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 5)
    rng = random.Random(4)
    sessions = {}
    for i in range(40):
        n = rng.randint(1, 40)
        roles = [rng.choice(["user_message", "assistant_message", "tool_call"]) for _ in range(n)] if i % 2 else ["user_message", "tool_call", "assistant_message"] * (n // 3 + 1)
        sessions[f"s{i}"] = [(j + 1, r, None, rng.choice(["x", "x", "x", None]) if i % 2 else "x") for j, r in enumerate(roles)]
    bad = set()
    for s, m in sessions.items():
        told = [r[0] for _, r, _, q in m if q and r[0] in "ua"]
        if "u" not in told or any(x == "u" and (told + ["u"])[k + 1] == "u" for k, x in enumerate(told)):
            bad.add(s)
    got = {r.session_id for r in conversations.verdicts(spark.createDataFrame(anchor_rows(sessions), ANCHORS)).where("dropped").collect()}
    assert got == bad and 0 < len(bad) < 40


def test_conversations_empty(spark):
    assert conversations.verdicts(spark.createDataFrame([], ANCHORS)).collect() == []


# Personal information


def places(row):
    """The text of a labelled row and its marked places."""
    text, found, at = "", set(), 0
    row = row.replace("\\n", "\n")
    for m in pii.MARKED.finditer(row):
        text += row[at : m.start()]
        found.add((len(text), len(text) + len(m[2]), pii_labels.KINDS[m[1]]))
        text += m[2]
        at = m.end()
    return text + row[at:], found


def test_personal_information_held_out():
    """Frames that weren't trained on, a quarter at a time: right and found places of every kind, whole and in part."""
    frames = pii_labels.WITH.splitlines(), pii_labels.WITHOUT.splitlines()
    n = {k: Counter() for k in pii_labels.KINDS.values()}
    for part in range(4):
        model = pii.Field(pii_labels.labelled(frames=tuple([f for i, f in enumerate(x) if i % 4 != part] for x in frames)))
        rows = [places(r) for r in pii_labels.labelled(6, 99, tuple([f for i, f in enumerate(x) if i % 4 == part] for x in frames), 0)]
        found = dict(pii._found([t for t, _ in rows], model))
        for i, (_, want) in enumerate(rows):
            got = set(found.get(i, []))
            for k, c in n.items():
                g, w = [x for x in got if x[2] == k], [x for x in want if x[2] == k]
                c["whole"] += len(set(g) & set(w))
                c["found"] += sum(any(a < y and x < b for a, b, _ in g) for x, y, _ in w)
                c["right"] += sum(any(a < y and x < b for a, b, _ in w) for x, y, _ in g)
                c["got"] += len(g)
                c["want"] += len(w)
    print({k: {"whole, precision": c["whole"] / c["got"], "whole, recall": c["whole"] / c["want"], "precision": c["right"] / c["got"], "recall": c["found"] / c["want"]} for k, c in n.items()})
    for c in n.values():
        assert c["right"] >= 0.82 * c["got"] and c["found"] >= 0.8 * c["want"] and c["whole"] >= 0.7 * c["want"]


def test_personal_information(spark):
    data = [
        (1, "Contact: Mirela Darnov, mirela.d@post.example, +1 250 555 0183. The queue in maldor-sync grew by 8012 seconds."),
        (2, "See git@code.example:team/repo.git and tool@1.2.3 (row 7051951004) (@some-reviewers)"),
        (3, None),
        (4, ""),
        (5, "my address is 172 Tuldor Avenue, Iskmar, please keep it"),
        (6, "passport or ID: 666-53-2985"),
        (1, "call me on 563-555-0105 ext. 362"),
        (7, "plain words " * 20000 + "cc someone@mail.example.org"),
    ]
    df = spark.createDataFrame(data, "id long, quote string").withColumns({"row": F.lit("r"), "text": F.lit("t"), "pii_kind": F.lit("k")})
    got = {(r.row, r.pii_kind) for r in pii.personal(df, "id", "quote").collect()}
    assert got == {(1, "person_name"), (1, "email"), (1, "phone"), (5, "street_address"), (6, "identity_number"), (7, "email")}
    text = {(r.row, r.n_places): r.text for r in pii.masked(df, "id", "quote").collect()}
    assert text[1, 3] == "Contact: [PERSON_NAME], [EMAIL], [PHONE]. The queue in maldor-sync grew by 8012 seconds."
    assert text[2, 0] == data[1][1] and text[3, 0] is None and text[4, 0] == ""


def test_personal_information_empty(spark):
    df = spark.createDataFrame([], "id long, quote string")
    assert pii.personal(df, "id", "quote").collect() == [] and pii.masked(df, "id", "quote").collect() == []


# Neighbours


def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.7 * rng.standard_normal((3000, 16))
    x[100] = x[7]
    x[200:215] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(9000, None), (9001, [1.0] * 5), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "rowid long, embedding array<float>").withColumns({"id": F.lit("c"), "v": F.lit(1), "other": F.lit(2)}).repartition(7)
    got = {}
    for r in neighbours.nearest(df, 5).collect():
        got.setdefault(r.id, {})[r.rank] = (r.other, r.similarity)
    assert set(got) == set(range(3000)) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    n = np.float32(x)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    s = n @ n.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len({o for o, _ in got[i].values()} & set(best[i].tolist())) / 5 for i in range(3000) if not 200 <= i < 215 and i != 50]) >= 0.9
    assert got[7][1][0] == 100 and got[100][1][0] == 7
    assert [got[210][k][0] for k in range(1, 6)] == [50, 200, 201, 202, 203]
    pairs = {(r.id_a, r.id_b) for r in neighbours.mutual(neighbours.nearest(df, 5), 0.95, df).collect()}
    assert (7, 100) in pairs and all(a < b for a, b in pairs)


def test_neighbours_of_few(spark):
    schema = "rowid long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], schema), 3).collect() == []
    assert neighbours.nearest(spark.createDataFrame([(1, [1.0, 2.0])], schema), 3).collect() == []
    two = neighbours.nearest(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], schema), 3).collect()
    assert sorted((r.id, r.other) for r in two) == [(1, 2), (2, 1)]


# Leaks


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_leaks_against_all_windows(spark, monkeypatch, shard):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(f"i{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for k in range(12)]
    items += [("same", items[0][1]), ("null", None), ("empty", "")]
    docs = []
    for d in range(60):
        text = " ".join(rng.choice(vocabulary + ["other"]) for _ in range(rng.randint(0, 60)))
        if d % 3 == 0:
            w = items[rng.randrange(12)][1].split()
            a = rng.randrange(max(1, len(w) - 12))
            text += " -- " + " ,\n".join(x.upper() for x in w[a : a + rng.randint(5, 30)]) + " end"
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, "x " * 30000 + items[0][1]), (0, docs[0][1])]
    pairs = {}
    for i, p in items:
        w = words(p)
        for k in range(len(w) - 7):
            pairs.setdefault(tuple(w[k : k + 8]), set()).add(i)
    want = {(d, i) for d, w in ((d, words(t)) for d, t in docs) for k in range(max(0, len(w) - 7)) for i in pairs.get(tuple(w[k : k + 8]), ())}
    monkeypatch.setattr(leaks, "SHARD_WORDS", shard)
    monkeypatch.setattr(leaks, "PASS_WORDS", 60)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    e = spark.createDataFrame(items, "item_id string, passage string").withColumn("doc_id", F.lit(5))
    got = leaks.leaks(d, e, 8).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    texts, passages = dict(docs), dict(items)
    for r in got:
        a, b = words(texts[r.doc_id]), words(passages[r.item_id])
        assert a[r.doc_word : r.doc_word + r.n_words] == b[r.item_word : r.item_word + r.n_words]
        assert a[r.doc_word + r.n_words : r.doc_word + r.n_words + 1] != b[r.item_word + r.n_words : r.item_word + r.n_words + 1] or r.doc_word + r.n_words == len(a)
    assert {r.doc_id for r in leaks.without_leaks(d, e, 8).collect()} == {x for x, _ in docs} - {x for x, _ in want}


def test_leaks_empty(spark):
    d, e = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id string, passage string")
    assert leaks.leaks(d, e).collect() == []


# Mixing


def test_mix_reaches_the_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = random.Random(9)
    docs = [(i, " ".join(["word"] * rng.randint(1, 60)), rng.choice(["A b", "a-b ", "a_b"]) if i % 3 else "C") for i in range(900)]
    docs += [(1000, None, "C"), (1001, "", "C"), (1002, "text", None), (1003, "text", "unlisted")]
    targets = [("a_b", 0.3, 2), ("c", 0.6, 3), ("none", 0.1, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"p": F.lit("x"), "bucket": F.lit(1), "copies": F.lit(9)})
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed = mixing.mix(d, t)
    rows = {r.doc_id: r for r in mixed.collect()}
    assert not {1000, 1001, 1002, 1003} & set(rows)
    limit = {"a_b": 2, "c": 3}
    assert all(1 <= r.copies <= limit[r.source] for r in rows.values())
    rep = {r.source: r for r in mixing.report(mixed, t).collect()}
    total = sum(r.tokens for r in rep.values())
    assert abs(rep["a_b"].tokens - total / 3) < 130 and rep["none"].tokens == 0
    # A total that is given, and copies that differ by one at most.
    assert abs(sum(r.copies * r.n_tokens for r in mixing.mix(d, t, total_tokens=9000).collect()) - 9000) < 150


def test_pivot_keeps_tokens_and_expectation():
    pdf = pd.DataFrame({"doc_id": range(60), "n_tokens": [3 + i % 7 for i in range(60)], "nth": 0, "p": 0.37})
    mean = np.zeros(60)
    for seed in range(400):
        out = mixing.pivot(pdf, seed).sort_values("doc_id")
        assert ((out.p > 0) & (out.p < 1)).sum() <= 1
        assert (out.p * out.n_tokens).sum() == pytest.approx(0.37 * pdf.n_tokens.sum())
        mean += out.p.to_numpy() / 400
    assert abs(mean - 0.37).max() < 0.12


def test_mix_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert mixing.mix(d, t).collect() == []
    assert mixing.mix(spark.createDataFrame([(1, "x", "a")], d.schema), t.limit(0)).collect() == []


# Keyword spam


def test_keyword_spam(spark):
    rng = random.Random(10)
    phrases = ["cheap recall tool", "best skill pack", "fast vector box", "top agent hosting"]
    plain_ = lambda: " ".join(f"{rng.choice(['we', 'they'])} moved {rng.choice(['the', 'a'])} item{rng.randint(0, 400)} to shelf{rng.randint(0, 400)} because of rule{rng.randint(0, 400)}." for _ in range(8))
    docs = [(i, plain_()) for i in range(80)]
    spam = [(100 + i, ", ".join(rng.choice(phrases) for _ in range(30))) for i in range(12)]
    spam += [(200, "\n".join(f"https://a{i}.example/x" for i in range(12))), (201, "\n".join(f"* [{rng.choice(phrases)}](https://a{i}.example/x)" for i in range(12))), (202, " ".join("#" + rng.choice(phrases).replace(" ", "") for _ in range(30)))]
    fine = [(300, None), (301, ""), (302, "-"), (303, plain_() + "\nhttps://a.example/x"), (304, "\n".join(f"{k}. {plain_()} (https://a{k}.example)" for k in range(4))), (305, " ".join(plain_() for _ in range(100)))]
    df = spark.createDataFrame(docs + spam + fine + spam[:1], "doc_id long, text string").withColumns({"spam": F.lit(1), "n_words": F.lit(2)})
    rows = keyword_spam.judged(df).collect()
    assert {r.doc_id for r in rows if r.spam} == {i for i, _ in spam}
    assert len(rows) == len(docs + spam + fine) + 1


def test_keyword_spam_empty(spark):
    assert keyword_spam.judged(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keyword_spam_counts_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 200) % 5000) for _ in range(1500)]
    n_pairs, n_words = Counter(), Counter()
    for t in texts:
        w = words(t)
        n_words.update(w)
        n_pairs.update(zip(w, w[1:]))
    total = sum(n_words.values())
    want = {i: np.mean([np.log(n_pairs[p] * total / (n_words[p[0]] * n_words[p[1]])) for p in zip(words(t), words(t)[1:])]) for i, t in enumerate(texts)}
    got = {r.doc_id: r.mean_pmi for r in keyword_spam.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_keyword_spam_among_many_others(spark):
    rng = np.random.default_rng(6)
    phrases = [f"front{i} back{i}" for i in range(20)]
    vocabulary = np.array([f"v{i}" for i in range(20000)])
    # Every phrase: in 12 documents, 3 of which repeat it.
    docs = [(i, ", ".join(rng.permutation(phrases * 3))) for i in range(3)]
    docs += [(3 + i, " ".join(f"{p} {' '.join(rng.choice(vocabulary, 6))}" for p in phrases)) for i in range(8)]
    page = (100, ", ".join(phrases))
    others = [(1000 + i, " ".join(w)) for i, w in enumerate(rng.choice(vocabulary, (6000, 400)))]
    for rows in (docs + [page], docs + [page] + others):
        judged = keyword_spam.judged(spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"]))).where("doc_id = 100").collect()
        assert [r.spam for r in judged] == [True]
