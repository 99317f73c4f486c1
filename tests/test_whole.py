"""Queries over whole tables against brute force."""

import math
from collections import Counter, defaultdict
from datetime import datetime
from itertools import combinations

import numpy as np

from recallgrid.operators import fusion
from recallgrid.plans import catalog, health, linking, search
from recallgrid.sources.tables import JOURNAL_SQL, TRIPLES_SQL, vectors


def unit(spark, data):
    rows = vectors(spark, data).collect()
    x = np.array([r.vec for r in rows], float)
    return np.array([r.id for r in rows]), np.array([r.label for r in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)


def run(name, spark, data):
    return catalog.QUERIES[name](spark, data).collect()


def test_dense_topk(spark, data):
    ids, _, x = unit(spark, data)
    got = {(r.query_id, r["rank"]): r.score for r in run("dense_topk", spark, data)}
    asked = [i for i in ids.tolist() if i % 100 == 0]
    assert len(got) == 10 * len(asked)
    for i in asked:
        like = sorted((x[ids != i] @ x[ids == i][0]).tolist(), reverse=True)[:10]
        assert np.allclose([got[i, k + 1] for k in range(10)], like, atol=2e-6)


def test_dense_topk_beyond_a_block(spark):
    v = spark.createDataFrame([(i, [float(np.cos(i / 500)), float(np.sin(i / 500))]) for i in range(1100)], "id long, vec array<double>")
    got = fusion.dense_topk(v, v, 1).collect()
    assert sorted(r.query_id for r in got) == list(range(1100)) and all(abs(r.id - r.query_id) == 1 for r in got)


def test_part_graph(spark, db, data):
    held, seen = defaultdict(set), defaultdict(set)
    for order, part in db.execute("SELECT l_orderkey, l_partkey FROM lineitem").fetchall():
        held[order].add(part)
        seen[part].add(order)
    weight = Counter(p for parts in held.values() for p in combinations(sorted(parts), 2))
    assert {(r.a, r.b): r.weight for r in run("part_graph", spark, data)} == weight
    near = defaultdict(set)
    for a, b in weight:
        near[a].add(b)
        near[b].add(a)
    overlap = {(r.a, r.b): r.overlap for r in run("session_jaccard", spark, data)}
    assert overlap.keys() == weight.keys() and all(abs(v - weight[p] / len(seen[p[0]] | seen[p[1]])) < 2e-6 for p, v in overlap.items())
    shared = {(r.a, r.b): r.adamic_adar for r in run("adamic_adar", spark, data)}
    assert shared.keys() == weight.keys()
    assert all(abs(v - sum(1 / math.log(len(near[z])) for z in near[a] & near[b])) < 2e-6 for (a, b), v in shared.items())


def test_semantic_tiling(spark, monkeypatch):
    more = spark.createDataFrame([(i, [1.0, float(i % 2)], 1) for i in range(300)], "id long, vec array<double>, label int")
    monkeypatch.setattr(linking, "vectors", lambda spark, d: more)
    got = linking.semantic_tiling(spark, "").collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a in range(100, 300) for b in range(a + 1, 300) if (a - b) % 2 == 0}


def test_traverse(spark, db, data):
    facts = db.execute(f"WITH {TRIPLES_SQL} SELECT id, subject, object FROM triples").fetchall()
    one = {i for i, s, o in facts if 3 in (s, o)}
    ends = {e for i, s, o in facts if i in one for e in (s, o)}
    want = {i: 1 if i in one else 2 for i, s, o in facts if i in one or s in ends or o in ends}
    assert {r.id: r.depth for r in run("traverse", spark, data)} == want


def test_attention_buckets(spark, db, data):
    want = {}
    for e, ts in db.execute(f"WITH {JOURNAL_SQL} SELECT entity_id, ts FROM journal").fetchall():
        want[e] = max(want.get(e, ts), ts)
    name = lambda t: "active" if t >= datetime(2024, 1, 25) else "historical" if t >= datetime(2024, 1, 2) else "fading"
    assert {r.entity_id: r.attention for r in run("attention_buckets", spark, data)} == {e: name(t) for e, t in want.items()}


def test_prefetch_admission(spark, db, data):
    rows = db.execute("SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events ORDER BY ts, event_id").fetchall()
    state, want = {}, {}
    for i, ts, user, kind, value, k in rows:
        s = state.setdefault(user, {"tries": 0, "hits": 0, "last": {}})
        if user % 5 == 0:
            reason = "consumer_ui"
        elif value > 60:
            reason = "already_slow"
        elif k % 10 == 0:
            reason = "no_results"
        elif kind in s["last"] and (ts - s["last"][kind]).total_seconds() < 5:
            reason = "in_flight"
        elif s["tries"] > 50 and s["hits"] / s["tries"] < 0.05:
            reason = "low_hit_rate"
        else:
            reason = None
            s["tries"] += 1
            s["hits"] += k % 3 == 0
            s["last"][kind] = ts
        want[i] = reason
    assert {r.id: r.reason for r in run("stream_prefetch_admission", spark, data)} == want


def test_auto_merge(spark, data):
    ids, label, x = unit(spark, data)
    like = x @ x.T
    pairs = sorted({(round(float(like[i, j]), 6), int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i in np.flatnonzero(ids % 100 == 0) for j in range(len(ids)) if i != j and label[i] == label[j]}, key=lambda p: (-p[0], p[1], p[2]))[:40]
    gone, want = set(), []
    for _, a, b in pairs:
        if len(want) < 20 and a not in gone and b not in gone:
            gone.add(b)
            want.append((a, b))
    assert [(r.main, r.other) for r in run("auto_merge", spark, data)] == want


def test_grounded_sentences(spark, data):
    got = run("grounded_sentences", spark, data)
    assert {r.grounded for r in got} == {True, False} and len({(r.conv_id, r.sentence) for r in got}) == len(got)


def test_full_search_is_a_part_of_its_stages(spark, data):
    kept = {r.id: r.score for r in search.staged(search.candidates(spark, data), "exploratory").collect()}
    got = run("full_search", spark, data)
    assert got and all(r.score <= kept[r.id] + 1e-4 for r in got) and [r.score for r in got] == sorted((r.score for r in got), reverse=True)


def test_checks_are_isolated(spark, data, monkeypatch):
    def broken(spark, d):
        raise RuntimeError("no")

    monkeypatch.setitem(health.CHECKS, "stale", broken)
    got = health.run(spark, data, ["stale", "empty_content"], isolated=True).collect()
    assert [r.message for r in got if r.check_name == "stale"] == ["check failed: RuntimeError"]
    assert "# Health report" in health.markdown(spark.createDataFrame([], "section string, body string"))


def test_containing(spark):
    names = spark.createDataFrame([(1, "red widget", "a"), (2, "big red widget", "a"), (3, "red widget", "b"), (4, "widget", "a")], "id long, name string, kind string")
    assert {(r.a, r.b) for r in health.containing(names).collect()} == {(1, 2), (4, 1), (4, 2)}
