"""Pruned search equals the full scan; recall of known nodes without a transcript."""

import numpy as np
import pytest

from credsight.operators import retrieve as B


def brute(docs, queries):
    """(qid, rank, doc) of distinct queries with their largest k."""
    ks = {}
    for qid, v, k in queries:
        if v is not None:
            ks[qid, tuple(v)] = max(k, ks.get((qid, tuple(v)), 0))
    out = []
    ids = [d for d, v in docs if v is not None]
    x = B._unit([v for _, v in docs if v is not None]) if ids else None
    for (qid, v), k in ks.items():
        s = np.round(x @ B._unit([v])[0], 12) if ids else []
        order = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:k]
        out += [(qid, r, ids[i], round(float(s[i]), 9)) for r, i in enumerate(order, 1)]
    return sorted(out, key=repr)


def search(spark, docs, queries, **kw):
    c = spark.createDataFrame(docs, "doc_id long, vec array<double>").repartition(3)
    q = spark.createDataFrame(queries, "qid string, vec array<double>, kk int")
    return sorted(((r.qid, r.rank, r.doc_id, round(r.score, 9)) for r in B.topk_search(c, q, "kk", **kw).collect()), key=repr)


def vectors(seed, n, dim=8, spread=0.2):
    """Vectors around a few directions, some of them equal or zero."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(6, dim))
    v = base[r.integers(0, 6, n)] + spread * r.normal(size=(n, dim))
    v[n // 2:n // 2 + 5] = v[0]
    v[-1] = 0
    return v.tolist()


@pytest.mark.parametrize("kw", [{}, {"clusters": 3, "sample": 5}, {"query_block": 4}])
def test_equals_the_full_scan(spark, kw):
    docs = [(100 - i, v) for i, v in enumerate(vectors(1, 90))] + [(500, None)]
    queries = [(f"q{i}", v, 1 + i % 4) for i, v in enumerate(vectors(2, 12))] + [
        ("all", vectors(3, 2)[0], 500), ("zero", [0.0] * 8, 3), (None, vectors(4, 2)[0], 2), ("gone", None, 2), ("none", vectors(5, 2)[0], 0)]
    assert search(spark, docs, queries, **kw) == [x for x in brute(docs, [q for q in queries if q[2] > 0])]


def test_equal_query_rows_are_one_query(spark):
    docs = [(i, v) for i, v in enumerate(vectors(6, 20))]
    q = vectors(7, 1 + 1)[0]
    got = search(spark, docs, [("a", q, 4), ("a", q, 2), ("b", q, 4)])
    assert got == brute(docs, [("a", q, 4), ("b", q, 4)]) and len({d for x, _, d, _ in got if x == "a"}) == 4


def test_empty_sides(spark):
    assert search(spark, [], [("a", [1.0, 0.0], 3)]) == []
    assert search(spark, [(1, [1.0, 0.0])], []) == []
    assert search(spark, [(1, None)], [("a", [1.0, 0.0], 3)]) == []


def test_rings_are_skipped():
    r = np.random.default_rng(8)
    dim, n = 16, 4000
    base = B._unit(r.normal(size=(20, dim)))
    x = B._unit(base[r.integers(0, 20, n)] + 0.1 * r.normal(size=(n, dim)))
    s = x @ base.T
    at, cos = s.argmax(axis=1), s.max(axis=1)
    rows = [{"row": str(i), "qid": i, "k": 5, "vec": v} for i, v in enumerate(x[:50])]
    best = B._Best(B._Queries(rows, base, x[:200]))
    order = np.lexsort((cos, at))
    for c in range(20):
        mine = order[at[order] == c]
        for a in range(0, len(mine), 50):
            m = mine[a:a + 50]
            best.scan(c, cos[m], m.astype(object), x[m])
    assert best.scored < 0.3 * 50 * n
    full = np.round(x[:50] @ x.T, 12)
    for i in range(50):
        assert list(best.kept[i][1]) == sorted(range(n), key=lambda j: (-full[i, j], j))[:5]


def test_recall_of_a_node_without_transcript(spark):
    nodes = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", ""), (1, 3, "c", "the line")],
                                  "graph_id long, seq long, node_id string, raw_text string")
    req = spark.createDataFrame([(i, 1, n, "line") for i, n in enumerate("abcd")], "req_id long, graph_id long, node_id string, goal string")
    got = {r.req_id: (r.outcome, r.text) for r in B.recall(req, nodes).collect()}
    assert [got[i][0] for i in range(4)] == ["empty_transcript", "empty_transcript", "ok", "unknown_node"]
    assert got[3][1] == "Node d not found. Available nodes: a, b, c"
