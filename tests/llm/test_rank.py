"""Ranked search against exhaustive scoring."""

import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import EDGES, SF_SMALL, make_docs

from credsight.llm import op13_rank as op13


def terms(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)


def brute(docs, items, k=20):
    ws = [(i, terms(t)) for i, t in docs]
    n_docs = sum(bool(w) for _, w in ws)
    total = sum(len(w) for _, w in ws)
    df = Counter(t for _, w in ws for t in set(w))
    out = []
    for item, text in sorted(set(items), key=repr):
        scores = []
        for i, w in ws:
            tf, score = Counter(w), 0
            for t in terms(text):
                if tf[t]:
                    m = 100 - 25 + 25 * len(w) * n_docs // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (
                        1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def make_items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").repartition(2)


def corpus(seed, n):
    r = random.Random(seed)
    vocab = ["the", "The", "a", "é", "naïve", "x9"] + [f"w{i}" for i in range(150)]
    weights = [300, 50, 200, 40, 10, 5] + [200 / (i + 1) for i in range(150)]
    return [(k, " ".join(r.choices(vocab, weights, k=r.randrange(1, 80)))) for k in range(n)]


def test_equals_exhaustive_scoring(spark):
    rows = EDGES + [(100 + i, t) for i, t in corpus(1, 300)] + [(900 + i, "tie of one id") for i in range(40)]
    items = [(i, t) for i, t in corpus(2, 25)] + [(3, "the tie of id"), (3, "the tie of id"), (None, "long x9 same row"),
                                                  (50, None), (51, ""), (52, "?!"), (53, "never seen"), (54, "ROW row Row")]
    want = brute(rows, items)
    docs = make_docs(spark, rows).selectExpr("*", "1 AS score", "'a' AS item_id", "2 AS rank")
    asked = make_items(spark, items).selectExpr("*", "1 AS key", "2 AS doc_id")
    for kw in ({}, {"dims": 8}, {"dims": 1}, {"block_chars": 300}):
        got = sorted(map(tuple, op13.search(docs, asked, **kw).collect()), key=repr)
        assert got == want, kw
    assert sorted(map(tuple, op13.search(docs, asked, k=3).collect()), key=repr) == brute(rows, items, 3)


def test_empty_tables(spark):
    docs, items = make_docs(spark, [(1, "a b")]), make_items(spark, [(1, "a")])
    assert op13.search(docs.where("false"), items).collect() == []
    assert op13.search(docs, items.where("false")).collect() == []
    assert op13.search(make_docs(spark, [(1, None), (2, "--")]), items).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([2, 16, 256]))
def test_bounds_are_never_below_scores(seed, dims):
    docs, items = corpus(seed, 30), corpus(seed + 1, 4)
    q = op13.Items([(i, t, 0) for i, t in items], dims)
    weight = np.array([1 + t % 97 for t in range(len(q.term))], np.int64)
    parts = []
    for _, t in docs:
        ids, tf = q.found(op13.words(t))
        parts.append((ids, op13.impacts(weight, ids, tf, len(op13.words(t)), 30, 1000)))
    sketch = op13.sketches(dims, q.coord, parts)
    for _, ids, times in q.items:
        bound = np.array(times) @ sketch[q.coord[ids]]
        for j, (a, b) in enumerate(parts):
            have = dict(zip(a.tolist(), b.tolist()))
            assert bound[j] >= sum(c * have.get(t, 0) for t, c in zip(ids, times))


def test_bounds_spare_most_documents():
    docs, items = corpus(5, 2000), corpus(6, 10)
    q = op13.Items([(i, t, 0) for i, t in items])
    df = Counter(t for _, x in docs for t in q.found(op13.words(x))[0].tolist())
    weight = np.array([op13.term_weight(2000, df[t]) for t in range(len(q.term))], np.int64)
    r = op13.Ranking(q, weight, 2000, sum(len(op13.words(t)) for _, t in docs), 5)
    for a in range(0, 2000, 500):
        r.add([i for i, _ in docs[a:a + 500]], [t for _, t in docs[a:a + 500]])
    assert r.rescored < 0.2 * 2000 * len(items)


def test_query_equals_sql(spark, duck):
    got = sorted(map(tuple, op13.op13_rank(spark, SF_SMALL).select("item_id", "rank", "doc_id", "score").collect()))
    assert got == sorted(duck.execute(op13.ORACLE).fetchall()) and got
