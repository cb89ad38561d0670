"""MinHash near-dedup with Bayesian screening against brute force."""

import random

import numpy as np
import pytest
import xxhash
from llm_cases import EDGES, SF_SMALL, make_docs

from credsight.llm import op11_bayes as op11


def words(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def linked(a, b):
    c = len(a & b)
    return bool(a) and bool(b) and 100 * c >= 80 * (len(a) + len(b) - c)


def components(rows):
    """Shingle set and root of every row."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        near = {j for x in s for j in where.get(x, ())}
        for j in near:
            if linked(s, sets[j]):
                root[find(i)] = find(j)
        for x in s:
            where.setdefault(x, []).append(i)
    return sets, [find(i) for i in range(len(rows))]


def brute(rows):
    sets, root = components(rows)
    low = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return sorted(((d, len(s), d if not s else low.get(r), True if not s else d == low.get(r))
                   for (d, _), s, r in zip(rows, sets, root)), key=repr)


def near_texts(seed, sizes=(1, 2, 3, 40), length=100, edits=(0, 0, 1, 2, 4)):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows, k = [], 1000
    for size in sizes:
        base = [r.choice(vocab) for _ in range(length)]
        for _ in range(size):
            t = list(base)
            for _ in range(r.choice(edits)):
                t[r.randrange(len(t))] = r.choice(vocab)
            if r.random() < 0.3:
                base = t                                # chains: the end is far from the beginning
            rows.append((k, " ".join(t)))
            k += 1
    r.shuffle(rows)
    return rows


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


ODD = [(40, "One\x0btwo\x0cTHREE\rfour"), (41, "one two three four"), (42, "one two three four five"), (43, "É x y z"), (44, "é x y z"),
       (45, "a b c"), (46, "A\tB  c"), (47, "a b c d"), (48, " \n\t"), (48, " \n\t"), (None, "null id twin of words here"), (None, "null id twin of words here")]


def test_bands_and_bounds():
    bands, rows = op11.choose_bands()
    assert bands * rows <= op11.MAX_ROWS and 1 - (1 - 0.8 ** rows) ** bands >= op11.RECALL
    least = op11.min_matches()
    assert least == sorted(least) and len(least) == op11.CHECKS // op11.STEP
    # the chance that a pair at the threshold is dropped, by simulation
    r = np.random.default_rng(1)
    m = np.cumsum((r.random((200_000, len(least), op11.STEP)) < 0.8).sum(axis=2), axis=1)
    assert (m < np.array(least)).any(axis=1).mean() < 6 * op11.MISS + 1e-4
    # and dissimilar pairs are dropped early
    m = np.cumsum((r.random((10_000, len(least), op11.STEP)) < 0.4).sum(axis=2), axis=1)
    assert (m[:, 1] < least[1]).mean() > 0.5 and (m < np.array(least)).any(axis=1).mean() > 0.99


def test_signatures_estimate_similarity():
    r = np.random.default_rng(2)
    mult = r.integers(1, 1 << 31, 2000).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    common = r.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    a, b = (np.unique(np.concatenate([common, r.integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2)])) for _ in range(2))
    x, y = (np.frombuffer(op11.check_bytes(op11.minhash(s, mult)), np.uint8) for s in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.04


@pytest.mark.parametrize("leaders", [0, 6])
def test_equals_brute_force(spark, leaders):
    rows = EDGES + ODD + near_texts(7) + near_texts(8, sizes=(5, 60), edits=(3, 4, 5, 6))
    docs = make_docs(spark, rows).selectExpr("*", "1 AS component_id", "2 AS th", "3 AS fp", "'k' AS kept")
    assert got(op11.link(docs, leaders=leaders)) == brute(rows)


def test_hot_bucket_in_blocks_and_runs(spark, monkeypatch):
    # near one another and rarely linked: what the leaders leave is cut into many blocks and runs
    rows = near_texts(9, sizes=(120, 30), length=60, edits=(3, 4, 5))
    want = brute(rows)
    assert len({c for _, _, c, _ in want}) > 10
    monkeypatch.setattr(op11, "BLOCK", 7)
    monkeypatch.setattr(op11, "RUN", 11)
    assert got(op11.link(make_docs(spark, rows), leaders=1)) == want
    monkeypatch.setattr(op11, "REST", 5)            # several leader rounds before the blocks
    assert got(op11.link(make_docs(spark, rows), leaders=3)) == want
    monkeypatch.setattr(op11, "HELD", 300)
    assert got(op11.link(make_docs(spark, rows), leaders=0)) == want


def test_deduplicate(spark):
    rows = EDGES + ODD + near_texts(3)
    docs = make_docs(spark, rows).selectExpr("*", "doc_id AS th", "7 AS one", "8 AS root")
    kept = op11.deduplicate(docs).collect()
    assert kept[0].asDict().keys() == dict.fromkeys(docs.columns).keys()
    worded = [r for r in kept if words(r.text)]
    assert {r.doc_id for r in worded} == {d for d, n, _, k in brute(rows) if n and k}
    sets, root = components(rows)
    of = {(d, t): r for (d, t), r in zip(rows, root)}
    # one text of every component, and none of its rows twice
    assert sorted(of[r.doc_id, r.text] for r in worded) == sorted({r for s, r in zip(sets, root) if s})
    assert sorted(repr((r.doc_id, r.text)) for r in kept if not words(r.text)) == sorted(repr(x) for x in rows if not words(x[1]))


def test_components_of_stars_chains_and_loops(spark):
    r = random.Random(1)
    edges = [(0, k) for k in range(1, 40)] + [(100 + k, 101 + k) for k in range(30)] + [(200, 200)] + [
        (300 + r.randrange(20), 300 + r.randrange(20)) for _ in range(15)]
    b = lambda x: x.to_bytes(4, "big")
    got = {bytes(x.fp): bytes(x.root) for x in op11.components(
        spark.createDataFrame([(b(x), b(y)) for x, y in edges], "a binary, b binary")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in edges:
        if x != y:
            root[find(x)] = find(y)
    assert {b(x) for x in root} == set(got)
    want = {}
    for x in root:
        want.setdefault(find(x), set()).add(b(x))
    have = {}
    for x, y in got.items():
        have.setdefault(y, set()).add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values())) and all(k in v for k, v in have.items())


def test_components_of_stars_take_few_steps(spark, monkeypatch):
    """Leader rounds give stars; their leaves meet in a few steps, whatever the prints are."""
    name = lambda *k: xxhash.xxh3_128_digest(repr(k).encode())
    edges = [(name(s), name(s, i)) for s in range(8) for i in range(100)]
    steps, write = [], op11.stored
    monkeypatch.setattr(op11, "stored", lambda sp, df, what: steps.append(what) or write(sp, df, what))
    got = {bytes(x.fp): bytes(x.root) for x in op11.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert len(got) == 8 * 101
    for s in range(8):
        assert len({got[name(s)]} | {got[name(s, i)] for i in range(100)}) == 1
    assert len(set(got.values())) == 8
    assert steps.count("op11-renamed") <= 2


def test_empty_table(spark):
    docs = make_docs(spark, [(1, "x")]).where("false")
    assert op11.link(docs).collect() == [] and op11.deduplicate(docs).collect() == []


def test_query_on_the_smallest_tables(spark, duck):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    have = got(op11.op11_bayes(spark, SF_SMALL))
    assert have == brute(rows)
    assert have == sorted(duck.execute(op11.ORACLE).fetchall(), key=repr)
