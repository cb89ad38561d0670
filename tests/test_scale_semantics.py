"""Whole results at any size and hand-worked cases: search, sampling, budgets, updates."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from credsight.functions.columns import MIX_MOD, mix_hash
from credsight.functions.ordering import running_sums
from credsight.operators import evaluate as V
from credsight.operators import graph as G
from credsight.operators import losses as L
from credsight.operators import metrics as M
from credsight.operators import retrieve as B
from credsight.operators import sampling as K


def test_search_answers_every_query(spark):
    r = np.random.default_rng(0)
    docs = r.integers(-3, 4, (60, 4)).astype(float)
    docs[7] = 0
    qs = {i: r.integers(-3, 4, 4).astype(float) for i in range(-2500, 2000)} | {None: np.ones(4), 5000: np.zeros(4)}
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "doc_id long, vec array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in qs.items()], "qid long, vec array<double>")
    got = B.topk_search(corpus, queries, 3, query_block=700, clusters=4, sample=25).collect()
    assert Counter(x.qid for x in got) == {q: 3 for q in qs}
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-300)
    by = {}
    for x in sorted(got, key=lambda x: x["rank"]):
        by.setdefault(x.qid, []).append(x)
    for q in (-2500, -1, 0, 1999, None, 5000):
        want = np.sort(unit(docs) @ unit(qs[q]))[::-1][:3]
        assert np.allclose([x.score for x in by[q]], want, atol=1e-12)
    assert [x.doc_id for x in by[5000]] == [0, 1, 2]                 # all ties: least ids


def test_search_without_queries_or_with_own_k(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "doc_id long, vec array<double>")
    none = spark.createDataFrame([], "qid long, vec array<double>")
    assert B.topk_search(corpus, none, 3).count() == 0
    q = spark.createDataFrame([(1, [1.0, 0.1], 1), (2, [1.0, 0.1], 9), (3, None, 2)], "qid long, vec array<double>, n int")
    assert [(x.qid, x.doc_id) for x in B.topk_search(corpus, q, "n").orderBy("qid", "rank").collect()] == [(1, 1), (2, 1), (2, 2)]


def test_open_page_falls_back_to_the_url(spark):
    pages = spark.createDataFrame([(1, "u1", "a"), (2, "u2", "b")], "page_id long, url string, html string")
    req = spark.createDataFrame([(10, 1, "u2"), (11, 99, "u2"), (12, None, "u1"), (13, 99, None)], "req_id long, docid long, url string")
    assert {r.req_id: r.page_id for r in B.open_page(req, pages).collect()} == {10: 1, 11: 2, 12: 1, 13: None}


def test_hash_neither_overflows_nor_keeps_order(spark):
    d = spark.range(4_000_000_000, 4_000_010_000).select("id", mix_hash(F.col("id"), 7).alias("h"))
    h = [r.h for r in d.collect()]
    assert min(h) >= 0 and max(h) < MIX_MOD and len(set(h)) > 9_990
    assert spark.range(1).select(mix_hash(F.lit(2**63 - 1), -(2**62)).alias("h")).first().h >= 0
    up = np.mean(np.diff(h) > 0)
    assert 0.45 < up < 0.55 and abs(np.mean(h) / MIX_MOD - 0.5) < 0.02


def test_draws_are_independent_and_take_whole_rows(spark):
    items = spark.range(1000).select("id", F.lit(1.0).alias("w"), (F.col("id") * 2).alias("payload"))
    got = K.weighted_draw(items, "id", "w", seed=1).collect()
    assert len(got) == 1000 and all(r.payload == 2 * r.id for r in got)
    times = Counter(Counter(r.id for r in got).values())
    # Poisson(1): about 368 once, 184 twice, 61 three times
    assert 310 < times[1] < 430 and 140 < times[2] < 230 and 35 < times[3] < 95
    heavy = spark.createDataFrame([(1, 3.0), (2, 1.0)], "id long, w double")
    share = Counter(r.id for r in K.weighted_draw(heavy, "id", "w", n=4000).collect())
    assert 2800 < share[1] < 3200
    assert K.weighted_draw(items.limit(0), "id", "w").count() == 0


def test_shuffles_depend_on_the_seed_and_caps_on_the_rollout(spark):
    d = spark.range(64)
    order = [[r.id for r in V.shuffle_batches(d, "id", s, batch=1).orderBy("batch_id").collect()] for s in (1, 2)]
    assert sorted(order[0]) == list(range(64)) and order[0] != order[1]
    assert [x - 1 for x in order[1][1:]] != order[0][:-1]
    ex = spark.range(90).select((F.col("id") % 3).alias("graph_id"), F.floor(F.col("id") / 3).alias("seq"),
                                F.lit(False).alias("on_chain"), F.lit(0).alias("depth"))
    kept = {}
    for r in M.trajectory_cap(ex, 6).collect():
        kept.setdefault(r.graph_id, set()).add(r.seq)
    assert [len(v) for v in kept.values()] == [5, 5, 5] and len({frozenset(v) for v in kept.values()}) == 3


def test_running_sums_with_null_and_several_keys(spark):
    rows = [(None, "a", 1), (None, "a", 2), (1, "a", 1), (1, None, 1), (1, None, 5), (1, "b", 1)]
    d = spark.createDataFrame(rows, "x int, y string, o int").withColumn("v", F.lit(2.0))
    got = {(r.x, r.y, r.o): (r._rank, r._cum_v) for r in running_sums(d.fillna("-", ["y"]).fillna(-1, ["x"]), ["o"], ["x", "y"], ["v"]).collect()}
    assert got == {(-1, "a", 1): (1, 2.0), (-1, "a", 2): (2, 4.0), (1, "a", 1): (1, 2.0), (1, "-", 1): (1, 2.0),
                   (1, "-", 5): (2, 4.0), (1, "b", 1): (1, 2.0)}


def test_budget_discards_observations_only_and_watches_the_live_context(spark):
    w = lambda n: " ".join(["x"] * n)
    rows = [(1, 0, "user", w(2700)), (1, 1, "user", w(400)), (1, 2, "assistant", w(1)),
            (2, 0, "assistant", w(2900)), (2, 1, "assistant", w(50)), (2, 2, "user", w(1)),
            (3, 0, "user", None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in M.context_budget(d, limit=3000).collect()}
    # 1: the 400-word observation goes, 299 tokens remain; 2: the model's own turns stay, the observation goes
    assert got == {1: (2701, 1, 400, 0, None), 2: (2950, 1, 1, 0, 0), 3: (0, 0, 0, None, None)}


def test_updates_of_one_node_are_one(spark):
    nodes = spark.createDataFrame([(1, "n1", "old", "keep")], "graph_id long, node_id string, a string, b string")
    upd = spark.createDataFrame([(1, "n1", "first", None, 1), (1, "n1", "last", None, 2), (1, "n9", "z", "z", 3)],
                                "graph_id long, node_id string, a string, b string, t int")
    assert [tuple(r) for r in G.apply_updates(nodes, upd, "t").collect()] == [(1, "n1", "last", "keep")]


def test_adaptive_kl_passes_zero_and_below(spark):
    # n / horizon = 10: the factor is 1 - 0.2 * 10 = -1 at a KL of 0, 1 + 2 = 3 at a high one
    steps = [(1, 0.0, 100_000), (2, 1.0, 100_000), (3, 0.0, 50_000), (4, 1.0, 10_000)]
    d = spark.createDataFrame(steps, "step long, kl double, n long")
    got = [r.kl_coef for r in L.adaptive_kl(d, 0.05, 0.02, 10_000).orderBy("step").collect()]
    assert got == pytest.approx([-0.05, -0.15, 0.0, 0.0])
    two = d.withColumn("run", F.lit("a")).unionByName(d.where("step <> 3").withColumn("run", F.lit("b")))
    last = {r.run: r.kl_coef for r in L.adaptive_kl(two, 0.05, 0.02, 10_000, run="run").where("step = 4").collect()}
    assert last == pytest.approx({"a": 0.0, "b": -0.18})


def test_rows_of_no_group_are_a_group(spark):
    from credsight.operators import advantage as A
    d = spark.createDataFrame([Row(traj_id=i, uid=u, score=float(i)) for i, u in enumerate(["a", "a", None, None])])
    got = {r.traj_id: r.adv for r in A.grpo(d, norm_by_std=False).collect()}
    assert got == {0: -0.5, 1: 0.5, 2: -0.5, 3: 0.5}
