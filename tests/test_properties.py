"""Property checks of SURVEY §5.3 on the derived fixtures (sf0.001)."""

import math

from pyspark.sql import functions as F

from conftest import SF_SMALL
from credsight.operators import advantage as A
from credsight.operators import graph as G
from credsight.sources.fixtures import dag_inputs, tokens, trajectories


def _traj(spark):
    tok = tokens(spark, SF_SMALL)
    return tok, trajectories(spark, SF_SMALL, tok)


def test_grpo_vectorised_equals_grpo(spark):
    _, t = _traj(spark)
    a = {r.traj_id: r.adv for r in A.grpo(t).collect()}
    b = {r.traj_id: r.adv for r in A.grpo_vectorized(t).collect()}
    assert a == b


def test_group_mean_of_grpo_is_zero(spark):
    _, t = _traj(spark)
    g = (A.grpo(t).join(t.select("traj_id", "uid"), "traj_id").groupBy("uid")
         .agg(F.count(F.lit(1)).alias("n"), F.avg("adv").alias("m")).filter("n >= 2"))
    assert all(abs(r.m) < 1e-9 for r in g.collect())


def test_role_grpo_without_penalty_equals_grpo_on_role_groups(spark):
    tok, t = _traj(spark)
    # unique gen_uid per row and no dummies: de-duplication is a no-op
    t = t.withColumn("gen_uid", F.col("traj_id").cast("string")).withColumn("is_dummy", F.lit(False))
    a = {r.traj_id: r.adv for r in A.role_penalised_grpo(t, tok, lam=0.0).collect()}
    b = {r.traj_id: r.adv for r in A.grpo(A.role_uid(t), key="role_uid").collect()}
    assert a.keys() == b.keys()
    assert all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_depth_increases_along_processed_edges(spark):
    n, d, _ = dag_inputs(spark, SF_SMALL)
    e = G.edges(n, d)
    dep = G.depths(n, e)
    src = dep.select("graph_id", F.col("node_id").alias("src"), F.col("depth").alias("ds"), F.col("processed").alias("ps"))
    dst = dep.select("graph_id", F.col("node_id").alias("dst"), F.col("depth").alias("dd"), F.col("processed").alias("pd"))
    j = e.join(src, ["graph_id", "src"]).join(dst, ["graph_id", "dst"]).filter("ps AND pd")
    assert j.count() > 0
    assert j.filter("dd <= ds").count() == 0
