"""Depth and closure of graphs beyond one task equal the grouped pass."""

import random

from pyspark.sql import functions as F

from credsight.operators import graph as G


def tables(spark, seed=4):
    """Random graphs with cycles, self-edges, unknown ids, isolated nodes; graph 0 holds a third of all edges."""
    r = random.Random(seed)
    nodes, deps = [], []
    for g in range(12):
        size = 60 if g == 0 else r.randrange(1, 14)
        for s in range(1, size + 1):
            nodes.append((g, s, f"n{s}"))
            for p in range(r.choice([0, 1, 1, 2]) if g else 2):
                back = r.randrange(1, 5)
                deps.append((g, s, p, f"n{s - back}" if r.random() < 0.95 else f"n{min(size, s + r.randrange(3))}"))
    n = spark.createDataFrame(nodes, "graph_id long, seq long, node_id string")
    return n, spark.createDataFrame(deps, "graph_id long, seq long, dep_pos long, dep_id string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_depths_of_big_graphs(spark):
    n, d = tables(spark)
    # edges as given, with those forward in the insertion order: cycles
    e = d.join(n.select("graph_id", F.col("node_id").alias("dep_id")), ["graph_id", "dep_id"]).join(
        n, ["graph_id", "seq"]).select("graph_id", F.col("dep_id").alias("src"), F.col("node_id").alias("dst"))
    want = rows(G.depths(n, e))
    assert any(not r[3] for r in want) and max(r[2] for r in want) > 5
    for limit in (0, 30):
        assert rows(G.depths(n, e, big_edges=limit)) == want


def test_closure_of_big_graphs(spark):
    n, d = tables(spark, 5)
    seeds = n.where("seq % 3 = 0").select("graph_id", F.col("node_id").alias("seed_id")).unionByName(
        spark.createDataFrame([(0, "unknown")], "graph_id long, seed_id string"))
    want = rows(G.transitive_deps(n, d, seeds))
    assert len(want) > 500 and (0, "unknown", "unknown") in want
    for limit in (0, 30):
        assert rows(G.transitive_deps(n, d, seeds, big_edges=limit)) == want


def test_only_graphs_over_the_limit_take_the_joins(spark):
    _, d = tables(spark)
    assert [r[0] for r in G._big_graphs(d, 100).collect()] == [0] and G._big_graphs(d, 10_000) is None
