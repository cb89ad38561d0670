"""Graph documents: row-equal after write and read, defaults, unknown keys, order."""

import json

from credsight.operators import graph as G

NODE = ("graph_id long, seq long, node_id string, description string, prompt string, status string, answer string, explanation string, "
        "key_steps string, confidence string, uncertainties string, raw_text string, depth long, turns long, failure_reason string, extra string")
FIELDS = [c.split()[0] for c in NODE.split(", ")]


def tables(spark):
    rows = [(1, 2, 'q"uote', 'd "1"\n', "p\\", "Success", "ä", "", "k", "9%", "", "raw\ntext", 3, 7, None, None),
            (1, 1, "a", "", "", "", "", "", "", "", "", "", 0, 0, "timeout", '{"x":{"y":[1,2.5,null]},"z":"w"}'),
            (2, 1, "b", "x", "y", "Failed", "", "", "", "0%", "u", "", 1, 2, "llm_error: no", "{}")]
    n = spark.createDataFrame(rows, NODE)
    d = spark.createDataFrame([(1, 2, 1, "zz"), (1, 2, 0, "a")], "graph_id long, seq long, dep_pos long, dep_id string")
    e = spark.createDataFrame([(1, "a", 'q"uote', 0, 2)], "graph_id long, src string, dst string, dep_pos long, dst_seq long")
    return rows, n, d, e


def test_every_field_comes_back(spark):
    rows, n, d, e = tables(spark)
    docs = G.serialize(n, d, e)
    back = sorted(tuple(r[f] for f in FIELDS) for r in G.deserialize(docs).collect())
    assert back == sorted((*r[:-1], None if r[-1] == "{}" else r[-1]) for r in rows)
    deps = {(r.graph_id, r.node_id): (r.dependencies, r.n_edges) for r in G.deserialize(docs).collect()}
    assert deps == {(1, 'q"uote'): (["a", "zz"], 1), (1, "a"): ([], 1), (2, "b"): ([], 0)}
    assert [tuple(r) for r in G.deserialize_edges(docs).collect()] == [(1, 0, "a", 'q"uote')]
    # written again, the documents are the same: nodes in insertion order
    doc = {r.graph_id: r.doc for r in docs.collect()}
    assert list(json.loads(doc[1])["nodes"]) == ["a", 'q"uote'] and json.loads(doc[1])["nodes"]["a"]["x"] == {"y": [1, 2.5, None]}
    again = G.deserialize(docs).select(*FIELDS)
    assert {r.graph_id: json.loads(r.doc) for r in G.serialize(again, d, e).collect()} == {k: json.loads(v) for k, v in doc.items()}


def test_missing_keys_take_defaults(spark):
    docs = spark.createDataFrame([(1, '{"nodes": {"n2": {}, "n1": {"answer": "flat", "query_doc": {"confidence": "5%"}}, "n0": {"answer": "old"}}, "edges": []}'),
                                  (2, '{"nodes": {}}'), (3, "no json"), (4, None)], "graph_id long, doc string")
    got = {r.node_id: r for r in G.deserialize(docs).collect()}
    assert [got[i].seq for i in ("n2", "n1", "n0")] == [1, 2, 3]
    n = got["n2"]
    assert (n.description, n.status, n.dependencies, n.depth, n.turns, n.failure_reason, n.raw_text, n.extra) == ("", "", [], 0, 0, None, "", None)
    assert (got["n1"].answer, got["n1"].confidence, got["n0"].answer) == ("", "5%", "old")
