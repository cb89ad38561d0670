"""Queries for the DAG operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from credsight.operators import graph as G
from credsight.plans.catalog import query
from credsight.session import stored
from credsight.sources.fixtures import dag_inputs, dag_nodes, dag_verdicts, oracle_with  # noqa: F401


def _g(spark, sf):
    n, d, _ = dag_inputs(spark, sf)
    return n, d


_SUMMARY_SQL = """concat_ws(chr(10),
   CASE WHEN {p}node_id <> '' THEN '[Node ' || {p}node_id || '] ' || {p}description END,
   CASE WHEN {p}status <> '' THEN 'Status: ' || {p}status END,
   CASE WHEN {p}answer <> '' THEN 'Answer: ' || {p}answer END,
   CASE WHEN {p}explanation <> '' THEN 'Explanation: ' || {p}explanation END,
   CASE WHEN {p}key_steps <> '' THEN 'Key Steps: ' || {p}key_steps END,
   CASE WHEN {p}confidence <> '' THEN 'Confidence: ' || {p}confidence END,
   CASE WHEN {p}uncertainties <> '' THEN 'Uncertainties: ' || {p}uncertainties END)"""

_DL = """, dl AS (SELECT d.graph_id, n.node_id, d.dep_pos, d.dep_id FROM deps d JOIN gnodes n USING (graph_id, seq))"""


@query("dag_edges", "D1", oracle_with("edges") + """
SELECT graph_id, src, dst, dep_pos FROM edges""")
def q_dag_edges(spark, sf):
    n, d = _g(spark, sf)
    return G.edges(n, d).select("graph_id", "src", "dst", "dep_pos")


@query("dag_auto_ids", "D1,C8", oracle_with("gnodes") + """
SELECT graph_id, seq, node_id FROM gnodes WHERE spec_id = ''""")
def q_dag_auto_ids(spark, sf):
    n, _ = _g(spark, sf)
    return n.filter(F.col("spec_id") == "").select("graph_id", "seq", "node_id")


@query("dag_lookup", "D2", oracle_with("gnodes", "deps") + """
SELECT d.graph_id, count(*) AS n_deps, count(n.node_id) AS n_found
FROM deps d LEFT JOIN gnodes n ON n.graph_id = d.graph_id AND n.node_id = d.dep_id GROUP BY d.graph_id""")
def q_dag_lookup(spark, sf):
    n, d = _g(spark, sf)
    f = G.has_node(d.select("graph_id", F.col("dep_id").alias("node_id")), n)
    return f.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_deps"), F.count_if("found").alias("n_found"))


_APPLY_SQL = """, batches AS (SELECT DISTINCT graph_id, iteration AS b FROM gnodes),
plans AS (SELECT DISTINCT graph_id, iteration FROM verdicts),
prev AS (SELECT p.graph_id, p.iteration, max(b) AS prev_b FROM plans p JOIN batches USING (graph_id)
         WHERE b < p.iteration GROUP BY p.graph_id, p.iteration),
applied AS (SELECT v.graph_id, v.iteration, v.node_id, v.status
            FROM verdicts v JOIN prev USING (graph_id, iteration)
            JOIN gnodes n ON n.graph_id = v.graph_id AND n.node_id = v.node_id AND n.iteration = prev.prev_b)
"""


@query("dag_status_apply", "D12", oracle_with("gnodes", "verdicts") + _APPLY_SQL + """
SELECT graph_id, iteration, node_id, status FROM applied""")
def q_dag_status_apply(spark, sf):
    raw = dag_nodes(spark, sf)
    n = G.resolve_ids(raw)
    return G.applicable_verdicts(n, dag_verdicts(spark, sf, raw))


@query("dag_update", "D3", oracle_with("gnodes", "verdicts") + _APPLY_SQL + """,
upd AS (SELECT graph_id, node_id, arg_max(status, iteration) AS status FROM applied GROUP BY graph_id, node_id)
SELECT n.graph_id, n.node_id, coalesce(u.status, n.status) AS status, u.status IS NOT NULL AS updated
FROM gnodes n LEFT JOIN upd u USING (graph_id, node_id)""")
def q_dag_update(spark, sf):
    raw = dag_nodes(spark, sf)
    n = G.resolve_ids(raw)
    ap = G.applicable_verdicts(n, dag_verdicts(spark, sf, raw))
    upd = ap.groupBy("graph_id", "node_id").agg(F.max_by("status", "iteration").alias("status"))
    out = G.apply_updates(n, upd)
    hit = upd.select("graph_id", "node_id", F.lit(True).alias("updated"))
    return (out.join(hit, ["graph_id", "node_id"], "left")
            .select("graph_id", "node_id", "status", F.coalesce("updated", F.lit(False)).alias("updated")))


@query("dag_upstream_context", "D4,C13", oracle_with("gnodes", "deps") + _DL + f""",
summ AS (SELECT graph_id, node_id AS dep_id, {_SUMMARY_SQL.format(p='')} AS summary FROM gnodes),
agg AS (SELECT dl.graph_id, dl.node_id, count(*) AS n_deps, count(summary) AS n_found,
               string_agg(summary, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY dep_pos) AS ctx
        FROM dl LEFT JOIN summ USING (graph_id, dep_id) GROUP BY dl.graph_id, dl.node_id)
SELECT n.graph_id, n.node_id,
       CASE WHEN n_deps IS NULL THEN '[No upstream dependencies]'
            WHEN n_found = 0 THEN '[Upstream dependencies not found in graph]' ELSE ctx END AS context
FROM gnodes n LEFT JOIN agg USING (graph_id, node_id)""")
def q_dag_upstream_context(spark, sf):
    n, d = _g(spark, sf)
    return G.upstream_context(n, d)


@query("dag_refine_budget", "D5", oracle_with("gnodes") + """,
r AS (SELECT graph_id, seq,
             CASE WHEN contains(node_id, '_refine') THEN split_part(node_id, '_refine', 1) ELSE node_id END AS root,
             CASE WHEN contains(node_id, '_refine') THEN 1 ELSE 0 END AS is_ref
      FROM gnodes WHERE contains(node_id, '_refine') OR NOT starts_with(node_id, 't_'))
SELECT graph_id, root, CAST(sum(is_ref) + 1 AS BIGINT) AS attempts, sum(is_ref) + 1 >= 3 AS exhausted
FROM r GROUP BY graph_id, root HAVING sum(is_ref) + 1 > 1""")
def q_dag_refine_budget(spark, sf):
    n, _ = _g(spark, sf)
    return G.refine_budget(n).select("graph_id", "root", "attempts", "exhausted")


@query("dag_frontier", "D6", oracle_with("gnodes") + """
SELECT graph_id,
       coalesce(string_agg(node_id, ', ' ORDER BY seq) FILTER (WHERE status = ''), '') AS awaiting,
       coalesce(string_agg(node_id, ', ' ORDER BY seq) FILTER (WHERE status IN ('Uncertain', 'Not Found')), '')
         AS unresolved
FROM gnodes GROUP BY graph_id""")
def q_dag_frontier(spark, sf):
    n, _ = _g(spark, sf)
    return G.frontier(n)


@query("dag_final_answer", "D7,D8", oracle_with("gnodes") + """,
a AS (SELECT graph_id, arg_max(node_id, seq) FILTER (WHERE ends_with(node_id, '_answer')) AS answer_node_id,
             arg_max(answer, seq) FILTER (WHERE ends_with(node_id, '_answer')) AS a1,
             arg_max(answer, seq) FILTER (WHERE answer <> '') AS a2
      FROM gnodes GROUP BY graph_id)
SELECT graph_id, answer_node_id, coalesce(CASE WHEN a1 <> '' THEN a1 END, a2) AS final_answer FROM a""")
def q_dag_final_answer(spark, sf):
    n, _ = _g(spark, sf)
    return (G.final_answer(n).join(G.answer_nodes(n).select("graph_id", "answer_node_id"), "graph_id", "left")
            .select("graph_id", "answer_node_id", "final_answer"))


_DEPTH_SQL = """,
sl AS (SELECT DISTINCT graph_id, src AS node_id FROM edges WHERE src = dst),
bad(graph_id, node_id) AS (
  SELECT graph_id, node_id FROM sl
  UNION
  SELECT e.graph_id, e.dst FROM bad JOIN edges e ON e.graph_id = bad.graph_id AND e.src = bad.node_id),
good AS (SELECT graph_id, node_id FROM gnodes EXCEPT SELECT graph_id, node_id FROM bad),
ge AS (SELECT e.graph_id, e.src, e.dst FROM edges e
       JOIN good a ON a.graph_id = e.graph_id AND a.node_id = e.src
       JOIN good b ON b.graph_id = e.graph_id AND b.node_id = e.dst),
cnt AS (SELECT max(c) AS k FROM (SELECT count(*) AS c FROM gnodes GROUP BY graph_id)),
lp(k, graph_id, node_id, depth) AS (
  SELECT 0, graph_id, node_id, 0 FROM good
  UNION ALL
  SELECT lp.k + 1, lp.graph_id, lp.node_id,
         coalesce((SELECT max(p.depth) + 1 FROM lp p JOIN ge ON ge.graph_id = p.graph_id AND ge.src = p.node_id
                   WHERE p.k = lp.k AND ge.dst = lp.node_id AND ge.graph_id = lp.graph_id), 0)
  FROM lp WHERE lp.k < (SELECT k FROM cnt)),
gd AS (SELECT graph_id, node_id, depth FROM lp WHERE k = (SELECT k FROM cnt)),
bd AS (SELECT b.graph_id, b.node_id,
              coalesce((SELECT max(gd.depth) + 1 FROM edges e JOIN gd ON gd.graph_id = e.graph_id AND gd.node_id = e.src
                        WHERE e.graph_id = b.graph_id AND e.dst = b.node_id), 0) AS depth
       FROM bad b),
dep AS (SELECT graph_id, node_id, CAST(depth AS BIGINT) AS depth, true AS processed FROM gd
        UNION ALL SELECT graph_id, node_id, CAST(depth AS BIGINT), false FROM bd)
"""


@query("dag_depth", "D9", oracle_with("edges", recursive=True) + _DEPTH_SQL + """
SELECT graph_id, node_id, depth, processed FROM dep""")
def q_dag_depth(spark, sf):
    n, d = _g(spark, sf)
    return G.depths(n, G.edges(n, d))


@query("dag_cycles", "D10,F14", oracle_with("edges", recursive=True) + _DEPTH_SQL + """
SELECT graph_id, count(*) FILTER (WHERE NOT processed) > 0 AS cyclic,
       CAST(CASE WHEN count(*) FILTER (WHERE NOT processed) > 0 THEN 0 ELSE max(depth) END AS BIGINT) AS max_depth,
       count(*) FILTER (WHERE NOT processed) AS n_unprocessed
FROM dep GROUP BY graph_id""")
def q_dag_cycles(spark, sf):
    n, d = _g(spark, sf)
    return G.graph_depth(G.depths(n, G.edges(n, d)))


_CLOSURE_SQL = _DL + """,
seeds AS (SELECT graph_id, arg_max(node_id, seq) AS seed_id FROM gnodes WHERE ends_with(node_id, '_answer')
          GROUP BY graph_id),
cl(graph_id, seed_id, node_id) AS (
  SELECT graph_id, seed_id, seed_id FROM seeds
  UNION
  SELECT cl.graph_id, cl.seed_id, dl.dep_id FROM cl JOIN dl ON dl.graph_id = cl.graph_id AND dl.node_id = cl.node_id)
"""


def _closure(spark, sf):
    n, d = _g(spark, sf)
    seeds = G.answer_nodes(n).select("graph_id", F.col("answer_node_id").alias("seed_id"))
    return n, d, G.transitive_deps(n, d, seeds)


@query("dag_closure", "D11", oracle_with("gnodes", "deps", recursive=True) + _CLOSURE_SQL + """
SELECT graph_id, seed_id, node_id FROM cl""")
def q_dag_closure(spark, sf):
    return _closure(spark, sf)[2]


@query("dag_chain_metrics", "F10", oracle_with("gnodes", "deps", recursive=True) + _CLOSURE_SQL + """,
nd AS (SELECT n.graph_id, n.node_id, count(d.dep_id) AS n_deps FROM gnodes n
       LEFT JOIN dl d USING (graph_id, node_id) GROUP BY n.graph_id, n.node_id),
oc AS (SELECT DISTINCT cl.graph_id, cl.node_id FROM cl JOIN gnodes g USING (graph_id, node_id))
SELECT nd.graph_id, count(*) AS n_nodes, count(oc.node_id) AS chain_nodes, count(*) - count(oc.node_id) AS off_chain_nodes,
       CAST(floor(CAST(count(oc.node_id) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 1e6::DOUBLE + 0.5::DOUBLE) AS DOUBLE) / 1e6::DOUBLE AS chain_ratio,
       CAST(floor(avg(nd.n_deps) * 1e6::DOUBLE + 0.5::DOUBLE) AS DOUBLE) / 1e6::DOUBLE AS mean_deps,
       CAST(coalesce(max(CASE WHEN nd.node_id = s.seed_id THEN nd.n_deps END), 0) AS BIGINT) AS answer_deps
FROM nd LEFT JOIN oc USING (graph_id, node_id) LEFT JOIN seeds s ON s.graph_id = nd.graph_id
GROUP BY nd.graph_id""")
def q_dag_chain_metrics(spark, sf):
    from credsight.operators.metrics import chain_metrics
    n, d, cl = _closure(spark, sf)
    return chain_metrics(n, d, cl)


@query("dag_counts", "D13", oracle_with("edges") + """,
ne AS (SELECT graph_id, count(*) AS n_edges FROM edges GROUP BY graph_id)
SELECT graph_id, count(*) AS n_nodes, count(DISTINCT iteration) AS n_batches, coalesce(max(ne.n_edges), 0) AS n_edges
FROM gnodes LEFT JOIN ne USING (graph_id) GROUP BY graph_id""")
def q_dag_counts(spark, sf):
    n, d = _g(spark, sf)
    return G.counts(n, G.edges(n, d)).select("graph_id", "n_nodes", "n_batches", "n_edges")


@query("dag_batch_sizes", "D13", oracle_with("gnodes") + """
SELECT graph_id, iteration, count(*) AS new_nodes FROM gnodes GROUP BY graph_id, iteration""")
def q_dag_batch_sizes(spark, sf):
    n, _ = _g(spark, sf)
    return G.nodes_per_batch(n)


_ROUNDTRIP_SQL = ("""
SELECT n.graph_id, n.seq, n.node_id, n.description, n.prompt, n.status, n.answer, n.explanation, n.key_steps, n.confidence, n.uncertainties,
       n.raw_text, n.turns, n.failure_reason, n.extra, dep.depth, coalesce(x.deps, '') AS dependencies, coalesce(ne.n_edges, 0) AS n_edges
FROM gnodes n JOIN dep USING (graph_id, node_id)
LEFT JOIN (SELECT graph_id, seq, string_agg(dep_id, ',' ORDER BY dep_pos) AS deps FROM deps GROUP BY ALL) x ON x.graph_id = n.graph_id AND x.seq = n.seq
LEFT JOIN (SELECT graph_id, CAST(count(*) AS INTEGER) AS n_edges FROM edges GROUP BY graph_id) ne ON ne.graph_id = n.graph_id""")


@query("dag_roundtrip", "A8", oracle_with("edges", recursive=True) + _DEPTH_SQL + _ROUNDTRIP_SQL)
def q_dag_roundtrip(spark, sf):
    """Written and read back: every field, order, unknown keys.  Nodes, dependencies, edges and
    depths are each read by several steps, so each is derived once."""
    n, d, _ = dag_inputs(spark, sf, stored(dag_nodes(spark, sf), "roundtrip-raw"))
    n, d = stored(n, "roundtrip-nodes"), stored(d, "roundtrip-deps")
    e = stored(G.edges(n, d), "roundtrip-edges")
    full = stored(n.join(G.depths(n, e).select("graph_id", "node_id", "depth"), ["graph_id", "node_id"]), "roundtrip-full")
    back = G.deserialize(G.serialize(full, d, e))
    return back.select("graph_id", F.col("seq").cast("bigint").alias("seq"), "node_id", "description", "prompt", "status", "answer", "explanation",
                       "key_steps", "confidence", "uncertainties", "raw_text", "turns", "failure_reason", "extra", "depth",
                       F.array_join("dependencies", ",").alias("dependencies"), "n_edges")


@query("dag_roundtrip_edges", "A8", oracle_with("edges") + """
SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY dst_seq, dep_pos, src, dst) - 1 AS INTEGER) AS pos, src, dst FROM edges""")
def q_dag_roundtrip_edges(spark, sf):
    n, d = _g(spark, sf)
    return G.deserialize_edges(G.serialize(n, d, G.edges(n, d)))


@query("dag_state_text", "C14", oracle_with("gnodes", "deps") + _DL + """,
ds AS (SELECT graph_id, node_id, string_agg(dep_id, ', ' ORDER BY dep_pos) AS deps_str FROM dl GROUP BY ALL),
blk AS (SELECT n.graph_id, n.seq, concat_ws(chr(10),
          '[' || n.node_id || ']: ' || n.description,
          '    Status: ' || CASE WHEN n.status = '' THEN 'Awaiting Evaluation' ELSE n.status END
             || CASE WHEN ds.deps_str IS NOT NULL THEN ' (deps: ' || ds.deps_str || ')' ELSE '' END,
          CASE WHEN n.answer <> '' THEN '    Answer: ' || n.answer END,
          CASE WHEN n.explanation <> '' THEN '    Explanation: ' || n.explanation END,
          CASE WHEN n.key_steps <> '' THEN '    Key Steps: ' || n.key_steps END,
          CASE WHEN n.confidence <> '' THEN '    Confidence: ' || n.confidence END,
          CASE WHEN n.uncertainties <> '' THEN '    Uncertainties: ' || n.uncertainties END, '') AS b
        FROM gnodes n LEFT JOIN ds USING (graph_id, node_id))
SELECT graph_id, 'Total nodes: ' || CAST(count(*) AS VARCHAR) || chr(10) || chr(10) || '=== Executed Nodes ===' || chr(10)
       || string_agg(b, chr(10) ORDER BY seq) AS state_text
FROM blk GROUP BY graph_id""")
def q_dag_state_text(spark, sf):
    n, d = _g(spark, sf)
    return G.state_text(n, d)


@query("dag_ledger", "C16,D5,D6", oracle_with("gnodes") + """,
st AS (SELECT graph_id, string_agg(node_id || ': ' || CASE WHEN status = '' THEN 'Awaiting Evaluation' ELSE status END,
                                   chr(10) ORDER BY seq) AS statuses FROM gnodes GROUP BY graph_id),
r AS (SELECT graph_id, seq,
             CASE WHEN contains(node_id, '_refine') THEN split_part(node_id, '_refine', 1) ELSE node_id END AS root,
             CASE WHEN contains(node_id, '_refine') THEN 1 ELSE 0 END AS is_ref
      FROM gnodes WHERE contains(node_id, '_refine') OR NOT starts_with(node_id, 't_')),
rb0 AS (SELECT graph_id, root, sum(is_ref) + 1 AS attempts, min(seq) AS first_seq FROM r GROUP BY graph_id, root
        HAVING sum(is_ref) + 1 > 1),
rb AS (SELECT graph_id, string_agg(root || ': ' || CAST(attempts AS VARCHAR) || '/3 attempts used'
                                   || CASE WHEN attempts >= 3 THEN ' [BUDGET REACHED]' ELSE '' END,
                                   chr(10) ORDER BY first_seq) AS budget FROM rb0 GROUP BY graph_id),
fr AS (SELECT graph_id,
              coalesce(string_agg(node_id, ', ' ORDER BY seq) FILTER (WHERE status = ''), '') AS awaiting,
              coalesce(string_agg(node_id, ', ' ORDER BY seq) FILTER (WHERE status IN ('Uncertain', 'Not Found')), '')
                AS unresolved
       FROM gnodes GROUP BY graph_id)
SELECT st.graph_id, '### Statuses' || chr(10) || statuses
  || CASE WHEN budget IS NOT NULL THEN chr(10) || chr(10)
       || '### Refine Budget (3 attempts max per line of inquiry: original + refine1 + refine2)' || chr(10) || budget
     ELSE '' END
  || CASE WHEN awaiting <> '' OR unresolved <> '' THEN chr(10) || chr(10) || '### Frontier'
       || CASE WHEN awaiting <> '' THEN chr(10) || 'Awaiting Evaluation: ' || awaiting ELSE '' END
       || CASE WHEN unresolved <> '' THEN chr(10) || 'Unresolved (need refine if budget remains): ' || unresolved ELSE '' END
     ELSE '' END AS ledger
FROM st LEFT JOIN rb USING (graph_id) LEFT JOIN fr USING (graph_id)""")
def q_dag_ledger(spark, sf):
    n, _ = _g(spark, sf)
    return G.ledger_text(n)


@query("dag_delta_text", "C15,D12", oracle_with("gnodes", "deps", "verdicts") + _APPLY_SQL + _DL + """,
P AS (SELECT graph_id, iteration FROM gnodes UNION SELECT graph_id, iteration FROM verdicts),
ch AS (SELECT a.graph_id, a.iteration + 1 AS iteration,
              string_agg('[' || a.node_id || ']: ' || a.status, chr(10) ORDER BY n.seq) AS changes
       FROM applied a JOIN gnodes n USING (graph_id, node_id) GROUP BY ALL),
ds AS (SELECT graph_id, node_id, string_agg(dep_id, ', ' ORDER BY dep_pos) AS deps_str FROM dl GROUP BY ALL),
blk AS (SELECT n.graph_id, n.iteration + 1 AS iteration, n.seq, concat_ws(chr(10),
          '[' || n.node_id || ']: ' || n.description,
          '    Status: ' || CASE WHEN n.status = '' THEN 'Awaiting Evaluation' ELSE n.status END
             || CASE WHEN ds.deps_str IS NOT NULL THEN ' (deps: ' || ds.deps_str || ')' ELSE '' END,
          CASE WHEN n.answer <> '' THEN '    Answer: ' || n.answer END,
          CASE WHEN n.explanation <> '' THEN '    Explanation: ' || n.explanation END,
          CASE WHEN n.key_steps <> '' THEN '    Key Steps: ' || n.key_steps END,
          CASE WHEN n.confidence <> '' THEN '    Confidence: ' || n.confidence END,
          CASE WHEN n.uncertainties <> '' THEN '    Uncertainties: ' || n.uncertainties END, '') AS b
        FROM gnodes n LEFT JOIN ds USING (graph_id, node_id)),
nb AS (SELECT graph_id, iteration, string_agg(b, chr(10) ORDER BY seq) AS results FROM blk GROUP BY ALL)
SELECT P.graph_id, P.iteration,
       CASE WHEN changes IS NULL AND results IS NULL THEN '[No new results]'
            ELSE concat_ws(chr(10),
                   CASE WHEN changes IS NOT NULL THEN '=== Status Changes ===' || chr(10) || changes || chr(10) END,
                   CASE WHEN results IS NOT NULL THEN '=== New Execution Results ===' || chr(10) || results END) END AS delta
FROM P LEFT JOIN ch USING (graph_id, iteration) LEFT JOIN nb USING (graph_id, iteration)""")
def q_dag_delta_text(spark, sf):
    from credsight.operators.rules import plans
    n, d, v = dag_inputs(spark, sf)
    ap = G.applicable_verdicts(n, v)
    return G.delta_text(n, d, ap, plans(n, v))
