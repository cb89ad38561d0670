"""Queries for rollout metrics, credit and selection (F1-F16) and sampling (K1-K3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from credsight.functions.columns import r6, sql_mix_hash, sql_r6
from credsight.functions.text import extract_calls
from credsight.operators import graph as G
from credsight.operators import metrics as M
from credsight.operators import rules as R
from credsight.operators import sampling as K
from credsight.plans.catalog import query
from credsight.plans.q_graph import _CLOSURE_SQL, _DEPTH_SQL
from credsight.sources.fixtures import chat_turns, dag_inputs, oracle_with, tokens, trajectories
from credsight.session import stored
from credsight.sources.tables import read_table

ALPHA, MAX_TRAJ = 0.5, 11


def _graph(spark, sf):
    n, d, v = dag_inputs(spark, sf)
    seeds = G.answer_nodes(n).select("graph_id", F.col("answer_node_id").alias("seed_id"))
    return v, n, d, seeds


def _credit(spark, sf, with_depth=False):
    """Credit rows, written once: the queries read them several times."""
    v, n, d, _ = _graph(spark, sf)
    n = stored(n.select("graph_id", "seq", "iteration", "node_id", "answer"), "credit-nodes")
    d = stored(d, "credit-deps")
    seeds = G.answer_nodes(n).select("graph_id", F.col("answer_node_id").alias("seed_id"))
    cl = G.transitive_deps(n, d, seeds)
    fa = G.final_answer(n).select("graph_id", F.when(F.col("final_answer").isNotNull(), 1.0).otherwise(0.0).alias("R"))
    c = M.credit_shaping(n, cl, fa, ALPHA)
    if with_depth:
        c = c.join(G.depths(n, G.edges(n, d)).select("graph_id", "node_id", "depth"), ["graph_id", "node_id"])
        c = stored(c, "credit")
    return c


_CREDIT_SQL = _CLOSURE_SQL + """,
fa AS (SELECT graph_id, CASE WHEN coalesce(CASE WHEN a1 <> '' THEN a1 END, a2) IS NOT NULL THEN 1.0 ELSE 0.0 END AS R
       FROM (SELECT graph_id, arg_max(answer, seq) FILTER (WHERE ends_with(node_id, '_answer')) AS a1,
                    arg_max(answer, seq) FILTER (WHERE answer <> '') AS a2 FROM gnodes GROUP BY graph_id)),
oc AS (SELECT DISTINCT graph_id, node_id FROM cl),
credit AS (SELECT n.graph_id, n.seq, n.node_id, oc.node_id IS NOT NULL AS on_chain, s.seed_id IS NOT NULL AS has_answer,
                  CASE WHEN oc.node_id IS NOT NULL OR s.seed_id IS NULL THEN fa.R ELSE 0.5 * fa.R END AS reward
           FROM gnodes n LEFT JOIN oc USING (graph_id, node_id) LEFT JOIN seeds s ON s.graph_id = n.graph_id
           LEFT JOIN fa ON fa.graph_id = n.graph_id)
"""


@query("credit_shaping", "F11", oracle_with("gnodes", "deps", recursive=True) + _CREDIT_SQL + f"""
SELECT graph_id, node_id, on_chain, has_answer, {sql_r6('reward')} AS reward FROM credit""")
def q_credit_shaping(spark, sf):
    c = _credit(spark, sf)
    return c.select("graph_id", "node_id", "on_chain", "has_answer", r6(F.col("reward")).alias("reward"))


def _cap_sql() -> str:
    body = _DEPTH_SQL + _CLOSURE_SQL.replace(", dl AS", ", dl AS", 1) + _CREDIT_SQL[len(_CLOSURE_SQL):] + f""",
ex AS (SELECT c.*, dep.depth FROM credit c JOIN dep USING (graph_id, node_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY on_chain DESC,
                   CASE WHEN on_chain THEN -depth END NULLS LAST,
                   CASE WHEN NOT on_chain THEN {sql_mix_hash('graph_id', 'seq', 7)} END NULLS LAST, seq) AS k FROM ex),
kept AS (SELECT * FROM rk WHERE k <= {MAX_TRAJ - 1})
"""
    return oracle_with("edges", recursive=True) + body


@query("traj_cap", "F12,K3,F14", _cap_sql() + """
SELECT graph_id, node_id, on_chain, depth FROM kept""")
def q_traj_cap(spark, sf):
    c = _credit(spark, sf, with_depth=True)
    return M.trajectory_cap(c, MAX_TRAJ).select("graph_id", "node_id", "on_chain", "depth")


@query("kept_stats", "F13", _cap_sql() + f""",
pre AS (SELECT graph_id, count(*) FILTER (WHERE on_chain) AS pre_chain FROM ex GROUP BY graph_id),
k AS (SELECT graph_id, count(*) AS kept, count(*) FILTER (WHERE on_chain) AS chain_kept, avg(reward) AS em,
             avg(reward) FILTER (WHERE on_chain) AS cm, avg(reward) FILTER (WHERE NOT on_chain) AS om
      FROM kept GROUP BY graph_id)
SELECT graph_id, coalesce(kept, 0) AS kept, coalesce(chain_kept, 0) AS chain_kept,
       coalesce(kept, 0) - coalesce(chain_kept, 0) AS off_chain_kept,
       greatest(pre_chain - coalesce(chain_kept, 0), 0) AS chain_truncated,
       {sql_r6('em')} AS exec_reward_mean, {sql_r6('cm')} AS chain_reward_mean, {sql_r6('om')} AS off_chain_reward_mean,
       {sql_r6('cm - om')} AS reward_gap
FROM pre LEFT JOIN k USING (graph_id)""")
def q_kept_stats(spark, sf):
    c = _credit(spark, sf, with_depth=True)
    return M.kept_stats(c, M.trajectory_cap(c, MAX_TRAJ))


_PLAN_CALLS_SQL = """, pc AS (SELECT graph_id, count(*) AS plan_calls FROM (
    SELECT graph_id, iteration FROM gnodes UNION SELECT graph_id, iteration FROM verdicts) GROUP BY graph_id)"""


def _plan_calls(n, v):
    return R.plans(n, v).groupBy("graph_id").agg(F.count(F.lit(1)).alias("plan_calls"))


@query("batch_cost", "F5", oracle_with("gnodes", "verdicts") + _PLAN_CALLS_SQL + """,
calls AS (SELECT n.graph_id, n.iteration, n.seq, count(c.conv_id) FILTER (WHERE regexp_matches(c.text, '\\S')) AS calls FROM gnodes n
          LEFT JOIN conversations c ON c.conv_id = n.okey AND c.role = 'assistant' GROUP BY ALL),
pb AS (SELECT graph_id, iteration, max(calls) AS bm FROM calls GROUP BY ALL),
g AS (SELECT graph_id, sum(bm) AS exec_steps FROM pb GROUP BY graph_id)
SELECT graph_id, CAST(exec_steps AS BIGINT) AS exec_steps, plan_calls, CAST(plan_calls + exec_steps AS BIGINT) AS steps
FROM g JOIN pc USING (graph_id)""")
def q_batch_cost(spark, sf):
    v, n, _, _ = _graph(spark, sf)
    return M.batch_cost(n, M.model_calls(n, read_table(spark, sf, "conversations")), _plan_calls(n, v))


@query("derived_counters", "F7", oracle_with("gnodes", "verdicts") + _PLAN_CALLS_SQL + """
SELECT graph_id, count(*) FILTER (WHERE status <> '') AS executed_nodes,
       count(DISTINCT CASE WHEN status <> '' THEN node_id END) AS unique_executed,
       count(*) FILTER (WHERE contains(node_id, '_refine')) AS refine_nodes, count(DISTINCT iteration) AS n_batches,
       max(plan_calls) AS plan_calls, greatest(max(plan_calls) - 1, 0) AS grow_iterations
FROM gnodes JOIN pc USING (graph_id) GROUP BY graph_id""")
def q_derived_counters(spark, sf):
    v, n, _, _ = _graph(spark, sf)
    return M.derived_counters(n, _plan_calls(n, v))


@query("tool_counts", "F6", oracle_with("turns") + """,
c0 AS (SELECT conv_id, regexp_extract_all(text, '(?s)<function=([^>]+)>(.*?)</function>', 1) AS fns
       FROM turns WHERE role = 'assistant'),
c AS (SELECT conv_id, unnest(fns) AS function FROM c0)
SELECT conv_id, count(*) FILTER (WHERE function = 'search') AS n_search,
       count(*) FILTER (WHERE function = 'open_page') AS n_open_page,
       count(*) FILTER (WHERE function = 'recall') AS n_recall, count(*) FILTER (WHERE function = 'finish') AS n_finish,
       count(*) FILTER (WHERE function IN ('search', 'open_page')) AS n_external
FROM (SELECT DISTINCT conv_id FROM turns) LEFT JOIN c USING (conv_id) GROUP BY conv_id""")
def q_tool_counts(spark, sf):
    t = chat_turns(spark, sf)
    # an assistant turn without a call, like any other turn, counts as a row without function
    calls = F.when(F.col("role") == "assistant", extract_calls(F.col("text")))
    return M.tool_counts(t.select("conv_id", F.explode_outer(calls).alias("c")).select("conv_id", "c.function"))


_BUDGET_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role = 'user' AS obs,
                  CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS n,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
f(conv_id, r, turn, used, dropped, trunc) AS (
  SELECT conv_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT f.conv_id, t.r, t.turn,
         f.used + CASE WHEN obs AND CAST(f.used + t.n AS DOUBLE) > 2850.0 THEN 0 ELSE t.n END,
         f.dropped + CASE WHEN obs AND CAST(f.used + t.n AS DOUBLE) > 2850.0 THEN 1 ELSE 0 END,
         f.trunc + CASE WHEN obs AND CAST(f.used + t.n AS DOUBLE) > 2850.0 THEN t.n ELSE 0 END
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.r = f.r + 1),
budget AS (SELECT conv_id, arg_max(used, r) AS used, arg_max(dropped, r) AS dropped_turns, arg_max(trunc, r) AS truncated_tokens,
                  min(turn) FILTER (WHERE CAST(used AS DOUBLE) >= 2550.0) AS warn_turn,
                  min(turn) FILTER (WHERE 3000 - used < 256) AS exhausted_turn FROM f GROUP BY conv_id)"""


@query("context_budget", "F2,F3,F4", _BUDGET_SQL + """
SELECT conv_id, used, dropped_turns, truncated_tokens, warn_turn, exhausted_turn FROM budget""")
def q_context_budget(spark, sf):
    return M.context_budget(read_table(spark, sf, "conversations"), limit=3000)


@query("node_metrics", "F1", oracle_with("gnodes", "deps") + """,
dl AS (SELECT d.graph_id, n.node_id, d.dep_pos, d.dep_id FROM deps d JOIN gnodes n USING (graph_id, seq)),
summ AS (SELECT graph_id, node_id AS dep_id, concat_ws(chr(10),
   CASE WHEN node_id <> '' THEN '[Node ' || node_id || '] ' || description END,
   CASE WHEN status <> '' THEN 'Status: ' || status END, CASE WHEN answer <> '' THEN 'Answer: ' || answer END,
   CASE WHEN explanation <> '' THEN 'Explanation: ' || explanation END,
   CASE WHEN key_steps <> '' THEN 'Key Steps: ' || key_steps END,
   CASE WHEN confidence <> '' THEN 'Confidence: ' || confidence END,
   CASE WHEN uncertainties <> '' THEN 'Uncertainties: ' || uncertainties END) AS summary FROM gnodes),
ctx AS (SELECT dl.graph_id, dl.node_id, count(summary) AS n_found,
               string_agg(summary, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY dep_pos) AS ctx
        FROM dl LEFT JOIN summ USING (graph_id, dep_id) GROUP BY ALL),
w AS (SELECT n.graph_id, n.node_id, n.status,
             CASE WHEN c.n_found IS NULL OR c.n_found = 0 THEN 0
                  ELSE len(list_filter(regexp_split_to_array(c.ctx, '\\s+'), lambda x: x <> '')) END AS up,
             len(list_filter(regexp_split_to_array(n.prompt, '\\s+'), lambda x: x <> '')) AS pw
      FROM gnodes n LEFT JOIN ctx c USING (graph_id, node_id))
SELECT graph_id, node_id, CAST(up AS BIGINT) AS upstream_tokens, CAST(pw + up AS BIGINT) AS prompt_tokens,
       CAST(floor(CASE WHEN pw + up > 0 THEN CAST(up AS DOUBLE) / CAST(pw + up AS DOUBLE) ELSE 0.0 END * 1e6::DOUBLE + 0.5::DOUBLE) AS DOUBLE) / 1e6::DOUBLE AS dep_ratio,
       CASE WHEN status IN ('Success', 'Uncertain', 'Not Found') THEN 'completed' WHEN status = 'Failed' THEN 'failed'
            ELSE 'exception' END AS exec_status
FROM w""")
def q_node_metrics(spark, sf):
    _, n, d, _ = _graph(spark, sf)
    return M.node_metrics(n, G.upstream_context(n, d))


@query("iteration_log", "F15", oracle_with("gnodes", "verdicts") + """
SELECT graph_id, iteration, 'plan' AS kind, count(*) AS n_verdicts, NULL::BIGINT AS n_nodes, NULL::BIGINT AS n_failed
FROM verdicts GROUP BY ALL
UNION ALL
SELECT graph_id, iteration, 'exec', NULL::BIGINT, count(*), count(*) FILTER (WHERE status = 'Failed')
FROM gnodes GROUP BY ALL""")
def q_iteration_log(spark, sf):
    v, n, _, _ = _graph(spark, sf)
    plan_rows = v.groupBy("graph_id", "iteration").agg(F.count(F.lit(1)).alias("n_verdicts"))
    exec_rows = n.groupBy("graph_id", "iteration").agg(F.count(F.lit(1)).alias("n_nodes"),
                                                       F.count_if(F.col("status") == "Failed").alias("n_failed"))
    return M.iteration_log(plan_rows, exec_rows).select("graph_id", "iteration", "kind", "n_verdicts", "n_nodes",
                                                        "n_failed")


# K1 / K2 -----------------------------------------------------------------------

@query("resample_weights", "K1", oracle_with("traj") + f""",
ext AS (SELECT max(score) AS mx, min(score) AS mn FROM traj)
SELECT traj_id, {sql_r6('greatest(pow(abs(score), 2.0) + 1e-8, 1e-8)')} AS w_pow,
       {sql_r6('greatest(CASE WHEN score = mx OR score = mn THEN 1.0 ELSE 0.0 END + 1e-8, 1e-8)')} AS w_max_min,
       {sql_r6('greatest(CASE WHEN score = mx THEN 0.4 ELSE 0.1 END + 1e-8, 1e-8)')} AS w_max_random
FROM traj, ext""")
def q_resample_weights(spark, sf):
    traj = trajectories(spark, sf, tokens(spark, sf)).select("traj_id", "score")
    j = K.resample_weights(traj, {"w_pow": "pow", "w_max_min": "max_min", "w_max_random": "max_random"})
    return j.select("traj_id", *[r6(F.col(x)).alias(x) for x in ("w_pow", "w_max_min", "w_max_random")])


@query("resample_draw", "K2", oracle_with("traj") + """,
w AS (SELECT traj_id, score, greatest(pow(abs(score), 2.0) + 1e-8, 1e-8) AS wt FROM traj),
c AS (SELECT traj_id, score, sum(wt) OVER (ORDER BY traj_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - wt AS lo,
             sum(wt) OVER (ORDER BY traj_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM w),
tot AS (SELECT max(hi) AS total, count(*) AS n FROM c),
d AS (SELECT id AS draw_id, (CAST(""" + sql_mix_hash('id', 3) + """ AS DOUBLE)
             + CAST(""" + sql_mix_hash('id', 4) + """ AS DOUBLE) / 2147483647.0::DOUBLE) / 2147483647.0::DOUBLE * total AS u
      FROM tot, range(0, (SELECT n FROM tot)) r(id))
SELECT c.traj_id, count(*) AS times_drawn, round(sum(score), 6) AS score_sum FROM d JOIN c ON d.u >= c.lo AND d.u < c.hi GROUP BY c.traj_id""")
def q_resample_draw(spark, sf):
    traj = trajectories(spark, sf, tokens(spark, sf)).select("traj_id", "score")
    w = K.resample_weights(traj, "pow", 2.0)
    d = K.weighted_draw(w, "traj_id", "weight", seed=3)
    return d.groupBy("traj_id").agg(F.count(F.lit(1)).alias("times_drawn"), F.round(F.sum("score"), 6).alias("score_sum"))


@query("failure_taxonomy", "F8", _BUDGET_SQL + """,
""" + oracle_with("turns")[len("WITH "):] + """,
c AS (SELECT conv_id, count(*) AS n_turns,
             sum(len(regexp_extract_all(text, '(?s)<function=(finish)>', 1))) AS n_finish
      FROM turns WHERE role = 'assistant' GROUP BY conv_id)
SELECT b.conv_id, CASE WHEN dropped_turns > 0 THEN 'context_overflow'
                       WHEN coalesce(n_turns, 0) >= 4 AND coalesce(n_finish, 0) = 0 THEN 'max_turn'
                       WHEN coalesce(n_finish, 0) = 0 THEN 'unfinished' ELSE 'completed' END AS reason
FROM budget b LEFT JOIN c USING (conv_id)""")
def q_failure_taxonomy(spark, sf):
    conv = read_table(spark, sf, "conversations")
    budget = M.context_budget(conv, limit=3000)
    t = chat_turns(spark, sf)
    calls = (t.filter(F.col("role") == "assistant")
             .select("conv_id", F.explode(extract_calls(F.col("text"))).alias("c")).select("conv_id", "c.function"))
    return M.failure_taxonomy(budget, calls, t)


@query("end_reason", "F9", oracle_with("gnodes", "verdicts", "plans") + """,
pc AS (SELECT graph_id, count(*) AS plan_calls FROM (
         SELECT graph_id, iteration FROM gnodes UNION SELECT graph_id, iteration FROM verdicts) GROUP BY graph_id),
ans AS (SELECT graph_id, arg_max(answer, seq) FILTER (WHERE ends_with(node_id, '_answer')) AS said FROM gnodes GROUP BY graph_id),
lst AS (SELECT graph_id, arg_max(contains(text, 'node_statuses'), iteration) AS usable FROM plans GROUP BY graph_id)
SELECT pc.graph_id, CASE WHEN coalesce(said, '') <> '' THEN 'answer' WHEN NOT usable THEN 'parse_error'
                         WHEN plan_calls >= 30 THEN 'max_iterations' ELSE 'incomplete' END AS reason
FROM pc LEFT JOIN ans USING (graph_id) LEFT JOIN lst USING (graph_id)""")
def q_end_reason(spark, sf):
    from credsight.functions.text import json_block, parse_plan, plan_error_of
    from credsight.sources.fixtures import plan_texts
    v, n, _, _ = _graph(spark, sf)
    p = plan_texts(spark, sf, dag_nodes_raw(spark, sf)).withColumn("blk", json_block(F.col("text")))
    p = p.withColumn("error", plan_error_of(F.col("blk"), parse_plan(F.col("blk"))))
    return M.end_reason(n, p, _plan_calls(n, v))


def dag_nodes_raw(spark, sf):
    from credsight.sources.fixtures import dag_nodes
    return dag_nodes(spark, sf)
