"""Streaming queries (L1-L4, L6, L7): each runs the stream to completion
(availableNow) and returns what it produced; the oracle is the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from credsight.functions.columns import r6, sql_r6
from credsight.operators import graph as G
from credsight.plans.catalog import query
from credsight.plans.q_losses import _KL_RUNS, _steps_spark
from credsight.session import stored
from credsight.sources.fixtures import dag_deps, dag_nodes, oracle_with
from credsight.streaming import stateful as K
from credsight.streaming import streams as S

_EV = oracle_with("evalres")


@query("stream_running_mean", "L1", _EV + f"""
SELECT data_source, {sql_r6('avg(score)')} AS mean_score, count(*) AS n FROM evalres GROUP BY data_source""")
def q_stream_running_mean(spark, sf):
    out = S.run_update(S.running_by_source(S.results_stream(spark, sf)), "l1", ["data_source"])
    return out.select("data_source", r6(F.col("mean_score")).alias("mean_score"), "n")


@query("stream_windowed_score", "L2", _EV + f"""
SELECT CAST(epoch(date_trunc('day', finished_at)) AS BIGINT) AS window_start_s, data_source,
       {sql_r6('avg(score)')} AS mean_score,
       {sql_r6("avg(CASE WHEN status = 'failed' THEN 1.0 ELSE 0.0 END)")} AS failure_rate, count(*) AS n
FROM evalres GROUP BY ALL""")
def q_stream_windowed_score(spark, sf):
    out = S.run_update(S.windowed_scores(S.results_stream(spark, sf)), "l2", ["window_start_s", "data_source"])
    return out.select("window_start_s", "data_source",
                      r6(F.col("mean_score")).alias("mean_score"), r6(F.col("failure_rate")).alias("failure_rate"), "n")


@query("stream_dedup", "L3", """
SELECT DISTINCT user_id, event_type FROM events""")
def q_stream_dedup(spark, sf):
    ev = S.stream_table(spark, f"{sf.rstrip('/')}/events.parquet").withColumn("ts", S.utc_instant(F.col("ts")))
    out = S.run_append(S.dedup_within_watermark(ev, ["user_id", "event_type"], "ts", "1 hour"), "l3")
    return out.select("user_id", "event_type")


def _rounds_sql(src: str, key: str, size: int | None, timeout_s: int, retention_s: int) -> str:
    """CTEs m(key, k, i, state): which round the rows of ``src`` (key, us, k) fall into, by recursion over the rounds."""
    inside = f"least({size or 10 ** 12}, len(list_filter(arr[i:], lambda x: x.us <= arr[i].us + {timeout_s * 10 ** 6})))"
    return f""",
g AS (SELECT {key}, list({{'us': us, 'k': k}} ORDER BY us, k) AS arr FROM {src} GROUP BY {key}),
rounds AS (
  SELECT {key}, arr, CAST(1 AS BIGINT) AS i FROM g
  UNION ALL
  SELECT * FROM (
    SELECT {key}, arr, CAST(1 + len(list_filter(arr, lambda x: x.us <= until)) AS BIGINT) AS i
    FROM (SELECT {key}, arr, {retention_s * 10 ** 6} + CASE WHEN n = {size or 0} THEN arr[i + n - 1].us ELSE arr[i].us + {timeout_s * 10 ** 6} END AS until
          FROM (SELECT {key}, arr, i, {inside} AS n FROM rounds)))
  WHERE i <= len(arr)),
rd AS (SELECT {key}, i, {inside} AS n, arr[i].us AS opened FROM rounds),
pos AS (SELECT {key}, unnest(arr).k AS k, unnest(arr).us AS us, generate_subscripts(arr, 1) AS p FROM g),
m AS (SELECT pos.{key}, pos.k, pos.us, rd.i, rd.n, rd.opened,
             CASE WHEN p >= rd.i + rd.n THEN 'late' WHEN rd.n = {size or 0} THEN 'complete' ELSE 'timeout' END AS state
      FROM pos ASOF JOIN rd ON pos.{key} = rd.{key} AND pos.p >= rd.i)
"""


def _events(spark, sf):
    """Events as successive appends in time order, closed at the end, with a delay of two days allowed."""
    ev = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").select(
        "event_id", "user_id", "event_type", S.utc_instant(F.col("ts")).alias("ts"))
    path = S.materialise_in_order(ev, "events", "ts", last=K.closing_row(ev, "ts"))
    return K.timed(S.stream_table(spark, path, max_files=4), "ts", "2 days")


_EVENT_US = "WITH RECURSIVE e AS (SELECT user_id, event_type, event_id AS k, epoch_us(ts) AS us FROM events)"


@query("stream_kept_events", "L3", _EVENT_US.replace(
    "SELECT user_id, event_type,", "SELECT CAST(user_id AS VARCHAR) || '/' || event_type AS kind,")
    + _rounds_sql("e", "kind", 1, 0, 5 * 86400) + "SELECT k AS event_id FROM m WHERE state <> 'late'")
def q_stream_kept_events(spark, sf):
    return K.run_stateful(K.first_per_window(_events(spark, sf), ["user_id", "event_type"], "event_id", 5 * 86400), "l3-kept")


@query("stream_sessions", "L6", """
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 5400 SECOND THEN 1 ELSE 0 END)
                          OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM e)
SELECT user_id, epoch_us(min(ts)) AS session_start_us, epoch_us(max(ts) + INTERVAL 5400 SECOND) AS session_end_us,
       count(*) AS n_events
FROM s GROUP BY user_id, sid""")
def q_stream_sessions(spark, sf):
    out = S.run_append(S.sessions(_events(spark, sf), "user_id", "ts"), "l6")
    return out.select("user_id", "session_start_us", "session_end_us", "n_events")


@query("stream_deadline_sessions", "L6", _EVENT_US + _rounds_sql("e", "user_id", None, 3 * 86400, 0) + f"""
SELECT user_id, opened AS session_start_us, opened + {3 * 86400 * 10 ** 6} AS session_end_us, max(us) AS last_event_us,
       count(*) AS n_events FROM m GROUP BY user_id, opened""")
def q_stream_deadline_sessions(spark, sf):
    """The events are hours apart, so the deadline is three days instead of 5,400 s."""
    out = K.run_stateful(K.deadline_sessions(_events(spark, sf), "user_id", "event_id", 3 * 86400), "l6-deadline")
    return out.select("user_id", "session_start_us", "session_end_us", "last_event_us", "n_events")


@query("stream_static_lookup", "L7", oracle_with("gnodes", "deps") + """
SELECT d.graph_id, count(*) AS n_deps, count(n.node_id) AS n_found
FROM deps d LEFT JOIN gnodes n ON n.graph_id = d.graph_id AND n.node_id = d.dep_id GROUP BY d.graph_id""")
def q_stream_static_lookup(spark, sf):
    """Nodes stored as two versions before the stream starts: every micro-batch finds both."""
    raw = stored(dag_nodes(spark, sf), "l7-raw")
    table = S.VersionedTable(spark, S.scratch(spark, "l7-nodes"), "graph_id long, node_id string")
    nodes = G.resolve_ids(raw)
    for half in (0, 1):
        table.append(nodes.where(F.col("seq") % 2 == half))
    path = S.materialise(dag_deps(spark, sf, raw), "l7-deps", partitions=8)
    out = S.versioned_lookup(S.stream_table(spark, path, max_files=2), table, "l7")
    return out.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_deps"), F.count_if("found").alias("n_found"))


@query("stream_adaptive_kl", "L4", oracle_with("tok") + _KL_RUNS.format(horizon="10000.0") + f"""
SELECT run, step, {sql_r6('kl')} AS kl, n, {sql_r6('0.05::DOUBLE * p')} AS kl_coef FROM c""")
def q_stream_adaptive_kl(spark, sf):
    """Steps arrive out of order, dealt over the files by a hash; all of them are within the allowed delay."""
    steps = _steps_spark(spark, sf).select(F.col("run").alias("run_id"), "step", "kl", "n", K.month_start(F.col("step")).alias("ts"))
    mixed = steps.withColumn("arrival", F.timestamp_seconds(F.pmod(F.xxhash64("run_id", "step"), F.lit(1_000_000))))
    path = S.materialise_in_order(mixed, "l4-steps", "arrival", last=K.closing_row(mixed, "ts"))
    st = K.timed(S.stream_table(spark, path, max_files=4), "ts", "4000 days")
    out = K.run_stateful(K.adaptive_kl_in_order(st, init=0.05, target=0.02, horizon=10000), "l4")
    return out.select(F.col("run_id").alias("run"), "step", r6(F.col("kl")).alias("kl"), "n", r6(F.col("kl_coef")).alias("kl_coef"))


@query("stream_group_credit", "L5,H2", oracle_with("traj") + f""",
st AS (SELECT uid, count(*) AS g_n, CASE WHEN count(*) = 1 THEN 0.0::DOUBLE ELSE avg(score) END AS g_mean,
              CASE WHEN count(*) = 1 THEN 1.0::DOUBLE ELSE stddev_samp(score) END AS g_std FROM traj GROUP BY uid)
SELECT traj_id, {sql_r6('(score - g_mean) / (g_std + 1e-6::DOUBLE)')} AS adv FROM traj JOIN st USING (uid)""")
def q_stream_group_credit(spark, sf):
    from credsight.sources.fixtures import tokens, trajectories
    traj = trajectories(spark, sf, tokens(spark, sf)).select("traj_id", "uid", "score", "batch_idx")
    expected = traj.groupBy("uid").agg(F.count(F.lit(1)).alias("g_expected"))
    path = S.materialise(traj, "l5-traj", partitions=8)          # groups are spread over the files
    st = S.group_complete_stats(S.stream_table(spark, path, max_files=2), expected, "l5")
    t = spark.read.parquet(path)
    return t.join(st, "uid").select(
        "traj_id", r6((F.col("score") - F.col("g_mean")) / (F.col("g_std") + F.lit(1e-6))).alias("adv"))


ROLLOUTS, TIMEOUT_S, RETENTION_S = 4, 900 * 86400, 200 * 86400


def _rollouts(spark, sf):
    """Rollouts at the time of their order, as appends in time order, closed at the end."""
    from credsight.sources.fixtures import tokens, trajectories
    o = spark.read.parquet(f"{sf.rstrip('/')}/orders.parquet").select(
        F.col("o_orderkey").alias("traj_id"), S.utc_instant(F.col("o_orderdate")).alias("ts"))
    t = trajectories(spark, sf, tokens(spark, sf)).join(o, "traj_id").select(
        "traj_id", "ts", "uid", "score", F.col("is_planner").alias("planner"), F.col("is_dummy").alias("dummy"),
        F.col("gen_uid").alias("gen"), F.col("n_violations").alias("violations"))
    path = S.materialise_in_order(t, "l5-rollouts", "ts", last=K.closing_row(t, "ts"))
    return K.timed(S.stream_table(spark, path, max_files=4), "ts", "500 days")


_ROLLOUT_SQL = """,
ro AS (SELECT t.traj_id AS k, epoch_us(o.o_orderdate) AS us, t.*, CAST(t.uid AS VARCHAR) || CASE WHEN is_planner THEN '/p' ELSE '/e' END AS role_uid
       FROM traj t JOIN orders o ON o.o_orderkey = t.traj_id)"""


@query("stream_group_deadline", "L5,H2", oracle_with("traj", recursive=True) + _ROLLOUT_SQL
       + _rounds_sql("ro", "uid", ROLLOUTS, TIMEOUT_S, RETENTION_S) + f""",
j AS (SELECT m.*, ro.score FROM m JOIN ro USING (k)),
st AS (SELECT uid, i, count(*) AS g_n, CASE WHEN count(*) = 1 THEN 0.0::DOUBLE ELSE avg(score) END AS mu,
              CASE WHEN count(*) = 1 THEN 1.0::DOUBLE ELSE stddev_samp(score) END AS sd FROM j WHERE state <> 'late' GROUP BY uid, i)
SELECT k AS traj_id, state, CASE WHEN state <> 'late' THEN g_n END AS g_n,
       {sql_r6("CASE WHEN state <> 'late' THEN (score - mu) / (sd + 1e-6::DOUBLE) END")} AS adv
FROM j JOIN st USING (uid, i)""")
def q_stream_group_deadline(spark, sf):
    out = K.run_stateful(K.group_credit(_rollouts(spark, sf).select("uid", "traj_id", "us", "score", "ts"), ["uid"],
                                        ROLLOUTS, TIMEOUT_S, RETENTION_S), "l5-h2")
    return out.select("traj_id", "state", "g_n", r6(F.col("adv")).alias("adv"))


@query("stream_role_deadline", "L5,H4", oracle_with("traj", recursive=True) + _ROLLOUT_SQL
       + _rounds_sql("ro", "role_uid", ROLLOUTS, TIMEOUT_S, RETENTION_S) + f""",
runs AS (SELECT traj_id, CAST(sum(CASE WHEN pmask < 0 AND coalesce(before, 0) >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS nv
         FROM (SELECT traj_id, pmask, lag(pmask) OVER (PARTITION BY traj_id ORDER BY pos) AS before FROM tok) GROUP BY traj_id),
j AS (SELECT m.*, ro.is_planner, ro.is_dummy, ro.gen_uid,
             ro.score - CASE WHEN ro.is_planner THEN 0.3::DOUBLE * CAST(least(coalesce(nv, 0), 5) AS DOUBLE) ELSE 0.0::DOUBLE END AS s
      FROM m JOIN ro USING (k) LEFT JOIN runs ON runs.traj_id = ro.traj_id),
cnt AS (SELECT *, row_number() OVER (PARTITION BY role_uid, i, gen_uid ORDER BY us, k) AS nth FROM j WHERE state <> 'late' AND NOT is_dummy),
st AS (SELECT role_uid, i, CASE WHEN count(*) = 1 THEN 0.0::DOUBLE ELSE avg(s) END AS mu,
              CASE WHEN count(*) = 1 THEN 1.0::DOUBLE ELSE stddev_samp(s) END AS sd FROM cnt WHERE NOT is_planner OR nth = 1 GROUP BY role_uid, i)
SELECT k AS traj_id, state, CASE WHEN state <> 'late' THEN n END AS g_n,
       {sql_r6("CASE WHEN state = 'late' THEN NULL WHEN is_dummy THEN 0.0::DOUBLE ELSE (s - mu) / (sd + 1e-6::DOUBLE) END")} AS adv
FROM j LEFT JOIN st USING (role_uid, i)""")
def q_stream_role_deadline(spark, sf):
    out = K.run_stateful(K.group_credit(_rollouts(spark, sf), ["uid", "planner"], ROLLOUTS, TIMEOUT_S, RETENTION_S, (0.3, 5)), "l5-h4")
    return out.select("traj_id", "state", "g_n", r6(F.col("adv")).alias("adv"))


def q_stream_validation(spark, sf):
    """Plans arrive out of order, dealt over the files by a hash; the event time is the iteration."""
    from credsight.sources.fixtures import rule_inputs
    p = K.plan_messages(*rule_inputs(spark, sf)).withColumn("ts", F.timestamp_seconds("iteration"))
    mixed = p.withColumn("arrival", F.timestamp_seconds(F.pmod(F.xxhash64("graph_id", "iteration"), F.lit(1_000_000))))
    path = S.materialise_in_order(mixed, "l8-plans", "arrival", last=K.closing_row(mixed, "ts"))
    st = K.timed(S.stream_table(spark, path, max_files=4), "ts", "100 days")
    return K.run_stateful(K.validate_plans(st), "l8")


def _register_validation():
    from credsight.plans.q_rules import _V_SQL
    query("stream_validation", "L8", _V_SQL + "SELECT graph_id, iteration, rule, node_id, message FROM viol")(
        q_stream_validation)


_register_validation()
