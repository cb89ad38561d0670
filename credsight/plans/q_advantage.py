"""Queries for the advantage estimators (H1-H15, F16) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from credsight.functions.columns import r6, sql_r6
from credsight.operators import advantage as A
from credsight.plans.catalog import query
from credsight.sources.fixtures import oracle_with, tokens, trajectories


def _tt(spark, sf):
    tok = tokens(spark, sf)
    return tok, trajectories(spark, sf, tok)


def _tok_out(df, *cols):
    return df.select("traj_id", "pos", *[r6(F.col(c)).alias(c) for c in cols])


_ST = """, st AS (
  SELECT uid, count(*) AS g_n,
         CASE WHEN count(*) = 1 THEN 0.0::DOUBLE ELSE avg(score) END AS g_mean,
         CASE WHEN count(*) = 1 THEN 1.0::DOUBLE ELSE stddev_samp(score) END AS g_std,
         sum(score) AS g_sum, avg(score) AS raw_mean, stddev_samp(score) AS raw_std
  FROM traj GROUP BY uid)
"""


def _tok_sql(adv_expr: str) -> str:
    return f""", ta AS (SELECT traj_id, {adv_expr} AS adv FROM traj JOIN st USING (uid))
SELECT tok.traj_id, tok.pos, {sql_r6('ta.adv * tok.mask')} AS adv FROM tok JOIN ta USING (traj_id)"""


# H2 -----------------------------------------------------------------------

@query("adv_grpo", "H2,H14", oracle_with("traj") + _ST + _tok_sql("(score - g_mean) / (g_std + 1e-6::DOUBLE)"))
def q_adv_grpo(spark, sf):
    tok, traj = _tt(spark, sf)
    return _tok_out(A.to_tokens(tok, A.grpo(traj)), "adv")


@query("adv_grpo_nostd", "H2", oracle_with("traj") + _ST + _tok_sql("score - g_mean"))
def q_adv_grpo_nostd(spark, sf):
    tok, traj = _tt(spark, sf)
    return _tok_out(A.to_tokens(tok, A.grpo(traj, norm_by_std=False)), "adv")


@query("adv_grpo_vec", "H5", oracle_with("traj") + _ST + _tok_sql("(score - g_mean) / (g_std + 1e-6::DOUBLE)"))
def q_adv_grpo_vec(spark, sf):
    tok, traj = _tt(spark, sf)
    return _tok_out(A.to_tokens(tok, A.grpo_vectorized(traj)), "adv")


# H3 -----------------------------------------------------------------------

_FOLD = """, fr AS (SELECT uid, gen_uid, arg_min(score, batch_idx) AS fs FROM traj GROUP BY uid, gen_uid),
st AS (SELECT uid, count(*) AS g_n, avg(fs) AS m, stddev_samp(fs) AS s FROM fr GROUP BY uid),
ta0 AS (SELECT traj_id, uid, raw_score,
          (score - CASE WHEN g_n = 1 THEN 0.0::DOUBLE ELSE m END)
          / (CASE WHEN g_n = 1 THEN 1.0::DOUBLE ELSE s END + 1e-6::DOUBLE) AS a
        FROM traj JOIN st USING (uid))
"""


@query("adv_fold", "H3", oracle_with("traj") + _FOLD + f""",
ta AS (SELECT traj_id, CASE WHEN a > 0 AND raw_score < 0 THEN 0.0::DOUBLE ELSE a END AS adv FROM ta0)
SELECT tok.traj_id, tok.pos, {sql_r6('ta.adv * tok.mask')} AS adv FROM tok JOIN ta USING (traj_id)""")
def q_adv_fold(spark, sf):
    tok, traj = _tt(spark, sf)
    return _tok_out(A.to_tokens(tok, A.fold_grpo(traj, fix_bad_positive=True)), "adv")


@query("adv_fold_process", "H3", oracle_with("traj") + _FOLD + f""",
ext AS (SELECT uid, CASE WHEN min(a) >= 0 THEN -1.0::DOUBLE ELSE min(a) END AS gmin,
               CASE WHEN max(a) <= 0 THEN 1.0::DOUBLE ELSE max(a) END AS gmax FROM ta0 GROUP BY uid),
ta AS (SELECT traj_id, a, gmin, gmax FROM ta0 JOIN ext USING (uid))
SELECT tok.traj_id, tok.pos,
       {sql_r6('(CASE WHEN tok.pmask > 0 THEN gmax WHEN tok.pmask < 0 THEN gmin ELSE a END) * tok.mask')} AS adv
FROM tok JOIN ta USING (traj_id)""")
def q_adv_fold_process(spark, sf):
    tok, traj = _tt(spark, sf)
    return _tok_out(A.fold_grpo_process(traj, tok), "adv")


# H4 (flagship) --------------------------------------------------------------

_H4 = """, lg AS (SELECT traj_id, CASE WHEN pmask < 0 THEN 1 ELSE 0 END AS ng,
              lag(CASE WHEN pmask < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY traj_id ORDER BY pos) AS prev
       FROM tok),
runs AS (SELECT traj_id, sum(CASE WHEN ng = 1 AND coalesce(prev, 0) = 0 THEN 1 ELSE 0 END) AS nv
         FROM lg GROUP BY traj_id),
t AS (SELECT traj.*, CAST(uid AS VARCHAR) || CASE WHEN is_planner THEN '_orch' ELSE '_exec' END AS role_uid,
             score - CASE WHEN is_planner THEN 0.3::DOUBLE * CAST(least(coalesce(nv, 0), 5) AS DOUBLE)
                          ELSE 0.0::DOUBLE END AS ps
      FROM traj LEFT JOIN runs USING (traj_id)),
pool AS (SELECT role_uid, arg_min(ps, batch_idx) AS s FROM t WHERE NOT is_dummy AND is_planner
         GROUP BY role_uid, gen_uid
         UNION ALL
         SELECT role_uid, ps AS s FROM t WHERE NOT is_dummy AND NOT is_planner),
st AS (SELECT role_uid, count(*) AS g_n, avg(s) AS m, stddev_samp(s) AS sd FROM pool GROUP BY role_uid),
ta AS (SELECT traj_id, role_uid,
              CASE WHEN is_dummy THEN 0.0::DOUBLE
                   ELSE (ps - CASE WHEN g_n = 1 THEN 0.0::DOUBLE ELSE m END)
                        / (CASE WHEN g_n = 1 THEN 1.0::DOUBLE ELSE sd END + 1e-6::DOUBLE) END AS adv
       FROM t LEFT JOIN st USING (role_uid))
"""


@query("adv_role_penalised", "H4,H14,F16", oracle_with("traj") + _H4 + f"""
SELECT tok.traj_id, tok.pos, {sql_r6('ta.adv * tok.mask')} AS adv FROM tok JOIN ta USING (traj_id)""")
def q_adv_role_penalised(spark, sf):
    tok, traj = _tt(spark, sf)
    return _tok_out(A.to_tokens(tok, A.role_penalised_grpo(traj, tok)), "adv")


def role_summary(spark, sf):
    tok, traj = _tt(spark, sf)
    ta = A.role_penalised_grpo(traj, tok)
    toks = A.to_tokens(tok, ta).join(ta.select("traj_id", "role_uid"), "traj_id")
    role = F.when(F.col("role_uid").endswith("_orch"), "orchestrator").otherwise("executor")
    return (toks.groupBy(role.alias("role"))
            .agg(r6(F.avg("adv")).alias("mean_adv"), r6(F.sum("adv")).alias("sum_adv"),
                 F.count(F.lit(1)).alias("n_tokens"),
                 F.countDistinct("traj_id").alias("n_traj")))


query("adv_role_summary", "H4", oracle_with("traj") + _H4 + f""",
x AS (SELECT tok.traj_id, ta.adv * tok.mask AS adv,
             CASE WHEN ta.role_uid LIKE '%\\_orch' ESCAPE '\\' THEN 'orchestrator' ELSE 'executor' END AS role
      FROM tok JOIN ta USING (traj_id))
SELECT role, {sql_r6('avg(adv)')} AS mean_adv, {sql_r6('sum(adv)')} AS sum_adv,
       count(*) AS n_tokens, count(DISTINCT traj_id) AS n_traj FROM x GROUP BY role""")(role_summary)


# H6 -----------------------------------------------------------------------

@query("adv_passk", "H6", oracle_with("traj") + f""", r AS (
  SELECT uid, traj_id, score,
         row_number() OVER (PARTITION BY uid ORDER BY score DESC, batch_idx) AS rk FROM traj),
top AS (SELECT uid, max(CASE WHEN rk = 1 THEN traj_id END) AS i_max,
               max(CASE WHEN rk = 1 THEN score END) AS r1, max(CASE WHEN rk = 2 THEN score END) AS r2
        FROM r WHERE rk <= 2 GROUP BY uid),
st AS (SELECT uid, count(*) AS g_n, stddev_samp(score) AS sd FROM traj GROUP BY uid),
ta AS (SELECT t.traj_id,
              CASE WHEN g_n < 2 THEN NULL WHEN t.traj_id = i_max THEN (r1 - r2) / (sd + 1e-6::DOUBLE)
                   ELSE 0.0::DOUBLE END AS adv,
              CASE WHEN g_n < 2 THEN 'group_too_small' ELSE 'ok' END AS status
       FROM traj t JOIN top USING (uid) JOIN st USING (uid))
SELECT tok.traj_id, tok.pos, {sql_r6('ta.adv * tok.mask')} AS adv, status FROM tok JOIN ta USING (traj_id)""")
def q_adv_passk(spark, sf):
    tok, traj = _tt(spark, sf)
    ta = A.passk(traj)
    t = tok.select("traj_id", "pos", "mask").join(ta, "traj_id")
    return t.select("traj_id", "pos", r6(F.col("adv") * F.col("mask")).alias("adv"), "status")


# H7 -----------------------------------------------------------------------

@query("adv_rfpp_baseline", "H7,H15", oracle_with("traj") + _ST + f""",
ta AS (SELECT traj_id, score - g_mean AS a FROM traj JOIN st USING (uid)),
x AS (SELECT tok.traj_id, tok.pos, tok.mask, ta.a * tok.mask AS x FROM tok JOIN ta USING (traj_id)),
mo AS (SELECT avg(x) FILTER (WHERE mask = 1) AS mu, var_samp(x) FILTER (WHERE mask = 1) AS v FROM x)
SELECT traj_id, pos, {sql_r6('(x - mu) / sqrt(v + 1e-8::DOUBLE) * mask')} AS adv FROM x, mo""")
def q_adv_rfpp_baseline(spark, sf):
    tok, traj = _tt(spark, sf)
    return _tok_out(A.to_tokens(tok, A.reinforce_pp_baseline(traj, tok)), "adv")


# H8, H9, H12, H13 ---------------------------------------------------------

@query("adv_rloo", "H8", oracle_with("traj") + _ST + _tok_sql(
    "CASE WHEN g_n > 1 THEN score * g_n / (g_n - 1) - raw_mean * g_n / (g_n - 1) ELSE score END"))
def q_adv_rloo(spark, sf):
    tok, traj = _tt(spark, sf)
    return _tok_out(A.to_tokens(tok, A.rloo(traj)), "adv")


@query("adv_opo", "H9", oracle_with("traj") + """, st AS (
  SELECT uid, CASE WHEN count(*) = 1 THEN 0.0::DOUBLE
                   ELSE sum(n_valid * score) / nullif(sum(n_valid), 0) END AS bsl
  FROM traj GROUP BY uid)""" + _tok_sql("score - bsl"))
def q_adv_opo(spark, sf):
    tok, traj = _tt(spark, sf)
    return _tok_out(A.to_tokens(tok, A.opo(traj)), "adv")


@query("adv_gpg", "H12", oracle_with("traj") + _ST + """,
al AS (SELECT CAST(count(*) AS DOUBLE) / CAST(greatest(count(*) FILTER (WHERE score <> 0), 1) AS DOUBLE) AS alpha
       FROM traj)""" + _tok_sql("(SELECT alpha FROM al) * (score - g_mean) / 1.0::DOUBLE"))
def q_adv_gpg(spark, sf):
    tok, traj = _tt(spark, sf)
    return _tok_out(A.to_tokens(tok, A.gpg(traj)), "adv")


@query("adv_rloo_vec", "H13", oracle_with("traj") + _ST + _tok_sql(
    "CASE WHEN g_n > 1 THEN (g_n * score - g_sum) / greatest(g_n - 1, 1) ELSE 0.0::DOUBLE END"))
def q_adv_rloo_vec(spark, sf):
    tok, traj = _tt(spark, sf)
    return _tok_out(A.to_tokens(tok, A.rloo_vectorized(traj)), "adv")


# H1, H10, H11 -------------------------------------------------------------

GAMMA, LAM = 0.99, 0.95

_TR = """, tr AS (SELECT traj_id, pos, reward, value, mask, max(pos) OVER (PARTITION BY traj_id) AS lp FROM tok)"""


@query("adv_gae", "H1,H15", oracle_with("tok", recursive=True) + _TR + f""",
scan(traj_id, pos, nextv, lastg) AS (
  SELECT traj_id, pos, value * mask, (reward - value) * mask FROM tr WHERE pos = lp
  UNION ALL
  SELECT t.traj_id, t.pos, t.value * t.mask + (1 - t.mask) * s.nextv,
         (t.reward + {GAMMA}::DOUBLE * s.nextv - t.value + {GAMMA * LAM}::DOUBLE * s.lastg) * t.mask
           + (1 - t.mask) * s.lastg
  FROM scan s JOIN tr t ON t.traj_id = s.traj_id AND t.pos = s.pos - 1),
x AS (SELECT s.traj_id, s.pos, s.lastg, t.value, t.mask FROM scan s JOIN tr t USING (traj_id, pos)),
mo AS (SELECT avg(lastg) FILTER (WHERE mask = 1) AS mu, var_samp(lastg) FILTER (WHERE mask = 1) AS v FROM x)
SELECT traj_id, pos, {sql_r6('(lastg - mu) / sqrt(v + 1e-8::DOUBLE)')} AS adv, {sql_r6('lastg + value')} AS ret
FROM x, mo""")
def q_adv_gae(spark, sf):
    return _tok_out(A.gae(tokens(spark, sf), GAMMA, LAM), "adv", "ret")


@query("adv_rfpp", "H10,H15", oracle_with("tok", recursive=True) + _TR + f""",
scan(traj_id, pos, ret, carry) AS (
  SELECT traj_id, pos, reward, reward * mask FROM tr WHERE pos = lp
  UNION ALL
  SELECT t.traj_id, t.pos, t.reward + {GAMMA}::DOUBLE * s.carry, (t.reward + {GAMMA}::DOUBLE * s.carry) * t.mask
  FROM scan s JOIN tr t ON t.traj_id = s.traj_id AND t.pos = s.pos - 1),
x AS (SELECT s.traj_id, s.pos, s.ret, t.mask FROM scan s JOIN tr t USING (traj_id, pos)),
mo AS (SELECT avg(ret) FILTER (WHERE mask = 1) AS mu, var_samp(ret) FILTER (WHERE mask = 1) AS v FROM x)
SELECT traj_id, pos, {sql_r6('(ret - mu) / sqrt(v + 1e-8::DOUBLE) * mask')} AS adv, {sql_r6('ret')} AS ret
FROM x, mo""")
def q_adv_rfpp(spark, sf):
    return _tok_out(A.reinforce_pp(tokens(spark, sf), GAMMA), "adv", "ret")


@query("adv_remax", "H11", oracle_with("traj") + f""",
x AS (SELECT traj_id, pos, mask,
             sum(reward * mask) OVER (PARTITION BY traj_id ORDER BY pos
                                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret FROM tok)
SELECT x.traj_id, x.pos, {sql_r6('x.ret - traj.baseline * x.mask')} AS adv, {sql_r6('x.ret')} AS ret
FROM x JOIN traj USING (traj_id)""")
def q_adv_remax(spark, sf):
    tok, traj = _tt(spark, sf)
    return _tok_out(A.remax(tok, traj), "adv", "ret")


# M1 / M2: operators found by name ------------------------------------------

_NAMED = {"grpo": "adv_grpo", "rloo": "adv_rloo", "remax": "adv_remax", "gae": "adv_gae"}


def _by_name_sql() -> str:
    from credsight.plans.catalog import ORACLES
    return " UNION ALL ".join(
        f"SELECT '{name}' AS estimator, traj_id, {sql_r6('sum(adv)')} AS adv_sum, count(*) AS n FROM ({ORACLES[q]}) GROUP BY traj_id" for name, q in _NAMED.items())


@query("estimators_by_name", "M1", _by_name_sql())
def q_estimators_by_name(spark, sf):
    """The same inputs for every estimator; each takes the tables it asks for."""
    from credsight.plans.registry import ESTIMATORS
    tok, traj = _tt(spark, sf)
    parts = []
    for name in _NAMED:
        a = ESTIMATORS.call(name, {"tok": tok, "traj": traj}, {"gamma": GAMMA, "lam": LAM} if name == "gae" else None)
        a = a if "pos" in a.columns else A.to_tokens(tok, a)
        parts.append(a.select("traj_id", r6(F.col("adv")).alias("adv")).groupBy("traj_id").agg(
            r6(F.sum("adv")).alias("adv_sum"), F.count(F.lit(1)).alias("n")).withColumn("estimator", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("estimator", "traj_id", "adv_sum", "n")
