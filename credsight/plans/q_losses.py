"""Queries for KL estimators and loss diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from credsight.functions.columns import d, r6, sql_mix_hash, sql_r6
from credsight.operators import losses as L
from credsight.plans.catalog import query
from credsight.sources.fixtures import oracle_with, tokens, trajectories

CFG = L.ClipConfig(clip_ratio=0.1, clip_ratio_high=0.15, clip_ratio_c=3.0)
LO, HI = 1 - CFG.low, 1 + CFG.high


def _tok(spark, sf):
    """Token fixture plus an advantage (the token reward) and a return target."""
    t = tokens(spark, sf)
    return t.withColumn("adv", F.col("reward")).withColumn("ret", F.col("reward") + F.col("value"))


def _round_all(df):
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_TK = """, tk AS (SELECT *, reward AS adv, reward + value AS ret FROM tok)"""


def _mm(x: str, m: str = "mask") -> str:
    return f"sum(CAST({x} AS DOUBLE) * {m}) / (CAST(sum({m}) AS DOUBLE) + 1e-8::DOUBLE)"


def _agg_sql(mode: str, src: str, loss: str, mask: str = "mask") -> str:
    """Scalar subquery aggregating ``loss`` of table ``src`` in J1 mode."""
    if mode == "token-mean":
        return f"(SELECT sum({loss} * {mask}) / CAST(greatest(sum({mask}), 1) AS DOUBLE) FROM {src})"
    per = f"(SELECT traj_id, sum({loss} * {mask}) AS s, CAST(sum({mask}) AS DOUBLE) AS n, count(*) AS w FROM {src} GROUP BY traj_id)"
    if mode == "seq-mean-token-sum":
        return f"(SELECT sum(s) FILTER (WHERE n > 0) / nullif(CAST(count(*) FILTER (WHERE n > 0) AS DOUBLE), 0) FROM {per})"
    if mode == "seq-mean-token-mean":
        return (f"(SELECT sum(s / (n + 1e-8::DOUBLE)) FILTER (WHERE n > 0) "
                f"/ nullif(CAST(count(*) FILTER (WHERE n > 0) AS DOUBLE), 0) FROM {per})")
    return f"(SELECT sum(s) / CAST(max(w) AS DOUBLE) FROM {per})"


_PPO_TOK = f""", p AS (SELECT traj_id, pos, mask, adv,
                greatest(-20.0::DOUBLE, least(20.0::DOUBLE, logp - old_logp)) AS nkl FROM tk),
z AS (SELECT traj_id, pos, mask, adv, nkl, -adv * exp(nkl) AS pg1,
             -adv * greatest({LO!r}::DOUBLE, least({HI!r}::DOUBLE, exp(nkl))) AS pg2,
             -adv * {CFG.clip_ratio_c!r}::DOUBLE AS pg3 FROM p),
y AS (SELECT *, greatest(pg1, pg2) AS c1 FROM z),
x AS (SELECT traj_id, pos, mask, nkl, CASE WHEN adv < 0 THEN least(pg3, c1) ELSE c1 END AS pg,
             CASE WHEN pg2 > pg1 THEN 1 ELSE 0 END AS is_clip,
             CASE WHEN c1 > pg3 AND adv < 0 THEN 1 ELSE 0 END AS is_low FROM y)
"""


def _ppo_oracle(mode: str) -> str:
    return oracle_with("tok") + _TK + _PPO_TOK + f"""
SELECT {sql_r6(_agg_sql(mode, 'x', 'pg'))} AS pg_loss,
       {sql_r6(f"(SELECT {_mm('is_clip')} FROM x)")} AS pg_clipfrac,
       {sql_r6(f"(SELECT {_mm('-nkl')} FROM x)")} AS ppo_kl,
       {sql_r6(f"(SELECT {_mm('is_low')} FROM x)")} AS pg_clipfrac_lower"""


def _ppo_query(mode: str):
    def fn(spark, sf):
        return _round_all(L.ppo_loss(_tok(spark, sf), CFG, mode).select(
            "pg_loss", "pg_clipfrac", "ppo_kl", "pg_clipfrac_lower"))
    return fn


for _name, _mode in [("loss_ppo_token_mean", "token-mean"), ("loss_ppo_seq_sum", "seq-mean-token-sum"),
                     ("loss_ppo_seq_mean", "seq-mean-token-mean"), ("loss_ppo_seq_norm", "seq-mean-token-sum-norm")]:
    query(_name, "J1,J2,J3,J13", _ppo_oracle(_mode))(_ppo_query(_mode))


# J3 with an overlong mask (trajectories longer than 8 tokens excluded) and IS weights
@query("loss_ppo_overlong", "J3", oracle_with("traj") + """,
tk AS (SELECT tok.*, reward AS adv,
              tok.mask * CASE WHEN traj.n_tokens > 8 THEN 0 ELSE 1 END AS emask,
              least(exp(logp - ref_logp), 2.0::DOUBLE) AS w
       FROM tok JOIN traj USING (traj_id))""" + _PPO_TOK.replace(
    "SELECT traj_id, pos, mask, adv,\n", "SELECT traj_id, pos, emask AS mask, adv, w,\n").replace(
    "SELECT traj_id, pos, mask, adv, nkl,", "SELECT traj_id, pos, mask, adv, nkl, w,").replace(
    "x AS (SELECT traj_id, pos, mask, nkl, CASE WHEN adv < 0 THEN least(pg3, c1) ELSE c1 END AS pg,",
    "x AS (SELECT traj_id, pos, mask, nkl, w * CASE WHEN adv < 0 THEN least(pg3, c1) ELSE c1 END AS pg,") + f"""
SELECT {sql_r6(_agg_sql('token-mean', 'x', 'pg'))} AS pg_loss,
       {sql_r6(f"(SELECT {_mm('is_clip')} FROM x)")} AS pg_clipfrac,
       {sql_r6(f"(SELECT {_mm('-nkl')} FROM x)")} AS ppo_kl,
       {sql_r6(f"(SELECT {_mm('is_low')} FROM x)")} AS pg_clipfrac_lower""")
def q_loss_ppo_overlong(spark, sf):
    t = _tok(spark, sf)
    traj = trajectories(spark, sf, t)
    t = (t.join(traj.select("traj_id", "n_tokens"), "traj_id")
         .withColumn("keep", F.when(F.col("n_tokens") > 8, 0).otherwise(1))
         .withColumn("w", F.least(F.exp(F.col("logp") - F.col("ref_logp")), d(2.0))))
    return _round_all(L.ppo_loss(t, CFG, "token-mean", overlong="keep", weights="w").select(
        "pg_loss", "pg_clipfrac", "ppo_kl", "pg_clipfrac_lower"))


@query("loss_gspo", "J4", oracle_with("tok") + _TK + f""",
sq AS (SELECT traj_id, sum((logp - old_logp) * mask) / CAST(greatest(sum(mask), 1) AS DOUBLE) AS seq_kl
       FROM tk GROUP BY traj_id),
z AS (SELECT tk.traj_id, mask, logp, old_logp, -adv * exp(least(seq_kl, 10.0::DOUBLE)) AS pg1,
             -adv * greatest({LO!r}::DOUBLE, least({HI!r}::DOUBLE, exp(least(seq_kl, 10.0::DOUBLE)))) AS pg2
      FROM tk JOIN sq USING (traj_id)),
x AS (SELECT traj_id, mask, greatest(pg1, pg2) AS pg, CASE WHEN pg2 > pg1 THEN 1 ELSE 0 END AS is_clip,
             -(logp - old_logp) AS neg_nkl FROM z)
SELECT {sql_r6(_agg_sql('seq-mean-token-mean', 'x', 'pg'))} AS pg_loss,
       {sql_r6(f"(SELECT {_mm('is_clip')} FROM x)")} AS pg_clipfrac,
       {sql_r6(f"(SELECT {_mm('neg_nkl')} FROM x)")} AS ppo_kl,
       0.0::DOUBLE AS pg_clipfrac_lower""")
def q_loss_gspo(spark, sf):
    return _round_all(L.gspo_loss(_tok(spark, sf), CFG))


@query("loss_gpg", "J5", oracle_with("tok") + _TK + f""",
x AS (SELECT traj_id, mask, -logp * adv AS pg FROM tk)
SELECT {sql_r6(_agg_sql('token-mean', 'x', 'pg'))} AS pg_loss""")
def q_loss_gpg(spark, sf):
    return _round_all(L.gpg_loss(_tok(spark, sf)))


def _clip_cov_sql(weight: str = "1.0::DOUBLE") -> str:
    r = "exp(logp - old_logp)"
    return oracle_with("tok") + _TK + f""",
mu AS (SELECT {_mm('adv')} AS mu_a, {_mm('logp')} AS mu_l, greatest(CAST(floor(0.002::DOUBLE * CAST(sum(mask) AS DOUBLE)) AS BIGINT), 1) AS k FROM tk),
z AS (SELECT tk.*, -adv * {r} AS pg1, -adv * greatest({LO!r}::DOUBLE, least({HI!r}::DOUBLE, {r})) AS pg2,
             (adv - mu_a) * (logp - mu_l) AS cov, k, {weight} AS w FROM tk, mu),
pick AS (SELECT traj_id, pos FROM (
           SELECT traj_id, pos, k, row_number() OVER (ORDER BY {sql_mix_hash('traj_id', 'pos', 0)}, traj_id, pos) AS rk FROM z
           WHERE mask > 0 AND NOT (pg2 > pg1) AND cov > 0.05 AND cov < 5.0) WHERE rk <= k),
x AS (SELECT z.traj_id, z.mask, CASE WHEN pick.pos IS NULL THEN greatest(pg1, pg2) * w ELSE 0.0::DOUBLE END AS pg,
             CASE WHEN pick.pos IS NULL THEN 0 ELSE 1 END AS zeroed, -(logp - old_logp) AS neg_nkl
      FROM z LEFT JOIN pick USING (traj_id, pos))
SELECT {sql_r6(_agg_sql('token-mean', 'x', 'pg'))} AS pg_loss,
       {sql_r6(f"(SELECT {_mm('zeroed')} FROM x)")} AS pg_clipfrac,
       {sql_r6(f"(SELECT {_mm('neg_nkl')} FROM x)")} AS ppo_kl"""


@query("loss_clip_cov", "J6", _clip_cov_sql())
def q_loss_clip_cov(spark, sf):
    return _round_all(L.clip_cov_loss(_tok(spark, sf), CFG, lb=0.05, ub=5.0, clip_cov_ratio=0.002))


# the same losses with rollout importance weights, 1 + value / 4
_W = "(1.0::DOUBLE + value / 4.0::DOUBLE)"


def _tok_w(spark, sf):
    return _tok(spark, sf).withColumn("w", F.lit(1.0) + F.col("value") / F.lit(4.0))


@query("loss_clip_cov_w", "J6", _clip_cov_sql(_W))
def q_loss_clip_cov_w(spark, sf):
    return _round_all(L.clip_cov_loss(_tok_w(spark, sf), CFG, lb=0.05, ub=5.0, clip_cov_ratio=0.002, weights="w"))


@query("loss_gpg_w", "J5", oracle_with("tok") + _TK + f""",
x AS (SELECT traj_id, mask, -logp * adv * {_W} AS pg FROM tk)
SELECT {sql_r6(_agg_sql('token-mean', 'x', 'pg'))} AS pg_loss""")
def q_loss_gpg_w(spark, sf):
    return _round_all(L.gpg_loss(_tok_w(spark, sf), weights="w"))


@query("loss_gspo_w", "J4", oracle_with("tok") + _TK + f""",
sq AS (SELECT traj_id, exp(least(sum((logp - old_logp) * mask) / CAST(greatest(sum(mask), 1) AS DOUBLE), 10.0::DOUBLE)) AS r
       FROM tk GROUP BY traj_id),
x AS (SELECT traj_id, mask, {_W} * greatest(-adv * r, -adv * greatest({LO!r}::DOUBLE, least({HI!r}::DOUBLE, r))) AS pg
      FROM tk JOIN sq USING (traj_id))
SELECT {sql_r6(_agg_sql('seq-mean-token-mean', 'x', 'pg'))} AS pg_loss""")
def q_loss_gspo_w(spark, sf):
    return _round_all(L.gspo_loss(_tok_w(spark, sf), CFG, weights="w").select("pg_loss"))


@query("loss_kl_cov_w", "J7", oracle_with("tok") + _TK + f""",
v AS (SELECT * FROM tk WHERE mask > 0),
mu AS (SELECT avg(adv) AS mu_a, avg(logp) AS mu_l, greatest(1, CAST(floor(count(*) * 0.0002::DOUBLE) AS BIGINT)) AS k FROM v),
top AS (SELECT traj_id, pos FROM (SELECT traj_id, pos, k, row_number() OVER (
          ORDER BY (adv - mu_a) * (logp - mu_l) DESC, traj_id, pos) AS rk FROM v, mu) WHERE rk <= k),
x AS (SELECT tk.traj_id, tk.mask, {_W} * (-adv * exp(logp - old_logp)
             + CASE WHEN top.pos IS NOT NULL THEN abs(logp - old_logp) ELSE 0.0::DOUBLE END) AS pg
      FROM tk LEFT JOIN top USING (traj_id, pos))
SELECT {sql_r6(_agg_sql('token-mean', 'x', 'pg'))} AS pg_loss""")
def q_loss_kl_cov_w(spark, sf):
    return _round_all(L.kl_cov_loss(_tok_w(spark, sf), weights="w").select("pg_loss"))


@query("loss_geo_mean_w", "J8", oracle_with("traj") + _TK + f""",
h AS (SELECT traj_id, mask, adv, sign(adv) * least(sign(adv) * (logp - old_logp), sign(adv)
             * greatest(-{CFG.low!r}::DOUBLE, least({CFG.high!r}::DOUBLE, logp - old_logp))) AS dmin, ln({_W} + 1e-10) AS lw FROM tk),
per AS (SELECT traj_id, sum(dmin * mask) AS dm, sum(adv * mask) AS am, sum(lw * mask) AS lw, CAST(sum(mask) AS DOUBLE) + 1e-8 AS n
        FROM h GROUP BY traj_id)
SELECT {sql_r6('avg(coalesce(-(am / n) * exp(dm / n) * exp(lw / n), 0.0::DOUBLE))')} AS pg_loss FROM traj LEFT JOIN per USING (traj_id)""")
def q_loss_geo_mean_w(spark, sf):
    t = _tok_w(spark, sf)
    return _round_all(L.geo_mean_loss(t, trajectories(spark, sf, t), CFG, weights="w").select("pg_loss"))


@query("loss_kl_cov", "J7", oracle_with("tok") + _TK + f""",
v AS (SELECT * FROM tk WHERE mask > 0),
mu AS (SELECT avg(adv) AS mu_a, avg(logp) AS mu_l, count(*) AS nv FROM v),
top AS (SELECT traj_id, pos FROM (
          SELECT traj_id, pos, row_number() OVER (ORDER BY (adv - mu_a) * (logp - mu_l) DESC, traj_id, pos) AS rk
          FROM v, mu) WHERE rk <= (SELECT greatest(1, CAST(floor(nv * 0.0002::DOUBLE) AS BIGINT)) FROM mu)),
x AS (SELECT tk.traj_id, tk.mask, abs(logp - old_logp) AS absd,
             CASE WHEN top.pos IS NOT NULL THEN -adv * exp(logp - old_logp) + 1.0::DOUBLE * abs(logp - old_logp)
                  ELSE -adv * exp(logp - old_logp) END AS pg
      FROM tk LEFT JOIN top USING (traj_id, pos))
SELECT {sql_r6(_agg_sql('token-mean', 'x', 'pg'))} AS pg_loss,
       {sql_r6(f"(SELECT {_mm('absd')} FROM x)")} AS ppo_kl""")
def q_loss_kl_cov(spark, sf):
    return _round_all(L.kl_cov_loss(_tok(spark, sf)))


@query("loss_geo_mean", "J8", oracle_with("traj") + _TK + f""",
g AS (SELECT traj_id, mask, adv, logp - old_logp AS delta,
             greatest(-{CFG.low!r}::DOUBLE, least({CFG.high!r}::DOUBLE, logp - old_logp)) AS dcl FROM tk),
h AS (SELECT *, sign(adv) * least(sign(adv) * delta, sign(adv) * dcl) AS dmin FROM g),
per AS (SELECT traj_id, sum(dmin * mask) AS dm, sum(adv * mask) AS am, CAST(sum(mask) AS DOUBLE) AS n
        FROM h GROUP BY traj_id),
rows AS (SELECT -(coalesce(am, 0.0::DOUBLE) / (coalesce(n, 0.0::DOUBLE) + 1e-8::DOUBLE))
                 * exp(coalesce(dm, 0.0::DOUBLE) / (coalesce(n, 0.0::DOUBLE) + 1e-8::DOUBLE)) AS pg
         FROM traj LEFT JOIN per USING (traj_id))
SELECT {sql_r6('(SELECT avg(pg) FROM rows)')} AS pg_loss,
       {sql_r6(f"(SELECT {_mm('CASE WHEN delta <> dcl AND adv > 0 THEN 1 ELSE 0 END')} FROM h)")} AS pg_clipfrac,
       {sql_r6(f"(SELECT {_mm('-delta')} FROM h)")} AS ppo_kl,
       {sql_r6(f"(SELECT {_mm('CASE WHEN delta <> dcl AND adv < 0 THEN 1 ELSE 0 END')} FROM h)")} AS pg_clipfrac_lower""")
def q_loss_geo_mean(spark, sf):
    t = _tok(spark, sf)
    return _round_all(L.geo_mean_loss(t, trajectories(spark, sf, t), CFG))


@query("token_entropy", "J9", oracle_with("tok") + f""",
e AS (SELECT traj_id, mask, logits, list_max(logits) AS m FROM tok),
f AS (SELECT traj_id, mask, m, logits,
             list_sum(list_transform(logits, lambda x: exp(x - m))) AS z FROM e),
x AS (SELECT traj_id, mask,
             (m + ln(z)) - list_sum(list_transform(logits, lambda x: exp(x - m) * x)) / z AS ent FROM f)
SELECT {sql_r6(_agg_sql('token-mean', 'x', 'ent'))} AS entropy""")
def q_token_entropy(spark, sf):
    return _round_all(L.entropy_loss(tokens(spark, sf)))


@query("loss_value", "J10", oracle_with("tok") + _TK + f""",
x AS (SELECT traj_id, mask,
             greatest((vpred - ret) * (vpred - ret),
                      (greatest(value - 0.05::DOUBLE, least(value + 0.05::DOUBLE, vpred)) - ret)
                      * (greatest(value - 0.05::DOUBLE, least(value + 0.05::DOUBLE, vpred)) - ret)) AS vl,
             CASE WHEN (greatest(value - 0.05::DOUBLE, least(value + 0.05::DOUBLE, vpred)) - ret)
                       * (greatest(value - 0.05::DOUBLE, least(value + 0.05::DOUBLE, vpred)) - ret)
                       > (vpred - ret) * (vpred - ret) THEN 1 ELSE 0 END AS vc FROM tk)
SELECT {sql_r6('0.5::DOUBLE * ' + _agg_sql('token-mean', 'x', 'vl'))} AS vf_loss,
       {sql_r6(f"(SELECT {_mm('vc')} FROM x)")} AS vf_clipfrac""")
def q_loss_value(spark, sf):
    return _round_all(L.value_loss(_tok(spark, sf), 0.05))


RC = L.RolloutCorrection(rollout_is="token", is_threshold=1.1, rollout_rs="token", rs_threshold=1.15,
                         rs_threshold_lower=None, veto_threshold=None, batch_normalize=False)


@query("loss_rollout_correction", "J11,J12", oracle_with("tok") + _TK + f""",
a AS (SELECT traj_id, pos, mask, adv, logp, old_logp,
             exp(greatest(-20.0::DOUBLE, least(20.0::DOUBLE, logp - old_logp))) AS r FROM tk),
x AS (SELECT traj_id, mask, adv, logp, old_logp, least(r, 1.1::DOUBLE) AS w,
             mask * CASE WHEN r >= {1 / 1.15!r}::DOUBLE AND r <= 1.15::DOUBLE THEN 1 ELSE 0 END AS emask,
             -adv * logp * least(r, 1.1::DOUBLE) AS pg FROM a)
SELECT {sql_r6(_agg_sql('seq-mean-token-sum', 'x', 'pg', 'emask'))} AS pg_loss,
       {sql_r6(f"(SELECT {_mm('-(logp - old_logp)', 'emask')} FROM x)")} AS ppo_kl,
       {sql_r6(f"(SELECT {_mm('w')} FROM x)")} AS is_weight_mean,
       {sql_r6('(SELECT CAST(sum(emask) AS DOUBLE) / CAST(greatest(sum(mask), 1) AS DOUBLE) FROM x)')} AS rs_kept_frac""")
def q_loss_rollout_correction(spark, sf):
    return _round_all(L.rollout_correction_loss(_tok(spark, sf), RC))


def _rc_sql(w: str, emask: str, norm: bool = False) -> str:
    """Sequence-level correction; ``w`` and ``emask`` over r (token ratio), sr (sequence ratio), mr (least valid ratio)."""
    wn = "w / wn" if norm else "w"
    return oracle_with("tok") + _TK + f""",
a AS (SELECT traj_id, pos, mask, adv, logp, old_logp, greatest(-20.0::DOUBLE, least(20.0::DOUBLE, logp - old_logp)) AS ld FROM tk),
sq AS (SELECT traj_id, exp(greatest(-20.0::DOUBLE, least(20.0::DOUBLE, sum(ld * mask)))) AS sr,
              min(exp(ld)) FILTER (WHERE mask > 0) AS mr FROM a GROUP BY traj_id),
b AS (SELECT a.*, exp(ld) AS r, sr, mr FROM a JOIN sq USING (traj_id)),
c AS (SELECT *, {w} AS w, {emask} AS emask FROM b),
nm AS (SELECT sum(w * emask) / (CAST(sum(emask) AS DOUBLE) + 1e-8) AS wn FROM c),
x AS (SELECT traj_id, mask, emask, logp, old_logp, {wn} AS w, -adv * logp * {wn} AS pg FROM c, nm)
SELECT {sql_r6(_agg_sql('seq-mean-token-sum', 'x', 'pg', 'emask'))} AS pg_loss,
       {sql_r6(f"(SELECT {_mm('-(logp - old_logp)', 'emask')} FROM x)")} AS ppo_kl,
       {sql_r6(f"(SELECT {_mm('w')} FROM x)")} AS is_weight_mean,
       {sql_r6('(SELECT CAST(sum(emask) AS DOUBLE) / CAST(greatest(sum(mask), 1) AS DOUBLE) FROM x)')} AS rs_kept_frac"""


@query("loss_rc_sequence", "J11", _rc_sql(
    "least(sr, 1.2::DOUBLE)",
    f"mask * CASE WHEN sr >= {1 / 1.3!r}::DOUBLE AND sr <= 1.3::DOUBLE THEN 1 ELSE 0 END * CASE WHEN mr < 0.9::DOUBLE THEN 0 ELSE 1 END", True))
def q_loss_rc_sequence(spark, sf):
    rc = L.RolloutCorrection(rollout_is="sequence", is_threshold=1.2, rollout_rs="sequence", rs_threshold=1.3,
                             veto_threshold=0.9, batch_normalize=True)
    return _round_all(L.rollout_correction_loss(_tok(spark, sf), rc))


@query("loss_rc_veto", "J11", _rc_sql("least(r, 1.1::DOUBLE)", "mask"))
def q_loss_rc_veto(spark, sf):
    """A veto without rejection leaves the mask as it is."""
    rc = L.RolloutCorrection(rollout_is="token", is_threshold=1.1, rollout_rs=None, veto_threshold=0.95)
    return _round_all(L.rollout_correction_loss(_tok(spark, sf), rc))


# I1-I3 --------------------------------------------------------------------

@query("kl_estimators", "I2,I3", oracle_with("tok") + f"""
SELECT traj_id, pos, {sql_r6('logp - ref_logp')} AS kl_k1, {sql_r6('abs(logp - ref_logp)')} AS kl_abs,
       {sql_r6('0.5::DOUBLE * (logp - ref_logp) * (logp - ref_logp)')} AS kl_k2,
       {sql_r6('greatest(-10.0::DOUBLE, least(10.0::DOUBLE, exp(greatest(-20.0::DOUBLE, least(20.0::DOUBLE, ref_logp - logp))) - greatest(-20.0::DOUBLE, least(20.0::DOUBLE, ref_logp - logp)) - 1.0::DOUBLE))')} AS kl_k3,
       {sql_r6('greatest(-10.0::DOUBLE, least(10.0::DOUBLE, exp(greatest(-20.0::DOUBLE, least(20.0::DOUBLE, ref_logp - logp))) - greatest(-20.0::DOUBLE, least(20.0::DOUBLE, ref_logp - logp)) - 1.0::DOUBLE))')} AS kl_k3_plus
FROM tok""")
def q_kl_estimators(spark, sf):
    t = tokens(spark, sf)
    lp, rf = F.col("logp"), F.col("ref_logp")
    return t.select("traj_id", "pos", *[r6(L.kl_penalty(lp, rf, k)).alias(n) for n, k in
                                        [("kl_k1", "k1"), ("kl_abs", "abs"), ("kl_k2", "mse"),
                                         ("kl_k3", "low_var_kl"), ("kl_k3_plus", "k3+")]])


@query("kl_reward", "I1", oracle_with("tok") + f"""
SELECT traj_id, pos, {sql_r6('reward - (old_logp - ref_logp) * 0.1::DOUBLE')} AS reward_kl FROM tok""")
def q_kl_reward(spark, sf):
    return L.kl_reward(tokens(spark, sf), 0.1).select("traj_id", "pos", r6(F.col("reward_kl")).alias("reward_kl"))


def _steps_spark(spark, sf):
    """A run for each order priority, a training step for each month: mean k1 KL and token count."""
    t = tokens(spark, sf)
    o = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("traj_id"), F.col("o_orderpriority").alias("run"), F.date_format("o_orderdate", "yyyyMM").cast("bigint").alias("step"))
    return (t.join(o, "traj_id").groupBy("run", "step")
            .agg(F.avg(F.col("logp") - F.col("ref_logp")).alias("kl"), F.count(F.lit(1)).alias("n")))


_KL_RUNS = """,
st AS (SELECT o_orderpriority AS run, CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS step, avg(logp - ref_logp) AS kl, count(*) AS n
       FROM tok JOIN orders ON tok.traj_id = orders.o_orderkey GROUP BY ALL),
m AS (SELECT run, step, kl, n, 1.0::DOUBLE + greatest(-0.2::DOUBLE, least(0.2::DOUBLE, kl / 0.02::DOUBLE - 1.0::DOUBLE))
                                 * CAST(n AS DOUBLE) / {horizon}::DOUBLE AS mult FROM st),
c AS (SELECT *, product(mult) OVER (PARTITION BY run ORDER BY step) AS p FROM m)
"""


@query("kl_adaptive", "I4,M3", oracle_with("tok") + _KL_RUNS.format(horizon="10000.0") + f"""
SELECT run, step, {sql_r6('kl')} AS kl, n, {sql_r6('0.05::DOUBLE * p')} AS kl_coef FROM c""")
def q_kl_adaptive(spark, sf):
    from credsight.plans.registry import kl_controller
    ctl = kl_controller("adaptive", init_kl_coef=0.05, target_kl=0.02, horizon=10000)
    out = ctl(_steps_spark(spark, sf), run="run")
    return out.select("run", "step", r6(F.col("kl")).alias("kl"), "n", r6(F.col("kl_coef")).alias("kl_coef"))


@query("kl_adaptive_steep", "I4", oracle_with("tok") + _KL_RUNS.format(horizon="20.0") + """
SELECT run, step, CAST(sign(p) AS INTEGER) AS sgn, round(ln(abs(p)), 4) AS log_change FROM c""")
def q_kl_adaptive_steep(spark, sf):
    """Steps of many horizons: factors of 0 and below, so the coefficient changes its sign."""
    out = L.adaptive_kl(_steps_spark(spark, sf), 1.0, 0.02, 20, run="run")
    return out.select("run", "step", F.signum("kl_coef").cast("int").alias("sgn"),
                      F.round(F.log(F.abs("kl_coef")), 4).alias("log_change"))
