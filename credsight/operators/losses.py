"""KL estimators, reward shaping and policy / value loss
*values* with their metrics, over logged token tables (no gradients).

Token input: traj_id, pos, mask, old_logp, logp, adv (+ ref_logp, value,
vpred, ret, logits for the variants that need them).

Every loss is a per-token column expression followed by one aggregate
(``J1``): global aggregates are computed with map-side partial sums, and the
sequence modes use a two-level aggregate (per trajectory, then global) --
nothing is sorted or windowed over the whole token table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsight.functions.columns import clip, d, mix_hash
from credsight.functions.ordering import running_sums
from credsight.session import stored

AGG_MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


@dataclass(frozen=True)
class ClipConfig:
    clip_ratio: float = 0.2
    clip_ratio_low: float | None = None
    clip_ratio_high: float | None = None
    clip_ratio_c: float = 3.0

    @property
    def low(self) -> float:
        return self.clip_ratio if self.clip_ratio_low is None else self.clip_ratio_low

    @property
    def high(self) -> float:
        return self.clip_ratio if self.clip_ratio_high is None else self.clip_ratio_high


# ---------------------------------------------------------------------------
# Aggregation modes
# ---------------------------------------------------------------------------


def agg_loss(df: DataFrame, loss: str, mask: str, mode: str, scale: float | None = None,
             batch_num_tokens: int | None = None, global_batch_size: int | None = None,
             extra: list[Column] | None = None) -> DataFrame:
    """Aggregate a token loss column to one row ``(pg_loss, *extra)``.

    ``extra`` are additional global aggregate expressions (metrics) computed
    in the same pass.
    """
    extra = extra or []
    lm = F.col(loss) * F.col(mask)
    if mode == "token-mean":
        denom = (F.greatest(F.sum(mask), F.lit(1)).cast("double") if batch_num_tokens is None
                 else d(max(batch_num_tokens, 1)))
        return df.agg((F.sum(lm) / denom).alias("pg_loss"), *extra)
    if mode not in AGG_MODES:
        raise ValueError(f"unknown loss aggregation {mode!r}; there are {', '.join(AGG_MODES)}")
    # rows of single trajectories and, with the metrics, the grand total come from one pass over the tokens
    g = df.rollup("traj_id").agg(F.grouping_id().alias("gid"), F.sum(lm).alias("s"), F.sum(mask).cast("double").alias("n"),
                                 F.count(F.lit(1)).alias("width"), *extra)
    one = F.col("gid") == 0
    if mode in ("seq-mean-token-sum", "seq-mean-token-mean"):
        per = F.col("s") if mode == "seq-mean-token-sum" else F.col("s") / (F.col("n") + d(1e-8))
        gbs = F.count_if(one & (F.col("n") > 0)).cast("double") if global_batch_size is None else d(global_batch_size)
        pg = F.try_divide(F.sum(F.when(one & (F.col("n") > 0), per)), F.nullif(gbs, d(0.0)))
    else:
        sc = d(scale) if scale is not None else F.max(F.when(one, F.col("width"))).cast("double")
        pg = F.sum(F.when(one, F.col("s"))) / sc
    names = [c for c in g.columns if c not in ("traj_id", "gid", "s", "n", "width")]
    return g.agg(pg.alias("pg_loss"), *[F.max(F.when(~one, F.col(c))).alias(c) for c in names])


def masked_mean(x: Column, m: str = "mask") -> Column:
    """J13 building block (aggregate)."""
    return F.sum(x.cast("double") * F.col(m)) / (F.sum(m).cast("double") + d(1e-8))


# ---------------------------------------------------------------------------
# PPO (dual clip)
# ---------------------------------------------------------------------------


def ppo_tokens(tok: DataFrame, cfg: ClipConfig, adv: str = "adv") -> DataFrame:
    """Per-token PPO dual-clip loss and the predicates the metrics need."""
    if not cfg.clip_ratio_c > 1.0:
        raise ValueError("clip_ratio_c must be > 1.0")
    a = F.col(adv)
    nkl = clip(F.col("logp") - F.col("old_logp"), -20.0, 20.0)
    ratio = F.exp(nkl)
    pg1 = -a * ratio
    pg2 = -a * clip(ratio, 1 - cfg.low, 1 + cfg.high)
    c1 = F.greatest(pg1, pg2)
    pg3 = -a * d(cfg.clip_ratio_c)
    c2 = F.least(pg3, c1)
    return tok.select(
        "*",
        nkl.alias("nkl"),
        F.when(a < 0, c2).otherwise(c1).alias("pg"),
        (pg2 > pg1).cast("int").alias("is_clip"),
        ((c1 > pg3) & (a < 0)).cast("int").alias("is_clip_lower"),
    )


def ppo_loss(tok: DataFrame, cfg: ClipConfig = ClipConfig(), mode: str = "token-mean",
             adv: str = "adv", overlong: str | None = None, weights: str | None = None) -> DataFrame:
    """Vanilla PPO loss value + clipfrac, approx KL, lower clipfrac.

    ``overlong``: per-trajectory 0/1 column (0 excludes the row from the
    mask); ``weights``: rollout importance weights multiplying the loss.
    """
    t = ppo_tokens(tok, cfg, adv)
    mask = "mask"
    if overlong is not None:
        t = t.withColumn("emask", F.col("mask") * F.col(overlong))
        mask = "emask"
    if weights is not None:
        t = t.withColumn("pg", F.col("pg") * F.col(weights))
    return agg_loss(t, "pg", mask, mode, extra=[
        masked_mean(F.col("is_clip"), mask).alias("pg_clipfrac"),
        masked_mean(-F.col("nkl"), mask).alias("ppo_kl"),
        masked_mean(F.col("is_clip_lower"), mask).alias("pg_clipfrac_lower"),
    ])


# ---------------------------------------------------------------------------
# J4 GSPO, J5 GPG
# ---------------------------------------------------------------------------


def _weighted(pg: Column, weights: str | None) -> Column:
    """Token losses times the rollout importance weights, if a column of them is named."""
    return pg if weights is None else pg * F.col(weights)


def gspo_loss(tok: DataFrame, cfg: ClipConfig = ClipConfig(), adv: str = "adv", weights: str | None = None) -> DataFrame:
    """Sequence ratio exp(min(mean_t(logp - old), 10)) on every token;
    always seq-mean-token-mean."""
    nkl = F.col("logp") - F.col("old_logp")
    seq = (tok.groupBy("traj_id")
           .agg((F.sum(nkl * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1)).cast("double")).alias("seq_kl")))
    t = tok.join(seq, "traj_id")
    a = F.col(adv)
    r = F.exp(F.least(F.col("seq_kl"), d(10.0)))
    pg1 = -a * r
    pg2 = -a * clip(r, 1 - cfg.low, 1 + cfg.high)
    t = t.select("traj_id", "mask", _weighted(F.greatest(pg1, pg2), weights).alias("pg"), (pg2 > pg1).cast("int").alias("is_clip"),
                 (-(F.col("logp") - F.col("old_logp"))).alias("neg_nkl"))
    return agg_loss(t, "pg", "mask", "seq-mean-token-mean", extra=[
        masked_mean(F.col("is_clip")).alias("pg_clipfrac"),
        masked_mean(F.col("neg_nkl")).alias("ppo_kl"),
        d(0.0).alias("pg_clipfrac_lower"),
    ])


def gpg_loss(tok: DataFrame, mode: str = "token-mean", adv: str = "adv", weights: str | None = None) -> DataFrame:
    """-logp * A."""
    t = tok.select("traj_id", "mask", _weighted(-F.col("logp") * F.col(adv), weights).alias("pg"))
    return agg_loss(t, "pg", "mask", mode)


# ---------------------------------------------------------------------------
# J6 Clip-Cov, J7 KL-Cov
# ---------------------------------------------------------------------------


def _valid_means(tok: DataFrame, adv: str) -> DataFrame:
    return tok.agg(
        (F.sum(F.col(adv) * F.col("mask")) / (F.sum("mask").cast("double") + d(1e-8))).alias("mu_a"),
        (F.sum(F.col("logp") * F.col("mask")) / (F.sum("mask").cast("double") + d(1e-8))).alias("mu_l"),
        F.sum("mask").cast("double").alias("n_valid"))


def clip_cov_loss(tok: DataFrame, cfg: ClipConfig = ClipConfig(), mode: str = "token-mean", adv: str = "adv",
                  clip_cov_ratio: float = 0.0002, lb: float = 1.0, ub: float = 5.0, seed: int = 0,
                  weights: str | None = None) -> DataFrame:
    """Zero the loss of k random tokens whose covariance lies in (lb, ub).

    k = max(floor(ratio * valid tokens), 1).  "Random" is a seeded hash order
    on (traj_id, pos), so the pick is the same on any engine and cluster.  k
    grows with the batch, so the k first are found by distributed ranks.
    """
    if clip_cov_ratio <= 0:
        raise ValueError("clip_cov_ratio must be > 0")
    a = F.col(adv)
    ratio = F.exp(F.col("logp") - F.col("old_logp"))
    pg1 = -a * ratio
    pg2 = -a * clip(ratio, 1 - cfg.low, 1 + cfg.high)
    mu = _valid_means(tok, adv)
    keep = [weights] if weights else []
    t = tok.crossJoin(F.broadcast(mu)).select(
        "traj_id", "pos", "mask", "logp", "old_logp", *keep,
        F.greatest(pg1, pg2).alias("pg_raw"),
        ((pg2 > pg1) & (F.col("mask") > 0)).alias("clip_origin"),
        ((a - F.col("mu_a")) * (F.col("logp") - F.col("mu_l"))).alias("cov"),
        F.greatest(F.floor(d(clip_cov_ratio) * F.col("n_valid")), F.lit(1)).alias("k"))
    cand = t.filter((F.col("mask") > 0) & ~F.col("clip_origin") & (F.col("cov") > lb) & (F.col("cov") < ub)).select(
        "traj_id", "pos", "k", mix_hash(F.col("traj_id"), F.col("pos"), seed).alias("h"))
    picked = (running_sums(cand, ["h", "traj_id", "pos"]).where(F.col("_rank") <= F.col("k"))
              .select("traj_id", "pos", F.lit(0).alias("corr0")))
    t = t.join(picked, ["traj_id", "pos"], "left")
    corr = F.when(F.col("corr0").isNotNull(), 0).otherwise(1)
    t = t.select("traj_id", "mask", _weighted(F.col("pg_raw") * corr, weights).alias("pg"), (corr == 0).cast("int").alias("zeroed"),
                 (-(F.col("logp") - F.col("old_logp"))).alias("neg_nkl"))
    return agg_loss(t, "pg", "mask", mode, extra=[
        masked_mean(F.col("zeroed")).alias("pg_clipfrac"),
        masked_mean(F.col("neg_nkl")).alias("ppo_kl")])


def kl_cov_loss(tok: DataFrame, mode: str = "token-mean", adv: str = "adv",
                kl_cov_ratio: float = 0.0002, ppo_kl_coef: float = 1.0, weights: str | None = None) -> DataFrame:
    """The top max(1, floor(n * ratio)) valid tokens by covariance use
    -A*r + coef*|delta| instead of -A*r; reported KL = masked mean |delta|.

    The moments are taken once (one row), then a quantile sketch gives a cut below which
    the top surely lies, and only the few tokens below it are ranked exactly, ties by
    (traj_id, pos).  The top is everything up to the last of them, so the tokens are
    neither sorted nor joined.
    """
    if kl_cov_ratio <= 0:
        raise ValueError("kl_cov_ratio must be > 0")
    keep = [weights] if weights else []
    tok = stored(tok.select("traj_id", "pos", "mask", "logp", "old_logp", F.col(adv).alias("adv"), *keep), "kl-cov")
    valid = tok.filter(F.col("mask") > 0)
    m = valid.agg(F.avg("adv"), F.avg("logp"), F.count(F.lit(1))).first()
    low = -(F.col("adv") - F.lit(m[0])) * (F.col("logp") - F.lit(m[1]))
    k = max(math.floor(m[2] * kl_cov_ratio), 1)
    # the sketch's rank is off by at most n / accuracy
    accuracy = min(1_000_000, max(10_000, math.ceil(2 / kl_cov_ratio)))
    cut = valid.agg(F.percentile_approx(low, min(1.0, kl_cov_ratio + 2 / accuracy), accuracy)).first()[0]
    cand = valid.select("traj_id", "pos", low.alias("low")).where(F.col("low") <= F.lit(cut))
    last = running_sums(cand, ["low", "traj_id", "pos"]).where(F.col("_rank") <= k).agg(F.max(F.struct("low", "traj_id", "pos")).alias("x")).first()["x"]
    hit = F.lit(False)
    if last is not None:
        hit = (F.col("mask") > 0) & (F.struct(low.alias("low"), "traj_id", "pos") <= F.struct(
            F.lit(last[0]).alias("low"), F.lit(last[1]).cast(tok.schema["traj_id"].dataType).alias("traj_id"),
            F.lit(last[2]).cast(tok.schema["pos"].dataType).alias("pos")))
    delta = F.col("logp") - F.col("old_logp")
    pg1, absd = -F.col("adv") * F.exp(delta), F.abs(delta)
    t = tok.select("traj_id", "mask", absd.alias("absd"), _weighted(F.when(hit, pg1 + d(ppo_kl_coef) * absd).otherwise(pg1), weights).alias("pg"))
    return agg_loss(t, "pg", "mask", mode, extra=[masked_mean(F.col("absd")).alias("ppo_kl")])


# ---------------------------------------------------------------------------
# J8 geometric mean
# ---------------------------------------------------------------------------


def geo_mean_loss(tok: DataFrame, traj_ids: DataFrame, cfg: ClipConfig = ClipConfig(), adv: str = "adv",
                  weights: str | None = None) -> DataFrame:
    """Sequence-level geometric-mean ratio; plain mean over all rows of the
    batch (``traj_ids`` lists every trajectory, including empty ones).  Token
    ``weights`` become one per sequence, their geometric mean over valid tokens."""
    delta = F.col("logp") - F.col("old_logp")
    s = F.signum(F.col(adv))
    dcl = clip(delta, -cfg.low, cfg.high)
    dmin = s * F.least(s * delta, s * dcl)
    t = tok.select("traj_id", "mask", F.col(adv).alias("a"), delta.alias("delta"),
                   (dmin * F.col("mask")).alias("dm"), (F.col(adv) * F.col("mask")).alias("am"),
                   (F.log(F.col(weights) + d(1e-10)) * F.col("mask") if weights else d(0.0)).alias("lw"),
                   (delta != dcl).alias("clipped"))
    per = t.groupBy("traj_id").agg(F.sum("lw").alias("lw"), F.sum("dm").alias("dm"), F.sum("am").alias("am"),
                                   F.sum("mask").cast("double").alias("n"))
    rows = traj_ids.select("traj_id").join(per, "traj_id", "left").select(
        (-(F.coalesce(F.col("am"), d(0.0)) / (F.coalesce(F.col("n"), d(0.0)) + d(1e-8)))
         * F.exp((F.coalesce(F.col("dm"), d(0.0)) + F.coalesce(F.col("lw"), d(0.0)))
                 / (F.coalesce(F.col("n"), d(0.0)) + d(1e-8)))).alias("pg"))
    loss = rows.agg(F.avg("pg").alias("pg_loss"))
    met = t.agg(masked_mean(F.col("clipped") & (F.col("a") > 0)).alias("pg_clipfrac"),
                masked_mean(-F.col("delta")).alias("ppo_kl"),
                masked_mean(F.col("clipped") & (F.col("a") < 0)).alias("pg_clipfrac_lower"))
    return loss.crossJoin(met)


# ---------------------------------------------------------------------------
# J9 entropy, J10 value loss
# ---------------------------------------------------------------------------


def entropy_from_logits(logits: Column) -> Column:
    """logsumexp(l) - sum(softmax(l) * l), with a max shift (higher-order functions, JVM-side)."""
    m = F.array_max(logits)
    ex = F.transform(logits, lambda x: F.exp(x - m))
    z = F.aggregate(ex, d(0.0), lambda acc, x: acc + x)
    wsum = F.aggregate(F.zip_with(ex, logits, lambda e, x: e * x), d(0.0), lambda acc, x: acc + x)
    return (m + F.log(z)) - wsum / z


def entropy_loss(tok: DataFrame, mode: str = "token-mean") -> DataFrame:
    t = tok.select("traj_id", "mask", entropy_from_logits(F.col("logits")).alias("ent"))
    return agg_loss(t, "ent", "mask", mode).withColumnRenamed("pg_loss", "entropy")


def value_loss(tok: DataFrame, cliprange_value: float, mode: str = "token-mean") -> DataFrame:
    """0.5 * agg(max((v - R)^2, (clip(v) - R)^2)) and the clip fraction."""
    vc = clip(F.col("vpred"), F.col("value") - d(cliprange_value), F.col("value") + d(cliprange_value))
    l1 = (F.col("vpred") - F.col("ret")) ** 2
    l2 = (vc - F.col("ret")) ** 2
    t = tok.select("traj_id", "mask", F.greatest(l1, l2).alias("vl"), (l2 > l1).cast("int").alias("vc"))
    out = agg_loss(t, "vl", "mask", mode, extra=[masked_mean(F.col("vc")).alias("vf_clipfrac")])
    return out.select((d(0.5) * F.col("pg_loss")).alias("vf_loss"), "vf_clipfrac")


# ---------------------------------------------------------------------------
# J11 / J12 rollout correction
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class RolloutCorrection:
    rollout_is: str | None = "token"       # token | sequence | None
    is_threshold: float = 2.0
    rollout_rs: str | None = None          # token | sequence | None
    rs_threshold: float | None = None
    rs_threshold_lower: float | None = None
    veto_threshold: float | None = None
    batch_normalize: bool = False


def rollout_correction_loss(tok: DataFrame, rc: RolloutCorrection = RolloutCorrection(),
                            mode: str = "seq-mean-token-sum", adv: str = "adv",
                            rollout_logp: str = "old_logp") -> DataFrame:
    """IS-weighted REINFORCE value with rejection and veto.

    J12: the logged old log-prob *is* the rollout log-prob (``rollout_logp``).
    """
    delta = clip(F.col("logp") - F.col(rollout_logp), -20.0, 20.0)
    t = tok.select("traj_id", "pos", "mask", F.col(adv).alias("a"), "logp", "old_logp",
                   F.col(rollout_logp).alias("rlp"), delta.alias("ld"), F.exp(delta).alias("tok_ratio"))
    seq = t.groupBy("traj_id").agg(
        F.exp(clip(F.sum(F.col("ld") * F.col("mask")), -20.0, 20.0)).alias("seq_ratio"),
        (F.min(F.when(F.col("mask") > 0, F.col("tok_ratio")))).alias("min_ratio"))
    t = t.join(seq, "traj_id")
    ratio_of = {"token": F.col("tok_ratio"), "sequence": F.col("seq_ratio")}
    m = F.col("mask")
    if rc.rollout_rs is not None:
        up = rc.rs_threshold if rc.rs_threshold is not None else rc.is_threshold
        lo = rc.rs_threshold_lower if rc.rs_threshold_lower is not None else 1.0 / up
        r = ratio_of[rc.rollout_rs]
        m = m * ((r >= d(lo)) & (r <= d(up))).cast("int")
    if rc.veto_threshold is not None:
        m = m * F.when(F.col("min_ratio") < d(rc.veto_threshold), 0).otherwise(1)
    # without rejection the loss keeps the original mask, veto or not
    t = t.withColumn("emask", m if rc.rollout_rs is not None else F.col("mask"))
    if rc.rollout_is is not None:
        t = t.withColumn("w", F.least(ratio_of[rc.rollout_is], d(rc.is_threshold)))
        if rc.batch_normalize:
            norm = t.agg((F.sum(F.col("w") * F.col("emask")) / (F.sum("emask").cast("double") + d(1e-8))).alias("wn"))
            t = t.crossJoin(F.broadcast(norm)).withColumn("w", F.try_divide(F.col("w"), F.col("wn")))
        t = t.withColumn("pg", -F.col("a") * F.col("logp") * F.col("w"))
    else:
        t = t.withColumn("w", d(1.0)).withColumn("pg", -F.col("a") * F.col("logp"))
    return agg_loss(t, "pg", "emask", mode, extra=[
        masked_mean(-(F.col("logp") - F.col("rlp")), "emask").alias("ppo_kl"),
        masked_mean(F.col("w"), "mask").alias("is_weight_mean"),
        (F.sum("emask").cast("double") / F.greatest(F.sum("mask"), F.lit(1)).cast("double")).alias("rs_kept_frac")])


# ---------------------------------------------------------------------------
# I1-I4 KL
# ---------------------------------------------------------------------------


def kl_penalty(logp: Column, ref: Column, kind: str) -> Column:
    """k1 (kl), abs, k2 (mse), k3 (low_var_kl); a trailing '+' only
    changes the gradient, so the value is the same as without it."""
    k = kind[:-1] if kind.endswith("+") else kind
    if k in ("kl", "k1"):
        return logp - ref
    if k == "abs":
        return F.abs(logp - ref)
    if k in ("mse", "k2"):
        return d(0.5) * (logp - ref) ** 2
    if k in ("low_var_kl", "k3"):
        kl = clip(ref - logp, -20.0, 20.0)
        return clip(F.exp(kl) - kl - d(1.0), -10.0, 10.0)
    if k == "full":
        raise NotImplementedError("kl_penalty 'full'")
    raise NotImplementedError(f"kl_penalty {kind!r}")


def kl_reward(tok: DataFrame, kl_ratio: float, score: str = "reward") -> DataFrame:
    """Token reward minus (old - ref) * kl_ratio."""
    return tok.select("traj_id", "pos",
                      (F.col(score) - (F.col("old_logp") - F.col("ref_logp")) * d(kl_ratio)).alias("reward_kl"))


def adaptive_kl(steps: DataFrame, init: float, target: float, horizon: int, run: str | None = None) -> DataFrame:
    """I4: kl coefficient after each step: value *= 1 + clip(kl/target - 1, +-0.2) * n / horizon.

    ``steps(step, kl, n)`` holds one row per training step, of one run or of
    several (``run`` names their column; each run has its own coefficient and
    its own task).  The product is split into logarithms of the absolute
    factors, a count of negative ones and a count of zeros, so a factor of 0 or
    below (n / horizon of 5 or more) takes part like any other.
    """
    if horizon <= 0:
        raise ValueError("horizon must be > 0")
    keys = [run] if run else []
    mult = d(1.0) + clip(F.col("kl") / d(target) - d(1.0), -0.2, 0.2) * F.col("n").cast("double") / d(horizon)
    t = steps.select(*keys, "step", "kl", "n", mult.alias("_m"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.sum(F.when(F.col("_m") != 0, F.log(F.abs(F.col("_m")))).otherwise(d(0.0))).over(w)
    odd = F.pmod(F.sum((F.col("_m") < 0).cast("bigint")).over(w), F.lit(2))
    zero = F.max(F.col("_m") == 0).over(w)
    coef = F.when(zero, d(0.0)).otherwise(d(init) * F.exp(size) * F.when(odd == 1, d(-1.0)).otherwise(d(1.0)))
    return t.select(*keys, "step", "kl", "n", coef.alias("kl_coef"))


def fixed_kl(steps: DataFrame, init: float) -> DataFrame:
    return steps.select("step", "kl", "n", d(init).alias("kl_coef"))
