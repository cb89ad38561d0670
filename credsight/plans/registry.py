"""M1-M3: user extension surface.

* M1 ``ESTIMATORS``: a name keeps its operator, another one is refused.
* M2 ``POLICY_LOSSES``: the last operator under a name counts.
  Names are strings or Enum members; an unknown name raises and lists the known.
* M3 KL controller factory: ``fixed`` / ``adaptive``.

Registered callables are DataFrame operators.  ``call(name, inputs, cfg)`` is their one
signature: ``inputs`` names the tables at hand (``tok``, ``traj``, ``traj_ids``) and each operator takes
those it asks for; ``cfg`` are its settings.
"""

from __future__ import annotations

import inspect
from enum import Enum
from functools import partial

from pyspark.sql import DataFrame

from credsight.operators import advantage as A
from credsight.operators import losses as L


class Registry:
    """Named DataFrame operators.

    ``replace=False``: a name keeps its first operator, offering another one is
    an error; ``replace=True``: the last operator given under a name counts.
    """

    def __init__(self, what: str, replace: bool):
        self.what, self.replace, self.entries = what, replace, {}

    def add(self, name, op=None):
        """Register ``op``; without it, a decorator that does."""
        if op is None:
            return lambda fn: self.add(name, fn)
        key = getattr(name, "value", name)
        if not self.replace and self.entries.get(key, op) is not op:
            raise ValueError(f"{self.what} {key!r} belongs to another operator")
        self.entries[key] = op
        return op

    def find(self, name):
        key = getattr(name, "value", name)
        try:
            return self.entries[key]
        except KeyError:
            raise ValueError(f"no {self.what} {key!r}; there are {', '.join(sorted(self.entries))}") from None

    def call(self, name, inputs: dict[str, DataFrame], cfg: dict | None = None) -> DataFrame:
        """Result of the operator under ``name``; a table it needs and does not get is an error."""
        op, cfg = self.find(name), cfg or {}
        asked = inspect.signature(op).parameters
        missing = [p.name for p in asked.values() if p.default is p.empty and p.kind is p.POSITIONAL_OR_KEYWORD
                   and p.name not in inputs and p.name not in cfg]
        unknown = [c for c in cfg if c not in asked]
        if missing or unknown:
            raise ValueError(f"{self.what} {name!r}: " + "; ".join(
                f"{what} {', '.join(x)}" for what, x in (("missing", missing), ("unknown", unknown)) if x))
        return op(**{k: v for k, v in inputs.items() if k in asked}, **cfg)


ESTIMATORS = Registry("estimator", replace=False)
POLICY_LOSSES = Registry("policy loss", replace=True)


# Estimator names that configurations use.
class AdvantageEstimator(str, Enum):
    GAE = "gae"
    GRPO = "grpo"
    FOLDGRPO = "foldgrpo"
    DAGRPO = "dagrpo"
    GRPO_VECTORIZED = "grpo_vectorized"
    GRPO_PASSK = "grpo_passk"
    REINFORCE_PLUS_PLUS_BASELINE = "reinforce_plus_plus_baseline"
    RLOO = "rloo"
    OPO = "opo"
    REINFORCE_PLUS_PLUS = "reinforce_plus_plus"
    REMAX = "remax"
    GPG = "gpg"
    RLOO_VECTORIZED = "rloo_vectorized"


for _e, _fn in [
    (AdvantageEstimator.GAE, A.gae),
    (AdvantageEstimator.GRPO, A.grpo),
    (AdvantageEstimator.FOLDGRPO, A.fold_grpo),
    (AdvantageEstimator.DAGRPO, A.role_penalised_grpo),
    (AdvantageEstimator.GRPO_VECTORIZED, A.grpo_vectorized),
    (AdvantageEstimator.GRPO_PASSK, A.passk),
    (AdvantageEstimator.REINFORCE_PLUS_PLUS_BASELINE, A.reinforce_pp_baseline),
    (AdvantageEstimator.RLOO, A.rloo),
    (AdvantageEstimator.OPO, A.opo),
    (AdvantageEstimator.REINFORCE_PLUS_PLUS, A.reinforce_pp),
    (AdvantageEstimator.REMAX, A.remax),
    (AdvantageEstimator.GPG, A.gpg),
    (AdvantageEstimator.RLOO_VECTORIZED, A.rloo_vectorized),
]:
    ESTIMATORS.add(_e, _fn)

for _n, _fn in [
    ("vanilla", L.ppo_loss), ("gspo", L.gspo_loss), ("gpg", L.gpg_loss), ("clip_cov", L.clip_cov_loss),
    ("kl_cov", L.kl_cov_loss), ("geo_mean", L.geo_mean_loss), ("rollout_correction", L.rollout_correction_loss),
]:
    POLICY_LOSSES.add(_n, _fn)


def kl_controller(kind: str, init_kl_coef: float, target_kl: float | None = None, horizon: int | None = None):
    """M3: returns ``f(steps_df) -> steps_df + kl_coef``."""
    if kind == "fixed":
        return partial(L.fixed_kl, init=init_kl_coef)
    if kind == "adaptive":
        if horizon is None or horizon <= 0:
            raise ValueError("an adaptive KL coefficient needs a positive horizon")
        return partial(L.adaptive_kl, init=init_kl_coef, target=target_kl, horizon=horizon)
    raise NotImplementedError(f"KL controller {kind!r}; there are 'fixed' and 'adaptive'")
