"""K1-K3: resampling weights and weighted draws with replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsight.functions.columns import MIX_MOD, mix_hash
from credsight.functions.ordering import running_sums


METHODS = ("pow", "max_min", "max_random")


def resample_weights(traj: DataFrame, method: str | dict[str, str] = "pow", p: float = 2.0, score: str = "score") -> DataFrame:
    """K1: pow -> |s|^p; max_min -> 1 at the batch max or min else 0;
    max_random -> 0.4 at the max else 0.1; then + 1e-8 with floor 1e-8.
    ``method`` is one name (column ``weight``) or {column: name} for several in
    one pass.  The batch extremes are one aggregate row attached by broadcast."""
    columns = {"weight": method} if isinstance(method, str) else method
    if bad := [m for m in columns.values() if m not in METHODS]:
        raise ValueError(f"resampling method {bad[0]!r}; there are {', '.join(METHODS)}")
    s, mx, mn = F.col(score), F.col("_mx"), F.col("_mn")
    raw = {"pow": F.pow(F.abs(s), F.lit(float(p))),
           "max_min": F.when((s == mx) | (s == mn), F.lit(1.0)).otherwise(F.lit(0.0)),
           "max_random": F.when(s == mx, F.lit(0.4)).otherwise(F.lit(0.1))}
    t = traj
    if set(columns.values()) != {"pow"}:
        t = traj.crossJoin(F.broadcast(traj.agg(F.max(score).alias("_mx"), F.min(score).alias("_mn"))))
    floor = F.lit(1e-8)
    return t.select(*traj.columns, *[F.greatest(raw[m] + floor, floor).alias(c) for c, m in columns.items()])


def uniform(key, seed: int):
    """Two independent hashes of a whole number as one value in [0, 1)."""
    return (mix_hash(key, seed).cast("double")
            + mix_hash(key, seed + 1).cast("double") / F.lit(float(MIX_MOD))) / F.lit(float(MIX_MOD))


def weighted_draw(items: DataFrame, key: str, weight: str, seed: int = 0, n: int | None = None) -> DataFrame:
    """K2: resample ``n`` rows (default: as many as items) with replacement,
    each draw independent, with probability proportional to ``weight``.

    Items own the interval [cum_before, cum) of the cumulative weight; draw j
    takes u_j = uniform(j, seed) * total.  Intervals and draws are merged in
    one global order with distributed prefix sums: the number of interval
    starts at or before u_j is the index of the interval that contains it --
    an exact range join without a nested loop.  -> draw_id and every column of
    ``items``, a row for each draw.
    """
    cum = running_sums(items, [key], values=[weight]).checkpoint()
    total, count = cum.agg(F.max(f"_cum_{weight}"), F.count(F.lit(1))).first()
    if not count:
        return items.select(F.lit(None).cast("bigint").alias("draw_id"), "*")
    starts = cum.select((F.col(f"_cum_{weight}") - F.col(weight)).alias("_pos"), F.lit(0).alias("_kind"),
                        F.col("_rank").alias("_id"), F.lit(1.0).alias("_one"))
    draws = items.sparkSession.range(count if n is None else n).select(
        (uniform(F.col("id"), seed) * F.lit(float(total))).alias("_pos"), F.lit(1).alias("_kind"),
        F.col("id").alias("_id"), F.lit(0.0).alias("_one"))
    merged = running_sums(starts.unionByName(draws), ["_pos", "_kind", "_id"], values=["_one"])
    picks = merged.filter(F.col("_kind") == 1).select(F.col("_id").alias("draw_id"),
                                                      F.col("_cum__one").cast("bigint").alias("_rank"))
    return picks.join(cum.select("_rank", *items.columns), "_rank").select("draw_id", *items.columns)
