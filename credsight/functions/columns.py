"""Column-level helpers (pure ``Column -> Column`` functions, JVM-side).

Contracts for the tensor helpers the estimators use (SURVEY §1.6):

* ``masked_mean(x, m)  = sum(x*m) / (sum(m) + 1e-8)``
* ``masked_whiten(x, m) = (x - mu) / sqrt(var + 1e-8)`` with the masked
  *sample* variance, over the whole batch, applied to every position
* ``clip_by_value(x, lo, hi) = greatest(lo, least(hi, x))``
* zero denominators give NULL (ANSI mode is on; plain ``/ 0`` raises)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS_MASK = 1e-8


def d(x: float) -> Column:
    """Double literal (a bare Python float is already double, this makes it explicit)."""
    return F.lit(float(x))


def r6(c: Column) -> Column:
    """Round to 6 digits as ``floor(x * 1e6 + 0.5) / 1e6``.

    Only IEEE double operations, so every engine lands on the same side of a
    .5 boundary (decimal HALF_UP rounding and binary rounding disagree
    there); ``floor(..)`` of a value in (-1, 0] gives +0.0, never -0.0.
    """
    return F.floor(c * d(1e6) + d(0.5)).cast("double") / d(1e6)


def sql_r6(e: str) -> str:
    """DuckDB twin of :func:`r6`."""
    return f"(CAST(floor(({e}) * 1e6::DOUBLE + 0.5::DOUBLE) AS DOUBLE) / 1e6::DOUBLE)"


def clip(c: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else d(lo)
    hi = hi if isinstance(hi, Column) else d(hi)
    return F.greatest(lo, F.least(hi, c))


#: multiplier and modulus of the mixing steps: products stay below 2**62
MIX, MIX_MOD = 1103515245, 2147483647


def mix_hash(key: Column, *more: Column | int) -> Column:
    """Deterministic hash of whole numbers to [0, 2**31 - 1), the same on any
    engine: chained multiply-and-reduce steps that cannot overflow."""
    h = F.pmod(key.cast("bigint"), F.lit(MIX_MOD))
    for m in more:
        m = m if isinstance(m, Column) else F.lit(m)
        h = F.pmod(h * F.lit(MIX) + F.pmod(m.cast("bigint"), F.lit(MIX_MOD)) + F.lit(12345), F.lit(MIX_MOD))
    for _ in range(2):
        # square the low half into the product, so that neighbouring keys part ways
        h = F.pmod(h * F.lit(MIX) + F.pmod(h, F.lit(46337)) * F.pmod(h, F.lit(46337)) + F.lit(12345), F.lit(MIX_MOD))
    return h


def sql_mix_hash(key: str, *more: str | int) -> str:
    """DuckDB twin of :func:`mix_hash`."""
    mod = lambda x: f"((({x}) % {MIX_MOD} + {MIX_MOD}) % {MIX_MOD})"
    h = mod(f"CAST({key} AS BIGINT)")
    for m in more:
        h = f"(({h} * {MIX} + {mod(f'CAST({m} AS BIGINT)')} + 12345) % {MIX_MOD})"
    for _ in range(2):
        h = f"list_transform([{h}], lambda x: (x * {MIX} + (x % 46337) * (x % 46337) + 12345) % {MIX_MOD})[1]"
    return h


def normalise_text(c: Column) -> Column:
    """Collapse any whitespace run to one space, trim, lower-case."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
