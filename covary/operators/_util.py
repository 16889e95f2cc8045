"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Cols = str | Sequence[str]


def as_list(cols: Cols | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys where NULL matches NULL (``<=>``).

    The keys appear once in the result (taken from the left side, or from
    the right for right-only rows of an outer join). At least one key is
    required: a one-row side is attached with a scalar subquery instead.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("null_safe_join needs keys; attach a one-row table with DataFrame.scalar()")
    lt = left.alias("__l")
    rt = right.select(*[F.col(f"`{c}`").alias(f"__r_{c}") if c in keys else F.col(f"`{c}`")
                        for c in right.columns]).alias("__r")

    def lc(c):
        return F.col(f"__l.`{c}`")

    def rc(c):
        return F.col(f"__r.`{c}`")

    cond = None
    for k in keys:
        term = lc(k).eqNullSafe(rc(f"__r_{k}"))
        cond = term if cond is None else cond & term
    joined = lt.join(rt, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        return joined.select(*[lc(c).alias(c) for c in left.columns])
    out = [F.coalesce(lc(k), rc(f"__r_{k}")).alias(k) if how in ("right", "full", "outer")
           else lc(k).alias(k) for k in keys]
    rest = [lc(c).alias(c) for c in left.columns if c not in keys]
    rrest = [rc(c).alias(c) for c in right.columns if c not in keys]
    return joined.select(*out, *rest, *rrest)


def rounded(col: Column | str, digits: int = 8) -> Column:
    """Round a double and fold -0.0 into 0.0 (for stable comparisons)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits) + F.lit(0.0)


def rounded_sig(col: Column | str, sig: int = 10) -> Column:
    """Round a double to ``sig`` significant digits (and fold -0.0).

    For statistics without a fixed scale (slopes, sums), whose last bits
    depend on the order in which partial aggregates are combined. The power
    of ten is an exact double and the value is scaled by multiplication or
    division with it, so any IEEE engine computes the same result.
    """
    x = F.col(col) if isinstance(col, str) else col
    k = F.lit(sig - 1) - F.floor(F.log10(F.abs(x)))
    q = F.pow(F.lit(10.0), F.abs(k))
    out = (F.when(x == 0, F.lit(0.0))
            .when(k >= 0, F.round(x * q, 0) / q)
            .otherwise(F.round(x / q, 0) * q))
    return out + F.lit(0.0)
