"""Weighted composite index over several count columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_index(weights: Mapping[str, float]) -> Column:
    """``sum(w_i * u_i) / sum(u_i)`` across columns of one row.

    A NULL count is treated as 0 in both sums (a row sum skips missing
    values); a row whose counts are all zero has no index (NULL).
    """
    if not weights:
        raise ValueError("weighted_index needs at least one column")
    parts = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), float(w))
             for c, w in weights.items()]
    num = parts[0][0] * parts[0][1]
    den = parts[0][0]
    for col, w in parts[1:]:
        num = num + col * w
        den = den + col
    return F.try_divide(num, den)
