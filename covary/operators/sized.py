"""Joins that broadcast a side only when its size is known to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covary.operators._util import null_safe_join

#: Bytes of a side that may be sent to every task.
BROADCAST_BYTES = 32 << 20
#: Copies of the other side's rows in a salted shuffle join.
SALTS = 16


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's output: files, limits and local
    data give an upper bound; filters and aggregates keep that of their input,
    joins multiply."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all of ``df`` fits in ``limit`` bytes: by the plan's estimate,
    else, as aggregates are much smaller than what they read, by counting no
    more rows than would fit."""
    if estimated_bytes(df) <= limit:
        return True
    width = sum(_width(t) for _, t in df.dtypes) + 16
    most = limit // width
    return df.limit(most + 1).count() <= most if most else False


def _width(kind: str) -> int:
    """Bytes that a value is taken to need; text and nested values are
    given room."""
    fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    return fixed.get(kind, 16 if kind.startswith("decimal") or kind in ("bigint", "double") or kind.startswith("timestamp") else 256)


def guarded_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                 limit: int | None = None) -> DataFrame:
    """Null-safe equi-join that broadcasts ``right`` when it is measured to be
    small (:func:`is_small`), and shuffles otherwise.

    In the shuffle each row of ``left`` draws one of ``SALTS`` numbers and
    ``right`` comes once per number, so a key that holds a third of ``left``
    is spread over as many tasks. Inner, left and left semi joins only: a row
    of ``right`` without a match would come back once per copy.
    """
    if how not in ("inner", "left", "left_outer", "leftouter", "left_semi", "leftsemi", "semi"):
        return null_safe_join(left, right, keys, how)
    if is_small(right, BROADCAST_BYTES if limit is None else limit):
        return null_safe_join(left, F.broadcast(right), keys, how)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    out = null_safe_join(left.withColumn("__salt", salt), copies, [*keys, "__salt"], how)
    return out.drop("__salt")
