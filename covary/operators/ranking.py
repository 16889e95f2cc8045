"""Top-k, membership restriction and rank-within-group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covary.operators._util import Cols, as_list
from covary.operators.sized import guarded_join


def top_k(df: DataFrame, keys: Cols, measure: str, k: int,
          ascending: bool = False) -> DataFrame:
    """The ``k`` rows with the largest (or smallest) ``measure``.

    Ties at the cut are broken by the keys, ascending, so the result is
    deterministic. Spark plans this as ``TakeOrderedAndProject``: each task
    keeps its own top k and only k rows per task reach the final merge.
    """
    order = F.col(measure).asc_nulls_last() if ascending else F.col(measure).desc_nulls_last()
    return df.orderBy(order, *[F.col(c).asc_nulls_first() for c in as_list(keys)]).limit(k)


def keep_top(df: DataFrame, top: DataFrame, keys: Cols) -> DataFrame:
    """Rows of ``df`` whose keys occur in ``top`` (NULL matches NULL).

    ``top`` is meant to be a bounded selection, such as a top-k result. It is
    broadcast when it is measured to be small, and joined by a salted shuffle
    otherwise (:func:`covary.operators.sized.guarded_join`). It is an inner
    join against the distinct keys (the same rows as a semi-join): Catalyst
    pushes a semi-join below an aggregate of ``df``, which would stop that
    aggregate from being shared with the branch that computed ``top``.
    """
    keys = as_list(keys)
    joined = guarded_join(df, top.select(*keys).distinct(), keys, "inner")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns])


def rank_within(df: DataFrame, partition: Cols, order: str, k: int,
                descending: bool = True, method: str = "rank",
                rank_col: str = "rank", tie_break: Sequence[str] = ()) -> DataFrame:
    """Rows ranked ``<= k`` inside each partition.

    ``method='rank'`` keeps ties (more than k rows may come back, as with
    SQL ``RANK``); ``'row_number'`` keeps exactly k using ``tie_break``.
    Spark inserts a ``WindowGroupLimit`` before the shuffle, so each task
    forwards at most the top k per partition key.
    """
    o = F.col(order).desc() if descending else F.col(order).asc()
    w = Window.partitionBy(*as_list(partition)).orderBy(o, *[F.col(c) for c in tie_break])
    fn = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}[method]
    return df.withColumn(rank_col, fn().over(w)).filter(F.col(rank_col) <= k)
