"""Global positions and ranks, numbered in parallel.

A window without partitions puts every row into one task. Here rows are dealt
by range and sorted where they are; a row's position is its place in its
partition plus the sizes of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.operators.counts import _q
from covary.session import materialize

_SHIFT = 33   # monotonically_increasing_id: partition number above, row number below


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "position",
                  start: int = 0) -> DataFrame:
    """``df`` with ``name``, the 0-based place of each row in the global
    ``order`` (rows that the order does not tell apart are numbered as they
    come). ``start=1`` gives a rank without ties.

    One shuffle by range. The sorted rows are materialised, because the
    counts must see the rows where they were numbered; the sums over
    partitions are a map of one entry per partition.
    """
    by = [F.col(_q(o)).asc_nulls_first() if isinstance(o, str) else o for o in order]
    return _numbered(df.repartitionByRange(*by).sortWithinPartitions(*by), name, start)


def _numbered(ordered: DataFrame, name: str, start: int) -> DataFrame:
    """Number rows whose partitions are already in order."""
    rows = materialize(ordered.withColumn("__at", F.monotonically_increasing_id()))
    sizes = (rows.groupBy(F.shiftright("__at", _SHIFT).alias("part")).agg(F.count(F.lit(1)).alias("n"))
                 .agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("s")))
    grown = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<part:long,before:long>>").alias("out")),
                        lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"),
                                              F.concat(a["out"], F.array(F.struct(x["part"].alias("part"), a["sum"].alias("before")))).alias("out")),
                        lambda a: F.map_from_entries(a["out"]))
    before = sizes.select(grown.alias("before")).scalar()
    within = F.col("__at").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    place = F.element_at(before, F.shiftright("__at", _SHIFT)) + within + F.lit(start)
    return rows.select(*[F.col(_q(c)) for c in ordered.columns], place.cast("long").alias(name))


def with_line_number(df: DataFrame, name: str = "line") -> DataFrame:
    """A file scan with the 0-based line number of each row among all files.

    Files count in the order of their paths; inside a file the splits count
    in the order of their first bytes, and a split's rows as they are read.
    ``df`` must be a scan, of which columns may have been selected.
    """
    meta = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                     F.monotonically_increasing_id().alias("__row"))
    return with_position(meta, ["__file", "__block", "__row"], name).drop("__file", "__block", "__row")
