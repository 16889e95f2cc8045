"""Counting operators: counts per key, categorical histograms, pivots, summaries.

All counts are grouped aggregates, so Spark combines map-side (partial
aggregation) before the shuffle: a hot key costs one partial row per task,
not one shuffled row per event.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covary.functions.keys import distinct_names
from covary.operators._util import Cols, as_list, null_safe_join

NULL_LABEL = "(null)"


def period_counts(df: DataFrame, keys: Sequence[str | Column], name: str = "n",
                  count_col: str | None = None) -> DataFrame:
    """Rows per key (``count(*)``) or non-null values of ``count_col`` per key."""
    agg = F.count(F.col(count_col)) if count_col else F.count(F.lit(1))
    return df.groupBy(*keys).agg(agg.alias(name))


def _dims(dims: Mapping[str, str | Column] | Sequence[str]) -> dict[str, Column]:
    if isinstance(dims, Mapping):
        return {k: (F.col(v) if isinstance(v, str) else v) for k, v in dims.items()}
    return {d: F.col(d) for d in dims}


def combination_counts(df: DataFrame, group: Cols, period: str,
                       dims: Mapping[str, str | Column] | Sequence[str],
                       name: str = "n") -> DataFrame:
    """Counts per (group, period, every dimension value) -- the one pass over
    the facts. Later histograms are sums over these few rows."""
    d = _dims(dims)
    cols = [*as_list(group), period]
    return (df.select(*cols, *[c.cast("string").alias(k) for k, c in d.items()])
              .groupBy(*cols, *d.keys()).agg(F.count(F.lit(1)).alias(name)))


def unpivot_dimensions(combo: DataFrame, group: Cols, period: str,
                       dims: Sequence[str], name: str = "n") -> DataFrame:
    """(group, period, d1..dk, n) -> long rows (group, period, dimension,
    category, n) summed per category."""
    ids = [*as_list(group), period, name]
    long = combo.unpivot(ids, [F.col(f"`{d}`").alias(d) for d in dims], "dimension", "category")
    return (long.groupBy(*as_list(group), period, "dimension", "category")
                .agg(F.sum(name).alias(name)))


def dimension_counts(df: DataFrame, group: Cols, period: str,
                     dims: Mapping[str, str | Column] | Sequence[str],
                     name: str = "n") -> DataFrame:
    """Counts per (group, period, dimension, category), and per (group,
    period) in rows whose ``dimension`` is NULL: the total is one more
    dimension of the same count. Combined map-side; the shuffle is bounded by
    the sum of the dimensions' categories per (group, period)."""
    d = _dims(dims)
    ids = [*as_list(group), period]
    # a dimension's own column may be called like a group, so it gets a number
    wide = df.select(*ids, *[c.cast("string").alias(f"__d{i}") for i, c in enumerate(d.values())],
                     F.lit(None).cast("string").alias(f"__d{len(d)}"))
    long = wide.unpivot(ids, [f"__d{i}" for i in range(len(d) + 1)], "dimension", "category")
    counts = long.groupBy(*ids, "dimension", "category").agg(F.count(F.lit(1)).alias(name))
    label = F.lit(None).cast("string")
    for i, key in enumerate(d):
        label = F.when(F.col("dimension") == f"__d{i}", F.lit(key)).otherwise(label)
    return counts.withColumn("dimension", label)


def category_counts(df: DataFrame, group: Cols, period: str,
                    dims: Mapping[str, str | Column] | Sequence[str],
                    name: str = "n", total: str = "total") -> DataFrame:
    """Several categorical histograms per (group, period) in one pass.

    Returns long rows ``(group, period, dimension, category, n, total)``
    where ``total`` is the number of events of the (group, period). A label
    that occurs in two dimensions stays two rows (keyed by dimension). The
    total is counted with the categories (:func:`dimension_counts`) and
    handed to its period's rows by a window: no join.
    """
    keys = [*as_list(group), period]
    cells = dimension_counts(df, group, period, dims, name)
    whole = F.max(F.when(F.col("dimension").isNull(), F.col(name))).over(Window.partitionBy(*keys))
    return (cells.withColumn(total, whole).filter(F.col("dimension").isNotNull())
                 .select(*keys, "dimension", "category", name, total))


def category_map(counts: DataFrame, group: Cols, period: str, name: str = "n",
                 total: str = "total", out: str = "counts") -> DataFrame:
    """One map per (group, period): ``'dimension:category' -> n`` plus ``'total'``.

    The map holds one entry per category, so it is bounded by the number of
    distinct categories, not by the number of events.
    """
    keys = [*as_list(group), period]
    # a label that looks like the one for NULL, or has a colon, is escaped, so
    # that different categories never meet under one key
    label = F.regexp_replace(F.col("category"), r"([\\:]|^\(null\)$)", r"\\$1")
    entry = F.struct(F.concat_ws(":", F.regexp_replace("dimension", r"([\\:])", r"\\$1"),
                                 F.coalesce(label, F.lit(NULL_LABEL)))
                     .alias("key"), F.col(name).cast("bigint").alias("value"))
    per = counts.groupBy(*keys).agg(F.collect_list(entry).alias("__e"),
                                    F.first(total).alias("__t"))
    all_entries = F.concat(F.array(F.struct(F.lit("total").alias("key"),
                                            F.col("__t").cast("bigint").alias("value"))),
                           F.col("__e"))
    return per.select(*keys, F.map_from_entries(all_entries).alias(out))


def ordered_series(df: DataFrame, group: Cols, order: str, value: str,
                   out: str = "series") -> DataFrame:
    """Per group, the (order, value) pairs as an array sorted by ``order``.

    Only for series whose length is bounded by the calendar (one entry per
    period), never for raw events.
    """
    return (df.groupBy(*as_list(group))
              .agg(F.array_sort(F.collect_list(F.struct(order, value))).alias(out)))


#: Columns that a pivot makes at most; a table of more is refused.
MOST_COLUMNS = 2000


def pivot_counts(df: DataFrame, period: str, category: str,
                 values: Sequence[str] | None = None, name: str = "n",
                 fill: int = 0, most: int = MOST_COLUMNS) -> DataFrame:
    """Period x category matrix of event counts, zero-filled.

    Long counts are computed first (partial aggregation), then pivoted with
    :func:`wide`. Without ``values`` a job looks up the categories, in
    ascending order; pass them when they are known.
    """
    long = df.groupBy(F.col(_q(period)).alias("__p"), F.col(_q(category)).cast("string").alias("__c")).agg(
        F.count(F.lit(1)).alias(name))
    return wide(long, "__p", "__c", name, values, fill, most, period)


def wide(long: DataFrame, period: str, category: str, value: str, values: Sequence[str] | None = None,
         fill: float | None = 0, most: int = MOST_COLUMNS, period_name: str | None = None) -> DataFrame:
    """Long (period, category, value) rows as one row per period, one column
    per category, summed, empty cells as ``fill``.

    Categories are numbered first and the columns are made by number; only
    the finished table is named, so a label may be anything. A NULL category
    is called ``(null)``. Names that differ by case only from an earlier one,
    the period's included, get ``_2``, ``_3`` and so on. More than ``most``
    categories raise a ValueError that says how many there are.
    """
    period_name = period_name or period
    label = F.col(_q(category)).cast("string")
    if values is None:
        kinds = long.select(label.alias("c")).distinct()
        names = [r.c for r in kinds.orderBy(F.col("c").asc_nulls_first()).limit(most + 1).collect()]
        if len(names) > most:
            raise ValueError(f"{kinds.count()} categories make more columns than the {most} allowed")
    else:
        names = list(values)
    dictionary = F.create_map(*[F.lit(v) for i, n in enumerate(names) if n is not None for v in (n, i)]) \
        if any(n is not None for n in names) else F.lit(None).cast("map<string,int>")
    none = F.lit(names.index(None) if None in names else None).cast("int")
    number = F.when(label.isNull(), none).otherwise(F.try_element_at(dictionary, label))
    table = (long.select(F.col(_q(period)).alias("__period"), number.alias("__number"), F.col(_q(value)).alias("__value"))
                 .groupBy("__period").pivot("__number", list(range(len(names)))).agg(F.sum("__value")))
    cells = [F.col(str(i)) if fill is None else F.coalesce(F.col(str(i)), F.lit(fill)) for i in range(len(names))]
    titles = distinct_names([period_name, *[NULL_LABEL if n is None else n for n in names]])
    return table.select(F.col("__period"), *[c.alias(f"__{i}") for i, c in enumerate(cells)]).toDF(*titles)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def zero_filled_cells(cells: DataFrame, period: str, category: str, value: str,
                      values: Sequence[str] | None = None) -> DataFrame:
    """Long (period, category, value) rows over the full period x category
    grid of ``cells``, missing cells as 0 -- the long form of a zero-filled
    pivot. Each category takes the array of all periods (one scalar subquery,
    as long as the calendar) and the cells are joined to that, so any number
    of categories will do and none is looked up on the driver."""
    if values is not None:
        cells = cells.filter(F.col(category).isin(list(values)))
    long = cells.groupBy(period, category).agg(F.sum(value).alias(value))
    periods = cells.agg(F.collect_set(F.struct(period)).alias("p")).scalar()
    grid = cells.select(category).distinct().select(category, F.explode(periods).alias("__p")).select(
        F.col(f"__p.{period}").alias(period), category)
    out = null_safe_join(grid, long, [period, category], "left")
    return out.select(period, category, F.coalesce(value, F.lit(0)).alias(value))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of one column, sorted."""
    return df.select(col).distinct().orderBy(col)


def summary_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count / mean / stddev / min / max of numeric columns in ONE pass,
    returned as long rows ``(column, stat, value)``."""
    stats = {"count": lambda x: F.count(x).cast("double"), "mean": F.avg,
             "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    labels = [(c, s) for c in cols for s in stats]
    wide = df.agg(*[stats[s](F.col(c).cast("double")).alias(f"_{i}") for i, (c, s) in enumerate(labels)])
    pairs = [F.struct(F.lit(c).alias("column"), F.lit(s).alias("stat"), F.col(f"_{i}").alias("value"))
             for i, (c, s) in enumerate(labels)]
    return wide.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")
