"""Per-series window operators and the lagged-indicator forecast.

A series is one group's values by period (one row per period), so every
window partition is as long as the calendar, not as large as the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covary.functions.stats import let
from covary.operators._util import Cols, as_list


def lag_features(df: DataFrame, series: Cols, order: str, col: str,
                 lags: Sequence[int] = (1, 2, 3), fill: float = -1.0,
                 prefix: str | None = None) -> DataFrame:
    """Add ``{prefix}_0`` (the value itself) and ``{prefix}_{i}`` = the value
    ``i`` observed rows earlier in ``order``; a missing value or a lag
    before the start becomes ``fill``. The shift counts rows, not calendar
    months."""
    prefix = prefix or col
    w = Window.partitionBy(*as_list(series)).orderBy(order)
    value = F.col(col).cast("double")
    # added in one projection: one window node for all lags
    return df.withColumns({f"{prefix}_0": F.coalesce(value, F.lit(float(fill)))}
                          | {f"{prefix}_{i}": F.coalesce(F.lag(value, i).over(w), F.lit(float(fill))) for i in lags})


def chronological_split(df: DataFrame, series: Cols, order: str, frac: float = 0.8,
                        rn: str = "rn", size: str = "n_rows", flag: str = "is_train") -> DataFrame:
    """Mark the first ``floor(n * frac)`` rows of each series (in ``order``)
    as training rows, the rest as holdout."""
    keys = as_list(series)
    w = Window.partitionBy(*keys).orderBy(order)
    return (df.withColumn(rn, F.row_number().over(w))
              .withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
              .withColumn(flag, F.col(rn) <= F.floor(F.col(size) * F.lit(float(frac)))))


def min_max_scale(df: DataFrame, by: Cols, cols: Sequence[str], lo: float = -1.0,
                  hi: float = 1.0, suffix: str = "_scaled") -> DataFrame:
    """Scale columns to ``[lo, hi]`` within each group; a constant column
    maps to ``lo``."""
    w = Window.partitionBy(*as_list(by))
    out = {}
    for c in cols:
        x = F.col(c).cast("double")
        mn, mx = F.min(x).over(w), F.max(x).over(w)
        span = mx - mn
        scaled = F.lit(float(lo)) + (x - mn) * F.lit(float(hi - lo)) / span
        out[f"{c}{suffix}"] = F.when(span > 0, scaled).otherwise(F.lit(float(lo)))
    return df.withColumns(out)


#: What must remain of a feature's sum of squares, beside the features taken
#: before it, for the feature to get a coefficient of its own.
TOLERANCE = 1e-9


def _solved(size: int, tolerance: float) -> Column:
    """Least-squares coefficients from ``__xx_i_j`` and ``__xy_i`` (centred
    sums): a sweep over the moment row, in column expressions.

    At each step the feature with the largest share of its own sum of squares
    left (the first of equal ones) is swept out of the others. Features that
    have ``tolerance`` or less left are linear in the ones taken, or constant,
    and get the coefficient 0.
    """
    rows = [F.array(*[F.col(f"__xx_{min(i, j)}_{max(i, j)}") for j in range(size)], F.col(f"__xy_{i}")) for i in range(size)]
    own = F.array(*[F.col(f"__xx_{i}_{i}") for i in range(size)])
    free = F.array(*[F.lit(True)] * size)

    def step(state, _):
        left = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(
            F.get(state["free"], i) & (F.get(own, i) > 0),
            F.get(F.get(state["m"], i), i) / F.get(own, i)).otherwise(F.lit(-1.0)))
        best = let(left, lambda x: F.struct(F.array_max(x).alias("left"), (F.array_position(x, F.array_max(x)) - 1).cast("int").alias("k")))

        def sweep(b):
            pivot = F.get(state["m"], b["k"])
            return let(F.struct(b["k"].alias("k"), F.transform(pivot, lambda v: v / F.get(pivot, b["k"])).alias("row")),
                       lambda p: F.struct(
                           F.transform(state["m"], lambda row, i: F.when(i == p["k"], p["row"]).otherwise(
                               F.zip_with(row, p["row"], lambda v, q: v - F.get(row, p["k"]) * q))).alias("m"),
                           F.transform(state["free"], lambda f, i: f & (i != p["k"])).alias("free")))
        return let(best, lambda b: F.when(b["left"] > F.lit(tolerance), sweep(b)).otherwise(state))

    return F.aggregate(F.sequence(F.lit(1), F.lit(size)), F.struct(F.array(*rows).alias("m"), free.alias("free")), step,
                       lambda s: F.zip_with(s["m"], s["free"], lambda row, f: F.when(f, F.lit(0.0)).otherwise(F.get(row, size))))


def lag_forecast(df: DataFrame, series: Cols, order: str, y: str,
                 features: Sequence[str], frac: float = 0.8, tolerance: float = TOLERANCE) -> DataFrame:
    """Linear forecast of ``y`` from ``features`` per series, fitted on the
    first ``frac`` of the rows in ``order`` and scored on the rest.

    One shuffle by series serves everything: the split and the training
    means are windows over it, and one aggregate gives the centred moments of
    the training rows and of the holdout. The solve (:func:`_solved`) and the
    holdout error, a quadratic form in the coefficients, are expressions on
    that one row per series. A row without a value or a feature takes part in
    neither fit nor score. Returns ``series, n_train, n_test, mse, b_*``: one
    row per series, a NULL key among them; a series without training rows has
    NULL coefficients and error.
    """
    keys = as_list(series)
    p = len(features)
    split = chronological_split(df, keys, order, frac, "__rn", "__rows", "__train")
    yc = F.col(y).cast("double")
    full = yc.isNotNull()
    for f in features:
        full = full & F.col(f).isNotNull()
    whole = Window.partitionBy(*keys)
    fit = F.col("__train") & full
    # centred on the means of the training rows: lagged indicators are large
    # and nearly collinear, and centred products keep the solve well conditioned
    named = [yc, *[F.col(f).cast("double") for f in features]]
    means = {f"__m{i}": F.avg(F.when(fit, c)).over(whole) for i, c in enumerate(named)}
    rows = split.withColumns({"__full": full, **{f"__v{i}": c for i, c in enumerate(named)}}).withColumns(means)
    v = [F.col(f"__v{i}") - F.col(f"__m{i}") for i in range(p + 1)]
    train, test = F.col("__train") & F.col("__full"), ~F.col("__train") & F.col("__full")
    aggs = [F.count(F.when(train, 1)).alias("n_train"), F.count(F.when(test, 1)).alias("n_test"),
            *[F.max(f"__m{i}").alias(f"__m{i}") for i in range(p + 1)]]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    aggs += [F.sum(F.when(train, v[i] * v[j])).alias(f"__f_{i}_{j}") for i, j in pairs if j]
    aggs += [F.sum(F.when(test, v[i] * v[j])).alias(f"__t_{i}_{j}") for i, j in pairs]
    moments = rows.groupBy(*keys).agg(*aggs)
    # y is number 0, the features 1 to p
    moments = moments.select(*[F.col(f"`{k}`") for k in keys], "n_train", "n_test", *[f"__m{i}" for i in range(p + 1)],
                             *[F.col(f"__f_0_{i + 1}").alias(f"__xy_{i}") for i in range(p)],
                             *[F.col(f"__f_{i + 1}_{j + 1}").alias(f"__xx_{i}_{j}") for i in range(p) for j in range(i, p)],
                             *[f"__t_{i}_{j}" for i, j in pairs])
    solved = moments.withColumn("__b", F.when(F.col("n_train") > 0, _solved(p, tolerance)))
    # one expression feeds several columns: a generator keeps it from being repeated in each
    solved = solved.withColumn("__b", F.explode(F.array("__b")))
    b = [F.get("__b", i) for i in range(p)]
    # residual = y - b x, squared and summed over the holdout
    error = F.col("__t_0_0")
    for i in range(p):
        error = error - F.lit(2.0) * b[i] * F.col(f"__t_0_{i + 1}")
        for j in range(p):
            error = error + b[i] * b[j] * F.col(f"__t_{min(i, j) + 1}_{max(i, j) + 1}")
    intercept = F.col("__m0")
    for i in range(p):
        intercept = intercept - b[i] * F.col(f"__m{i + 1}")
    mse = F.when((F.col("n_test") > 0) & F.col("__b").isNotNull(), F.greatest(F.lit(0.0), error) / F.greatest("n_test", F.lit(1)))
    return solved.select(*[F.col(f"`{k}`") for k in keys], "n_train", "n_test", mse.alias("mse"),
                         intercept.alias("b_intercept"), *[c.alias(f"b_{f}") for c, f in zip(b, features)])
