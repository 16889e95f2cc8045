"""Correlation, one-feature linear models and slope significance tests.

Every test is computed from the second moments of (x, y) per group --
``n, mean_x, mean_y, sxx, syy, sxy`` -- which one grouped aggregate yields
for all groups at once. No per-group loop, no collection on the driver.
The moments table has one row per group, so all later column arithmetic
(closed-form fits, t statistics, p-values) runs on tiny data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covary.functions.stats import (
    MACHINE_EPSILON,
    safe_div,
    safe_sqrt,
    t_two_sided_p,
)
from covary.operators._util import Cols, as_list, null_safe_join

MOMENT_COLS = ["n", "mean_x", "mean_y", "sxx", "syy", "sxy"]


def moments(df: DataFrame, by: Cols | None, x: str, y: str) -> DataFrame:
    """Per-group moments of (x, y); rows with a NULL in x or y are skipped."""
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    aggs = [F.regr_count(yc, xc).alias("n"), F.regr_avgx(yc, xc).alias("mean_x"),
            F.regr_avgy(yc, xc).alias("mean_y"), F.regr_sxx(yc, xc).alias("sxx"),
            F.regr_syy(yc, xc).alias("syy"), F.regr_sxy(yc, xc).alias("sxy")]
    keys = as_list(by)
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def zero_filled_moments(dense: DataFrame, sparse: DataFrame, frame: Cols | None,
                        period: str, category: Cols, dense_value: str,
                        sparse_value: str, dense_role: str = "y",
                        center: bool = True) -> DataFrame:
    """Moments between a per-period series and per-(period, category) counts
    where a missing (period, category) cell counts as zero.

    ``dense`` has one row per (frame, period) -- the periods of the frame;
    ``sparse`` has a row only where the category occurred. The result equals
    the moments over the full zero-filled period x category grid, but the
    grid is never built: zeros add nothing to the sums of the sparse
    variable, so
    ``S_ss = sum s^2 - (sum s)^2 / n`` and ``S_sd = sum s*d - sum s * sum d / n``
    need the sparse cells only, while ``n, sum d, sum d^2`` come from the
    periods. Work is proportional to the non-zero cells.

    ``center`` subtracts the frame mean of the dense value first (better
    rounding for large values). Integer counts are summed in DECIMAL, whose
    result does not depend on the order of the rows and loses no digit: those
    of the sparse value always, those of the dense value if ``center`` is
    off. Categories seen only in periods outside ``dense`` get zero
    sums. ``dense_role`` says whether the dense value is the regression's
    ``x`` or ``y``.
    """
    fk = as_list(frame)
    cats = as_list(category)
    whole = ("tinyint", "smallint", "int", "bigint")
    exact_s = dict(sparse.dtypes)[sparse_value] in whole
    exact_d = exact_s and not center and dict(dense.dtypes)[dense_value] in whole

    def number(c, exact):
        return F.col(c).cast("decimal(18,0)" if exact else "double")

    # a period whose dense value is NULL is no pair at all (as in regr_*)
    d = (dense.select(*fk, period, number(dense_value, exact_d).alias("__d"))
              .filter(F.col("__d").isNotNull()))
    if center and fk:
        mu = d.groupBy(*fk).agg(F.avg("__d").alias("__mu"))
        d = null_safe_join(d, mu, fk).select(*fk, period, (F.col("__d") - F.col("__mu")).alias("__d"),
                                              "__mu")
    elif center:
        # one frame: the mean is a scalar subquery, evaluated once, no join
        mean = d.agg(F.avg("__d")).scalar()
        d = d.select(period, (F.col("__d") - mean).alias("__d"), mean.alias("__mu"))
    else:
        d = d.withColumn("__mu", F.lit(0.0))
    dense_aggs = [F.count(F.lit(1)).alias("n"), F.sum("__d").alias("__sd"),
                  F.sum(F.col("__d") * F.col("__d")).alias("__sdd"), F.first("__mu").alias("__mu")]
    s = sparse.select(*fk, period, *cats, number(sparse_value, exact_s).alias("__s"))
    cells = null_safe_join(s, d.select(*fk, period, "__d"), [*fk, period], "left")
    inside = F.col("__d").isNotNull()
    cstat = cells.groupBy(*fk, *cats).agg(
        F.coalesce(F.sum(F.when(inside, F.col("__s"))), F.lit(0)).alias("__ss"),
        F.coalesce(F.sum(F.when(inside, F.col("__s") * F.col("__s"))), F.lit(0)).alias("__sss"),
        F.coalesce(F.sum((F.col("__s") if exact_d else F.col("__s").cast("double")) * F.col("__d")),
                   F.lit(0)).alias("__ssd"))
    if fk:
        m = null_safe_join(cstat, d.groupBy(*fk).agg(*dense_aggs), fk)
    else:
        # one frame: its period statistics are one struct-valued scalar subquery
        stats = d.agg(F.struct(*dense_aggs).alias("s")).scalar()
        m = cstat.select("*", *[stats.getField(c).alias(c) for c in ("n", "__sd", "__sdd", "__mu")])
    n = F.col("n").cast("double")

    def centred(square, a, b, exact):
        # n * sum(ab) - sum(a) * sum(b), rounded once
        if exact:
            big = "decimal(38,0)"
            return (F.col("n").cast("decimal(12,0)").cast(big) * F.col(square).cast(big)
                    - F.col(a).cast(big) * F.col(b).cast(big)).cast("double") / n
        return F.col(square).cast("double") - F.col(a).cast("double") * F.col(b).cast("double") / n

    sdd = centred("__sdd", "__sd", "__sd", exact_d)
    sss = centred("__sss", "__ss", "__ss", exact_s)
    ssd = centred("__ssd", "__ss", "__sd", exact_d)
    mean_d = F.col("__mu") + F.col("__sd").cast("double") / n
    mean_s = F.col("__ss").cast("double") / n
    if dense_role == "y":
        out = [mean_s.alias("mean_x"), mean_d.alias("mean_y"), sss.alias("sxx"),
               sdd.alias("syy"), ssd.alias("sxy")]
    else:
        out = [mean_d.alias("mean_x"), mean_s.alias("mean_y"), sdd.alias("sxx"),
               sss.alias("syy"), ssd.alias("sxy")]
    return m.select(*fk, *cats, F.col("n"), *out)


def correlation_expr(sxx="sxx", syy="syy", sxy="sxy") -> Column:
    """Pearson r from moments; NULL when either variable is constant."""
    sxx, syy, sxy = (F.col(c) if isinstance(c, str) else c for c in (sxx, syy, sxy))
    return F.when((sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy))


def correlation_by(df: DataFrame, by: Cols | None, x: str, y: str,
                   out: str = "corr") -> DataFrame:
    """Pearson correlation of x and y per group (one aggregate for all groups).

    Pairs with a NULL are skipped; a constant column gives NULL instead of
    the division-by-zero error of ``corr`` under ANSI mode.
    """
    m = moments(df, by, x, y)
    return m.select(*as_list(by), "n", correlation_expr().alias(out))


def elastic_net_1d(mom: DataFrame, reg: float = 0.3, mix: float = 0.8) -> DataFrame:
    """Closed-form one-feature elastic-net fit per moments row.

    Solves the objective of ``pyspark.ml.regression.LinearRegression`` with
    ``regParam=reg``, ``elasticNetParam=mix``, an intercept and
    standardisation, for a single feature: with population deviations
    ``sx, sy`` and ``e = reg / sy`` the standardised coefficient is the
    soft-thresholded correlation ``sign(r) max(|r| - mix e, 0) / (1 + (1-mix) e)``.
    A constant feature or label gives slope 0 and intercept ``mean_y``; a
    group without pairs gives slope 0 and NULL in the other columns.
    Adds ``slope, intercept, rss, rmse, r2``.
    """
    n = F.col("n").cast("double")
    sxx, syy, sxy = F.col("sxx"), F.col("syy"), F.col("sxy")
    # a group without any pair has n = 0 and NULL sums: nothing is divided
    sx = F.sqrt(safe_div(sxx, n))
    sy = F.sqrt(safe_div(syy, n))
    r = sxy / F.sqrt(sxx * syy)
    e = F.lit(float(reg)) / sy
    shrunk = F.signum(r) * F.greatest(F.abs(r) - F.lit(float(mix)) * e, F.lit(0.0)) \
        / (F.lit(1.0) + F.lit(1.0 - float(mix)) * e)
    slope = F.when((sxx > 0) & (syy > 0), shrunk * sy / sx).otherwise(F.lit(0.0))
    with_slope = mom.withColumn("slope", slope)
    b = F.col("slope")
    rss = F.when(sxx.isNotNull() & syy.isNotNull(),
                 F.greatest(F.lit(0.0), syy - F.lit(2.0) * b * sxy + b * b * sxx))
    fitted = with_slope.withColumns({"intercept": F.col("mean_y") - b * F.col("mean_x"), "rss": rss})
    return fitted.withColumns({"rmse": F.sqrt(safe_div(F.col("rss"), n)),
                               "r2": F.when(syy > 0, F.lit(1.0) - F.col("rss") / syy)})


def score_linear(df: DataFrame, model: DataFrame, by: Cols | None, x: str,
                 out: str = "prediction") -> DataFrame:
    """``intercept + slope * x`` for every row, with the model row of its group.

    The model table has one row per group; Spark's AQE broadcasts it when it
    is small and shuffles otherwise.
    """
    keys = as_list(by)
    if not keys:
        # a single model row: scalar subquery, no join
        m = model.select(F.struct("slope", "intercept").alias("m")).scalar()
        return df.withColumn(out, m.getField("intercept") + m.getField("slope") * F.col(x).cast("double"))
    coef = model.select(*keys, "slope", "intercept")
    joined = null_safe_join(df, coef, keys, "inner")
    return (joined.withColumn(out, F.col("intercept") + F.col("slope") * F.col(x).cast("double"))
                  .drop("slope", "intercept"))


def slope_test(fit: DataFrame, n_coeffs: int = 1, alpha: float = 0.05,
               sxx_damping: float = 0.0) -> DataFrame:
    """Significance of a fitted slope per row of ``fit`` (moments + slope + rss).

    ``dof = n - (n_coeffs + 1)``, ``se = sqrt(rss / (dof (sxx + damping)))``,
    ``t = slope / se``, two-sided p from Student-t, Bonferroni-corrected level
    ``alpha / n_coeffs``. ``significant`` is true when ``p <= level``;
    ``verdict`` reads 'reject null' (the slope matters) or 'accept null'.
    A perfect fit (zero standard error, slope not 0) has an infinite t, shown
    as NULL, and p = 0. Rows with ``dof < 1``, and a slope of 0 with a zero
    standard error, are not testable (NULL).
    ``sxx_damping`` (e.g. 1e9) reproduces a damped variant that shrinks the
    standard error; it is off by default.
    """
    dof = F.col("n") - F.lit(n_coeffs + 1)
    se = safe_sqrt(safe_div(F.col("rss"), dof.cast("double") * (F.col("sxx") + F.lit(float(sxx_damping)))))
    level = float(alpha) / n_coeffs
    out = fit.withColumns({"dof": dof, "std_err": F.when(dof >= 1, se)})
    out = out.withColumn("t_stat", safe_div(F.col("slope"), F.col("std_err")))
    perfect = (F.col("std_err") == 0) & (F.col("slope") != 0)
    out = out.withColumns({"p_value": F.when(perfect, F.lit(0.0)).otherwise(
                               t_two_sided_p(F.col("t_stat"), F.col("dof"))),
                           "alpha": F.lit(level)})
    p = F.col("p_value")
    return out.withColumns({
        "significant": F.when(p.isNotNull(), p <= F.lit(level)),
        "verdict": F.when(p.isNull(), F.lit("not testable"))
                    .when(p > F.lit(level), F.lit("accept null"))
                    .otherwise(F.lit("reject null"))})


def directional_screen(mom: DataFrame, group: Cols, max_p: float | None = 0.05) -> DataFrame:
    """One-sided OLS slope screen of many categories per group.

    For each (group, category) moments row (x = category count, y = group
    total): ``beta = sxy / sxx`` (0 for constant x), ``sse = (syy - beta sxy)
    / max(n-2, 1)``, ``se = sqrt(sse / (sxx + eps))``, ``t = beta / (se + eps)``;
    p is the Student-t tail with ``n - 2`` dof in the direction of beta,
    multiplied by ``k`` = number of categories tested in the group
    (Bonferroni, not clipped at 1). Groups with n <= 2 have no p and drop
    out. Only rows with ``p < max_p`` are kept (all rows when ``max_p`` is
    None). The reported ``corr`` is Pearson r of the pair.
    """
    gk = as_list(group)
    eps = F.lit(MACHINE_EPSILON)
    beta = F.coalesce(safe_div(F.col("sxy"), F.col("sxx")), F.lit(0.0))
    n = F.col("n")
    k = F.count(F.lit(1)).over(Window.partitionBy(*gk)) if gk else F.count(F.lit(1)).over(Window.partitionBy())
    staged = mom.withColumn("slope", beta)
    sse = (F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
           / F.greatest(n - 2, F.lit(1)).cast("double"))
    se = F.sqrt(sse / (F.col("sxx") + eps))
    staged = staged.withColumn("t_stat", F.col("slope") / (se + eps))
    # The tail is computed below the window: the window is a barrier for
    # filter push-down, so the p filter reads this column instead of computing
    # it a second time. t has the sign of the slope, so the tail in the
    # direction of the slope is half the two-sided one.
    staged = staged.withColumn("__tail", t_two_sided_p("t_stat", n - 2) / 2).withColumn("k", k)
    res = staged.select("*", (F.col("__tail") * F.col("k")).alias("p_value"),
                        correlation_expr().alias("corr")).drop("__tail")
    if max_p is not None:
        res = res.filter(F.col("p_value") < F.lit(float(max_p)))
    return res


def category_screen(df: DataFrame, group: str, period: str,
                    dims: Sequence[str], top: int | None = 10,
                    max_p: float | None = 0.05) -> DataFrame:
    """Which categories track the monthly total of each large group?

    ``df`` holds one row per event with ``group``, ``period`` and the
    dimension columns. The total is counted as one more dimension, so:

    1. one count per (group, period, dimension, category), combined map-side:
       its shuffle is bounded by the sum of the dimensions' categories times
       groups and periods, not by their product nor by the events;
    2. these cells are dealt by group, and that one partitioning serves the
       totals (a window per period), the sums of every (category, total) pair
       in DECIMAL, the number of tests ``k`` and the group's total;
    3. a group is now one row with its categories in an array; the ``top``
       groups are a sorted limit, and the test runs inside the array.

    There is no join and no second pass. Returns ``group, dimension,
    category, n, k, slope, t_stat, p_value, corr``; see
    :func:`directional_screen` for the test.
    """
    from covary.operators.counts import dimension_counts

    g = F.col(group)
    cells = dimension_counts(df, group, period, dims, "__x").repartition(g)
    x = F.col("__x").cast("decimal(18,0)")
    is_total = F.col("dimension").isNull()
    y = F.max(F.when(is_total, x)).over(Window.partitionBy(group, period))
    cells = cells.select(g, "dimension", "category", x.alias("__x"), y.alias("__y"))
    sums = cells.groupBy(group, "dimension", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__x").alias("sx"),
        F.sum(F.col("__x") * F.col("__x")).alias("sxx"), F.sum(F.col("__x") * F.col("__y")).alias("sxy"))
    one = F.struct("dimension", "category", "sx", "sxx", "sxy")
    total = F.max(F.when(is_total, F.struct("n", "sx", "sxx")))
    groups = sums.groupBy(group).agg(F.collect_list(F.when(~is_total, one)).alias("__c"), total.alias("__t"))
    if top is not None:
        groups = groups.orderBy(F.col("__t.sx").desc(), g.asc_nulls_first()).limit(top)

    t, k = F.col("__t"), F.size("__c")
    n, eps = t["n"], F.lit(MACHINE_EPSILON)
    whole, big = n.cast("decimal(12,0)").cast("decimal(38,0)"), "decimal(38,0)"

    def centred(square, a, b):
        return (whole * square.cast(big) - a.cast(big) * b.cast(big)).cast("double") / n.cast("double")

    def added(array, **new):
        """The structs of ``array`` with further fields, each computed once."""
        names = fields + list(new)
        out = F.transform(array, lambda s: F.struct(*[s[f].alias(f) for f in fields], *[f(s).alias(c) for c, f in new.items()]))
        fields[:] = names
        return out

    fields = ["dimension", "category"]
    c = added(F.col("__c"), sxx=lambda s: centred(s["sxx"], s["sx"], s["sx"]),
              sxy=lambda s: centred(s["sxy"], s["sx"], t["sx"]), syy=lambda s: centred(t["sxx"], t["sx"], t["sx"]))
    c = added(c, slope=lambda s: F.coalesce(safe_div(s["sxy"], s["sxx"]), F.lit(0.0)))
    c = added(c, sse=lambda s: F.greatest(F.lit(0.0), s["syy"] - s["slope"] * s["sxy"])
              / F.greatest(n - 2, F.lit(1)).cast("double"))
    c = added(c, t_stat=lambda s: s["slope"] / (F.sqrt(s["sse"] / (s["sxx"] + eps)) + eps))
    c = added(c, p_value=lambda s: t_two_sided_p(s["t_stat"], n - 2) / 2 * k,
              corr=lambda s: correlation_expr(s["sxx"], s["syy"], s["sxy"]))
    res = groups.select(g, n.alias("n"), k.cast("bigint").alias("k"), F.explode(c).alias("__r"))
    res = res.select(group, "__r.dimension", "__r.category", "n", "k", "__r.slope", "__r.t_stat",
                     "__r.p_value", "__r.corr")
    if max_p is not None:
        res = res.filter(F.col("p_value") < F.lit(float(max_p)))
    return res
