"""Correlation, elastic net, slope tests and the category screen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covary.operators import (
    category_screen,
    correlation_by,
    elastic_net_1d,
    moments,
    score_linear,
    slope_test,
    zero_filled_moments,
)

MOMENTS_ROWS = [
    # g, x, y: negative slope, weak correlation, constant x, constant y, one row, null pair
    ("neg", 1.0, 10.0), ("neg", 2.0, 8.5), ("neg", 3.0, 5.0), ("neg", 4.0, 4.0),
    ("weak", 1.0, 3.0), ("weak", 2.0, 1.0), ("weak", 3.0, 4.0), ("weak", 4.0, 1.0), ("weak", 5.0, 3.5),
    ("cx", 2.0, 1.0), ("cx", 2.0, 5.0), ("cx", 2.0, 3.0),
    ("cy", 1.0, 7.0), ("cy", 2.0, 7.0), ("cy", 3.0, 7.0),
    ("one", 1.0, 2.0),
    ("nul", 1.0, 1.0), ("nul", 2.0, None), ("nul", 3.0, 2.0), ("nul", None, 9.0), ("nul", 5.0, 4.0),
]


@pytest.fixture(scope="module")
def mframe(spark):
    return spark.createDataFrame(MOMENTS_ROWS, "g string, x double, y double")


def _np_groups():
    out = {}
    for g, x, y in MOMENTS_ROWS:
        if x is not None and y is not None:
            out.setdefault(g, ([], []))
            out[g][0].append(x)
            out[g][1].append(y)
    return {g: (np.array(a), np.array(b)) for g, (a, b) in out.items()}


def test_correlation_guards(mframe):
    got = {r.g: r for r in correlation_by(mframe, "g", "x", "y").collect()}
    for g, (x, y) in _np_groups().items():
        if g in ("cx", "cy", "one"):
            assert got[g].corr is None, g
        else:
            assert got[g].corr == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12), g
    assert got["nul"].n == 3   # pairs with a null are skipped


def test_correlation_invariant_under_shift_and_scale(mframe):
    a = {r.g: r.corr for r in correlation_by(mframe, "g", "x", "y").collect()}
    t = mframe.withColumn("x", F.col("x") * 3.5 + 100).withColumn("y", F.col("y") * 0.25 - 7)
    b = {r.g: r.corr for r in correlation_by(t, "g", "x", "y").collect()}
    for g in a:
        if a[g] is None:
            assert b[g] is None
        else:
            assert b[g] == pytest.approx(a[g], abs=1e-12)


def test_elastic_net_matches_spark_ml(spark, mframe):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    fits = {r.g: r for r in elastic_net_1d(moments(mframe, "g", "x", "y")).collect()}
    for g in ("neg", "weak", "nul"):
        data = VectorAssembler(inputCols=["x"], outputCol="features").transform(
            mframe.filter((F.col("g") == g) & F.col("x").isNotNull() & F.col("y").isNotNull()))
        model = LinearRegression(featuresCol="features", labelCol="y", maxIter=200,
                                 regParam=0.3, elasticNetParam=0.8).fit(data)
        assert fits[g].slope == pytest.approx(model.coefficients[0], rel=1e-6, abs=1e-9), g
        assert fits[g].intercept == pytest.approx(model.intercept, rel=1e-6, abs=1e-9), g
        assert fits[g].rmse == pytest.approx(model.summary.rootMeanSquaredError, rel=1e-6), g
        assert fits[g].r2 == pytest.approx(model.summary.r2, rel=1e-6, abs=1e-9), g
    # constant feature, constant label, single row: slope 0, intercept = mean of y
    for g, mean_y in (("cx", 3.0), ("cy", 7.0), ("one", 2.0)):
        assert fits[g].slope == 0.0 and fits[g].intercept == pytest.approx(mean_y)


def test_unpenalised_slope_test_matches_spark_ml_pvalue(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    xs = [float(i) for i in range(12)]
    ys = [2.0 + 0.3 * x + ((-1) ** i) * 0.9 + (i % 3) * 0.4 for i, x in enumerate(xs)]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    tested = slope_test(elastic_net_1d(moments(df, None, "x", "y"), reg=0.0, mix=0.0)).first()
    model = LinearRegression(featuresCol="features", labelCol="y", regParam=0.0, solver="normal").fit(
        VectorAssembler(inputCols=["x"], outputCol="features").transform(df))
    assert tested.slope == pytest.approx(model.coefficients[0], rel=1e-9)
    assert tested.p_value == pytest.approx(model.summary.pValues[0], abs=1e-9)
    assert tested.t_stat == pytest.approx(model.summary.tValues[0], rel=1e-9)
    assert tested.verdict == "reject null" and tested.significant


def test_slope_test_untestable_and_damping(spark, mframe):
    out = {r.g: r for r in slope_test(elastic_net_1d(moments(mframe, "g", "x", "y"))).collect()}
    assert out["one"].p_value is None and out["one"].verdict == "not testable"
    damped = {r.g: r for r in slope_test(elastic_net_1d(moments(mframe, "g", "x", "y")),
                                         sxx_damping=1e9).collect()}
    # damping shrinks the standard error, so |t| grows
    assert abs(damped["neg"].t_stat) > abs(out["neg"].t_stat)


def test_score_linear(spark, mframe):
    fit = elastic_net_1d(moments(mframe, "g", "x", "y"))
    scored = score_linear(mframe.filter("g = 'neg'"), fit, "g", "x").collect()
    f = fit.filter("g = 'neg'").first()
    for r in scored:
        assert r.prediction == pytest.approx(f.intercept + f.slope * r.x)


def test_zero_filled_moments_equal_explicit_grid(spark):
    dense = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 14.0), ("a", 3, 9.0), ("a", 4, 20.0),
                                   ("b", 1, 3.0), ("b", 2, 5.0)], "f string, p int, d double")
    sparse = spark.createDataFrame([("a", 1, "u", 2), ("a", 3, "u", 5), ("a", 4, "v", 1),
                                    ("a", 9, "w", 7), ("b", 2, "u", 4)],
                                   "f string, p int, c string, s long")
    for center in (False, True):
        got = {(r.f, r.c): r for r in zero_filled_moments(dense, sparse, "f", "p", "c", "d", "s",
                                                          dense_role="x", center=center).collect()}
        dvals = {"a": {1: 10.0, 2: 14.0, 3: 9.0, 4: 20.0}, "b": {1: 3.0, 2: 5.0}}
        cells = {("a", 1, "u"): 2, ("a", 3, "u"): 5, ("a", 4, "v"): 1, ("b", 2, "u"): 4}
        for (f, c) in [("a", "u"), ("a", "v"), ("a", "w"), ("b", "u")]:
            ps = sorted(dvals[f])
            x = np.array([dvals[f][p] for p in ps])
            y = np.array([cells.get((f, p, c), 0) for p in ps], dtype=float)
            r = got[(f, c)]
            assert r.n == len(ps)
            assert r.sxx == pytest.approx(((x - x.mean()) ** 2).sum())
            assert r.syy == pytest.approx(((y - y.mean()) ** 2).sum(), abs=1e-12)
            assert r.sxy == pytest.approx(((x - x.mean()) * (y - y.mean())).sum(), abs=1e-12)
            assert r.mean_x == pytest.approx(x.mean()) and r.mean_y == pytest.approx(y.mean())


def _t_cdf_np(t, v):
    # numerical integration of the t density (independent of the series)
    from math import gamma, pi, sqrt
    xs = np.linspace(0.0, abs(t), 200001)
    dens = gamma((v + 1) / 2) / (sqrt(v * pi) * gamma(v / 2)) * (1 + xs ** 2 / v) ** (-(v + 1) / 2)
    mass = np.trapezoid(dens, xs)
    return 0.5 + np.sign(t) * mass


def test_category_screen_matches_reference_formulas(spark):
    rng = np.random.default_rng(7)
    events = []
    for g in ("g1", "g2", "g3"):
        for m in range(1, 9):
            for _ in range(int(rng.integers(3, 30))):
                events.append((g, m, str(rng.choice(["a", "b", "c"])), str(rng.choice(["M", "F"]))))
    events.append((None, 1, "a", "M"))   # a null group is a group
    df = spark.createDataFrame(events, "grp string, month int, age string, sex string")
    got = {(r.grp, r.dimension, r.category): r
           for r in category_screen(df, "grp", "month", ["age", "sex"], top=2, max_p=None).collect()}
    # brute force
    eps = 2.220446049250313e-16
    totals = {}
    for g, m, a, s in events:
        totals[g] = totals.get(g, 0) + 1
    top = sorted(totals, key=lambda k: (-totals[k], k or ""))[:2]
    assert {k[0] for k in got} == set(top)
    for g in top:
        months = sorted({m for gg, m, _, _ in events if gg == g})
        y = np.array([sum(1 for e in events if e[0] == g and e[1] == m) for m in months], float)
        cats = [("age", c) for c in sorted({e[2] for e in events if e[0] == g})] + \
               [("sex", c) for c in sorted({e[3] for e in events if e[0] == g})]
        k = len(cats)
        for dim, c in cats:
            idx = 2 if dim == "age" else 3
            x = np.array([sum(1 for e in events if e[0] == g and e[1] == m and e[idx] == c)
                          for m in months], float)
            n = len(months)
            sxx = ((x - x.mean()) ** 2).sum()
            beta = ((x - x.mean()) * (y - y.mean())).sum() / sxx if sxx else 0.0
            pred = y.mean() + beta * (x - x.mean())
            sse = ((pred - y) ** 2).sum() / max(n - 2, 1)
            se = np.sqrt(sse / (sxx + eps))
            t = beta / (se + eps)
            cdf = _t_cdf_np(t, n - 2)
            p = cdf * k if beta < 0 else (1 - cdf) * k
            r = got[(g, dim, c)]
            assert r.k == k and r.n == n
            assert r.slope == pytest.approx(beta, abs=1e-9)
            assert r.p_value == pytest.approx(p, abs=1e-6)


def test_zero_filled_moments_skip_null_dense_value(spark):
    dense = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0)], "f string, p int, d double")
    sparse = spark.createDataFrame([("a", 1, "u", 2), ("a", 2, "u", 9), ("a", 3, "u", 4)],
                                   "f string, p int, c string, s long")
    r = zero_filled_moments(dense, sparse, "f", "p", "c", "d", "s", dense_role="x").first()
    assert r.n == 2 and r.sxx == pytest.approx(2.0) and r.sxy == pytest.approx(2.0)
