"""Property-based checks (hypothesis) of the moment algebra and the t series."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from covary.operators import zero_filled_moments

cells_strategy = st.lists(
    st.tuples(st.sampled_from(["f1", "f2"]), st.integers(1, 6), st.sampled_from(["a", "b", "c"]),
              st.integers(1, 50)),
    min_size=1, max_size=25, unique_by=lambda t: (t[0], t[1], t[2]))
dense_strategy = st.dictionaries(st.tuples(st.sampled_from(["f1", "f2"]), st.integers(1, 6)),
                                 st.integers(-1000, 1000), min_size=1, max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cells=cells_strategy, dense=dense_strategy, center=st.booleans())
def test_zero_filled_moments_property(spark, cells, dense, center):
    dense_rows = [(f, p, float(v)) for (f, p), v in dense.items()]
    ddf = spark.createDataFrame(dense_rows, "f string, p int, d double")
    sdf = spark.createDataFrame(cells, "f string, p int, c string, s long")
    got = {(r.f, r.c): r for r in zero_filled_moments(ddf, sdf, "f", "p", "c", "d", "s",
                                                      dense_role="x", center=center).collect()}
    for f in {c[0] for c in cells}:
        periods = sorted(p for (ff, p) in dense if ff == f)
        if not periods:
            continue
        x = np.array([dense[(f, p)] for p in periods], float)
        for cat in {c[2] for c in cells if c[0] == f}:
            y = np.array([next((c[3] for c in cells if c[:3] == (f, p, cat)), 0) for p in periods], float)
            r = got[(f, cat)]
            assert r.n == len(periods)
            assert r.sxy == pytest.approx(((x - x.mean()) * (y - y.mean())).sum(), abs=1e-6)
            assert r.syy == pytest.approx(((y - y.mean()) ** 2).sum(), abs=1e-6)
            assert r.sxx == pytest.approx(((x - x.mean()) ** 2).sum(), abs=1e-6)


def _t_mass_numeric(t, v):
    xs = np.linspace(0.0, abs(t), 400001)
    logc = math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi)
    dens = np.exp(logc - (v + 1) / 2 * np.log1p(xs ** 2 / v))
    return 2 * np.trapezoid(dens, xs)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(t=st.floats(-8, 8), v=st.integers(1, 400))
def test_t_series_property(spark, t, v):
    from covary.functions import t_two_sided_p
    df = spark.createDataFrame([(float(t), v)], "t double, v long")
    p = df.select(t_two_sided_p("t", "v").alias("p")).first().p
    assert 0.0 <= p <= 1.0
    assert p == pytest.approx(1.0 - _t_mass_numeric(t, v), abs=1e-7)
