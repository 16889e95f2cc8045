"""Counts, pivots, ranking, joins, series and the nearest-area join."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from covary.operators import (
    category_counts,
    category_map,
    chronological_split,
    code_ranges,
    haversine_km,
    keep_top,
    lag_features,
    lag_forecast,
    min_max_scale,
    nearest_area,
    ordered_series,
    period_counts,
    pivot_counts,
    rank_within,
    summary_stats,
    top_k,
    with_indicator,
)
from tests.conftest import rows


@pytest.fixture(scope="module")
def dims(spark):
    # the same label in two dimensions; a null group; a missing month for g2
    data = [("g1", "m1", "UNKNOWN", "M", "W"), ("g1", "m1", "18-24", "F", "UNKNOWN"),
            ("g1", "m2", "UNKNOWN", "M", "B"), (None, "m1", "25-44", "F", "W"),
            ("g2", "m2", "18-24", "M", "W")]
    return spark.createDataFrame(data, "grp string, month string, age string, sex string, race string")


def test_category_counts_keeps_dimensions_apart(dims):
    cc = category_counts(dims, "grp", "month", ["age", "sex", "race"])
    got = {(r.grp, r.month, r.dimension, r.category): (r.n, r.total) for r in cc.collect()}
    assert got[("g1", "m1", "age", "UNKNOWN")] == (1, 2)
    assert got[("g1", "m1", "race", "UNKNOWN")] == (1, 2)
    assert got[(None, "m1", "sex", "F")] == (1, 1)
    # the counts of every dimension add up to the total
    for (g, m, d, _), (n, tot) in got.items():
        assert sum(v[0] for k, v in got.items() if k[:3] == (g, m, d)) == tot


def test_category_map_and_series(dims):
    cc = category_counts(dims, "grp", "month", ["age", "sex", "race"])
    m = {(r.grp, r.month): r.counts for r in category_map(cc, "grp", "month").collect()}
    assert m[("g1", "m1")]["total"] == 2 and m[("g1", "m1")]["age:UNKNOWN"] == 1
    s = ordered_series(period_counts(dims, ["grp", "month"], "n"), "grp", "month", "n").collect()
    g1 = [r for r in s if r.grp == "g1"][0].series
    assert [(e.month, e.n) for e in g1] == [("m1", 2), ("m2", 1)]


def test_pivot_zero_fill_and_null_category(spark):
    df = spark.createDataFrame([("p1", "A"), ("p1", "B"), ("p2", "A"), ("p2", None)], "p string, c string")
    pv = {r.p: r.asDict() for r in pivot_counts(df, "p", "c").collect()}
    assert pv["p1"]["B"] == 1 and pv["p2"]["B"] == 0 and pv["p2"]["(null)"] == 1


def test_counts_sum_to_rows(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("j"))
    assert sum(r.n for r in period_counts(df, ["k", "j"]).collect()) == 1000


def test_top_k_ties_and_rank(spark):
    ties = spark.createDataFrame([("a", 5), ("b", 7), ("c", 5), ("d", 5), ("e", 1)], "k string, v long")
    assert rows(top_k(ties, "k", "v", 3)) == [("a", 5), ("b", 7), ("c", 5)]
    assert rows(top_k(ties.repartition(3), "k", "v", 3)) == rows(top_k(ties, "k", "v", 3))
    grp = ties.withColumn("g", F.lit(1))
    ranked = rank_within(grp, "g", "v", 2)   # rank keeps ties: 7, then three 5s
    assert ranked.count() == 4


def test_keep_top_null_safe(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    top = spark.createDataFrame([("a",), (None,)], "k string")
    assert rows(keep_top(df, top, "k"), "v") == [(1,), (2,)]


def test_indicator_fill_and_code_ranges(spark):
    df = spark.createDataFrame([(1, 5), (2, 300), (3, 1650), (4, 610)], "m int, code int")
    ind = spark.createDataFrame([(1, 0.5), (3, 0.7)], "m int, rate double")
    got = {r.m: r.rate for r in with_indicator(df, ind, "m", fill=-1.0).collect()}
    assert got == {1: 0.5, 2: -1.0, 3: 0.7, 4: -1.0}
    hits = code_ranges(df, "code", [(261, 291), (1610, 1697), (1, 10)])
    assert set(rows(hits, "code", "range_lo")) == {(5, 1), (1650, 1610)}


def test_summary_stats(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    s = {(r.column, r.stat): r.value for r in summary_stats(df, ["x"]).collect()}
    assert s[("x", "count")] == 3 and s[("x", "mean")] == pytest.approx(7 / 3)
    assert s[("x", "stddev")] == pytest.approx(np.std([1, 2, 4], ddof=1))


def test_series_lags_split_scale(spark):
    series = spark.createDataFrame([("s", i, float(i * 10)) for i in range(1, 6)] + [("t", 1, 3.0)],
                                   "s string, m int, u double")
    lg = {(r.s, r.m): r for r in lag_features(series, "s", "m", "u", (1, 2, 3)).collect()}
    assert (lg[("s", 4)].u_1, lg[("s", 4)].u_3) == (30.0, 10.0)
    assert lg[("s", 2)].u_2 == -1.0 and lg[("t", 1)].u_1 == -1.0   # fewer rows than lags
    sp = {(r.s, r.m): r for r in chronological_split(series, "s", "m", 0.8).collect()}
    assert [sp[("s", i)].is_train for i in range(1, 6)] == [True] * 4 + [False]
    assert sp[("t", 1)].is_train is False   # n = 1: floor(0.8) = 0 training rows
    sc = {(r.s, r.m): r.u_scaled for r in min_max_scale(series, "s", ["u"]).collect()}
    assert sc[("s", 1)] == -1.0 and sc[("s", 5)] == 1.0 and sc[("t", 1)] == -1.0


def test_lag_forecast_matches_numpy(spark):
    rng = np.random.default_rng(3)
    data = []
    for s in ("a", "b"):
        for m in range(30):
            x1, x2 = rng.normal(size=2)
            data.append((s, m, float(1.5 + 2 * x1 - x2 + rng.normal() * 0.1), float(x1), float(x2)))
    df = spark.createDataFrame(data, "s string, m int, y double, x1 double, x2 double")
    got = {r.s: r for r in lag_forecast(df, "s", "m", "y", ["x1", "x2"], 0.8).collect()}
    for s in ("a", "b"):
        d = [r for r in data if r[0] == s]
        X = np.array([[1.0, r[3], r[4]] for r in d])
        y = np.array([r[2] for r in d])
        b, *_ = np.linalg.lstsq(X[:24], y[:24], rcond=None)
        mse = float(np.mean((X[24:] @ b - y[24:]) ** 2))
        assert got[s].n_train == 24 and got[s].n_test == 6
        assert [got[s].b_intercept, got[s].b_x1, got[s].b_x2] == pytest.approx(list(b), rel=1e-8)
        assert got[s].mse == pytest.approx(mse, rel=1e-8)


def _brute_nearest(points, cents):
    out = {}
    for pid, plat, plon in points:
        if plat is None or plon is None:
            continue
        best = None
        for aid, clat, clon in cents:
            p1, p2 = math.radians(plat), math.radians(clat)
            a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(clon - plon) / 2) ** 2
            d = 2 * 6371.0 * math.asin(math.sqrt(min(1.0, a)))
            if best is None or (d, aid) < best:
                best = (d, aid)
        out[pid] = best
    return out


def test_nearest_area_exact_against_brute_force(spark):
    rng = np.random.default_rng(11)
    pts = [(i, float(rng.uniform(-80, 80)), float(rng.uniform(-180, 180))) for i in range(300)]
    pts += [(900, 40.0, 179.99), (901, None, 3.0), (902, 89.9, 10.0)]   # antimeridian, null, pole
    cents = [(j, float(rng.uniform(-60, 60)), float(rng.uniform(-180, 180))) for j in range(40)]
    cents += [(100, 40.0, -179.99), (101, 10.0, 10.0), (102, 10.0, 10.0)]   # equal distance pair
    pdf = spark.createDataFrame(pts, "pid long, lat double, lon double")
    cdf = spark.createDataFrame(cents, "aid long, lat double, lon double")
    got = {r.pid: (r.dist_km, r.aid) for r in nearest_area(pdf, cdf, "pid", "aid").collect()}
    want = _brute_nearest(pts, cents)
    assert set(got) == set(want)
    for pid, (d, aid) in want.items():
        assert got[pid][1] == aid, pid
        assert got[pid][0] == pytest.approx(d, rel=1e-9)
    assert got[900][1] == 100


def test_haversine(spark):
    d = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d")).first().d
    assert d == pytest.approx(2 * math.pi * 6371.0 / 360, rel=1e-12)


def test_lags_count_rows_not_months(spark):
    # month 3 is missing: the lag of month 4 is month 2's value
    s = spark.createDataFrame([("s", 1, 10.0), ("s", 2, 20.0), ("s", 4, 40.0), ("s", 5, None)],
                              "s string, m int, u double")
    got = {r.m: r for r in lag_features(s, "s", "m", "u", (1, 2)).collect()}
    assert got[4].u_1 == 20.0 and got[4].u_2 == 10.0
    assert got[5].u_0 == -1.0 and got[5].u_1 == 40.0   # a missing indicator value is filled


def test_nearest_area_in_one_city(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(rng.uniform(40.4, 41.0)), float(rng.uniform(-74.3, -73.6))) for i in range(400)]
    cents = [(j, float(rng.uniform(40.5, 40.9)), float(rng.uniform(-74.2, -73.7))) for j in range(60)]
    pdf = spark.createDataFrame(pts, "pid long, lat double, lon double")
    cdf = spark.createDataFrame(cents, "aid long, lat double, lon double")
    got = {r.pid: r.aid for r in nearest_area(pdf, cdf, "pid", "aid").collect()}
    want = _brute_nearest(pts, cents)
    assert got == {pid: aid for pid, (_, aid) in want.items()}
