"""Ordinary but awkward input: NULL and repeated keys, dots in names, empty
groups, fractional bounds, very large counts."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from covary.operators import (
    category_map,
    code_ranges,
    elastic_net_1d,
    lag_forecast,
    moments,
    nearest_area,
    pivot_counts,
    slope_test,
    zero_filled_moments,
)
from covary.operators.counts import zero_filled_cells
from covary.operators.enrich import EARTH_RADIUS_KM
from covary.plans.fixtures import exact_mean
from covary.session import materialize


def test_group_without_pairs_is_not_testable(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 2.0)] + [("b", float(i), 2.0 * i + i % 3) for i in range(9)],
                               "g string, x double, y double")
    got = {r.g: r for r in slope_test(elastic_net_1d(moments(df, "g", "x", "y"))).collect()}
    assert got["a"].verdict == "not testable" and got["a"].rss is None and got["a"].n == 0
    assert got["b"].verdict != "not testable"
    none = slope_test(elastic_net_1d(moments(df.filter("g = 'c'"), None, "x", "y"))).first()
    assert none.verdict == "not testable"


def test_perfect_fit_rejects(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i) for i in range(8)], "x double, y double")
    r = slope_test(elastic_net_1d(moments(df, None, "x", "y"), reg=0.0, mix=0.0)).first()
    assert r.rss == 0.0 and r.p_value == 0.0 and r.significant and r.verdict == "reject null"


@pytest.mark.parametrize("center", [False, True])
def test_large_counts_keep_their_digits(spark, center):
    cells = [(p, 500_000_000 + (p * 7919) % 22_361 - 11_180) for p in range(83)]
    totals = [(p, 4 * n + (p * 104_729) % 40_009) for p, n in cells]
    dense = spark.createDataFrame(totals, "p long, d long")
    sparse = spark.createDataFrame([("c", p, n) for p, n in cells], "c string, p long, s long")
    r = zero_filled_moments(dense, sparse, None, "p", "c", "d", "s", center=center).first()
    n = len(cells)
    mx, my = Fraction(sum(x for _, x in cells), n), Fraction(sum(y for _, y in totals), n)
    sxx = sum((x - mx) ** 2 for _, x in cells)
    sxy = sum((x - mx) * (y - my) for (_, x), (_, y) in zip(cells, totals))
    syy = sum((y - my) ** 2 for _, y in totals)
    limit = 1e-12 if not center else 1e-9
    for got, want in ((r.sxx, sxx), (r.sxy, sxy), (r.syy, syy)):
        assert abs(got - float(want)) <= limit * float(want)


def km(a, b):
    (y1, x1), (y2, x2) = [(math.radians(p[0]), math.radians(p[1])) for p in (a, b)]
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * math.asin(min(1.0, math.sqrt(h)))


def test_nearest_area_by_row_not_by_key(spark):
    rows = [(1, 40.0, -73.0), (1, 40.0, -75.0), (None, 10.0, 10.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, None, 1.0),
            (5, float("nan"), 1.0), (6, -0.0, 0.0)]
    areas = [(k, 40.0 + k * 1e-4, -73.0 - k * 1e-4) for k in range(100)] + [(900, 39.9, -75.1)]
    got = nearest_area(spark.createDataFrame(rows, "k long, lat double, lon double"),
                       spark.createDataFrame(areas, "a long, lat double, lon double"), "k", "a").collect()
    want = sorted(((r[0], min((km(r[1:], a[1:]), a[0]) for a in areas)) for r in rows
                   if r[1] is not None and r[1] == r[1]), key=repr)
    assert len(got) == len(want) == 6
    for g, (k, (d, a)) in zip(sorted(got, key=lambda r: repr((r.k, (r.dist_km, r.a)))), want):
        assert g.k == k and g.dist_km == pytest.approx(d, abs=1e-6)


def test_code_ranges_keep_fractions(spark):
    df = spark.createDataFrame([(1.2,), (1.5,), (2.4,), (2.5,), (2.6,)], "c double")
    got = sorted((r.c, r.range_label) for r in code_ranges(df, "c", [(1.5, 2.5)]).collect())
    assert got == [(1.5, "1.5-2.5"), (2.4, "1.5-2.5"), (2.5, "1.5-2.5")]


def test_null_and_its_label_stay_apart(spark):
    df = spark.createDataFrame([("g", 1, "d", None, 2, 5), ("g", 1, "d", "(null)", 3, 5), ("g", 1, "d:x", "y", 1, 5),
                                ("g", 1, "d", "x:y", 1, 5)],
                               "g string, p int, dimension string, category string, n long, total long")
    m = category_map(df, "g", "p").first()["counts"]
    assert len(m) == 5 and m["d:(null)"] == 2 and sorted(m.values()) == [1, 1, 2, 3, 5]
    wide = pivot_counts(spark.createDataFrame([(1, None), (1, "(null)"), (1, "F.C.A. X"), (2, "F.C.A. X")],
                                              "p int, c string"), "p", "c")
    got = {r["p"]: r.asDict() for r in wide.collect()}
    assert got[1] == {"p": 1, "(null)": 1, "(null)_2": 1, "F.C.A. X": 1}
    assert got[2] == {"p": 2, "(null)": 0, "(null)_2": 0, "F.C.A. X": 1}


def test_zero_filled_cells_need_no_pivot(spark):
    cells = spark.createDataFrame([(1, "a.b", 2), (2, None, 3), (3, "c", 4)], "p int, c string, n long")
    got = sorted(map(tuple, zero_filled_cells(cells, "p", "c", "n").collect()), key=repr)
    assert len(got) == 9 and sum(r[2] for r in got) == 9 and (2, None, 3) in got and (1, None, 0) in got


def test_forecast_keeps_every_series(spark):
    rows = [(None, t, float(t), float(t % 3)) for t in range(10)] + [("s", t, 2.0 * t, float(t)) for t in range(10)]
    rows += [("one", 0, 1.0, 1.0)] + [("s", 10, None, 4.0)]
    df = spark.createDataFrame(rows, "g string, t int, y double, u double")
    got = {r.g: r for r in lag_forecast(df, "g", "t", "y", ["u"], 0.8).collect()}
    assert set(got) == {None, "s", "one"}
    assert got[None].n_test == 2 and got[None].mse is not None
    assert got["s"].n_train == 8 and got["s"].n_test == 2 and got["s"].mse == pytest.approx(0.0, abs=1e-12)
    assert got["one"].n_train == 0 and got["one"].b_u is None and got["one"].mse is None


def test_mean_of_what_is_there(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.005), ("b", None)], "g string, v double")
    got = {r.g: r.m for r in df.groupBy("g").agg(exact_mean("v").alias("m")).collect()}
    assert got == {"a": pytest.approx(2.0025), "b": None}


def test_materialize_keeps_the_callers_cache(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2).cache()
    df.count()
    assert materialize(df).count() == 10
    assert df.storageLevel.useMemory
    df.unpersist()
