"""Algorithms that the operators rest on, against plain versions of them."""

import math
import random
from decimal import Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from covary.functions import distinct_names, t_cdf, t_two_sided_p
from covary.operators import guarded_join, is_small, keep_top, lag_forecast, nearest_area, pivot_counts, range_join, wide
from covary.operators import with_indicator, with_line_number, with_position
from covary.operators import enrich
from covary.sources import ingest

# -- Student-t ---------------------------------------------------------------


def exact_tail(t, v):
    """P(|T| >= t) for even v, from the finite series in 700 digits."""
    with localcontext() as ctx:
        ctx.prec = 700
        t, v = Decimal(repr(t)), Decimal(v)
        c2 = v / (v + t * t)
        term = total = Decimal(1)
        for i in range(1, int(v) // 2):
            term *= c2 * (2 * i - 1) / (2 * i)
            total += term
        return float(1 - t / (v + t * t).sqrt() * total)


def integrated_tail(t, v):
    """The same for very many degrees of freedom, by integrating the density."""
    x, w = np.polynomial.legendre.leggauss(300)
    width = min(40.0, 45 / max(t, 1.0))
    s = t + (x + 1) * width / 2
    constant = (1 - 1 / (4 * v) + 1 / (32 * v * v)) / math.sqrt(2 * math.pi)
    at = constant * np.exp(-(v + 1) / 2 * (np.log1p(s * s / v) - math.log1p(t * t / v)))
    return 2 * float((at * w).sum()) * width / 2 * math.exp(-(v + 1) / 2 * math.log1p(t * t / v))


def test_t_tail_keeps_its_digits(spark):
    cases = [(t, v, exact_tail(t, v)) for v in (2, 4, 10, 60, 400) for t in
             (1e-3, 0.5, 1.7, 1.7321, 1.75, 2.0, 5.0, 12.0, 37.0, 1e4, 1e20) if exact_tail(t, v) > 1e-300]
    cases += [(t, v, integrated_tail(t, v)) for v in (10 ** 6, 10 ** 9) for t in (1.0, 1.7, 1.8, 3.0, 10.0, 36.0)]
    cases += [(t, 1, 2 / math.pi * math.atan2(1, t)) for t in (0.1, 1.0, 1.8, 1e3, 1e100, 1e200, 1e299)]
    df = spark.createDataFrame([(t, v) for t, v, _ in cases], "t double, v long")
    got = {(r.t, r.v): r.p for r in df.select("t", "v", t_two_sided_p("t", "v").alias("p")).collect()}
    for t, v, p in cases:
        assert got[t, v] == pytest.approx(p, rel=1e-10), (t, v)
    assert min(p for *_, p in cases) < 1e-280


def test_t_cost_does_not_grow_with_freedom(spark):
    df = spark.createDataFrame([(2.0, 2_000_000), (-2.0, 2_000_000), (0.0, 7), (None, 7), (1.0, 0)], "t double, v long")
    got = [r.c for r in df.select(t_cdf("t", "v").alias("c")).collect()]
    assert got[0] == pytest.approx(0.97724987, abs=1e-6) and got[0] + got[1] == pytest.approx(1) and got[2:] == [0.5, None, None]


# -- forecast ----------------------------------------------------------------

def test_forecast_singular_designs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s, kind in enumerate(("twice", "constant", "sum", "few", "zero")):
        for t in range(4 if kind == "few" else 40):
            a, b = rng.normal(size=2)
            c = {"twice": 2 * a, "constant": 5.0, "sum": a - b, "few": rng.normal(), "zero": 0.0}[kind]
            y = 3.0 if kind == "zero" else 1 + 2 * a - b + 0.1 * rng.normal()
            rows.append((s, t, float(y), float(a), float(b), float(c)))
    df = spark.createDataFrame(rows, "s int, t int, y double, a double, b double, c double")
    got = {r.s: r for r in lag_forecast(df, "s", "t", "y", ["a", "b", "c"]).collect()}
    for s in range(5):
        d = [r for r in rows if r[0] == s]
        cut = math.floor(len(d) * 0.8)
        x, y = np.array([[1.0, *r[3:]] for r in d]), np.array([r[2] for r in d])
        beta = np.array([got[s].b_intercept, got[s].b_a, got[s].b_b, got[s].b_c])
        best, *_ = np.linalg.lstsq(x[:cut], y[:cut], rcond=None)
        # other coefficients may fit a singular design as well, but none better
        assert x[:cut] @ beta == pytest.approx(x[:cut] @ best, abs=1e-6)
        assert got[s].mse == pytest.approx(float(np.mean((x[cut:] @ beta - y[cut:]) ** 2)), rel=1e-6, abs=1e-12)
    assert got[1].b_c == 0.0 and got[4].b_c == 0.0 and 0.0 in (got[0].b_a, got[0].b_c)
    assert 0.0 in (got[2].b_a, got[2].b_b, got[2].b_c)


# -- nearest area ------------------------------------------------------------

def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, lat double, lon double")


def far_and_dense():
    rng = np.random.default_rng(9)
    cents = [(j, 40.7 + float(rng.normal()) * 0.05, -74.0 + float(rng.normal()) * 0.05) for j in range(800)]
    pts = [(i, float(rng.normal()) * 0.01, float(rng.normal()) * 0.01) for i in range(1500)]
    pts += [(2000 + i, 40.7 + float(rng.normal()) * 0.08, -74.0 + float(rng.normal()) * 0.08) for i in range(500)]
    return pts, cents


def test_nearest_meets_few_centroids(spark):
    """1,500 points near (0, 0) and 500 in the city, 800 centroids in the city."""
    pts, cents = far_and_dense()
    got = {r.p: r.a for r in nearest_area(frame(spark, pts, "p"), frame(spark, cents, "a"), "p", "a").collect()}
    c = np.radians(np.array([r[1:] for r in cents]))
    for key, lat, lon in pts:
        la, lo = math.radians(lat), math.radians(lon)
        d = np.sin((c[:, 0] - la) / 2) ** 2 + math.cos(la) * np.cos(c[:, 0]) * np.sin((c[:, 1] - lo) / 2) ** 2
        assert got[key] == cents[int(d.argmin())][0]
    here = ["__plat", "__plon"]
    cen = frame(spark, cents, "a").select("a", F.col("lat").alias("__clat"), F.col("lon").alias("__clon"))
    cen = cen.withColumns(dict(zip(("__x", "__y", "__z"), enrich._on_sphere("__clat", "__clon"))))
    cells, depth = enrich._pyramid(cen)
    at = frame(spark, pts, "p").select(F.col("lat").alias("__plat"), F.col("lon").alias("__plon"))
    at = at.withColumns(dict(zip(("__px", "__py", "__pz"), enrich._on_sphere(*here))))
    found = enrich.nearest_candidates(at, cells, depth, here)
    last = cells.filter(F.col("level") == depth).select("cell", "n")
    met = found.select(*here, F.explode("cells").alias("cell")).join(last, "cell").groupBy(*here).agg(F.sum("n").alias("n"))
    most, mean = met.agg(F.max("n"), F.avg("n")).first()
    assert met.count() == 2000 and most <= 64 and mean <= 20, (most, mean)


def test_nearest_without_areas_or_points(spark):
    some, none = frame(spark, [(1, 1.0, 1.0)], "p"), frame(spark, [], "a")
    assert nearest_area(some, none, "p", "a").count() == 0
    assert nearest_area(frame(spark, [], "p"), frame(spark, [(1, 0.0, 0.0)], "a"), "p", "a").count() == 0
    same = frame(spark, [(k, 10.0, 10.0) for k in range(50)], "a")       # more than a cell's worth at one place
    assert [tuple(r)[:2] for r in nearest_area(some, same, "p", "a").collect()] == [(1, 0)]


# -- range table -------------------------------------------------------------

@pytest.mark.parametrize("closed", [(True, True), (False, True), (True, False), (False, False)])
def test_range_join_equals_all_pairs(spark, closed):
    rng = random.Random(6)
    ranges = [(i, float(a), float(a + rng.choice([0, 0, 1, 3, 7.5, 64, 1000, 1e6]))) for i, a in
              enumerate(rng.choices([-1e9, -8, -1, 0, 0.5, 3, 63, 64, 1e12], k=60))]
    inf, nan = float("inf"), float("nan")
    ranges += [(100, -inf, 3.0), (101, 0.0, inf), (102, -inf, inf), (103, 5.0, 4.0), (104, None, 4.0), (105, 1.0, None), (106, nan, 1.0),
               (107, -1e300, 1e300), (107, -1e300, 1e300)]
    codes = [(i, float(v)) for i, v in enumerate([-1e9, -8, -7.9, -1, 0, 0.25, 0.5, 1, 3, 4, 10.5, 63, 64, 65, 1e6, 1e12, 1e12 + 1, 1e300])]
    codes += [(50, None), (51, nan), (52, inf)]
    got = sorted(map(tuple, range_join(spark.createDataFrame(codes, "id int, code double"), spark.createDataFrame(
        ranges, "r int, lo double, hi double"), "code", closed=closed).select("id", "r").collect()))
    ok = lambda x, a, b: (x >= a if closed[0] else x > a) and (x <= b if closed[1] else x < b)
    want = sorted((i, r) for i, x in codes if x is not None and x == x for r, a, b in ranges
                  if a is not None and b is not None and a == a and a <= b and ok(x, a, b))
    assert got == want


def test_range_join_of_empty_tables_and_plan(spark):
    none = spark.createDataFrame([], "r int, lo double, hi double")
    some = spark.createDataFrame([(1, 2.0)], "id int, code double")
    assert range_join(some, none, "code").count() == 0
    assert range_join(some.filter("id = 2"), spark.createDataFrame([(1, 1.0, 3.0)], "r int, lo double, hi double"), "code").count() == 0
    many = spark.range(5000).selectExpr("id", "id * 3.0D AS lo", "id * 3.0D + id % 9 AS hi")
    df = range_join(spark.range(1000).selectExpr("id AS c", "id * 1.5D AS code"), many, "code")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert df.count() == sum(1 for c in range(1000) for i in range(5000) if i * 3 <= c * 1.5 <= i * 3 + i % 9)


# -- pivot -------------------------------------------------------------------

def test_pivot_takes_any_label(spark):
    df = spark.createDataFrame([(1, "Theft"), (1, "THEFT"), (1, None), (2, "(null)"), (2, "period"), (2, "a.b `c`"), (None, "Theft")],
                               "period int, kind string")
    got = pivot_counts(df, "period", "kind")
    assert got.columns == ["period", "(null)", "(null)_2", "THEFT", "Theft_2", "a.b `c`", "period_2"]
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 1, 0, 1, 1, 0, 0), (2, 0, 1, 0, 0, 1, 1), (None, 0, 0, 0, 1, 0, 0)]
    assert pivot_counts(df, "period", "kind", values=["THEFT", "none"]).columns == ["period", "THEFT", "none"]
    with pytest.raises(ValueError, match="6 categories"):
        pivot_counts(df, "period", "kind", most=5)
    assert pivot_counts(df.filter("period = 7"), "period", "kind").count() == 0
    assert distinct_names(["a", "A", "a_2", "A"]) == ["a", "A_2", "a_2_2", "A_3"]
    assert wide(df.selectExpr("period", "kind", "2 AS v"), "period", "kind", "v", fill=None).filter("period = 1").first()["period_2"] is None


# -- positions ---------------------------------------------------------------

def test_positions_over_many_partitions(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 400), i) for i in range(3000)] + [(None, 5000)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(13)
    got = with_position(df, ["k", F.col("v").desc()], "pos").collect()
    want = {r: i for i, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1])))}
    assert {(r.k, r.v): r.pos for r in got} == want
    assert with_position(df.filter("v < 0"), ["k"]).count() == 0
    assert sorted(r.rank for r in with_position(df.select(F.lit(1).alias("same")), ["same"], "rank", start=1).collect()) == list(range(1, 3002))


def test_line_numbers_over_splits(spark, tmp_path):
    for f in ("b", "a"):
        (tmp_path / f"{f}.csv").write_text("".join(f"{f}{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = with_line_number(spark.read.schema("v string").csv(str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.v: r.line for r in got} == {f"{f}{i}": i + (20_000 if f == "b" else 0) for f in "ab" for i in range(20_000)}


# -- measured broadcast --------------------------------------------------------

def test_guard_measures_before_it_broadcasts(spark):
    left = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).repartition(4)
    want = sorted((7 if i % 3 == 0 else i, i) for i in range(4000) if i % 3 == 0 or i < 500)
    for limit, broadcast in ((1 << 20, True), (100, False)):
        out = guarded_join(left, right, ["k"], limit=limit)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == broadcast
        assert sorted((r.k, r.v) for r in out.collect()) == want
        outer = guarded_join(left, right, ["k"], "left", limit=limit)
        assert outer.count() == 4000 and outer.filter("w IS NULL").count() == 4000 - len(want)
    assert not is_small(right, 100) and is_small(right)


def test_operators_use_the_guard(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, m int")
    top = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    ind = spark.createDataFrame([(1, 0.5), (3, 0.7)], "m int, rate double")
    plans = []
    for limit in (32 << 20, 0):
        monkeypatch.setattr("covary.operators.sized.BROADCAST_BYTES", limit)
        kept, joined = keep_top(df, top, "k"), with_indicator(df, ind, "m", fill=-1.0, broadcast=True)
        assert sorted(r.m for r in kept.collect()) == [1, 2]
        assert {r.m: r.rate for r in joined.collect()} == {1: 0.5, 2: -1.0, 3: 0.7}
        plans.append(["strategy=broadcast" in x._jdf.queryExecution().optimizedPlan().toString() for x in (kept, joined)])
    assert plans == [[True, True], [False, False]]


# -- broken lines --------------------------------------------------------------

def test_ingest_parts_good_from_broken(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "1.json").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b"\n{"a": "no", "b": "y"}\n')
    (raw / "2.json").write_text('nothing here\n{"a": 3}\n')
    got = ingest(spark, str(raw), "a long, b string", str(tmp_path / "out"))
    assert (got.rows, got.bad) == (5, 3) and got.good.columns == ["a", "b"]
    assert sorted(tuple(r) for r in got.good.collect()) == [(1, "x"), (3, None)]
    assert {(r.line, r.file[-6:]) for r in got.quarantine.collect()} == {
        ('{"a": 2, "b"', "1.json"), ('{"a": "no", "b": "y"}', "1.json"), ("nothing here", "2.json")}
    assert got.good.select("b").count() == 2


def test_ingest_csv_and_extremes(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text("a,b,c\n1,x,2.5\n2,y,bad\nz,q,1\n3,w,\n")
    got = ingest(spark, str(raw), "a int, b string, c double", str(tmp_path / "o1"), "csv")
    assert (got.rows, got.bad) == (4, 2) and sorted(r.a for r in got.good.select("a").collect()) == [1, 3]
    raw.write_text("a,b\nx,1\n")
    got = ingest(spark, str(raw), "a int, b int", str(tmp_path / "o2"), "csv")
    assert (got.rows, got.bad, got.good.count()) == (1, 1, 0)
    raw.write_text("a,b\n")
    got = ingest(spark, str(raw), "a int, b int", str(tmp_path / "o3"), "csv")
    assert (got.rows, got.bad, got.good.count(), got.quarantine.count()) == (0, 0, 0, 0)
