"""Scalar expressions: t distribution, keys, parsing, codes, names, index."""

import math

import pytest
from pyspark.sql import functions as F

from covary.functions import (
    month_from_position,
    month_start,
    parse_timestamp,
    period_number,
    safe_int,
    sanitize_columns,
    sanitized_names,
    split_date_key,
    t_cdf,
    t_two_sided_p,
    timestamp_text,
    weighted_index,
    zero_pad,
)

# Known two-sided tail probabilities of Student-t (t, dof, p).
T_TABLE = [
    (2.0, 10, 0.07338803477074),
    (1.0, 1, 0.5),
    (12.706204736174707, 1, 0.05),
    (4.302652729749464, 2, 0.05),
    (3.182446305284263, 3, 0.05),
    (2.2621571628540, 9, 0.05),
    (2.0, 2, 0.1835034190722739),
    (0.0, 7, 1.0),
    (1.959963984540054, 5000, 0.0500554632),
]


def test_t_two_sided_known_values(spark):
    df = spark.createDataFrame([(t, v) for t, v, _ in T_TABLE], "t double, v long")
    got = df.select(t_two_sided_p("t", "v").alias("p")).collect()
    for (t, v, want), row in zip(T_TABLE, got):
        assert row.p == pytest.approx(want, abs=2e-9), (t, v)


def test_t_cdf_symmetry_and_untestable(spark):
    df = spark.createDataFrame([(1.7, 6), (-1.7, 6), (3.0, 0), (None, 5)], "t double, v long")
    c = [r.c for r in df.select(t_cdf("t", "v").alias("c")).collect()]
    assert c[0] + c[1] == pytest.approx(1.0, abs=1e-15)
    assert c[2] is None and c[3] is None
    p = [r.p for r in df.select(t_two_sided_p("t", "v").alias("p")).collect()]
    assert p[2] is None and p[3] is None


def test_t_matches_normal_limit(spark):
    df = spark.createDataFrame([(1.0, 20001)], "t double, v long")
    p = df.select(t_two_sided_p("t", "v").alias("p")).first().p
    assert p == pytest.approx(math.erfc(1 / math.sqrt(2)), abs=2e-5)


def test_dates_keys_and_parsing(spark):
    df = spark.createDataFrame(
        [("01/05/2011",), ("01/05/2011 03:04:05 PM",), ("2011 Jan",), ("junk",), (None,)], "d string")
    out = df.select(
        split_date_key("d", "/", (2, 0)).alias("ym"),
        timestamp_text(parse_timestamp("d", "MM/dd/yyyy hh:mm:ss a")).alias("ts"),
        timestamp_text(parse_timestamp("d", "yyyy MMM")).alias("lab")).collect()
    assert out[0].ym == "2011-01"
    assert out[1].ts == "2011-01-05 15:04:05"
    assert out[2].lab == "2011-01-01 00:00:00"
    assert out[3].ym is None and out[3].ts is None   # a missing part gives NULL, not an error
    assert out[4].ym is None


def test_month_start_and_position(spark):
    df = spark.createDataFrame([(0,), (11,), (12,), (25,)], "pos int")
    assert [r.m for r in df.select(month_from_position("pos").alias("m")).collect()] == [1, 12, 1, 2]
    d = spark.sql("select timestamp_ntz'2011-03-17 10:00:00' as t").select(month_start("t").alias("m")).first().m
    assert str(d) == "2011-03-01"


def test_codes_and_periods(spark):
    df = spark.createDataFrame([("0460",), ("143A",), ("",), (None,), ("M07",)], "code string")
    out = df.select(safe_int("code").alias("c"), period_number("code").alias("p")).collect()
    assert [r.c for r in out] == [460, None, None, None, None]
    assert out[4].p == 7
    assert spark.range(1).select(zero_pad(F.lit(7), 2).alias("z")).first().z == "07"


def test_sanitized_names_collisions(spark):
    assert sanitized_names(["A.B", "A B", "AB", "C"]) == ["AB", "AB_2", "AB_3", "C"]
    df = spark.createDataFrame([(1, 2, 3)], "`A.B` int, `A B` int, AB int")
    assert sanitize_columns(df).columns == ["AB", "AB_2", "AB_3"]


def test_weighted_index_edges(spark):
    w = {"a": 0.15, "b": 0.4, "c": 0.7, "d": 1.0, "e": 1.5}
    df = spark.createDataFrame([(1, 1, 1, 1, 1), (0, 0, 0, 0, 0), (2, None, 0, 0, 2)],
                               "a int, b int, c int, d int, e int")
    out = [r.i for r in df.select(weighted_index(w).alias("i")).collect()]
    assert out[0] == pytest.approx((0.15 + 0.4 + 0.7 + 1 + 1.5) / 5)
    assert out[1] is None                       # all zero: no index
    assert out[2] == pytest.approx((0.3 + 3.0) / 4)   # a null count counts as 0
