"""Readers and writers: JSON-lines shards, CSV indicators, unions, JSON fields."""

import os
import tempfile

from pyspark.sql import functions as F

from covary.sources import (
    parse_json_column,
    read_events,
    read_indicator,
    union_all,
    write_table,
)
from tests.conftest import SF001


def _scratch():
    return tempfile.mkdtemp(prefix="covary-test-")


def test_json_shards_one_scan_with_bad_line(spark):
    orders = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey", "o_orderpriority")
    base = _scratch()
    paths = []
    for i, pri in enumerate(["1-URGENT", "2-HIGH"]):
        p = os.path.join(base, f"shard{i}")
        write_table(orders.filter(F.col("o_orderpriority") == pri), p, "json")
        paths.append(p)
    bad = os.path.join(base, "bad")
    os.makedirs(bad)
    with open(os.path.join(bad, "part-bad.json"), "w") as fh:
        fh.write('{"o_orderkey": 1, "o_orderpriority": "X"}\nnot json\n')
    paths.append(bad)
    schema = "o_orderkey long, o_orderpriority string, _corrupt string"
    # Spark refuses queries on a raw scan that read only the corrupt column: parse once
    ev = read_events(spark, paths, schema, "json", corrupt_column="_corrupt").cache()
    want = orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).count()
    assert ev.filter(F.col("_corrupt").isNull()).count() == want + 1
    assert ev.filter(F.col("_corrupt").isNotNull()).count() == 1


def test_csv_indicator_typed(spark):
    base = _scratch()
    path = os.path.join(base, "ind.csv")
    with open(path, "w") as fh:
        fh.write("Year,Period,Value\n2011,M01,9.1\n2011,M02,8.8\n")
    ind = read_indicator(spark, path, "year int, period string, value double")
    assert [tuple(r) for r in ind.orderBy("period").collect()] == [(2011, "M01", 9.1), (2011, "M02", 8.8)]
    renamed = read_indicator(spark, path, "a int, b string, c double", columns=["y", "p", "u"])
    assert renamed.columns == ["y", "p", "u"]


def test_union_by_name_and_json_column(spark):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, id int")
    assert sorted(tuple(r) for r in union_all([a, b]).collect()) == [(1, "x"), (2, "y")]
    ev = spark.createDataFrame([('{"k": 69}',), ("oops",), (None,)], "props string")
    ks = [r.k for r in ev.select(parse_json_column("props", "k INT").alias("p")).select("p.k").collect()]
    assert ks == [69, None, None]
