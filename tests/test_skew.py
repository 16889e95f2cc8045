"""A key holding more than a third of the events: results stay exact and AQE
splits the hot join partition instead of giving it to one task."""

import pytest
from pyspark.sql import functions as F

from covary.operators import category_screen, period_counts

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",          # force a shuffle join
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_key_join_is_split_and_exact(spark, skew_conf):
    n = 30000
    # part key 0 holds 40% of the events
    ev = spark.range(n).select(
        F.when(F.col("id") % 5 < 2, F.lit(0)).otherwise(F.col("id") % 97).alias("l_partkey"),
        (F.col("id") % 12 + 1).alias("month"),
        F.when(F.col("id") % 3 == 0, "R").otherwise("N").alias("flag"))
    part = spark.range(97).select(F.col("id").alias("p_partkey"),
                                  F.concat(F.lit("B"), (F.col("id") % 4).cast("string")).alias("brand"))
    counts = period_counts(ev.join(part, ev.l_partkey == part.p_partkey), ["brand", "month", "flag"], "n")
    rows = counts.collect()
    final = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin(skew=true)" in final and "AQEShuffleRead skewed" in final
    assert sum(r.n for r in rows) == n
    # the same counts computed without a join, from the brand rule
    want = (ev.withColumn("brand", F.concat(F.lit("B"), (F.col("l_partkey") % 4).cast("string")))
              .groupBy("brand", "month", "flag").count().collect())
    assert sorted((r.brand, r.month, r.flag, r["count"]) for r in want) == \
        sorted((r.brand, r.month, r.flag, r.n) for r in rows)


def test_screen_exact_with_a_dominant_group(spark, skew_conf):
    # group 'hot' has 60% of the events; the screen's result does not depend on it
    ev = spark.range(6000).select(
        F.when(F.col("id") % 10 < 6, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 3).cast("string"))).alias("grp"),
        (F.col("id") % 9).alias("month"),
        F.when(F.col("id") % 7 < 3, "a").otherwise("b").alias("d1"))
    a = {(r.grp, r.category): r.p_value for r in
         category_screen(ev, "grp", "month", ["d1"], top=None, max_p=None).collect()}
    b = {(r.grp, r.category): r.p_value for r in
         category_screen(ev.repartition(7, "grp"), "grp", "month", ["d1"], top=None, max_p=None).collect()}
    assert a.keys() == b.keys() and len(a) == 8
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-12)
