"""Plan-shape guards: no nested-loop or cartesian joins, one pass over facts."""

import re

import pytest
from pyspark.sql import functions as F

from covary.operators import category_screen, lag_forecast
from covary.plans import fixtures as fx
from covary.plans import queries
from tests.conftest import SF001

NAMES = list(queries())


@pytest.mark.parametrize("name", NAMES)
def test_no_nested_loop_or_cartesian(spark, name):
    plan = queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def _final_plan(df):
    df.collect()   # runs the DataFrame's own query execution (a write would plan a new one)
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def _lineitem_scans(plan):
    return [s for s in re.findall(r"FileScan parquet \[([^\]]*)\]", plan) if "l_partkey" in s]


@pytest.mark.parametrize("name", ["semi_keep_top", "top_group_series", "top_areas_per_code", "hotspot_areas"])
def test_facts_scanned_once(spark, name):
    final = _final_plan(queries()[name](spark, SF001))
    assert len(_lineitem_scans(final)) == 1
    assert "ReusedExchange" in final


def test_screen_needs_no_join_and_two_exchanges(spark):
    """After the facts are joined to their parts: the cells' own shuffle and
    one by group, with every later step in that partitioning."""
    keys = fx.fact_a(spark, SF001).select("p_brand", F.month("l_shipdate").alias("period"), *fx.DIMS_A)
    final = _final_plan(category_screen(keys, "p_brand", "period", fx.DIMS_A, top=10, max_p=None))
    above = final[:final.index("Join")]
    assert len(_lineitem_scans(final)) == 1 and final.count("Join") == 1
    assert len(re.findall(r"\+- Exchange ", above)) <= 3, above
    # the shuffled count is by one category at a time, not by their combinations
    assert re.search(r"Exchange hashpartitioning\(p_brand#\d+, period#\d+, dimension#\d+, category#\d+", above)
    counts = _final_plan(queries()["category_counts"](spark, SF001))
    assert len(_lineitem_scans(counts)) == 1 and counts.count("Join") == 1


def test_forecast_is_native_and_in_one_pass(spark):
    df = spark.range(200).selectExpr("id % 5 AS s", "id AS t", "rand(1) AS y", "rand(2) AS a", "rand(3) AS b")
    final = _final_plan(lag_forecast(df, "s", "t", "y", ["a", "b"]))
    assert "Python" not in final and "InPandas" not in final and "Join" not in final
    assert len(re.findall(r"\+- (?:Exchange|ShuffleQueryStage)", final)) <= 2 and final.count("Exchange hashpartitioning") == 1


def test_filters_and_columns_reach_the_scan(spark):
    final = _final_plan(queries()["flag_corr_by_bucket"](spark, SF001))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_linestatus,F\)", final)
    cols = re.search(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem", final).group(1)
    assert set(re.sub(r"#\d+L?", "", cols).split(",")) == {"l_linestatus", "l_shipdate"}


def test_events_combined_map_side(spark):
    # a hot key costs one partial row per task: the count is split into
    # partial (before the shuffle) and final aggregates
    keys = fx.fact_a(spark, SF001).select("p_brand", F.month("l_shipdate").alias("period"), *fx.DIMS_A)
    final = _final_plan(category_screen(keys, "p_brand", "period", fx.DIMS_A))
    partial = [ln for ln in final.split("\n")
               if "HashAggregate(keys=" in ln and "partial_count" in ln and "category" in ln]
    assert partial, "the event counts should have a map-side partial aggregate"
