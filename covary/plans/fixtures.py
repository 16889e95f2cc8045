"""Stand-ins for the reference's inputs, derived from the driver tables.

* fact A (events with three demographic-like dimensions): ``lineitem``
  joined with ``part``; group = ``p_brand``, date = ``l_shipdate``,
  dimensions = ``l_returnflag, l_linestatus, p_type``; area = supplier nation.
* fact B (events with one category): ``orders``; category =
  ``o_orderpriority``, date = ``o_orderdate``.
* monthly indicator: mean order price per month of ``o_orderdate``.
* yearly panel: share of the orders of a year per bucket (first character
  of ``o_orderpriority``).
* area attribute: mean customer balance per nation.

Money columns carry two decimals; their sums are taken in DECIMAL, so the
indicator values do not depend on the order in which rows are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covary.functions.keys import month_start, safe_int

DIMS_A = ["l_returnflag", "l_linestatus", "p_type"]


_TABLES: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the scan DataFrame is reused within a session so its
    file listing and footer reading happen once."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), spark.sparkContext.applicationId, path)
    df = _TABLES.get(key)
    if df is None:
        df = _TABLES[key] = spark.read.parquet(path)
    return df


def exact_mean(col: str) -> F.Column:
    """Mean of the values that are not NULL, summed exactly (DECIMAL with
    eight decimals, beyond what money carries)."""
    return F.try_divide(F.sum(F.col(col).cast("decimal(26,8)")).cast("double"), F.count(F.col(col)))


def fact_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    return li.join(part, li.l_partkey == part.p_partkey, "inner")


def fact_a_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    fa = fact_a(spark, sf_dir)
    return fa.join(sup, fa.l_suppkey == sup.s_suppkey, "inner")


def fact_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def monthly_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(period DATE, indicator DOUBLE): one row per month with orders."""
    return (fact_b(spark, sf_dir)
            .groupBy(month_start("o_orderdate").alias("period"))
            .agg(exact_mean("o_totalprice").alias("indicator")))


def ship_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(period DATE, indicator DOUBLE): mean line price per *ship* month, a
    calendar that reaches beyond that of the orders."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy(month_start("l_shipdate").alias("period"))
            .agg(exact_mean("l_extendedprice").alias("indicator")))


def yearly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year INT, bucket INT, share DOUBLE)."""
    counts = (fact_b(spark, sf_dir)
              .groupBy(F.year("o_orderdate").alias("year"),
                       safe_int(F.substring("o_orderpriority", 1, 1)).alias("bucket"))
              .agg(F.count(F.lit(1)).alias("n")))
    return counts.select("year", "bucket",
                         (F.col("n") / F.sum("n").over(Window.partitionBy("year"))).alias("share"))


def area_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(area INT, cost DOUBLE): mean customer balance per nation."""
    return (table(spark, sf_dir, "customer")
            .groupBy(F.col("c_nationkey").alias("area"))
            .agg(exact_mean("c_acctbal").alias("cost")))


# DuckDB relations of the same stand-ins (used inside WITH clauses).
SQL_FACT_A = "lineitem JOIN part ON l_partkey = p_partkey"
SQL_FACT_A_AREAS = SQL_FACT_A + " JOIN supplier ON l_suppkey = s_suppkey"
SQL_IND = ("ind AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, "
           "CAST(SUM(CAST(o_totalprice AS DECIMAL(26,8))) AS DOUBLE) / COUNT(o_totalprice) AS indicator "
           "FROM orders GROUP BY 1)")
SQL_SHIP_IND = ("ind AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, "
                "CAST(SUM(CAST(l_extendedprice AS DECIMAL(26,8))) AS DOUBLE) / COUNT(l_extendedprice) AS indicator "
                "FROM lineitem GROUP BY 1)")
SQL_PANEL = ("panel AS (SELECT year, bucket, n / SUM(n) OVER (PARTITION BY year) AS share FROM "
             "(SELECT CAST(year(o_orderdate) AS INTEGER) AS year, "
             "TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS bucket, COUNT(*) AS n "
             "FROM orders GROUP BY 1, 2))")
SQL_AREA = ("area_cost AS (SELECT c_nationkey AS area, "
            "CAST(SUM(CAST(c_acctbal AS DECIMAL(26,8))) AS DOUBLE) / COUNT(c_acctbal) AS cost "
            "FROM customer GROUP BY 1)")
