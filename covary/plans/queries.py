"""The query catalog: each analysis of the reference as one Spark plan over
the driver tables, paired with a DuckDB twin written from the definitions.

Every query reads whole tables. Doubles in results are rounded -- fixed
decimals for statistics on a fixed scale (r, p, shares), 10 significant
digits for slopes, sums and other unbounded values -- and ``-0.0`` is folded
into ``0.0``, so results do not depend on the order in which partial
aggregates are combined and the two engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covary.functions import (
    month_from_position,
    month_start,
    months_since,
    parse_timestamp,
    period_number,
    safe_int,
    sanitize_columns,
    split_date_key,
    timestamp_text,
    weighted_index,
    zero_pad,
)
from covary.operators import (
    category_counts,
    category_map,
    category_screen,
    chronological_split,
    code_ranges,
    correlation_by,
    correlation_expr,
    distinct_sorted,
    elastic_net_1d,
    in_open_range,
    keep_top,
    lag_features,
    lag_forecast,
    min_max_scale,
    moments,
    nearest_area,
    ordered_series,
    period_counts,
    pivot_counts,
    range_join,
    rank_within,
    score_linear,
    slope_test,
    summary_stats,
    top_k,
    wide,
    with_indicator,
    with_line_number,
    with_position,
    zero_filled_moments,
)
from covary.operators._util import null_safe_join, rounded, rounded_sig
from covary.operators.counts import zero_filled_cells
from covary.plans import fixtures as fx
from covary.plans import sqlparts as S
from covary.session import materialize
from covary.sources import ingest, parse_json_column, read_events, read_indicator, union_all, write_table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = " ".join(sql.split())
        return fn
    return deco


def r(col: str, digits: int = 8):
    """Fixed decimals: for statistics on a fixed scale (r, p, shares)."""
    return rounded(col, digits).alias(col)


def rs(col: str, sig: int = 10):
    """Significant digits: for slopes, sums and other unbounded values."""
    return rounded_sig(col, sig).alias(col)


EPS = "2.220446049250313e-16::DOUBLE"

# --------------------------------------------------------------------------
# fact A helpers
# --------------------------------------------------------------------------

def _fact_a_keys(spark, sf):
    return fx.fact_a(spark, sf).select("p_brand", month_start("l_shipdate").alias("period"),
                                       *fx.DIMS_A)


def _brand_months(spark, sf):
    return period_counts(_fact_a_keys(spark, sf), ["p_brand", "period"], "cases")


SQL_F = (f"f AS (SELECT p_brand, {S.month('l_shipdate')} AS period, l_returnflag, l_linestatus, p_type "
         f"FROM {fx.SQL_FACT_A})")
SQL_CELLS = ("cells AS (SELECT p_brand, period, 'l_returnflag' AS dimension, CAST(l_returnflag AS VARCHAR) AS category FROM {src} "
             "UNION ALL SELECT p_brand, period, 'l_linestatus', CAST(l_linestatus AS VARCHAR) FROM {src} "
             "UNION ALL SELECT p_brand, period, 'p_type', CAST(p_type AS VARCHAR) FROM {src})")
SQL_TOP10 = ("top AS (SELECT p_brand FROM (SELECT p_brand, COUNT(*) AS total FROM f GROUP BY p_brand) "
             "ORDER BY total DESC, p_brand ASC NULLS FIRST LIMIT 10)")


# --------------------------------------------------------------------------
# flagship: category screen
# --------------------------------------------------------------------------

@query("category_screen", f"""
WITH {SQL_F}, {SQL_TOP10},
ft AS (SELECT * FROM f WHERE EXISTS (SELECT 1 FROM top WHERE top.p_brand IS NOT DISTINCT FROM f.p_brand)),
tot AS (SELECT p_brand, period, COUNT(*) AS y FROM ft GROUP BY 1, 2),
{SQL_CELLS.format(src='ft')},
cats AS (SELECT DISTINCT p_brand, dimension, category FROM cells),
xc AS (SELECT p_brand, period, dimension, category, COUNT(*) AS x FROM cells GROUP BY ALL),
grid AS (SELECT c.p_brand, t.period, c.dimension, c.category, COALESCE(xc.x, 0) AS x, t.y
  FROM cats c JOIN tot t ON t.p_brand IS NOT DISTINCT FROM c.p_brand
  LEFT JOIN xc ON xc.p_brand IS NOT DISTINCT FROM c.p_brand AND xc.period = t.period
   AND xc.dimension = c.dimension AND xc.category IS NOT DISTINCT FROM c.category),
mom AS (SELECT p_brand, dimension, category, {S.moments('y', 'x')} FROM grid GROUP BY ALL),
s0 AS (SELECT *, COUNT(*) OVER (PARTITION BY p_brand) AS k,
  COALESCE(CASE WHEN sxx <> 0 THEN sxy / sxx END, 0.0::DOUBLE) AS slope FROM mom),
s1 AS (SELECT *, greatest(0.0::DOUBLE, syy - slope * sxy) / greatest(n - 2, 1)::DOUBLE AS sse FROM s0),
s2 AS (SELECT *, slope / (sqrt(sse / (sxx + {EPS})) + {EPS}) AS t_stat FROM s1),
s3 AS (SELECT *, {S.t_cdf('t_stat', 'n - 2')} AS cdf FROM s2),
s4 AS (SELECT *, CASE WHEN slope < 0 THEN cdf * k ELSE (1.0::DOUBLE - cdf) * k END AS p_value,
  {S.corr()} AS corr FROM s3)
SELECT *, row_number() OVER (ORDER BY p_brand NULLS FIRST, p_value, corr NULLS FIRST, dimension, category NULLS FIRST) AS rank
FROM (SELECT p_brand, dimension, category, n, k, {S.rnd_sig('slope')} AS slope, {S.rnd_sig('t_stat')} AS t_stat,
  {S.rnd('p_value')} AS p_value, {S.rnd('corr')} AS corr
FROM s4 WHERE p_value < 0.05)
""")
def q_category_screen(spark, sf):
    res = category_screen(_fact_a_keys(spark, sf), "p_brand", "period", fx.DIMS_A, top=10, max_p=0.05)
    out = res.select("p_brand", "dimension", "category", "n", "k", rs("slope"), rs("t_stat"), r("p_value"), r("corr"))
    # within a group, most significant first (p, then r), as the reference reports them
    return with_position(out, ["p_brand", "p_value", "corr", "dimension", "category"], "rank", start=1)


# --------------------------------------------------------------------------
# counts, histograms, series
# --------------------------------------------------------------------------

@query("category_counts", f"""
WITH {SQL_F},
tot AS (SELECT p_brand, period, COUNT(*) AS total FROM f GROUP BY 1, 2),
{SQL_CELLS.format(src='f')}
SELECT c.p_brand, c.period, c.dimension, c.category, COUNT(*) AS n, t.total
FROM cells c JOIN tot t ON c.p_brand IS NOT DISTINCT FROM t.p_brand AND c.period = t.period
GROUP BY c.p_brand, c.period, c.dimension, c.category, t.total
""")
def q_category_counts(spark, sf):
    return category_counts(_fact_a_keys(spark, sf), "p_brand", "period", fx.DIMS_A)


@query("category_map", f"""
WITH {SQL_F},
tot AS (SELECT p_brand, period, COUNT(*) AS total FROM f GROUP BY 1, 2),
{SQL_CELLS.format(src='f')},
e AS (SELECT p_brand, period, dimension || ':' || COALESCE(category, '(null)') AS key, COUNT(*) AS value
      FROM cells GROUP BY ALL
      UNION ALL SELECT p_brand, period, 'total', total FROM tot)
SELECT p_brand, period, CAST(COUNT(*) AS INTEGER) AS n_entries,
  string_agg(key || '=' || CAST(value AS VARCHAR), ';' ORDER BY key) AS entries
FROM e GROUP BY p_brand, period
""")
def q_category_map(spark, sf):
    cc = category_counts(_fact_a_keys(spark, sf), "p_brand", "period", fx.DIMS_A)
    m = category_map(cc, "p_brand", "period")
    entries = F.array_join(F.array_sort(F.transform(
        F.map_entries("counts"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";")
    return m.select("p_brand", "period", F.size("counts").alias("n_entries"), entries.alias("entries"))


@query("ordered_series", f"""
WITH {SQL_F},
mc AS (SELECT p_brand, period, COUNT(*) AS n FROM f GROUP BY 1, 2)
SELECT p_brand, CAST(COUNT(*) AS INTEGER) AS n_periods,
  string_agg(strftime(period, '%Y-%m') || ':' || CAST(n AS VARCHAR), ',' ORDER BY period) AS series
FROM mc GROUP BY p_brand
""")
def q_ordered_series(spark, sf):
    mc = period_counts(_fact_a_keys(spark, sf), ["p_brand", "period"], "n")
    s = ordered_series(mc, "p_brand", "period", "n")
    text = F.array_join(F.transform("series", lambda e: F.concat(
        F.date_format(e["period"], "yyyy-MM"), F.lit(":"), e["n"].cast("string"))), ",")
    return s.select("p_brand", F.size("series").alias("n_periods"), text.alias("series"))


@query("period_counts", f"""
SELECT o_orderpriority AS category, {S.month('o_orderdate')} AS period, COUNT(*) AS n
FROM orders GROUP BY 1, 2
""")
def q_period_counts(spark, sf):
    fb = fx.fact_b(spark, sf)
    return period_counts(fb, [F.col("o_orderpriority").alias("category"),
                              month_start("o_orderdate").alias("period")], "n")


@query("year_month_counts", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
  COUNT(l_returnflag) AS case_count
FROM lineitem GROUP BY 1, 2
""")
def q_year_month_counts(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return period_counts(li, [F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")],
                         "case_count", count_col="l_returnflag")


@query("distinct_sorted", f"""
SELECT DISTINCT p_brand FROM {fx.SQL_FACT_A}
""")
def q_distinct_sorted(spark, sf):
    # distinct brands among the events: the part keys that occur are reduced
    # first (map-side, so a hot key becomes one row per task), then matched
    part = fx.table(spark, sf, "part")
    used = fx.table(spark, sf, "lineitem").select("l_partkey").distinct()
    seen = part.join(used, part.p_partkey == used.l_partkey, "left_semi")
    return distinct_sorted(seen, "p_brand")


@query("head_preview", """
SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_ts
FROM orders ORDER BY o_orderkey LIMIT 4
""")
def q_head_preview(spark, sf):
    fb = fx.fact_b(spark, sf)
    return (fb.select("o_orderkey", "o_orderpriority", timestamp_text("o_orderdate").alias("order_ts"))
              .orderBy("o_orderkey").limit(4))


# --------------------------------------------------------------------------
# pivot
# --------------------------------------------------------------------------

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _pivot_sql(sanitize: bool) -> str:
    cols = ", ".join(
        f"COUNT(*) FILTER (WHERE o_orderpriority = '{p}') AS \"{p.replace(' ', '').replace('.', '') if sanitize else p}\""
        for p in PRIORITIES)
    return f"SELECT {S.month('o_orderdate')} AS period, {cols} FROM orders GROUP BY 1"


def _pivoted(spark, sf):
    fb = fx.fact_b(spark, sf).select(month_start("o_orderdate").alias("period"), "o_orderpriority")
    return pivot_counts(fb, "period", "o_orderpriority")


@query("pivot_counts", f"SELECT *, row_number() OVER (ORDER BY period) AS rank FROM ({_pivot_sql(False)})")
def q_pivot_counts(spark, sf):
    return with_position(_pivoted(spark, sf), ["period"], "rank", start=1)


@query("sanitized_pivot", _pivot_sql(True))
def q_sanitized_pivot(spark, sf):
    return sanitize_columns(_pivoted(spark, sf))


#: Labels that no plain column name can be: NULL and the text for it, case
#: alone between two, dots, and the name of the period's own column.
LABELS = [None, "Theft", "THEFT", "(null)", "period", "F.C.A. x"]
LABEL_COLUMNS = {None: "(null)", "(null)": "(null)_2", "F.C.A. x": "F.C.A. x", "THEFT": "THEFT", "Theft": "Theft_2",
                 "period": "period_2"}


def _label_sql() -> str:
    label = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LABELS) if x) + " END"
    cols = ", ".join(f"COUNT(*) FILTER (WHERE l IS NOT DISTINCT FROM {'NULL' if x is None else repr(x)}) AS \"{name}\""
                     for x, name in LABEL_COLUMNS.items())
    return f"SELECT period, {cols} FROM (SELECT {S.month('o_orderdate')} AS period, {label} AS l FROM orders) GROUP BY period"


@query("labelled_pivot", _label_sql())
def q_labelled_pivot(spark, sf):
    label = F.get(F.array(*[F.lit(x).cast("string") for x in LABELS]), (F.col("o_orderkey") % 6).cast("int"))
    fb = fx.fact_b(spark, sf).select(month_start("o_orderdate").alias("period"), label.alias("label"))
    return pivot_counts(fb, "period", "label")


@query("pivot_indicator_join", f"""
WITH {fx.SQL_SHIP_IND}, pv AS ({_pivot_sql(True)})
SELECT pv.*, {S.rnd('ind.indicator', 6)} AS indicator FROM pv JOIN ind ON pv.period = ind.period
""")
def q_pivot_indicator_join(spark, sf):
    cells, ind = _fb_cells_dense(spark, sf)
    table = sanitize_columns(wide(cells, "period", "category", "n"))
    return table.join(ind, "period", "inner").withColumn("indicator", rounded("indicator", 6))


# --------------------------------------------------------------------------
# top-k, membership, ranks
# --------------------------------------------------------------------------

@query("top_groups", f"""
SELECT p_brand, COUNT(*) AS total FROM {fx.SQL_FACT_A} GROUP BY p_brand
ORDER BY total DESC, p_brand ASC NULLS FIRST LIMIT 10
""")
def q_top_groups(spark, sf):
    totals = period_counts(_fact_a_keys(spark, sf), ["p_brand"], "total")
    return top_k(totals, ["p_brand"], "total", 10)


@query("semi_keep_top", f"""
WITH {SQL_F}, {SQL_TOP10}
SELECT p_brand, l_returnflag, l_linestatus, COUNT(*) AS n FROM f
WHERE EXISTS (SELECT 1 FROM top WHERE top.p_brand IS NOT DISTINCT FROM f.p_brand)
GROUP BY ALL
""")
def q_semi_keep_top(spark, sf):
    counts = period_counts(_fact_a_keys(spark, sf), ["p_brand", "l_returnflag", "l_linestatus"], "n")
    # the group totals come from the same counts, so the facts are read once
    top = top_k(counts.groupBy("p_brand").agg(F.sum("n").alias("total")), ["p_brand"], "total", 10)
    return keep_top(counts, top, ["p_brand"])


@query("top_group_series", f"""
WITH {SQL_F}, {SQL_TOP10}
SELECT p_brand, period, COUNT(*) AS n FROM f
WHERE EXISTS (SELECT 1 FROM top WHERE top.p_brand IS NOT DISTINCT FROM f.p_brand)
GROUP BY ALL
""")
def q_top_group_series(spark, sf):
    keys = _fact_a_keys(spark, sf)
    mc = period_counts(keys, ["p_brand", "period"], "n")
    top = top_k(mc.groupBy("p_brand").agg(F.sum("n").alias("total")), ["p_brand"], "total", 10)
    return keep_top(mc, top, ["p_brand"])


SQL_AREA_TOP = f"""
WITH f AS (SELECT p_brand AS code, s_nationkey AS area FROM {fx.SQL_FACT_A_AREAS} WHERE year(l_shipdate) >= 1999),
top AS (SELECT code, COUNT(*) AS total_count FROM f GROUP BY code ORDER BY total_count DESC, code ASC NULLS FIRST LIMIT 7),
per AS (SELECT f.code, f.area, top.total_count, COUNT(*) AS n FROM f JOIN top ON f.code IS NOT DISTINCT FROM top.code GROUP BY ALL),
ranked AS (SELECT *, n / total_count AS fraction,
  CAST(rank() OVER (PARTITION BY code ORDER BY n / total_count DESC) AS INTEGER) AS rank FROM per)
"""


def _top_areas(spark, sf):
    # counts per (part, supplier) first: the joins then see one row per pair,
    # not one per event
    # year >= 1999 as a range on the column itself, so parquet can skip row groups
    li = fx.table(spark, sf, "lineitem").filter(F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    pairs = period_counts(li, ["l_partkey", "l_suppkey"], "__c")
    part = fx.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("code"))
    sup = fx.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("area"))
    f = (pairs.join(part, pairs.l_partkey == part.p_partkey, "inner")
              .join(sup, pairs.l_suppkey == sup.s_suppkey, "inner"))
    # code totals and the top 7 come from the (code, area) counts
    per = f.groupBy("code", "area").agg(F.sum("__c").alias("n"))
    totals = per.groupBy("code").agg(F.sum("n").alias("total_count"))
    top = top_k(totals, ["code"], "total_count", 7)
    per_top = null_safe_join(per, F.broadcast(top), ["code"], "inner")
    per_top = per_top.withColumn("fraction", F.col("n") / F.col("total_count"))
    return rank_within(per_top, "code", "fraction", 3)


@query("top_areas_per_code", SQL_AREA_TOP + f"""
SELECT code, area, total_count, n, {S.rnd('fraction')} AS fraction, rank FROM ranked WHERE rank <= 3
""")
def q_top_areas_per_code(spark, sf):
    return _top_areas(spark, sf).select("code", "area", "total_count", "n", r("fraction"), "rank")


@query("hotspot_areas", SQL_AREA_TOP + """
SELECT area, COUNT(*) AS n_codes FROM ranked WHERE rank <= 3 GROUP BY area
""")
def q_hotspot_areas(spark, sf):
    return period_counts(_top_areas(spark, sf), ["area"], "n_codes")


# --------------------------------------------------------------------------
# indicator joins and correlations
# --------------------------------------------------------------------------

SQL_CASES_YM = f"""
{fx.SQL_IND},
cases AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
  COUNT(o_orderkey) AS case_count FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
indym AS (SELECT CAST(year(period) AS INTEGER) AS year, CAST(month(period) AS INTEGER) AS month, indicator
  FROM ind WHERE year(period) > 1995),
j AS (SELECT * FROM cases JOIN indym USING (year, month))
"""


def _cases_indicator(spark, sf):
    fb = fx.fact_b(spark, sf)
    flagged = fb.withColumn("flag", F.col("o_orderstatus") == "F").filter("flag")
    cases = period_counts(flagged, [F.year("o_orderdate").alias("year"),
                                    F.month("o_orderdate").alias("month")],
                          "case_count", count_col="o_orderkey")
    ind = (fx.monthly_indicator(spark, sf)
           .select(F.year("period").alias("year"), F.month("period").alias("month"), "indicator")
           .filter(F.col("year") > 1995))
    return cases.join(ind, ["year", "month"], "inner")


@query("indicator_corr", f"""
WITH {SQL_CASES_YM}
SELECT CAST(regr_count(indicator, case_count) AS BIGINT) AS n,
  {S.rnd(S.corr('regr_sxx(indicator, case_count)', 'regr_syy(indicator, case_count)', 'regr_sxy(indicator, case_count)'))} AS corr
FROM j
""")
def q_indicator_corr(spark, sf):
    return correlation_by(_cases_indicator(spark, sf), None, "case_count", "indicator").select("n", r("corr"))


SQL_FB_GRID = f"""
{fx.SQL_SHIP_IND},
cells AS (SELECT o_orderpriority AS category, {S.month('o_orderdate')} AS period, COUNT(*) AS n FROM orders GROUP BY 1, 2),
dense AS (SELECT ind.period, ind.indicator FROM ind WHERE period IN (SELECT period FROM cells)),
cats AS (SELECT DISTINCT category FROM cells),
grid AS (SELECT c.category, d.period, d.indicator, COALESCE(x.n, 0) AS n
  FROM cats c CROSS JOIN dense d
  LEFT JOIN cells x ON x.category IS NOT DISTINCT FROM c.category AND x.period = d.period),
mom AS (SELECT category, {S.moments('n', 'indicator')} FROM grid GROUP BY category)
"""


def _fb_cells_dense(spark, sf):
    fb = fx.fact_b(spark, sf)
    cells = (fb.groupBy(F.col("o_orderpriority").alias("category"), month_start("o_orderdate").alias("period"))
               .agg(F.count(F.lit(1)).alias("n")))
    # months x categories rows, read by several branches: written once
    cells = materialize(cells)
    # an indicator of its own calendar; only months with orders are observed
    dense = fx.ship_indicator(spark, sf).join(cells.select("period").distinct(), "period", "left_semi")
    return cells, dense


def _fb_moments(spark, sf):
    cells, dense = _fb_cells_dense(spark, sf)
    return zero_filled_moments(dense, cells, None, "period", "category", "indicator", "n",
                               dense_role="x", center=True)


@query("category_indicator_corr", f"""
WITH {SQL_FB_GRID}
SELECT category, n, corr, row_number() OVER (ORDER BY corr DESC NULLS LAST, category) AS rank
FROM (SELECT category, n, {S.rnd(S.corr())} AS corr FROM mom)
""")
def q_category_indicator_corr(spark, sf):
    mom = _fb_moments(spark, sf)
    order = [F.col("corr").desc_nulls_last(), F.col("category")]
    out = mom.select("category", "n", rounded(correlation_expr(), 8).alias("corr"))
    return with_position(out, order, "rank", start=1)


SQL_YEAR_CASES = """
cases AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, COUNT(*) AS case_count FROM lineitem {where} GROUP BY 1),
j AS (SELECT * FROM cases JOIN panel USING (year))
"""


def _bucket_corr_sql(where: str) -> str:
    return f"""
WITH {fx.SQL_PANEL}, {SQL_YEAR_CASES.format(where=where)}
SELECT bucket, CAST(regr_count(share, case_count) AS BIGINT) AS n,
  {S.rnd(S.corr('regr_sxx(share, case_count)', 'regr_syy(share, case_count)', 'regr_sxy(share, case_count)'))} AS corr
FROM j GROUP BY bucket
"""


def _bucket_corr(spark, sf, flag=None):
    li = fx.table(spark, sf, "lineitem")
    if flag is not None:
        li = li.withColumn("flag", flag).filter("flag")
    cases = period_counts(li, [F.year("l_shipdate").alias("year")], "case_count")
    j = cases.join(fx.yearly_panel(spark, sf), "year", "inner")
    return correlation_by(j, ["bucket"], "case_count", "share").select("bucket", "n", r("corr"))


@query("bucket_corr", _bucket_corr_sql(""))
def q_bucket_corr(spark, sf):
    return _bucket_corr(spark, sf).orderBy("bucket")


@query("flag_corr_by_bucket", _bucket_corr_sql("WHERE l_linestatus = 'F'"))
def q_flag_corr_by_bucket(spark, sf):
    return _bucket_corr(spark, sf, F.col("l_linestatus") == "F").orderBy("bucket")


CODE_RANGES = [(1, 10, "low"), (41, 50, "high")]


@query("code_range_corr", f"""
WITH {fx.SQL_PANEL},
rng AS (SELECT * FROM (VALUES (1, 10), (41, 50)) t(range_lo, range_hi)),
f AS (SELECT rng.range_lo, rng.range_hi, CAST(year(l_shipdate) AS INTEGER) AS year
  FROM {fx.SQL_FACT_A} JOIN rng ON p_size >= rng.range_lo AND p_size <= rng.range_hi),
cases AS (SELECT range_lo, range_hi, year, COUNT(*) AS case_count FROM f GROUP BY ALL),
j AS (SELECT * FROM cases JOIN panel USING (year) WHERE bucket IN (1, 5))
SELECT range_lo, range_hi, bucket, CAST(regr_count(share, case_count) AS BIGINT) AS n,
  {S.rnd(S.corr('regr_sxx(share, case_count)', 'regr_syy(share, case_count)', 'regr_sxy(share, case_count)'))} AS corr
FROM j GROUP BY ALL
""")
def q_code_range_corr(spark, sf):
    # the ranges pick parts before the facts are joined
    codes = code_ranges(fx.table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", CODE_RANGES)
    li = fx.table(spark, sf, "lineitem").select("l_partkey", "l_shipdate")
    hits = li.join(codes, li.l_partkey == codes.p_partkey, "inner")
    cases = period_counts(hits, ["range_lo", "range_hi", F.year("l_shipdate").alias("year")], "case_count")
    panel = fx.yearly_panel(spark, sf).filter(F.col("bucket").isin(1, 5))
    j = cases.join(panel, "year", "inner")
    return correlation_by(j, ["range_lo", "range_hi", "bucket"], "case_count", "share") \
        .select("range_lo", "range_hi", "bucket", "n", r("corr"))


SQL_RANGE_TABLE = ("rng AS (SELECT n_nationkey * 2 AS range_lo, n_nationkey * 2 + (n_nationkey % 7) * 4 AS range_hi, "
                   "n_name AS range_label FROM nation)")


@query("range_table_counts", f"""
WITH {SQL_RANGE_TABLE},
f AS (SELECT range_label, range_lo, range_hi, CAST(year(l_shipdate) AS INTEGER) AS year
  FROM {fx.SQL_FACT_A} JOIN rng ON p_size >= range_lo AND p_size <= range_hi)
SELECT range_label, range_lo, range_hi, year, COUNT(*) AS n FROM f GROUP BY ALL
""")
def q_range_table_counts(spark, sf):
    # a table of overlapping ranges of many widths; parts are matched before the facts
    nation = fx.table(spark, sf, "nation")
    ranges = nation.select((F.col("n_nationkey") * 2).alias("range_lo"),
                           (F.col("n_nationkey") * 2 + F.col("n_nationkey") % 7 * 4).alias("range_hi"),
                           F.col("n_name").alias("range_label"))
    parts = range_join(fx.table(spark, sf, "part").select("p_partkey", "p_size"), ranges, "p_size", "range_lo", "range_hi")
    li = fx.table(spark, sf, "lineitem").select("l_partkey", "l_shipdate")
    hits = li.join(parts, li.l_partkey == parts.p_partkey, "inner")
    return period_counts(hits, ["range_label", "range_lo", "range_hi", F.year("l_shipdate").alias("year")], "n")


SQL_OPEN_RANGE = f"""
WITH {fx.SQL_AREA},
cases AS (SELECT s_nationkey AS area, COUNT(*) AS case_count FROM {fx.SQL_FACT_A_AREAS}
  WHERE p_size > 10 AND p_size < 40 GROUP BY 1),
j AS (SELECT * FROM cases JOIN area_cost USING (area))
"""


def _open_range_area(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    codes = fx.table(spark, sf, "part").filter(in_open_range("p_size", 10, 40)).select("p_partkey")
    hits = li.join(codes, li.l_partkey == codes.p_partkey, "left_semi")
    # events per supplier before the supplier join: one row per supplier
    per_sup = period_counts(hits, ["l_suppkey"], "__c")
    sup = fx.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    cases = (per_sup.join(sup, per_sup.l_suppkey == sup.s_suppkey, "inner")
                    .groupBy(F.col("s_nationkey").alias("area")).agg(F.sum("__c").alias("case_count")))
    return cases.join(fx.area_cost(spark, sf), "area", "inner")


@query("open_range_area_corr", SQL_OPEN_RANGE + f"""
SELECT CAST(regr_count(cost, case_count) AS BIGINT) AS n,
  {S.rnd(S.corr('regr_sxx(cost, case_count)', 'regr_syy(cost, case_count)', 'regr_sxy(cost, case_count)'))} AS corr
FROM j
""")
def q_open_range_area_corr(spark, sf):
    return correlation_by(_open_range_area(spark, sf), None, "case_count", "cost").select("n", r("corr"))


SQL_AREA_CASES = f"""
WITH {fx.SQL_AREA},
cases AS (SELECT c_nationkey AS area, COUNT(*) AS case_count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
j AS (SELECT * FROM cases JOIN area_cost USING (area))
"""


def _area_cases(spark, sf):
    cust = fx.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    # orders per customer first (map-side combined), then the customer join
    per_cust = period_counts(fx.fact_b(spark, sf), ["o_custkey"], "__c")
    cases = (per_cust.join(cust, per_cust.o_custkey == cust.c_custkey, "inner")
                     .groupBy(F.col("c_nationkey").alias("area")).agg(F.sum("__c").alias("case_count")))
    return cases.join(fx.area_cost(spark, sf), "area", "inner")


@query("area_cost_corr", SQL_AREA_CASES + f"""
SELECT CAST(regr_count(cost, case_count) AS BIGINT) AS n,
  {S.rnd(S.corr('regr_sxx(cost, case_count)', 'regr_syy(cost, case_count)', 'regr_sxy(cost, case_count)'))} AS corr
FROM j
""")
def q_area_cost_corr(spark, sf):
    return correlation_by(_area_cases(spark, sf), None, "case_count", "cost").select("n", r("corr"))


@query("segment_cost_corr", f"""
WITH cost AS (SELECT c_nationkey AS area, CAST(SUM(CAST(c_acctbal AS DECIMAL(26,8))) AS DOUBLE) / COUNT(c_acctbal) AS cost
  FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1),
cases AS (SELECT c_nationkey AS area, COUNT(*) AS case_count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
j AS (SELECT * FROM cases JOIN cost USING (area))
SELECT CAST(regr_count(cost, case_count) AS BIGINT) AS n,
  {S.rnd(S.corr('regr_sxx(cost, case_count)', 'regr_syy(cost, case_count)', 'regr_sxy(cost, case_count)'))} AS corr
FROM j
""")
def q_segment_cost_corr(spark, sf):
    # the mean per area over the rows of one kind only, then the cases of the area
    customer = fx.table(spark, sf, "customer")
    cost = (customer.filter(F.col("c_mktsegment") == "BUILDING").groupBy(F.col("c_nationkey").alias("area"))
                    .agg(fx.exact_mean("c_acctbal").alias("cost")))
    per_cust = period_counts(fx.fact_b(spark, sf), ["o_custkey"], "__c")
    cases = (per_cust.join(customer.select("c_custkey", "c_nationkey"), per_cust.o_custkey == F.col("c_custkey"), "inner")
                     .groupBy(F.col("c_nationkey").alias("area")).agg(F.sum("__c").alias("case_count")))
    return correlation_by(cases.join(cost, "area", "inner"), None, "case_count", "cost").select("n", r("corr"))


# The composite-index weights of the reference, in column order.
INDEX_WEIGHTS = {"l_quantity": 0.15, "l_discount": 0.4, "l_tax": 0.7,
                 "l_linenumber": 1.0, "l_extendedprice": 1.5}
SQL_WINDEX = ("(COALESCE(CAST(l_quantity AS DOUBLE), 0.0::DOUBLE) * 0.15::DOUBLE "
              "+ COALESCE(CAST(l_discount AS DOUBLE), 0.0::DOUBLE) * 0.4::DOUBLE "
              "+ COALESCE(CAST(l_tax AS DOUBLE), 0.0::DOUBLE) * 0.7::DOUBLE "
              "+ COALESCE(CAST(l_linenumber AS DOUBLE), 0.0::DOUBLE) * 1.0::DOUBLE "
              "+ COALESCE(CAST(l_extendedprice AS DOUBLE), 0.0::DOUBLE) * 1.5::DOUBLE)"
              " / NULLIF(COALESCE(CAST(l_quantity AS DOUBLE), 0.0::DOUBLE) "
              "+ COALESCE(CAST(l_discount AS DOUBLE), 0.0::DOUBLE) "
              "+ COALESCE(CAST(l_tax AS DOUBLE), 0.0::DOUBLE) "
              "+ COALESCE(CAST(l_linenumber AS DOUBLE), 0.0::DOUBLE) "
              "+ COALESCE(CAST(l_extendedprice AS DOUBLE), 0.0::DOUBLE), 0.0::DOUBLE)")


@query("weighted_index", f"""
SELECT l_orderkey, l_linenumber, {S.rnd(SQL_WINDEX)} AS windex FROM lineitem
""")
def q_weighted_index(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", rounded(weighted_index(INDEX_WEIGHTS), 8).alias("windex"))


@query("area_sum", f"""
SELECT s_nationkey AS area, COUNT(*) AS n, {S.rnd_sig(f'SUM({SQL_WINDEX})')} AS index_sum
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1
""")
def q_area_sum(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    # partial sums per supplier before the supplier join
    per_sup = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("__c"),
                                          F.sum(weighted_index(INDEX_WEIGHTS)).alias("__s"))
    sup = fx.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    j = per_sup.join(sup, per_sup.l_suppkey == sup.s_suppkey, "inner")
    return (j.groupBy(F.col("s_nationkey").alias("area"))
             .agg(F.sum("__c").alias("n"), F.sum("__s").alias("index_sum"))
             .select("area", "n", rs("index_sum")).orderBy("area"))


# --------------------------------------------------------------------------
# linear models and slope tests
# --------------------------------------------------------------------------

@query("elastic_net_fit", f"""
WITH {SQL_FB_GRID}, {S.fit_select()}
SELECT category, n, {S.rnd_sig('slope')} AS slope, {S.rnd_sig('intercept')} AS intercept,
  {S.rnd_sig('sqrt(rss / n)')} AS rmse, {S.rnd('CASE WHEN syy > 0 THEN 1.0::DOUBLE - rss / syy END')} AS r2
FROM fit
""")
def q_elastic_net_fit(spark, sf):
    fit = elastic_net_1d(_fb_moments(spark, sf), reg=0.3, mix=0.8)
    return fit.select("category", "n", rs("slope"), rs("intercept"), rs("rmse"), r("r2"))


@query("linear_predictions", f"""
WITH {SQL_FB_GRID}, {S.fit_select()}
SELECT g.category, g.period, {S.rnd('g.indicator', 6)} AS indicator, g.n,
  {S.rnd_sig('fit.intercept + fit.slope * g.indicator')} AS prediction
FROM grid g JOIN fit ON g.category IS NOT DISTINCT FROM fit.category
""")
def q_linear_predictions(spark, sf):
    cells, dense = _fb_cells_dense(spark, sf)
    mom = zero_filled_moments(dense, cells, None, "period", "category", "indicator", "n",
                              dense_role="x", center=True)
    fit = elastic_net_1d(mom)
    grid = zero_filled_cells(cells, "period", "category", "n").join(dense, "period", "inner")
    scored = score_linear(grid, fit, ["category"], "indicator")
    return scored.select("category", "period", r("indicator", 6), "n", rs("prediction"))


def _tested(fit_select_cols, tested):
    return tested.select(*fit_select_cols, "n", rs("slope"), rs("intercept"), rs("t_stat"), r("p_value"),
                         "alpha", "significant", "verdict")


SQL_TEST_OUT = (f"n, {S.rnd_sig('slope')} AS slope, {S.rnd_sig('intercept')} AS intercept, "
                f"{S.rnd_sig('t_stat')} AS t_stat, {S.rnd('p_value')} AS p_value, alpha, significant, verdict")


@query("slope_test", f"""
WITH {SQL_CASES_YM},
mom AS (SELECT {S.moments('case_count', 'indicator')} FROM j),
{S.fit_select()}, {S.test_select()}
SELECT {SQL_TEST_OUT} FROM tested
""")
def q_slope_test(spark, sf):
    mom = moments(_cases_indicator(spark, sf), None, "indicator", "case_count")
    return _tested([], slope_test(elastic_net_1d(mom)))


@query("slope_test_damped", SQL_AREA_CASES + f""",
mom AS (SELECT {S.moments('case_count', 'cost')} FROM j),
{S.fit_select()}, {S.test_select(damping=1e9)}
SELECT {SQL_TEST_OUT} FROM tested
""")
def q_slope_test_damped(spark, sf):
    mom = moments(_area_cases(spark, sf), None, "cost", "case_count")
    return _tested([], slope_test(elastic_net_1d(mom), sxx_damping=1e9))


@query("bucket_slope_test", f"""
WITH {fx.SQL_PANEL}, {SQL_YEAR_CASES.format(where='')},
mom AS (SELECT bucket, {S.moments('case_count', 'share')} FROM j GROUP BY bucket),
{S.fit_select()}, {S.test_select()}
SELECT bucket, {SQL_TEST_OUT} FROM tested
""")
def q_bucket_slope_test(spark, sf):
    # yearly events against each bucket's share: every bucket fitted and tested in one job
    li = fx.table(spark, sf, "lineitem")
    cases = period_counts(li, [F.year("l_shipdate").alias("year")], "case_count")
    j = cases.join(fx.yearly_panel(spark, sf), "year", "inner")
    return _tested(["bucket"], slope_test(elastic_net_1d(moments(j, "bucket", "share", "case_count"))))


@query("category_slope_tests", f"""
WITH {SQL_FB_GRID}, {S.fit_select()}, {S.test_select()}
SELECT category, {S.rnd(S.corr())} AS corr, {SQL_TEST_OUT} FROM tested
""")
def q_category_slope_tests(spark, sf):
    tested = slope_test(elastic_net_1d(_fb_moments(spark, sf)))
    return _tested(["category", rounded(correlation_expr(), 8).alias("corr")], tested).orderBy(
        F.col("corr").desc_nulls_last(), "category")


# --------------------------------------------------------------------------
# series: lags, split, scaling, forecast
# --------------------------------------------------------------------------

SQL_LAGS = f"""
{SQL_F}, {fx.SQL_IND},
mc AS (SELECT p_brand, period, COUNT(*) AS cases FROM f GROUP BY 1, 2),
s AS (SELECT mc.*, COALESCE(ind.indicator, -1.0::DOUBLE) AS u FROM mc LEFT JOIN ind ON mc.period = ind.period),
lg AS (SELECT p_brand, period, cases, u AS u_0,
  COALESCE(lag(u, 1) OVER w, -1.0::DOUBLE) AS u_1, COALESCE(lag(u, 2) OVER w, -1.0::DOUBLE) AS u_2,
  COALESCE(lag(u, 3) OVER w, -1.0::DOUBLE) AS u_3
  FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY period))
"""


def _lags(spark, sf):
    mc = _brand_months(spark, sf)
    ind = fx.monthly_indicator(spark, sf).withColumnRenamed("indicator", "u")
    # one row per calendar month: bounded by the time span, safe to broadcast
    s = with_indicator(mc, ind, ["period"], fill=-1.0, broadcast=True)
    return lag_features(s, "p_brand", "period", "u", (1, 2, 3), fill=-1.0)


@query("lag_features", f"""
WITH {SQL_LAGS}
SELECT p_brand, period, cases, {S.rnd('u_0', 6)} AS u_0, {S.rnd('u_1', 6)} AS u_1,
  {S.rnd('u_2', 6)} AS u_2, {S.rnd('u_3', 6)} AS u_3 FROM lg
""")
def q_lag_features(spark, sf):
    return _lags(spark, sf).select("p_brand", "period", "cases", r("u_0", 6), r("u_1", 6),
                                   r("u_2", 6), r("u_3", 6))


@query("chronological_split", f"""
WITH {SQL_F},
mc AS (SELECT p_brand, period, COUNT(*) AS cases FROM f GROUP BY 1, 2)
SELECT p_brand, period, cases,
  CAST(row_number() OVER (PARTITION BY p_brand ORDER BY period) AS INTEGER) AS rn,
  COUNT(*) OVER (PARTITION BY p_brand) AS n_rows,
  row_number() OVER (PARTITION BY p_brand ORDER BY period) <= floor(COUNT(*) OVER (PARTITION BY p_brand) * 0.8::DOUBLE) AS is_train
FROM mc
""")
def q_chronological_split(spark, sf):
    return chronological_split(_brand_months(spark, sf), "p_brand", "period", 0.8)


@query("min_max_scale", f"""
WITH {SQL_LAGS},
mm AS (SELECT *, min(u_0) OVER g AS a0, max(u_0) OVER g AS b0, min(u_1) OVER g AS a1, max(u_1) OVER g AS b1,
  min(u_2) OVER g AS a2, max(u_2) OVER g AS b2, min(u_3) OVER g AS a3, max(u_3) OVER g AS b3
  FROM lg WINDOW g AS (PARTITION BY p_brand))
SELECT p_brand, period,
  {S.rnd("CASE WHEN b0 - a0 > 0 THEN -1.0::DOUBLE + (u_0 - a0) * 2.0::DOUBLE / (b0 - a0) ELSE -1.0::DOUBLE END")} AS u_0_scaled,
  {S.rnd("CASE WHEN b1 - a1 > 0 THEN -1.0::DOUBLE + (u_1 - a1) * 2.0::DOUBLE / (b1 - a1) ELSE -1.0::DOUBLE END")} AS u_1_scaled,
  {S.rnd("CASE WHEN b2 - a2 > 0 THEN -1.0::DOUBLE + (u_2 - a2) * 2.0::DOUBLE / (b2 - a2) ELSE -1.0::DOUBLE END")} AS u_2_scaled,
  {S.rnd("CASE WHEN b3 - a3 > 0 THEN -1.0::DOUBLE + (u_3 - a3) * 2.0::DOUBLE / (b3 - a3) ELSE -1.0::DOUBLE END")} AS u_3_scaled
FROM mm
""")
def q_min_max_scale(spark, sf):
    cols = ["u_0", "u_1", "u_2", "u_3"]
    scaled = min_max_scale(_lags(spark, sf), "p_brand", cols, -1.0, 1.0)
    return scaled.select("p_brand", "period", *[r(f"{c}_scaled") for c in cols])


FORECAST = ["u_0", "u_1", "u_2", "u_3"]


def _forecast_sql() -> str:
    fs = FORECAST
    mean = ", ".join(f"AVG({f}) AS m_{f}" for f in fs)
    rows = ", ".join("[" + ", ".join(f"SUM(({f} - m_{f}) * ({g} - m_{g}))" for g in fs) + f", SUM(({f} - m_{f}) * (cases - m_y))]" for f in fs)
    own = ", ".join(f"SUM(({f} - m_{f}) * ({f} - m_{f}))" for f in fs)
    icept = "m_y - " + " - ".join(f"b{i} * m_{f}" for i, f in enumerate(fs, 1))
    error = "cases - b0 - " + " - ".join(f"b{i} * {f}" for i, f in enumerate(fs, 1))
    same = "IS NOT DISTINCT FROM"
    return f"""
WITH {SQL_LAGS}, {SQL_TOP10},
tl AS (SELECT lg.* FROM lg JOIN top ON lg.p_brand {same} top.p_brand),
sp AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY period)
  <= floor(COUNT(*) OVER (PARTITION BY p_brand) * 0.8::DOUBLE) AS is_train FROM tl),
mu AS (SELECT p_brand, COUNT(*) AS n_train, AVG(cases) AS m_y, {mean} FROM sp WHERE is_train GROUP BY p_brand),
s0 AS (SELECT sp.p_brand, [{rows}] AS m, [{own}] AS own, [{', '.join(['true'] * len(fs))}] AS free
  FROM sp JOIN mu ON sp.p_brand {same} mu.p_brand WHERE is_train GROUP BY sp.p_brand),
{S.solve_select(len(fs), 1e-9, 'p_brand')},
co AS (SELECT solved.*, n_train, {icept} AS b0 FROM solved JOIN mu ON solved.p_brand {same} mu.p_brand),
er AS (SELECT sp.p_brand, COUNT(*) AS n_test, AVG(({error}) * ({error})) AS mse
  FROM sp JOIN co ON sp.p_brand {same} co.p_brand WHERE NOT is_train GROUP BY sp.p_brand),
al AS (SELECT p_brand, COUNT(*) FILTER (WHERE NOT is_train) AS n_test FROM sp GROUP BY p_brand)
SELECT al.p_brand, COALESCE(n_train, 0) AS n_train, al.n_test, {S.rnd_sig('mse', 8)} AS mse, {S.rnd_sig('b0', 8)} AS b_intercept,
  {', '.join(f"{S.rnd_sig(f'b{i}', 8)} AS b_{f}" for i, f in enumerate(fs, 1))}
FROM al LEFT JOIN co ON al.p_brand {same} co.p_brand LEFT JOIN er ON al.p_brand {same} er.p_brand
"""


@query("lag_forecast", _forecast_sql())
def q_lag_forecast(spark, sf):
    lags = _lags(spark, sf)
    # the ten brands with the most cases; their totals come from the same monthly counts
    top = top_k(_brand_months(spark, sf).groupBy("p_brand").agg(F.sum("cases").alias("total")), ["p_brand"], "total", 10)
    out = lag_forecast(keep_top(lags, top, ["p_brand"]), "p_brand", "period", "cases", FORECAST, 0.8)
    return out.select("p_brand", "n_train", "n_test", rs("mse", 8), rs("b_intercept", 8), *[rs(f"b_{f}", 8) for f in FORECAST])


# --------------------------------------------------------------------------
# summaries
# --------------------------------------------------------------------------

SUMMARY_COLS = ["l_quantity", "l_discount", "l_tax"]


def _summary_sql() -> str:
    parts = []
    for c in SUMMARY_COLS:
        for stat, expr in [("count", f"CAST(COUNT({c}) AS DOUBLE)"), ("mean", f"AVG({c})"),
                           ("stddev", f"STDDEV_SAMP({c})"), ("min", f"MIN({c})"), ("max", f"MAX({c})")]:
            parts.append(f"SELECT '{c}' AS column, '{stat}' AS stat, {S.rnd(expr, 6)} AS value FROM lineitem")
    return " UNION ALL ".join(parts)


@query("summary_stats", _summary_sql())
def q_summary_stats(spark, sf):
    s = summary_stats(fx.table(spark, sf, "lineitem"), SUMMARY_COLS)
    return s.select("column", "stat", r("value", 6))


# --------------------------------------------------------------------------
# nearest area
# --------------------------------------------------------------------------

def _points(spark, sf):
    c = fx.table(spark, sf, "customer")
    return c.select("c_custkey",
                    (F.lit(40.5) + F.pmod(F.col("c_custkey") * 7919, F.lit(1000)) / F.lit(2000.0)).alias("lat"),
                    (F.lit(-74.25) + F.pmod(F.col("c_custkey") * 104729, F.lit(1000)) / F.lit(1400.0)).alias("lon"))


def _centroids(spark, sf):
    s = fx.table(spark, sf, "supplier")
    return s.select("s_suppkey",
                    (F.lit(40.5) + F.pmod(F.col("s_suppkey") * 7907, F.lit(500)) / F.lit(1000.0)).alias("lat"),
                    (F.lit(-74.25) + F.pmod(F.col("s_suppkey") * 6007, F.lit(700)) / F.lit(1000.0)).alias("lon"))


_R = "0.017453292519943295::DOUBLE"


@query("nearest_area_join", f"""
WITH pts AS (SELECT c_custkey, 40.5::DOUBLE + ((c_custkey * 7919) % 1000) / 2000.0::DOUBLE AS lat,
    -74.25::DOUBLE + ((c_custkey * 104729) % 1000) / 1400.0::DOUBLE AS lon FROM customer),
cen AS (SELECT s_suppkey, 40.5::DOUBLE + ((s_suppkey * 7907) % 500) / 1000.0::DOUBLE AS clat,
    -74.25::DOUBLE + ((s_suppkey * 6007) % 700) / 1000.0::DOUBLE AS clon FROM supplier),
d AS (SELECT c_custkey, s_suppkey,
  12742.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE,
    sin((clat - lat) * {_R} / 2) * sin((clat - lat) * {_R} / 2)
    + cos(lat * {_R}) * cos(clat * {_R}) * sin((clon - lon) * {_R} / 2) * sin((clon - lon) * {_R} / 2)))) AS dist_km
  FROM pts CROSS JOIN cen),
b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY dist_km, s_suppkey) AS rn FROM d)
SELECT c_custkey, s_suppkey, {S.rnd('dist_km', 6)} AS dist_km FROM b WHERE rn = 1
""")
def q_nearest_area_join(spark, sf):
    res = nearest_area(_points(spark, sf), _centroids(spark, sf), "c_custkey", "s_suppkey")
    return res.select("c_custkey", "s_suppkey", r("dist_km", 6))


def _placed_sql(key: str, a: int, b: int) -> tuple[str, str]:
    """Coordinates from a key; every 11th row has no latitude."""
    return (f"CASE WHEN {key} % 11 <> 0 THEN 40.5::DOUBLE + (({key} * {a}) % 1000) / 2000.0::DOUBLE END",
            f"-74.25::DOUBLE + (({key} * {b}) % 1000) / 1400.0::DOUBLE")


def _placed(key: str, a: int, b: int) -> list:
    return [F.when(F.col(key) % 11 != 0, F.lit(40.5) + F.pmod(F.col(key) * a, F.lit(1000)) / F.lit(2000.0)).alias("lat"),
            (F.lit(-74.25) + F.pmod(F.col(key) * b, F.lit(1000)) / F.lit(1400.0)).alias("lon")]


CASE_PLACE, PART_PLACE = ("o_orderkey", 7919, 104729), ("p_partkey", 6151, 3571)
AREA_WEIGHTS = {"p_size": 0.15, "p_retailprice": 0.4}
_AREA_INDEX = ("(COALESCE(CAST(p_size AS DOUBLE), 0.0::DOUBLE) * 0.15::DOUBLE + COALESCE(CAST(p_retailprice AS DOUBLE), 0.0::DOUBLE) * 0.4::DOUBLE)"
               " / NULLIF(COALESCE(CAST(p_size AS DOUBLE), 0.0::DOUBLE) + COALESCE(CAST(p_retailprice AS DOUBLE), 0.0::DOUBLE), 0.0::DOUBLE)")


def _nearest_sql(table: str, place: tuple, more: str = "") -> str:
    key, (lat, lon) = place[0], _placed_sql(*place)
    return (f"(SELECT * FROM (SELECT q.*, s_suppkey AS area, row_number() OVER (PARTITION BY {key} ORDER BY "
            f"{S.haversine('lat', 'lon', 'clat', 'clon')}, s_suppkey) AS rn FROM "
            f"(SELECT {key}, {lat} AS lat, {lon} AS lon{more} FROM {table}) q CROSS JOIN cen WHERE lat IS NOT NULL) WHERE rn = 1)")


@query("area_index_slope_test", f"""
WITH cen AS (SELECT s_suppkey, 40.5::DOUBLE + ((s_suppkey * 7907) % 500) / 1000.0::DOUBLE AS clat,
    -74.25::DOUBLE + ((s_suppkey * 6007) % 700) / 1000.0::DOUBLE AS clon FROM supplier),
cases AS (SELECT area, COUNT(*) AS case_count FROM {_nearest_sql('orders', CASE_PLACE)} GROUP BY area),
idx AS (SELECT area, SUM({_AREA_INDEX}) AS idx FROM {_nearest_sql('part', PART_PLACE, ', p_size, p_retailprice')}
  GROUP BY area),
j AS (SELECT * FROM cases JOIN idx USING (area)),
mom AS (SELECT {S.moments('case_count', 'idx')} FROM j),
{S.fit_select()}, {S.test_select(damping=1e9)}
SELECT {S.rnd(S.corr())} AS corr, {SQL_TEST_OUT} FROM tested
""")
def q_area_index_slope_test(spark, sf):
    # points of two tables go to their nearest areas; cases per area are
    # tested against the composite index per area
    areas = _centroids(spark, sf)
    orders = fx.fact_b(spark, sf).select("o_orderkey", *_placed(*CASE_PLACE))
    cases = period_counts(nearest_area(orders, areas, "o_orderkey", "s_suppkey"), ["s_suppkey"], "case_count")
    part = fx.table(spark, sf, "part")
    homes = nearest_area(part.select("p_partkey", *_placed(*PART_PLACE)), areas, "p_partkey", "s_suppkey").select("p_partkey", "s_suppkey")
    index = part.select("p_partkey", weighted_index(AREA_WEIGHTS).alias("index"))
    index = homes.join(index, "p_partkey", "inner").groupBy("s_suppkey").agg(F.sum("index").alias("index"))
    mom = moments(cases.join(index, "s_suppkey", "inner"), None, "index", "case_count")
    return _tested([rounded(correlation_expr(), 8).alias("corr")], slope_test(elastic_net_1d(mom), sxx_damping=1e9))


# --------------------------------------------------------------------------
# scalar functions: parsing, keys, codes
# --------------------------------------------------------------------------

@query("parse_timestamp", """
SELECT o_orderkey,
  strftime(strptime(strftime(o_orderdate, '%m/%d/%Y %I:%M:%S %p'), '%m/%d/%Y %I:%M:%S %p'), '%Y-%m-%d %H:%M:%S') AS order_ts,
  strftime(strptime(strftime(o_orderdate, '%Y %b'), '%Y %b'), '%Y-%m-%d %H:%M:%S') AS label_ts
FROM orders
""")
def q_parse_timestamp(spark, sf):
    fb = fx.fact_b(spark, sf)
    text = F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a")
    label = F.date_format("o_orderdate", "yyyy MMM")
    return fb.select("o_orderkey",
                     timestamp_text(parse_timestamp(text, "MM/dd/yyyy hh:mm:ss a")).alias("order_ts"),
                     timestamp_text(parse_timestamp(label, "yyyy MMM")).alias("label_ts"))


@query("split_month_key", """
WITH t AS (SELECT strftime(o_orderdate, '%m/%d/%Y') AS d FROM orders)
SELECT split_part(d, '/', 3) || '-' || split_part(d, '/', 1) AS key_ym,
  split_part(d, '/', 1) || '-' || split_part(d, '/', 3) AS key_my, COUNT(*) AS n
FROM t GROUP BY 1, 2
""")
def q_split_month_key(spark, sf):
    fb = fx.fact_b(spark, sf).select(F.date_format("o_orderdate", "MM/dd/yyyy").alias("d"))
    return period_counts(fb, [split_date_key("d", "/", (2, 0)).alias("key_ym"),
                              split_date_key("d", "/", (0, 2)).alias("key_my")], "n")


@query("substring_period", """
WITH t AS (SELECT 'M' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS period_label FROM orders)
SELECT period_label, TRY_CAST(substr(period_label, 2, 2) AS INTEGER) AS month, COUNT(*) AS n
FROM t GROUP BY 1, 2
""")
def q_substring_period(spark, sf):
    fb = fx.fact_b(spark, sf).select(
        F.concat(F.lit("M"), zero_pad(F.month("o_orderdate"), 2)).alias("period_label"))
    return period_counts(fb, ["period_label", period_number("period_label").alias("month")], "n")


@query("safe_code_cast", """
SELECT TRY_CAST(substr(p_brand, 7) AS INTEGER) AS brand_code, TRY_CAST(p_type AS INTEGER) AS type_code,
  COUNT(*) AS n FROM part GROUP BY 1, 2
""")
def q_safe_code_cast(spark, sf):
    p = fx.table(spark, sf, "part")
    return period_counts(p, [safe_int(F.substring("p_brand", 7, 100)).alias("brand_code"),
                             safe_int("p_type").alias("type_code")], "n")


@query("month_from_position", f"""
WITH {fx.SQL_IND}, o AS (SELECT row_number() OVER (ORDER BY period) - 1 AS pos, indicator FROM ind)
SELECT pos, CAST(pos % 12 + 1 AS INTEGER) AS month_from_pos, {S.rnd('indicator', 6)} AS value FROM o
""")
def q_month_from_position(spark, sf):
    # a series as it is published: a file without a header and without a
    # month, one value a line in the order of time (one row per month)
    path = _scratch(spark, "series")
    fx.monthly_indicator(spark, sf).orderBy("period").coalesce(1).select("indicator").write.csv(path, header=False)
    series = read_indicator(spark, path, "value double", options={"header": "false"})
    numbered = with_line_number(series, "pos")
    return numbered.select("pos", month_from_position("pos").alias("month_from_pos"), r("value", 6))


# --------------------------------------------------------------------------
# sources: unions of event sets, JSON fields
# --------------------------------------------------------------------------

@query("union_shards", """
WITH u AS (SELECT 'order' AS kind, o_orderdate AS ts FROM orders
           UNION ALL SELECT 'ship' AS kind, l_shipdate AS ts FROM lineitem)
SELECT kind, CAST(year(ts) AS INTEGER) AS year, COUNT(*) AS n FROM u GROUP BY 1, 2
""")
def q_union_shards(spark, sf):
    orders = fx.fact_b(spark, sf).select(F.lit("order").alias("kind"), F.col("o_orderdate").alias("ts"))
    ships = fx.table(spark, sf, "lineitem").select(F.lit("ship").alias("kind"), F.col("l_shipdate").alias("ts"))
    return period_counts(union_all([orders, ships]), ["kind", F.year("ts").alias("year")], "n")


@query("json_field_counts", """
SELECT event_type, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
  COUNT(*) AS n FROM events GROUP BY 1, 2
""")
def q_json_field_counts(spark, sf):
    ev = fx.table(spark, sf, "events")
    parsed = ev.select("event_type", parse_json_column("props", "k INT").alias("p"))
    return period_counts(parsed, ["event_type", F.col("p.k").alias("k")], "n")


def _scratch(spark, kind: str) -> str:
    """A fresh folder under the session's reliable checkpoint folder, deleted
    when the application ends."""
    import uuid

    from covary.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@query("json_shard_counts", """
SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n
FROM orders GROUP BY 1, 2
""")
def q_json_shard_counts(spark, sf):
    # The orders become JSON-lines shards (one folder per order year, dates as
    # 'MM/dd/yyyy hh:mm:ss a' text), which are read back by ONE scan over all
    # shards with a typed schema and a corrupt-record column.
    base = _scratch(spark, "shards")
    text = fx.fact_b(spark, sf).select(
        "o_orderkey", "o_orderpriority",
        F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a").alias("order_date"),
        F.year("o_orderdate").alias("shard"))
    write_table(text, base, "json", partition_by=["shard"])
    schema = "o_orderkey long, o_orderpriority string, order_date string, _corrupt string"
    ev = read_events(spark, [f"{base}/shard=*"], schema, "json", corrupt_column="_corrupt")
    ts = parse_timestamp("order_date", "MM/dd/yyyy hh:mm:ss a")
    return period_counts(ev, ["o_orderpriority", F.year(ts).alias("year")], "n")


@query("json_malformed_counts", """
SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n, 'good' AS kind
FROM orders WHERE o_orderkey % 97 <> 5 GROUP BY 1, 2
UNION ALL SELECT NULL, NULL, COUNT(*), 'broken' FROM orders WHERE o_orderkey % 97 = 5
UNION ALL SELECT NULL, NULL, COUNT(*), 'read' FROM orders
""")
def q_json_malformed_counts(spark, sf):
    # JSON lines of which some are cut off: good rows are counted, the broken
    # lines and all lines read as the ingest reconciled them
    base = _scratch(spark, "lines")
    text = F.to_json(F.struct("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a").alias("order_date")))
    cut = F.when(F.col("o_orderkey") % 97 == 5, F.substring(text, 1, 30)).otherwise(text)
    fx.fact_b(spark, sf).select(cut.alias("value")).write.text(f"{base}/raw")
    got = ingest(spark, f"{base}/raw", "o_orderkey long, o_orderpriority string, order_date string", f"{base}/out")
    year = F.year(parse_timestamp("order_date", "MM/dd/yyyy hh:mm:ss a"))
    good = period_counts(got.good, ["o_orderpriority", year.alias("year")], "n").withColumn("kind", F.lit("good"))
    return _with_counts(good, got)


def _with_counts(good, got):
    keys = [F.lit(None).cast(t).alias(c) for c, t in good.dtypes[:-2]]
    broken = got.quarantine.agg(F.count("line").alias("n")).select(*keys, "n", F.lit("broken").alias("kind"))
    read = broken.select(*[F.col(c) for c in good.columns[:-2]], F.lit(got.rows).cast("long").alias("n"), F.lit("read").alias("kind"))
    return good.unionByName(broken).unionByName(read)


@query("csv_malformed_counts", """
SELECT p_size, COUNT(*) AS n, 'good' AS kind FROM part WHERE p_partkey % 53 <> 7 GROUP BY 1
UNION ALL SELECT NULL, COUNT(*), 'broken' FROM part WHERE p_partkey % 53 = 7
UNION ALL SELECT NULL, COUNT(*), 'read' FROM part
""")
def q_csv_malformed_counts(spark, sf):
    # CSV lines with a text where the price should be; the price isn't used
    # below, and the lines count as broken all the same
    base = _scratch(spark, "csv-lines")
    price = F.when(F.col("p_partkey") % 53 == 7, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string"))
    fx.table(spark, sf, "part").select("p_partkey", "p_size", price.alias("price")).write.csv(f"{base}/raw", header=True)
    got = ingest(spark, f"{base}/raw", "p_partkey long, p_size int, price double", f"{base}/out", "csv")
    return _with_counts(period_counts(got.good, ["p_size"], "n").withColumn("kind", F.lit("good")), got)


@query("positional_names", f"""
WITH {fx.SQL_IND} SELECT CAST(year(period) AS INTEGER) AS yr, COUNT(*) AS n, {S.rnd('AVG(indicator)', 6)} AS mean FROM ind GROUP BY 1
""")
def q_positional_names(spark, sf):
    # a sheet whose header says nothing of use: names are given by position
    path = _scratch(spark, "sheet")
    fx.monthly_indicator(spark, sf).select(F.year("period").alias("Unnamed 0"), F.month("period").alias("Unnamed 1"),
                                           F.col("indicator").alias("x.y")).write.csv(path, header=True)
    sheet = read_indicator(spark, path, "a int, b int, c double", columns=["yr", "mon", "value"])
    return sheet.groupBy("yr").agg(F.count("mon").alias("n"), F.avg("value").alias("mean")).select("yr", "n", r("mean", 6))


@query("csv_indicator_corr", f"""
WITH {fx.SQL_IND},
cases AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
  COUNT(*) AS case_count FROM orders GROUP BY 1, 2),
j AS (SELECT * FROM cases JOIN (SELECT CAST(year(period) AS INTEGER) AS year,
  CAST(month(period) AS INTEGER) AS month, indicator FROM ind) USING (year, month))
SELECT CAST(regr_count(indicator, case_count) AS BIGINT) AS n,
  {S.rnd(S.corr('regr_sxx(indicator, case_count)', 'regr_syy(indicator, case_count)', 'regr_sxy(indicator, case_count)'))} AS corr
FROM j
""")
def q_csv_indicator_corr(spark, sf):
    # The monthly indicator is written as a header CSV in the layout of a
    # published series (Year, Period 'M01'..'M12', Value) and read back typed.
    path = _scratch(spark, "indicator")
    ind = fx.monthly_indicator(spark, sf).select(
        F.year("period").alias("Year"), F.concat(F.lit("M"), zero_pad(F.month("period"), 2)).alias("Period"),
        F.col("indicator").alias("Value"))
    write_table(ind, path, "csv")
    back = read_indicator(spark, path, "Year int, Period string, Value double")
    back = back.select(F.col("Year").alias("year"), period_number("Period").alias("month"),
                       F.col("Value").alias("indicator"))
    cases = period_counts(fx.fact_b(spark, sf), [F.year("o_orderdate").alias("year"),
                                                 F.month("o_orderdate").alias("month")], "case_count")
    j = cases.join(back, ["year", "month"], "inner")
    return correlation_by(j, None, "case_count", "indicator").select("n", r("corr"))


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
