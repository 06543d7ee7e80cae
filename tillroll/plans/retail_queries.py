"""Retail queries over the test data, each with its oracle SQL."""

from __future__ import annotations

from tillroll.operators import retail
from tillroll.plans.registry import register
from tillroll.plans.sqltext import M, Q
from tillroll.plans.views import with_views
from tillroll.sources.testdata import TestTables

FILTER_STORES = ("S001", "S002")
FILTER_FROM, FILTER_TO = "1996-01-01", "1997-12-31"

_PROFIT = f"""{M('SUM(revenue)')} AS revenue, {M('SUM(revenue) - SUM(cost)')} AS gross_profit,
  {Q('SUM(revenue) - SUM(cost)', 'SUM(revenue)', 1, 100)} AS margin_pct"""


def _sales(spark, d):
    return TestTables(spark, d).store_sales()


@register("retail_kpis", with_views(f"SELECT {_PROFIT}, CAST(SUM(units) AS BIGINT) AS units FROM store_sales", "store_sales"))
def q_retail_kpis(spark, d):
    return retail.retail_kpis(_sales(spark, d))


@register("retail_filtered", with_views(f"""
SELECT {_PROFIT}, CAST(SUM(units) AS BIGINT) AS units FROM store_sales
WHERE store_id IN ('{FILTER_STORES[0]}', '{FILTER_STORES[1]}') AND date >= DATE '{FILTER_FROM}' AND date <= DATE '{FILTER_TO}'""",
    "store_sales"))
def q_retail_filtered(spark, d):
    return retail.retail_kpis(_sales(spark, d), FILTER_STORES, FILTER_FROM, FILTER_TO)


@register("retail_by_store", with_views(f"""
SELECT store_id, {M('SUM(revenue)')} AS revenue, CAST(SUM(units) AS BIGINT) AS units,
  {Q('SUM(revenue)', 'SUM(SUM(revenue)) OVER ()', 1, 100)} AS revenue_share_pct FROM store_sales GROUP BY 1""", "store_sales"))
def q_retail_by_store(spark, d):
    return retail.retail_by_store(_sales(spark, d))


@register("retail_by_category", with_views(f"""
SELECT category, {M('SUM(revenue)')} AS revenue, CAST(SUM(units) AS BIGINT) AS units,
  {Q('SUM(revenue)', 'SUM(SUM(revenue)) OVER ()', 1, 100)} AS revenue_share_pct FROM store_sales GROUP BY 1""", "store_sales"))
def q_retail_by_category(spark, d):
    return retail.retail_by_category(_sales(spark, d))


@register("retail_gross_profit", with_views(f"""
SELECT store_id, {M('SUM(cost)')} AS cost, {_PROFIT} FROM store_sales GROUP BY 1""", "store_sales"))
def q_retail_gross_profit(spark, d):
    return retail.retail_gross_profit(_sales(spark, d))


@register("retail_monthly", with_views(f"""
SELECT store_id, CAST(date_trunc('month', date) AS DATE) AS month, {_PROFIT}, CAST(SUM(units) AS BIGINT) AS units
FROM store_sales GROUP BY 1, 2""", "store_sales"))
def q_retail_monthly(spark, d):
    return retail.retail_monthly(_sales(spark, d))


_MS = "SELECT store_id, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, SUM(revenue) AS rev, SUM(cost) AS cost FROM store_sales GROUP BY 1, 2, 3"


@register("retail_net_profit", with_views(f"""
WITH ms AS ({_MS}),
ex AS (SELECT store_id, year, month, rent + labor + utilities + misc_expenses AS exp FROM store_expenses),
j AS (SELECT COALESCE(ms.store_id, ex.store_id) AS store_id, ms.rev, ms.cost, ex.exp FROM ms FULL OUTER JOIN ex
      ON ms.store_id = ex.store_id AND ms.year = ex.year AND ms.month = ex.month),
a AS (SELECT store_id, SUM(rev) AS rev, SUM(cost) AS cost, SUM(exp) AS exp FROM j GROUP BY 1)
SELECT store_id, {M('rev')} AS revenue, {M('COALESCE(rev, 0) - COALESCE(cost, 0)')} AS gross_profit,
  CAST(exp AS BIGINT) AS expenses, {M('COALESCE(rev, 0) - COALESCE(cost, 0) - COALESCE(exp, 0)')} AS net_profit,
  {Q('COALESCE(rev, 0) - COALESCE(cost, 0) - COALESCE(exp, 0)', 'rev', 1, 100)} AS net_margin_pct FROM a""",
    "store_sales", "store_expenses"))
def q_retail_net_profit(spark, d):
    t = TestTables(spark, d)
    return retail.retail_net_profit(t.store_sales(), t.store_expenses())


@register("retail_labor_ratio", with_views(f"""
WITH ms AS ({_MS})
SELECT e.store_id, e.year, e.month, {M('ms.rev')} AS revenue, e.labor, {Q('e.labor', 'ms.rev', 1, 100)} AS labor_ratio_pct
FROM store_expenses e LEFT JOIN ms ON e.store_id = ms.store_id AND e.year = ms.year AND e.month = ms.month""",
    "store_sales", "store_expenses"))
def q_retail_labor_ratio(spark, d):
    t = TestTables(spark, d)
    return retail.retail_labor_ratio(t.store_sales(), t.store_expenses())


@register("retail_category_rank", with_views(f"""
WITH a AS (SELECT category, {_PROFIT}, CAST(SUM(units) AS BIGINT) AS units,
  {Q('SUM(revenue)', 'SUM(SUM(revenue)) OVER ()', 1, 100)} AS revenue_share_pct FROM store_sales GROUP BY 1)
SELECT *, CAST(DENSE_RANK() OVER (ORDER BY revenue DESC) AS INTEGER) AS revenue_rank,
  CAST(DENSE_RANK() OVER (ORDER BY margin_pct DESC) AS INTEGER) AS margin_rank FROM a""", "store_sales"))
def q_retail_category_rank(spark, d):
    return retail.retail_category_rank(_sales(spark, d))


@register("retail_yoy", with_views(f"""
WITH a AS (SELECT CAST(year(date) AS INTEGER) AS year, SUM(revenue) AS rev FROM store_sales GROUP BY 1)
SELECT year, {M('rev')} AS revenue, {M('LAG(rev) OVER (ORDER BY year)')} AS prev_revenue,
  {Q('rev - LAG(rev) OVER (ORDER BY year)', 'LAG(rev) OVER (ORDER BY year)', 1, 100)} AS yoy_pct FROM a""", "store_sales"))
def q_retail_yoy(spark, d):
    return retail.retail_yoy(_sales(spark, d))


@register("retail_seasonality", with_views(f"""
WITH a AS (SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, SUM(revenue) AS rev
           FROM store_sales GROUP BY 1, 2)
SELECT year, month, {M('rev')} AS revenue,
  {Q('rev * COUNT(*) OVER (PARTITION BY year)', 'SUM(rev) OVER (PARTITION BY year)', 4)} AS season_index,
  rev = MAX(rev) OVER (PARTITION BY year) AS is_peak_month FROM a""", "store_sales"))
def q_retail_seasonality(spark, d):
    return retail.retail_seasonality(_sales(spark, d))


_STATUS = "CASE WHEN units_in_stock <= reorder_threshold THEN 'Low Stock' WHEN units_in_stock > 150 THEN 'Overstocked' ELSE 'OK' END"


@register("retail_stock_status", with_views(f"""
SELECT store_id, category, product, units_in_stock, reorder_threshold, {_STATUS} AS status FROM store_inventory""",
    "store_inventory"))
def q_retail_stock_status(spark, d):
    return retail.retail_stock_status(TestTables(spark, d).store_inventory())


@register("retail_stock_value", with_views(f"""
SELECT {_STATUS} AS status, category, COUNT(*) AS products, CAST(SUM(units_in_stock) AS BIGINT) AS units,
  {M('SUM(units_in_stock * unit_cost)')} AS stock_value FROM store_inventory GROUP BY 1, 2""", "store_inventory"))
def q_retail_stock_value(spark, d):
    return retail.retail_stock_value(TestTables(spark, d).store_inventory())


@register("retail_expense_check", with_views("""
SELECT store_id, year, month, rent, labor, utilities, misc_expenses, rent + labor + utilities + misc_expenses AS computed_total,
  total_expenses AS stated_total, total_expenses <> rent + labor + utilities + misc_expenses AS mismatch
FROM store_expenses""", "store_expenses"))
def q_retail_expense_check(spark, d):
    return retail.retail_expense_check(TestTables(spark, d).store_expenses())


@register("retail_shelf_productivity", with_views(f"""
WITH r AS (SELECT category, SUM(revenue) AS rev FROM store_sales GROUP BY 1),
s AS (SELECT category, SUM(units_in_stock) AS units FROM store_inventory GROUP BY 1)
SELECT COALESCE(r.category, s.category) AS category, {M('r.rev')} AS revenue, CAST(s.units AS BIGINT) AS units_in_stock,
  {Q('r.rev', 's.units', 2)} AS revenue_per_stock_unit
FROM r FULL OUTER JOIN s ON r.category = s.category""", "store_sales", "store_inventory"))
def q_retail_shelf_productivity(spark, d):
    t = TestTables(spark, d)
    return retail.retail_shelf_productivity(t.store_sales(), t.store_inventory())


@register("retail_daily_mart", with_views("""
SELECT store_id, category, date, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(cost) AS DOUBLE) AS cost,
  CAST(SUM(units) AS BIGINT) AS units
FROM store_sales GROUP BY 1, 2, 3""", "store_sales"))
def q_retail_daily_mart(spark, d):
    """The mart keeps exact decimals; the report exposes them as DOUBLE."""
    m = retail.retail_daily_mart(_sales(spark, d))
    return m.select("store_id", "category", "date", m.revenue.cast("double").alias("revenue"),
                    m.cost.cast("double").alias("cost"), "units")
