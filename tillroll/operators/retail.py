"""Retail dashboard metrics (T1-T14) for a few stores.

Dashboard controls (store list, date range) are operator parameters that
become filters on the raw columns, so they reach the Parquet scan. Sales
and expenses meet only after both are aggregated to (store, year, month).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.numeric import money, ratio
from tillroll.functions.windows import grand_total, previous

# Stock rule inferred from the inventory export.
OVERSTOCK_ABOVE = 150


def retail_daily_mart(sales: DataFrame) -> DataFrame:
    """(store, category, date) grain with additive revenue, cost, units: the
    dashboard's working table. Every retail operator only sums these three
    over store / category / date keys, so on this mart it gives the answer
    of the raw lines (revenue is kept to the cent and cost to 1/100 cent, as
    the exports state them), and dashboard filters re-aggregate a table that
    is orders of magnitude smaller."""
    return sales.groupBy("store_id", "category", "date").agg(
        F.sum("revenue").cast("decimal(38,2)").alias("revenue"), F.sum("cost").cast("decimal(38,4)").alias("cost"),
        F.sum("units").alias("units"))


def retail_filter(sales: DataFrame, stores=None, date_from: str | dt.date | None = None,
                  date_to: str | dt.date | None = None) -> DataFrame:
    if stores is not None:  # an empty list selects no store
        sales = sales.filter(F.col("store_id").isin(list(stores)) if stores else F.lit(False))
    if date_from is not None:
        sales = sales.filter(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        sales = sales.filter(F.col("date") <= F.lit(date_to).cast("date"))
    return sales


def _money_aggs():
    return [F.sum("revenue").alias("_rev"), F.sum("cost").alias("_cost"), F.sum("units").alias("units")]


def _profit_cols():
    gp = F.col("_rev") - F.col("_cost")
    return [money("_rev").alias("revenue"), money(gp).alias("gross_profit"), ratio(gp, "_rev", 1, 100).alias("margin_pct")]


def retail_kpis(sales: DataFrame, stores=None, date_from=None, date_to=None) -> DataFrame:
    a = retail_filter(sales, stores, date_from, date_to).agg(*_money_aggs())
    return a.select(*_profit_cols(), "units")


def retail_by_store(sales: DataFrame, stores=None, date_from=None, date_to=None) -> DataFrame:
    a = retail_filter(sales, stores, date_from, date_to).groupBy("store_id").agg(*_money_aggs())
    return a.select("store_id", money("_rev").alias("revenue"), "units",
                    ratio("_rev", grand_total(a, "_rev"), 1, 100).alias("revenue_share_pct")).orderBy(F.desc("revenue"))


def retail_by_category(sales: DataFrame, stores=None, date_from=None, date_to=None) -> DataFrame:
    a = retail_filter(sales, stores, date_from, date_to).groupBy("category").agg(*_money_aggs())
    return a.select("category", money("_rev").alias("revenue"), "units",
                    ratio("_rev", grand_total(a, "_rev"), 1, 100).alias("revenue_share_pct")).orderBy(F.desc("revenue"))


def retail_gross_profit(sales: DataFrame, stores=None, date_from=None, date_to=None) -> DataFrame:
    a = retail_filter(sales, stores, date_from, date_to).groupBy("store_id").agg(*_money_aggs())
    return a.select("store_id", money("_cost").alias("cost"), *_profit_cols()).orderBy(F.desc("gross_profit"))


def retail_monthly(sales: DataFrame, stores=None, date_from=None, date_to=None) -> DataFrame:
    a = retail_filter(sales, stores, date_from, date_to).groupBy("store_id", F.trunc("date", "month").alias("month")) \
        .agg(*_money_aggs())
    return a.select("store_id", "month", *_profit_cols(), "units").orderBy("store_id", "month")


def _monthly_sales(sales: DataFrame) -> DataFrame:
    return sales.groupBy("store_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum("revenue").alias("_rev"), F.sum("cost").alias("_cost"))


def expense_total(expenses: DataFrame):
    return F.col("rent") + F.col("labor") + F.col("utilities") + F.col("misc_expenses")


def retail_net_profit(sales: DataFrame, expenses: DataFrame) -> DataFrame:
    """Gross profit minus operating expenses per store."""
    ms = _monthly_sales(sales)
    ex = expenses.select("store_id", "year", "month", expense_total(expenses).alias("_exp"))
    j = ms.join(ex, ["store_id", "year", "month"], "full")
    a = j.groupBy("store_id").agg(F.sum("_rev").alias("_rev"), F.sum("_cost").alias("_cost"), F.sum("_exp").alias("_exp"))
    gp = F.coalesce(F.col("_rev"), F.lit(0)) - F.coalesce(F.col("_cost"), F.lit(0))
    net = gp - F.coalesce(F.col("_exp"), F.lit(0))
    return a.select("store_id", money("_rev").alias("revenue"), money(gp).alias("gross_profit"),
                    F.col("_exp").alias("expenses"), money(net).alias("net_profit"),
                    ratio(net, "_rev", 1, 100).alias("net_margin_pct")).orderBy(F.desc("net_profit"))


def retail_labor_ratio(sales: DataFrame, expenses: DataFrame) -> DataFrame:
    ms = _monthly_sales(sales)
    j = expenses.select("store_id", "year", "month", "labor").join(ms, ["store_id", "year", "month"], "left")
    return j.select("store_id", "year", "month", money("_rev").alias("revenue"), "labor",
                    ratio("labor", "_rev", 1, 100).alias("labor_ratio_pct")).orderBy("store_id", "year", "month")


def retail_category_rank(sales: DataFrame) -> DataFrame:
    """Categories by revenue (share, rank) next to their margin rank: volume
    vs margin. One row per category, so the rank windows are bounded."""
    a = sales.groupBy("category").agg(*_money_aggs())
    out = a.select("category", *_profit_cols(), "units",
                   ratio("_rev", grand_total(a, "_rev"), 1, 100).alias("revenue_share_pct"))
    return (out.withColumn("revenue_rank", F.dense_rank().over(Window.orderBy(F.desc("revenue"))))
            .withColumn("margin_rank", F.dense_rank().over(Window.orderBy(F.desc("margin_pct"))))
            .orderBy("revenue_rank", "category"))


def retail_yoy(sales: DataFrame) -> DataFrame:
    a = sales.groupBy(F.year("date").alias("year")).agg(F.sum("revenue").alias("_rev"))
    prev = previous("_rev", "year")
    return a.select("year", money("_rev").alias("revenue"), money(prev).alias("prev_revenue"),
                    ratio(F.col("_rev") - prev, prev, 1, 100).alias("yoy_pct")).orderBy("year")


def retail_seasonality(sales: DataFrame) -> DataFrame:
    """Month revenue / mean monthly revenue of its year, and the peak month."""
    a = sales.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(F.sum("revenue").alias("_rev"))
    w = Window.partitionBy("year")
    return a.select("year", "month", money("_rev").alias("revenue"),
                    ratio(F.col("_rev") * F.count(F.lit(1)).over(w), F.sum("_rev").over(w), 4).alias("season_index"),
                    (F.col("_rev") == F.max("_rev").over(w)).alias("is_peak_month")).orderBy("year", "month")


def stock_status(units="units_in_stock", threshold="reorder_threshold", over: int = OVERSTOCK_ABOVE):
    u = F.col(units)
    return (F.when(u <= F.col(threshold), F.lit("Low Stock")).when(u > over, F.lit("Overstocked"))
            .otherwise(F.lit("OK")))


def retail_stock_status(inventory: DataFrame, over: int = OVERSTOCK_ABOVE) -> DataFrame:
    return inventory.select("store_id", "category", "product", "units_in_stock", "reorder_threshold",
                            stock_status(over=over).alias("status"))


def retail_stock_value(inventory: DataFrame, over: int = OVERSTOCK_ABOVE) -> DataFrame:
    """Cash tied up in stock (units x unit cost) by status and category."""
    inv = inventory.withColumn("status", stock_status(over=over))
    a = inv.groupBy("status", "category").agg(
        F.count(F.lit(1)).alias("products"), F.sum("units_in_stock").alias("units"),
        F.sum(F.col("units_in_stock") * F.col("unit_cost")).alias("_val"))
    return a.select("status", "category", "products", "units", money("_val").alias("stock_value")) \
        .orderBy(F.desc("stock_value"), "status", "category")


def retail_expense_check(expenses: DataFrame) -> DataFrame:
    """Recompute the expense total; where the export states one, flag rows
    whose stated total disagrees."""
    tot = expense_total(expenses)
    cols = ["store_id", "year", "month", "rent", "labor", "utilities", "misc_expenses", tot.alias("total_expenses")]
    if "total_expenses" in expenses.columns:
        cols = cols[:-1] + [tot.alias("computed_total"), F.col("total_expenses").alias("stated_total"),
                            (tot != F.col("total_expenses")).alias("mismatch")]
    return expenses.select(*cols).orderBy("store_id", "year", "month")


def retail_shelf_productivity(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Revenue per unit on the shelf by category (lowest first)."""
    rev = sales.groupBy("category").agg(F.sum("revenue").alias("_rev"))
    stock = inventory.groupBy("category").agg(F.sum("units_in_stock").alias("units_in_stock"))
    j = rev.join(stock, "category", "full")
    return j.select("category", money("_rev").alias("revenue"), "units_in_stock",
                    ratio("_rev", "units_in_stock", 2).alias("revenue_per_stock_unit")) \
        .orderBy(F.asc_nulls_last("revenue_per_stock_unit"), "category")
