"""Cost and profitability (X1-X4).

The monthly P&L stitches three facts by aggregating each to month grain
first and joining the month tables (bounded by the calendar), never the
raw facts to each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.calendar import year_month
from tillroll.functions.numeric import money, ratio
from tillroll.operators._sales import measure


def pnl_monthly(sales: DataFrame, purchases: DataFrame, labor: DataFrame) -> DataFrame:
    rev = sales.groupBy(year_month("date").alias("ym")).agg(measure(sales, "_rev")).withColumn("_r", F.round("_rev", 2)).drop("_rev")
    cogs = purchases.groupBy(year_month("date").alias("ym")).agg(F.round(F.sum("total_cost"), 2).alias("_c"))
    lab = labor.groupBy(year_month("date").alias("ym")).agg(
        F.round(F.sum("labor_cost"), 2).alias("_l"), F.round(F.sum("hours_worked"), 1).alias("_h"))
    j = rev.join(cogs, "ym", "left").join(lab, "ym", "left")
    c, l, h = (F.coalesce(F.col(x), F.lit(0)) for x in ("_c", "_l", "_h"))
    profit = F.col("_r") - c - l
    return j.select(
        "ym", money("_r").alias("revenue"), money(c).alias("cogs"), money(l).alias("labor_cost"),
        money(profit).alias("operating_profit"), ratio(profit, "_r", 1, 100).alias("operating_margin_pct"),
        h.cast("double").alias("labor_hours"), ratio("_r", h, 2).alias("revenue_per_labor_hour"),
    ).orderBy("ym")


def cost_by_supplier(purchases: DataFrame) -> DataFrame:
    a = purchases.groupBy("ingredient_category", "supplier", F.year("date").alias("year")).agg(
        F.sum("qty").alias("total_qty"), F.sum("total_cost").alias("_spend"),
        F.sum("unit_cost").alias("_uc"), F.count("unit_cost").alias("_n"))
    return a.select("ingredient_category", "supplier", "year", "total_qty", money("_spend").alias("total_spend"),
                    ratio("_uc", "_n", 2).alias("avg_unit_cost")).orderBy("ingredient_category", "year")


def cost_inflation(purchases: DataFrame, base: str = "min") -> DataFrame:
    """Average unit cost per (ingredient, year) and % change against a base:
    ``base="min"`` the lowest yearly average (what the reference computes),
    ``base="first"`` the first year's average."""
    a = purchases.groupBy("ingredient_category", F.year("date").alias("year")).agg(
        F.sum("unit_cost").alias("_uc"), F.count("unit_cost").alias("_n"))
    avg = F.try_divide(F.col("_uc").cast("double"), F.col("_n").cast("double"))
    a = a.withColumn("_avg", avg)
    w = Window.partitionBy("ingredient_category")
    if base == "min":
        b = F.min("_avg").over(w)
    elif base == "first":
        b = F.first("_avg").over(w.orderBy("year").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    else:
        raise ValueError(base)
    return a.select("ingredient_category", "year", ratio("_uc", "_n", 2).alias("avg_unit_cost"),
                    ratio(F.col("_avg") - b, b, 1, 100).alias("pct_increase_from_2022_base")) \
        .orderBy("ingredient_category", "year")


def labor_by_role(labor: DataFrame) -> DataFrame:
    a = labor.groupBy("role").agg(
        F.countDistinct("employee_id").alias("headcount"), F.sum("hours_worked").alias("_h"),
        F.sum("labor_cost").alias("_cost"), F.sum("hourly_rate").alias("_rate"), F.count("hourly_rate").alias("_n"))
    return a.select("role", "headcount", money("_h", 0).alias("total_hours"), money("_cost").alias("total_labor_cost"),
                    ratio("_rate", "_n", 2).alias("avg_hourly_rate"),
                    ratio("_cost", "_h", 2).alias("effective_hourly_rate")).orderBy(F.desc("total_labor_cost"))
