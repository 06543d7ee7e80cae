"""Revenue overview (R1-R6): annual P&L, monthly trend, like-for-like YTD,
service share, weekday profile, month-over-same-month-last-year."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.calendar import iso_weekday, weekday_name, year_month
from tillroll.functions.numeric import money, ratio
from tillroll.operators._sales import measure, order_grain


def _period_summary(sales: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct checks and seatings plus additive sums per period. Lines are
    first collapsed to (keys, order, reservation), map-side; the distinct
    counts then expand rows of that grain, several times fewer than lines."""
    orders = order_grain(sales, keys, ("_disc",))
    return orders.groupBy(*keys).agg(
        F.countDistinct("order_id").alias("checks"), F.countDistinct("reservation_id").alias("covers"),
        *[F.sum(c).alias(c) for c in ("_rev", "_alc", "_food", "_n", "_disc")])


def rev_annual_pnl(sales: DataFrame) -> DataFrame:
    """Per year: checks, seatings ("covers"), gross / alcohol / food revenue,
    discounts (line_total x discount_pct, as the reference computes it),
    average line, shares and YoY growth on the rounded gross."""
    s = sales.withColumn("year", F.year("date"))
    a = _period_summary(s, ["year"])
    g = F.round("_rev", 2)
    a = a.select(
        "year", F.col("checks").alias("total_checks"), "covers",
        g.alias("_g"), F.round("_alc", 2).alias("_a"), F.round("_food", 2).alias("_f"),
        money("_disc").alias("discounts_given"), ratio("_rev", "_n", 2).alias("avg_line_value"))
    prev = F.lag("_g").over(Window.orderBy("year"))  # one row per year: bounded
    return a.select(
        "year", "total_checks", "covers", money("_g").alias("gross_revenue"),
        money("_a").alias("alcohol_revenue"), money("_f").alias("food_revenue"), "discounts_given",
        "avg_line_value", ratio("_a", "_g", 1, 100).alias("alcohol_pct"),
        ratio("_f", "_g", 1, 100).alias("food_pct"),
        ratio(F.col("_g") - prev, prev, 1, 100).alias("yoy_growth_pct"),
    ).orderBy("year")


def rev_monthly_trend(sales: DataFrame) -> DataFrame:
    s = sales.withColumn("_m", F.trunc("date", "month"))
    a = _period_summary(s, ["_m"])
    return a.select(
        year_month("_m").alias("year_month"), F.year("_m").alias("year"), F.month("_m").alias("month"),
        "checks", "covers", money("_rev").alias("revenue"), money("_alc").alias("alcohol_rev"),
        money("_food").alias("food_rev"), ratio("_rev", "_n", 2).alias("avg_line_value"),
    ).orderBy("year_month")


def rev_ytd_compare(sales: DataFrame, years=(2025, 2026), cutoff: str = "04-25") -> DataFrame:
    """Same calendar window (1 Jan - cutoff) in each year. The exact test is
    on month/day; a range on the raw date is added so the scan can skip
    files and row groups outside the years."""
    mm, dd = (int(x) for x in cutoff.split("-"))
    lo, hi = dt.date(min(years), 1, 1), dt.date(max(years), 12, 31)
    s = (sales.filter(F.col("date").between(F.lit(lo), F.lit(hi)))
         .filter(F.year("date").isin(list(years)) & ((F.month("date") * 100 + F.dayofmonth("date")) <= mm * 100 + dd))
         .withColumn("year", F.year("date")))
    a = _period_summary(s, ["year"])
    return a.select("year", "checks", "covers", money("_rev").alias("revenue"),
                    ratio("_rev", "_n", 2).alias("avg_line_value")).orderBy("year")


def rev_by_service_share(sales: DataFrame) -> DataFrame:
    orders = order_grain(sales.withColumn("year", F.year("date")), ["service", "year"])
    a = orders.groupBy("service", "year").agg(F.countDistinct("order_id").alias("checks"), F.sum("_rev").alias("_rev"))
    tot = F.sum("_rev").over(Window.partitionBy("year"))  # few rows per year
    return a.select("service", "year", "checks", money("_rev").alias("revenue"),
                    ratio("_rev", tot, 1, 100).alias("revenue_share_pct")).orderBy("year", F.desc("revenue"))


def rev_by_weekday(sales: DataFrame) -> DataFrame:
    a = (order_grain(sales, ["date"]).groupBy(weekday_name("date").alias("day_of_week"), iso_weekday("date").alias("sort_order"))
         .agg(F.countDistinct("order_id").alias("checks"), F.sum("_rev").alias("_rev"),
              F.sum("_n").alias("_n"), F.countDistinct("date").alias("days_open")))
    return a.select("day_of_week", "sort_order", "checks", money("_rev").alias("revenue"),
                    ratio("_rev", "_n", 2).alias("avg_line_value"), "days_open").orderBy("sort_order")


def rev_month_yoy(sales: DataFrame) -> DataFrame:
    """Each month's revenue next to the same month one year earlier (NULL
    when that month has no sales). LAG over the years of each calendar
    month, on the monthly aggregate: one pass, at most 12 partitions of a
    few dozen rows."""
    m = (sales.groupBy(F.year("date").alias("year"), F.month("date").alias("month"))
         .agg(measure(sales, "_rev")))
    w = Window.partitionBy("month").orderBy("year")
    prev = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("_rev").over(w))
    return m.select("year", "month", money("_rev").alias("revenue"), money(prev).alias("prev_year_revenue"),
                    ratio(F.col("_rev") - prev, prev, 1, 100).alias("yoy_pct")).orderBy("year", "month")
