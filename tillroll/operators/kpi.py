"""Flat daily KPI table (K1) and the day-type roll-up (K2).

Each fact is aggregated to date grain on its own, then the date tables are
joined (a few thousand days, regardless of fact size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.calendar import day_type, week_number, weekday_name
from tillroll.functions.numeric import money, ratio
from tillroll.operators._sales import checks_and_seatings


def _per_service(sales: DataFrame, fanout: bool = False) -> DataFrame:
    """(date, service): distinct checks, distinct seatings, guests and the
    revenue split, from one scan. Guests count each reservation's party once,
    or once per sales line with ``fanout`` (the reference's SUM over lines)."""
    if fanout:
        a = checks_and_seatings(sales, ["date", "service"], ("_party_lines",))
        return a.withColumn("total_guests", F.col("_party_lines").cast("bigint"))
    return checks_and_seatings(sales, ["date", "service"], guests=True)


def kpi_daily(sales: DataFrame, labor: DataFrame, purchases: DataFrame, fanout: bool = False) -> DataFrame:
    """One row per trading date: checks and seatings summed over services
    (an order seen in two services counts twice, as in the reference), guests
    = party sizes of distinct reservations, revenue split, labour, COGS,
    operating profit and margin."""
    daily = _per_service(sales, fanout).groupBy("date").agg(
        F.sum("checks").alias("checks"), F.sum("covers").alias("covers"), F.sum("total_guests").alias("total_guests"),
        F.sum("_rev").alias("_rev"), F.sum("_alc").alias("_alc"), F.sum("_food").alias("_food"))
    lab = labor.groupBy("date").agg(F.sum("labor_cost").alias("_l"), F.sum("hours_worked").alias("_h"))
    cogs = purchases.groupBy("date").agg(F.sum("total_cost").alias("_c"))
    j = daily.join(lab, "date", "left").join(cogs, "date", "left")
    lc, cc = F.coalesce(F.col("_l"), F.lit(0)), F.coalesce(F.col("_c"), F.lit(0))
    profit = F.col("_rev") - lc - cc
    return j.select(
        "date", F.year("date").alias("year"), F.month("date").alias("month"), week_number("date").alias("week_num"),
        weekday_name("date").alias("day_of_week"), day_type("date").alias("day_type"),
        "checks", "covers", "total_guests", money("_rev").alias("revenue"), money("_alc").alias("alcohol_revenue"),
        money("_food").alias("food_revenue"), ratio("_alc", "_rev", 1, 100).alias("alcohol_pct"),
        ratio("_rev", "covers", 2).alias("revenue_per_cover"),
        F.coalesce(F.round("_l", 2), F.lit(0)).cast("double").alias("labor_cost"),
        F.coalesce(F.round("_h", 1), F.lit(0)).cast("double").alias("hours_worked"),
        F.coalesce(F.round("_c", 2), F.lit(0)).cast("double").alias("cogs"),
        money(profit).alias("operating_profit"), ratio(profit, "_rev", 1, 100).alias("margin_pct"),
    ).orderBy("date")


def kpi_day_type(daily: DataFrame) -> DataFrame:
    """Trading days and revenue by day type and weekday, from ``kpi_daily``."""
    a = daily.groupBy("day_type", "day_of_week").agg(
        F.count(F.lit(1)).alias("days"), F.sum(F.col("revenue").cast("decimal(18,2)")).alias("_rev"))
    return a.select("day_type", "day_of_week", "days", money("_rev").alias("revenue"),
                    ratio("_rev", "days", 2).alias("avg_daily_revenue")).orderBy("day_type", "day_of_week")
