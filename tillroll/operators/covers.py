"""Covers and table performance (C1-C5).

"seatings" = distinct reservations, "covers" = guests (party sizes). Lines
are pre-aggregated to reservation grain before meeting reservations, so a
party is counted once (the ``_fanout`` variant reproduces the reference's
per-line count without materialising the fan-out join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.calendar import iso_weekday, weekday_name
from tillroll.functions.numeric import money, ratio
from tillroll.functions.windows import grand_total
from tillroll.operators._sales import measures


def covers_capacity(reservations: DataFrame, seats: int = 65) -> DataFrame:
    a = reservations.groupBy(weekday_name("date").alias("day_of_week"), iso_weekday("date").alias("_dow"),
                             "service").agg(
        F.countDistinct("date").alias("days_in_sample"), F.sum("party_size").alias("total_covers"))
    return a.select(
        "day_of_week", "service", "days_in_sample", "total_covers",
        ratio("total_covers", "days_in_sample", 1).alias("avg_covers_per_day"),
        ratio("total_covers", F.col("days_in_sample") * seats, 1, 100).alias("capacity_utilisation_pct"),
        "_dow").orderBy("_dow", "service").drop("_dow")


def _per_reservation(sales: DataFrame) -> DataFrame:
    return sales.groupBy("reservation_id").agg(*measures(sales, "_rev", "_lines"))


def covers_revenue_per_cover(reservations: DataFrame, sales: DataFrame, fanout: bool = False) -> DataFrame:
    per_res = _per_reservation(sales)
    j = reservations.select("reservation_id", "service", "date", "party_size").join(per_res, "reservation_id")
    covers = F.col("party_size") * F.col("_lines") if fanout else F.col("party_size")
    a = j.groupBy("service", weekday_name("date").alias("day_of_week")).agg(
        F.sum(covers).alias("total_covers"), F.sum("_rev").alias("_rev"))
    return a.select("service", "day_of_week", "total_covers", money("_rev").alias("total_revenue"),
                    ratio("_rev", "total_covers", 2).alias("revenue_per_cover")).orderBy(F.desc("revenue_per_cover"))


def covers_by_channel(reservations: DataFrame) -> DataFrame:
    a = reservations.groupBy("res_type").agg(
        F.countDistinct("reservation_id").alias("seatings"), F.sum("party_size").alias("total_covers"),
        F.count("party_size").alias("_n"))
    return a.select("res_type", "seatings", "total_covers",
                    ratio("total_covers", "_n", 1).alias("avg_party_size"))


def covers_hourly(sales: DataFrame) -> DataFrame:
    a = sales.groupBy("service", "hour").agg(
        F.countDistinct("order_id").alias("checks"), *measures(sales, "_rev", "_n"))
    return a.select("service", "hour", "checks", money("_rev").alias("revenue"),
                    ratio("_rev", "_n", 2).alias("avg_line_value")).orderBy("service", "hour")


def covers_peak_windows(sales: DataFrame) -> DataFrame:
    """(weekday, hour) cells ranked by revenue with their share of total.
    At most 7 x 24 cells, so the rank window over all cells is bounded."""
    a = sales.groupBy(weekday_name("date").alias("day_of_week"), "hour").agg(
        F.countDistinct("order_id").alias("checks"), *measures(sales, "_rev"))
    total = grand_total(a, "_rev")
    out = a.select("day_of_week", "hour", "checks", money("_rev").alias("revenue"),
                   ratio("_rev", total, 1, 100).alias("revenue_share_pct"))
    return out.withColumn("revenue_rank", F.dense_rank().over(Window.orderBy(F.desc("revenue")))) \
        .orderBy("revenue_rank", "day_of_week", "hour")
