"""Guest analytics (G1-G6)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.numeric import money, ratio
from tillroll.functions.selection import cut, order_code, share_rank
from tillroll.functions.windows import grand_total


def _means():
    return [F.sum("total_visits").alias("_v"), F.count("total_visits").alias("_vn"),
            F.sum("avg_check").alias("_ac"), F.count("avg_check").alias("_acn"),
            F.sum("satisfaction").alias("_s"), F.count("satisfaction").alias("_sn"),
            F.sum("lifetime_value").alias("_ltv")]


def guest_segments(guests: DataFrame) -> DataFrame:
    a = guests.groupBy("segment").agg(F.count(F.lit(1)).alias("guests"), *_means())
    total = grand_total(a, "_ltv")
    return a.select("segment", "guests", ratio("_v", "_vn", 1).alias("avg_visits"),
                    ratio("_ac", "_acn", 2).alias("avg_check"), money("_ltv").alias("total_revenue"),
                    ratio("_ltv", total, 1, 100).alias("revenue_share_pct"),
                    ratio("_s", "_sn", 2).alias("avg_satisfaction")).orderBy(F.desc("total_revenue"))


def guest_by_town(guests: DataFrame) -> DataFrame:
    a = guests.groupBy("town").agg(F.count(F.lit(1)).alias("guests"), *_means())
    return a.select("town", "guests", money("_ltv").alias("total_revenue"), ratio("_ac", "_acn", 2).alias("avg_check"),
                    ratio("_s", "_sn", 2).alias("avg_satisfaction")).orderBy(F.desc("total_revenue"))


def guest_cohorts(guests: DataFrame) -> DataFrame:
    a = guests.groupBy(F.year("first_visit_date").alias("join_year")).agg(F.count(F.lit(1)).alias("new_guests"), *_means())
    return a.select("join_year", "new_guests", ratio("_ac", "_acn", 2).alias("avg_check"),
                    ratio("_v", "_vn", 1).alias("avg_visits_to_date")).orderBy("join_year")


def guest_pareto(guests: DataFrame, share: float = 0.20) -> DataFrame:
    """Top ``share`` of guests by lifetime value vs the rest. The value at
    rank ROUND(n * share) is found by digit histograms over (value, count)
    (``functions.selection``): no sort, no checkpoint, and no job before the
    result is asked for. Guests tied at the cut have equal values, so the
    sums do not depend on who of them is in; ``selection.split_top`` names
    them."""
    code = order_code(guests, "lifetime_value")
    counted = (guests.groupBy("lifetime_value").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("s", (F.col("lifetime_value") * F.col("n")).cast("decimal(38,4)")))
    scale = getattr(guests.schema["lifetime_value"].dataType, "scale", 0)
    at = cut(counted, code, share_rank(share))
    value = (F.col("_cut").cast("decimal(38,0)") / F.lit(Decimal(10) ** scale)).cast("decimal(38,4)")
    top = F.coalesce(F.col("s_above") + F.when(F.col("take") > 0, F.coalesce(value * F.col("take"), F.lit(0))).otherwise(0),
                     F.when(F.col("take") > 0, value * F.col("take"))).cast("decimal(38,4)")
    pct = int(round(share * 100))
    # a segment without any known value has no revenue
    rest = F.when(F.col("n_known") > F.col("want"), F.col("s_total") - F.coalesce(top, F.lit(0)))
    sides = F.array(F.struct(F.lit(f"Top {pct}% of guests").alias("segment"), F.col("want").alias("guests"), top.alias("_ltv")),
                    F.struct(F.lit(f"Bottom {100 - pct}% of guests").alias("segment"), (F.col("n_total") - F.col("want")).alias("guests"),
                             rest.cast("decimal(38,4)").alias("_ltv")))
    a = at.select("s_total", F.explode(sides).alias("g")).filter("g.guests > 0")
    return a.select("g.segment", "g.guests", money("g._ltv").alias("revenue"), ratio("g._ltv", "s_total", 1, 100).alias("revenue_share_pct"))


def guest_segment_ratio(guests: DataFrame) -> DataFrame:
    """Value per guest by segment, the segment's share of the guest base,
    and its value per guest as a multiple of the lowest segment's."""
    a = guests.groupBy("segment").agg(F.count(F.lit(1)).alias("guests"), F.sum("lifetime_value").alias("_ltv"))
    a = a.withColumn("_ph", F.col("_ltv").cast("double") / F.col("guests").cast("double"))
    n = grand_total(a, "guests")
    low = F.min("_ph").over(Window.partitionBy())  # one row per segment
    return a.select("segment", "guests", ratio("_ltv", "guests", 2).alias("value_per_guest"),
                    ratio("guests", n, 1, 100).alias("guest_share_pct"),
                    ratio("_ph", low, 2).alias("value_index_vs_lowest")).orderBy(F.desc("value_per_guest"))


def guest_town_rank(guests: DataFrame) -> DataFrame:
    """Towns ranked by guest revenue (one row per town, so the ranking
    window sees a bounded number of rows)."""
    a = guests.groupBy("town").agg(F.count(F.lit(1)).alias("guests"), F.sum("lifetime_value").alias("_ltv"))
    out = a.select("town", "guests", money("_ltv").alias("total_revenue"))
    return out.withColumn("revenue_rank", F.dense_rank().over(Window.orderBy(F.desc("total_revenue")))) \
        .orderBy("revenue_rank", "town")
