"""Materialisable restaurant marts (M1-M5) and their reconciliation (M6).

Marts are plain aggregates at a fixed grain. ``mart_cube`` makes all five
and the fact's own total from one scan: GROUPING SETS emit a line once per
mart, at the mart's grain and order (the daily mart also by reservation), so
the partial aggregate collapses lines before the shuffle and a distinct
count becomes a count of rows. ``plans.pipelines`` writes the cube once,
split by mart."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.calendar import weekday_name, year_month
from tillroll.functions.numeric import money, ratio
from tillroll.operators._sales import measure, measures, order_grain


class Mart(NamedTuple):
    keys: dict[str, Column]   # grain
    sums: tuple[str, ...]     # measures besides revenue
    columns: list             # output, over keys, checks, covers and measures


def _specs() -> dict[str, Mart]:
    year, month = F.year("date"), F.trunc("date", "month")
    item = {c: F.col(c) for c in ("category", "item", "is_alcohol")}
    shift = {c: F.col(c) for c in ("service", "hour")}
    revenue, avg_check = money("_rev").alias("revenue"), ratio("_rev", "checks", 2)
    return {
        "category_monthly": Mart({"_m": month, "category": item["category"], "is_alcohol": item["is_alcohol"]}, ("_qty",),
                                 [year_month("_m").alias("year_month"), F.year("_m").alias("year"), F.month("_m").alias("month"), "category",
                                  "is_alcohol", F.col("_qty").alias("items_sold"), revenue, "checks"]),
        "item_performance": Mart({"year": year, **item}, ("_qty", "_up", "_upn"),
                                 ["year", "category", "item", "is_alcohol", F.col("checks").alias("times_ordered"),
                                  F.col("_qty").alias("items_sold"), revenue, ratio("_up", "_upn", 2).alias("avg_price")]),
        "hourly_heatmap": Mart({"day_of_week": weekday_name("date"), **shift}, (),
                               ["day_of_week", "service", "hour", "checks", revenue, avg_check.alias("avg_revenue")]),
        "server_performance": Mart({"year": year, "server_id": F.col("server_id")}, ("_alc",),
                                   ["year", "server_id", "checks", revenue, money("_alc").alias("alcohol_rev"), avg_check.alias("avg_check"),
                                    ratio("_alc", "_rev", 1, 100).alias("alcohol_pct")]),
        "daily_summary": Mart({"date": F.col("date"), "service": F.col("service")}, ("_alc", "_food"),
                              ["date", "service", "checks", "covers", revenue, money("_alc").alias("alcohol_rev"),
                               money("_food").alias("food_rev"), avg_check.alias("avg_check")]),
    }


def _one(sales: DataFrame, name: str) -> DataFrame:
    """One mart on its own."""
    spec = _specs()[name]
    keyed = sales.withColumns({k: c for k, c in spec.keys.items() if k not in sales.columns})
    a = keyed.groupBy(*spec.keys).agg(F.countDistinct("order_id").alias("checks"), *measures(sales, "_rev", *spec.sums))
    return a.select(*spec.columns)


def mart_category_monthly(sales: DataFrame) -> DataFrame:
    return _one(sales, "category_monthly")


def mart_item_performance(sales: DataFrame) -> DataFrame:
    return _one(sales, "item_performance")


def mart_hourly_heatmap(sales: DataFrame) -> DataFrame:
    return _one(sales, "hourly_heatmap")


def mart_server_year(sales: DataFrame) -> DataFrame:
    return _one(sales, "server_performance")


def mart_daily_service(sales: DataFrame) -> DataFrame:
    a = order_grain(sales, ["date", "service"]).groupBy("date", "service").agg(
        F.countDistinct("order_id").alias("checks"), F.countDistinct("reservation_id").alias("covers"),
        *[F.sum(c).alias(c) for c in ("_rev", "_alc", "_food")])
    return a.select(*_specs()["daily_summary"].columns)


MARTS = {
    "category_monthly": mart_category_monthly,
    "item_performance": mart_item_performance,
    "hourly_heatmap": mart_hourly_heatmap,
    "server_performance": mart_server_year,
    "daily_summary": mart_daily_service,
}
FACT = "fact"  # the cube's row with the total over all lines


def mart_cube(sales: DataFrame, counts: bool = True) -> DataFrame:
    """Rows of all marts, told apart by ``mart``, before rounding: keys,
    checks, covers and measures; and one row ``fact`` with the total of the
    fact, its own grouping set. One scan of the fact.

    Only the two distinct counts need order and reservation ids in the
    grouping. For readers of the measures alone (``counts`` False) lines
    collapse to the marts' own grains at once; the rows and measures are the
    same."""
    specs = _specs()
    keys = {k: c for spec in specs.values() for k, c in spec.keys.items()}
    sums = ["_rev", *dict.fromkeys(s for spec in specs.values() for s in spec.sums)]
    ids = ["order_id", "reservation_id"] if counts else []
    cols = [*keys, *ids]
    sets = [(name, [*spec.keys, *ids[:1]]) for name, spec in specs.items()]
    if counts:
        sets.append(("daily_summary", [*specs["daily_summary"].keys, "reservation_id"]))
    sets.append((FACT, []))
    used = [c for c in ("line_total", "qty", "unit_price") if c in sales.columns]
    lines = sales.select(*ids, *used, *[c.alias(k) for k, c in keys.items()])
    g = lines.groupingSets([s for _, s in sets], *cols).agg(*measures(lines, *sums), F.grouping_id().alias("_gid"))
    # grouping_id: one bit per column that is rolled up, the first column highest
    number = [sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in chosen) for _, chosen in sets]
    name = F.lit(FACT)
    for (mart, _), gid in zip(sets, number, strict=True):
        name = F.when(F.col("_gid") == gid, mart).otherwise(name)
    if not counts:
        return g.select(name.alias("mart"), *keys, *sums)
    by_reservation = F.col("_gid") == number[-2]
    g = g.withColumn("mart", name)
    return g.groupBy("mart", *keys).agg(
        F.count(F.when(~by_reservation & F.col("order_id").isNotNull(), 1)).alias("checks"),
        F.count(F.when(by_reservation & F.col("reservation_id").isNotNull(), 1)).alias("covers"),
        *[F.sum(F.when(~by_reservation, F.col(s))).alias(s) for s in sums])


def mart_of(cube: DataFrame, name: str) -> DataFrame:
    """One mart out of the cube (or of the cube as written)."""
    return cube.filter(F.col("mart") == name).select(*_specs()[name].columns)


def dq_mart_reconcile(sales: DataFrame, marts: dict[str, DataFrame] | None = None) -> DataFrame:
    """Each mart's total revenue against an independent total of the fact.
    Mart revenue is rounded per row, so a mart reconciles when the gap is
    within half a cent per row. ``marts``: the written mart tables by name;
    ``sales`` is then the fact or its order-grain working table. Without,
    marts and total come from one scan (``mart_cube``)."""
    if marts is None:
        cube = mart_cube(sales, counts=False)
        a = cube.groupBy("mart").agg(F.count(F.lit(1)).alias("mart_rows"), F.sum(F.round("_rev", 2)).alias("_rounded"), F.sum("_rev").alias("_sum"))
        fact = F.max(F.when(F.col("mart") == FACT, F.col("_sum"))).over(Window.partitionBy())  # six rows
        u = a.withColumn("_fact", fact).filter(F.col("mart") != FACT).withColumn("_rev", F.col("_rounded"))
    else:
        parts = [m.agg(F.count(F.lit(1)).alias("mart_rows"),
                       F.sum(F.col("revenue").cast("decimal(18,2)")).alias("_rev")).withColumn("mart", F.lit(name))
                 for name, m in marts.items()]
        total = sales.agg(measure(sales, "_rev").alias("_fact"))  # one row beside the marts' rows
        u = reduce(DataFrame.unionByName, parts).unionByName(total, allowMissingColumns=True)
        u = u.withColumn("_fact", F.max("_fact").over(Window.partitionBy())).filter(F.col("mart").isNotNull())
    gap = F.coalesce("_rev", F.lit(0)) - F.round("_fact", 2)
    return u.select("mart", "mart_rows", money("_rev").alias("revenue"), money("_fact").alias("fact_revenue"),
                    money(gap).alias("difference"),
                    (F.abs(gap) <= F.col("mart_rows") * F.lit(0.005)).alias("reconciled")).orderBy("mart")
