"""Menu and product performance (I1-I5).

Fact lines are aggregated to item grain *before* the dimension join, so the
join sees one row per item instead of every line (and a hot item is
collapsed by the partial aggregate, not shipped through the join).
Averages of dimension attributes over lines are kept exact as
SUM(attr * lines) / lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.numeric import fix, money, ratio
from tillroll.functions.windows import grand_total
from tillroll.operators._sales import measures


def _weighted(attr: str, n: str = "_lines"):
    """(sum of attr over lines, count of lines with attr) after a left join."""
    has = F.col(attr).isNotNull()
    return (F.when(has, F.col(attr) * F.col(n)).alias(f"_s_{attr}"),
            F.when(has, F.col(n)).otherwise(F.lit(0)).alias(f"_c_{attr}"))


def menu_category_margin(sales: DataFrame, menu: DataFrame) -> DataFrame:
    """Revenue, units, average COGS %, estimated gross profit and share of
    total by (category, alcohol flag); dim joined on (item, category)."""
    pre = sales.groupBy("item", "category", "is_alcohol").agg(
        *measures(sales, "_lines", "_qty", "_rev"))
    j = pre.join(menu.select("item", "category", "cogs_pct"), ["item", "category"], "left")
    s, c = _weighted("cogs_pct")
    a = (j.select("category", "is_alcohol", "_lines", "_qty", "_rev", s, c)
         .groupBy("category", "is_alcohol")
         .agg(F.sum("_lines").alias("line_items"), F.sum("_qty").alias("units_sold"), F.sum("_rev").alias("_rev"),
              F.sum("_s_cogs_pct").alias("_sc"), F.sum("_c_cogs_pct").alias("_cc")))
    avg_cogs = F.try_divide(F.col("_sc").cast("double"), F.col("_cc").cast("double"))
    total = grand_total(a, "_rev")
    return a.select(
        "category", "is_alcohol", "line_items", "units_sold", money("_rev").alias("revenue"),
        ratio("_sc", "_cc", 1, 100).alias("avg_cogs_pct"),
        fix(F.col("_rev").cast("double") * (F.lit(1.0) - avg_cogs), 2).alias("est_gross_profit"),
        ratio("_rev", total, 1, 100).alias("revenue_share_pct"),
    ).orderBy(F.desc("revenue"))


def _item_stats(sales: DataFrame, menu: DataFrame) -> DataFrame:
    """(category, item) grain with the dim joined on item only. Both sides
    have one row per item when they meet; an item that the dim holds k times
    counts k times, as in a line-level join."""
    pre = sales.groupBy("category", "item").agg(
        *measures(sales, "_lines", "_rev", "_up", "_upn"))
    dim = menu.groupBy("item").agg(F.count(F.lit(1)).alias("_k"), F.sum("gross_margin_pct").alias("_s"),
                                   F.count("gross_margin_pct").alias("_c"))
    k = F.coalesce("_k", F.lit(1))
    return pre.join(dim, "item", "left").select(
        "category", "item", "_lines", (F.col("_lines") * k).alias("_n"), (F.col("_rev") * k).alias("_rev"),
        (F.col("_up") * k).alias("_up"), (F.col("_upn") * k).alias("_upn"),
        (F.col("_s") * F.col("_lines")).alias("_s_gross_margin_pct"), (F.col("_c") * F.col("_lines")).alias("_c_gross_margin_pct"))


def menu_top_items(sales: DataFrame, menu: DataFrame, k: int = 15) -> DataFrame:
    st = _item_stats(sales, menu)
    avg_gm = F.try_divide(F.col("_s_gross_margin_pct").cast("double"), F.col("_c_gross_margin_pct").cast("double"))
    out = st.select(
        "category", "item", F.col("_n").alias("times_ordered"), money("_rev").alias("revenue"),
        ratio("_up", "_upn", 2).alias("avg_selling_price"),
        ratio("_s_gross_margin_pct", "_c_gross_margin_pct", 1).alias("gross_margin_pct"),
        fix(F.col("_rev").cast("double") * avg_gm / F.lit(100.0), 2).alias("est_profit_contribution"))
    return out.orderBy(F.desc("revenue"), "category", "item").limit(k)


def menu_worst_items(sales: DataFrame, menu: DataFrame, k: int = 10) -> DataFrame:
    """Items ordered less often than the average item, lowest margin first.
    The average comes from the item rows themselves (one scan of the lines):
    a window total over aggregated rows."""
    st = _item_stats(sales, menu)
    per_item = Window.partitionBy("item").orderBy("category")
    st = st.withColumn("_first", F.when(F.row_number().over(per_item) == 1, 1).otherwise(0))
    mean = F.try_divide(grand_total(st, "_lines").cast("double"), grand_total(st, "_first").cast("double"))
    out = st.withColumn("_mean", mean).filter(F.col("_n") < F.col("_mean")).select(
        "category", "item", F.col("_n").alias("times_ordered"), money("_rev").alias("revenue"),
        ratio("_s_gross_margin_pct", "_c_gross_margin_pct", 1).alias("gross_margin_pct"))
    return out.orderBy(F.asc_nulls_last("gross_margin_pct"), F.asc("revenue"), "category", "item").limit(k)


def menu_alcohol_share(sales: DataFrame) -> DataFrame:
    a = sales.groupBy(F.year("date").alias("year")).agg(
        *measures(sales, "_alc", "_food", "_rev"))
    return a.select("year", ratio("_alc", "_rev", 1, 100).alias("alcohol_pct"),
                    ratio("_food", "_rev", 1, 100).alias("food_pct")).orderBy("year")


def menu_discounts(sales: DataFrame) -> DataFrame:
    """Discounted lines and revenue lost = list value - net line totals."""
    a = sales.groupBy("category").agg(
        *measures(sales, "_cut_lines", "_lines", "_list", "_rev"))
    return a.select("category", F.col("_cut_lines").alias("discounted_lines"), F.col("_lines").alias("total_lines"),
                    ratio("_cut_lines", "_lines", 1, 100).alias("discount_rate_pct"),
                    money(F.col("_list") - F.col("_rev")).alias("revenue_lost")).orderBy(F.desc("revenue_lost"))
