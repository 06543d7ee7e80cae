"""Measures over sales at any grain: raw lines, or a working table whose rows
stand for several lines (``operators.working``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alcohol_rev() -> Column:
    return F.when(F.col("is_alcohol") == "Yes", F.col("line_total")).otherwise(F.lit(0))


def food_rev() -> Column:
    return F.when(F.col("is_alcohol") == "No", F.col("line_total")).otherwise(F.lit(0))


#: Additive measures of lines (sums, counts, extremes), by name.
MEASURES = {
    "_lines": lambda: F.count(F.lit(1)), "_rev": lambda: F.sum("line_total"), "_alc": lambda: F.sum(alcohol_rev()),
    "_food": lambda: F.sum(food_rev()), "_n": lambda: F.count("line_total"),
    "_disc": lambda: F.sum(F.col("line_total") * F.col("discount_pct")), "_qty": lambda: F.sum("qty"),
    "_up": lambda: F.sum("unit_price"), "_upn": lambda: F.count("unit_price"), "_lo": lambda: F.min("unit_price"),
    "_hi": lambda: F.max("unit_price"), "_list": lambda: F.sum(F.col("unit_price") * F.col("qty")),
    "_cut_lines": lambda: F.count_if(F.col("discount_pct") > 0), "_drink": lambda: F.max((F.col("is_alcohol") == "Yes").cast("int")),
    "_party_lines": lambda: F.sum("party_size"),
}
_AGAIN = {"_lo": F.min, "_hi": F.max, "_drink": F.max, "_cat": F.max}


def measure(df: DataFrame, name: str) -> Column:
    """The aggregate ``name``, from lines or from rows that hold it already
    for several lines."""
    if name in df.columns:
        return _AGAIN.get(name, F.sum)(name).alias(name)
    return MEASURES[name]().alias(name)


def measures(df: DataFrame, *names: str) -> list[Column]:
    return [measure(df, n) for n in names]


def order_grain(sales: DataFrame, keys: list, extra: tuple[str, ...] = ()) -> DataFrame:
    """Collapse lines to (keys, order_id, reservation_id) with additive
    measures. The partial aggregate runs map-side, so the shuffle carries
    orders rather than lines."""
    return sales.groupBy(*keys, "order_id", "reservation_id").agg(*measures(sales, "_rev", "_alc", "_food", "_n", *extra))


def checks_and_seatings_rows(sales: DataFrame, keys: list[str], names: tuple[str, ...], guests: bool = False) -> DataFrame:
    """Lines collapsed to (keys, order) and to (keys, reservation) by one
    scan; ``_by_order`` tells the rows apart, the other id is NULL.

    GROUPING SETS emit each line twice; the partial aggregate collapses them
    to either grain before the shuffle, so a distinct count becomes a count
    of rows (no Expand per distinct column over lines, no second scan). A
    hot key value is spread over its reservations and orders."""
    aggs = measures(sales, *names) + ([F.max("party_size").alias("total_guests")] if guests else [])
    cols = [*keys, "reservation_id", "order_id"]
    g = sales.groupingSets([[*keys, "reservation_id"], [*keys, "order_id"]], *cols).agg(*aggs, F.grouping_id().alias("_gid"))
    return g.withColumn("_by_order", F.col("_gid") == 2).drop("_gid")  # 2: reservation_id rolled up


def checks_and_seatings(sales: DataFrame, keys: list[str], extra: tuple[str, ...] = (), guests: bool = False) -> DataFrame:
    """Per ``keys``: distinct checks (orders), distinct seatings
    (reservations), the additive line measures (_rev, _alc, _food, _n), the
    ``extra`` ones and, with ``guests``, party sizes summed over distinct
    reservations (total_guests) -- from one scan."""
    names = ("_rev", "_alc", "_food", "_n", *extra)
    g = checks_and_seatings_rows(sales, keys, names, guests)
    by_res = ~F.col("_by_order")
    out = [F.count(F.when(F.col("_by_order") & F.col("order_id").isNotNull(), 1)).alias("checks"),
           F.count(F.when(by_res & F.col("reservation_id").isNotNull(), 1)).alias("covers")]
    out += [F.sum(F.when(by_res, F.col(name))).alias(name) for name in (*names, *(["total_guests"] if guests else []))]
    return g.groupBy(*keys).agg(*out)
