"""Server performance (V1-V2).

The scorecard reads the fact once: GROUPING SETS collapse lines to (server,
order) and (server, reservation); parties are joined at reservation grain
only. "Orders containing X" are flags at (server, order) grain, of the
role's staff alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import money, ratio
from tillroll.operators._sales import checks_and_seatings_rows, measures


def server_revenue(sales: DataFrame, staff: DataFrame, reservations: DataFrame, fanout: bool = False) -> DataFrame:
    """Checks, covers, revenue, average check and alcohol share per server.

    Covers count each reservation's party once per server (``fanout=True``
    counts it once per sales line, as a line-level join does)."""
    rows = checks_and_seatings_rows(sales, ["server_id"], ("_rev", "_alc", "_lines"))
    # rows by order meet no reservation: they are one row a server before the join
    rows = rows.groupBy("server_id", "reservation_id", "_by_order").agg(
        F.count("order_id").alias("checks"), *[F.sum(c).alias(c) for c in ("_rev", "_alc", "_lines")])
    party = rows.join(reservations.select("reservation_id", "party_size"), "reservation_id", "left")
    guests = F.col("party_size") * F.col("_lines") if fanout else F.col("party_size")

    def by_order(c):
        return F.sum(F.when(F.col("_by_order"), F.col(c)))

    per_server = party.groupBy("server_id").agg(
        by_order("checks").alias("checks_served"), by_order("_rev").alias("_rev"), by_order("_alc").alias("_alc"),
        F.sum(F.when(~F.col("_by_order"), guests)).alias("covers_served"))
    j = per_server.join(staff.select(F.col("employee_id").alias("_eid"), F.col("name").alias("server_name")),
                        F.col("server_id") == F.col("_eid"), "left")
    return j.select(
        "server_id", "server_name", "checks_served", "covers_served", money("_rev").alias("total_revenue"),
        ratio("_rev", "checks_served", 2).alias("avg_check_value"),
        ratio("_alc", "_rev", 1, 100).alias("alcohol_upsell_pct"),
    ).orderBy(F.desc("total_revenue"))


def server_attach_rate(sales: DataFrame, staff: DataFrame, role: str = "Server", category: str = "Dolci") -> DataFrame:
    """Share of a server's checks containing ``category`` / any alcohol (an
    order-grain working table has the flag of its own category). Only staff with ``role`` (the reference's WHERE turns its left join into
    an inner join)."""
    st = staff.filter(F.col("role") == role).select(F.col("employee_id").alias("_eid"), "name")
    served = sales.filter(F.col("order_id").isNotNull()).join(st, F.col("server_id") == F.col("_eid"), "left_semi")
    has_cat = measures(sales, "_cat") if "_cat" in sales.columns else [F.max((F.col("category") == category).cast("int")).alias("_cat")]
    per_order = (served.groupBy("server_id", "order_id").agg(*has_cat, *measures(sales, "_drink"))
                 .fillna(0, ["_cat", "_drink"]))
    j = per_order.join(st, F.col("server_id") == F.col("_eid"))
    a = j.groupBy("server_id", "name").agg(
        F.count(F.lit(1)).alias("checks"), F.sum("_cat").alias("checks_with_dessert"),
        F.sum("_drink").alias("checks_with_alcohol"))
    return a.select("server_id", "name", "checks", "checks_with_dessert",
                    ratio("checks_with_dessert", "checks", 1, 100).alias("dessert_attach_pct"),
                    "checks_with_alcohol", ratio("checks_with_alcohol", "checks", 1, 100).alias("alcohol_attach_pct"),
                    ).orderBy(F.desc("dessert_attach_pct"))
