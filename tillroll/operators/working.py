"""Working tables of the restaurant's sales: one scan of the lines, written
once, read by every report that a coarser grain can answer.

``orders``  one row per order (order, reservation, date, service, hour,
            server, party): everything that counts orders or reservations.
``items``   one row per (date, service, hour, server, category, item,
            alcohol flag): everything by product.

Both come from one pass: GROUPING SETS emit each line at the two grains and
the partial aggregate collapses them before the shuffle. Rows hold additive
measures under the names of ``operators._sales``, so the operators take
them in place of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators._sales import measures

ORDER_KEYS = ["order_id", "reservation_id", "date", "service", "hour", "server_id", "party_size"]
ITEM_KEYS = ["date", "service", "hour", "server_id", "category", "item", "is_alcohol"]
ORDER_MEASURES = ["_lines", "_rev", "_alc", "_food", "_n", "_disc", "_drink", "_cat", "_party_lines"]
ITEM_MEASURES = ["_lines", "_rev", "_alc", "_food", "_n", "_qty", "_up", "_upn", "_lo", "_hi", "_list", "_cut_lines"]


def working_tables(sales: DataFrame, category: str = "Dolci") -> DataFrame:
    """Both grains in one frame, told apart by ``grain``; ``category`` is
    the one whose orders are flagged (``_cat``, for the attach rate)."""
    keys = list(dict.fromkeys([*ORDER_KEYS, *ITEM_KEYS]))
    names = [m for m in dict.fromkeys([*ORDER_MEASURES, *ITEM_MEASURES]) if m != "_cat"]
    # a line counts the party of its reservation, also where that is rolled up
    lines = sales.withColumn("_of_category", (F.col("category") == category).cast("int"))
    g = lines.groupingSets([ORDER_KEYS, ITEM_KEYS], *keys).agg(
        *measures(lines, *names), F.max("_of_category").alias("_cat"), F.grouping_id().alias("_gid"))
    order_gid = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in ORDER_KEYS)
    return g.withColumn("grain", F.when(F.col("_gid") == order_gid, "orders").otherwise("items")).drop("_gid")


def orders_of(working: DataFrame) -> DataFrame:
    return working.filter("grain = 'orders'").select(*ORDER_KEYS, *ORDER_MEASURES)


def items_of(working: DataFrame) -> DataFrame:
    return working.filter("grain = 'items'").select(*ITEM_KEYS, *ITEM_MEASURES)


def null_counts(working: DataFrame, prefix: str = "null_") -> DataFrame:
    """NULLs per column of the lines behind the working tables (Q2), each
    column counted at a grain that keeps it."""
    def lines(grain, test, value="_lines"):
        return F.coalesce(F.sum(F.when((F.col("grain") == grain) & test, F.col(value))), F.lit(0)).cast("long")

    out = {c: lines("orders", F.col(c).isNull()) for c in ("order_id", "date")}
    everything = F.lit(True)
    out["line_total"] = lines("orders", everything) - lines("orders", everything, "_n")
    out |= {"category": lines("items", F.col("category").isNull()), "server_id": lines("orders", F.col("server_id").isNull()),
            "is_alcohol": lines("items", F.col("is_alcohol").isNull())}
    return working.agg(*[c.alias(prefix + k) for k, c in out.items()])
