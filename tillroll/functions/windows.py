"""Window patterns over already-aggregated rows.

Grand totals are taken over rows that are already aggregated to a grain
bounded by a business domain (categories, segments, stores, weekday x hour
cells), so the single-partition exchange of ``OVER ()`` moves only those
few rows, and the total is computed in the same pass as the groups. (A
scalar subquery would re-run the whole upstream plan: checked, Spark does
not reuse the group-by exchange between a subquery and the main plan.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grand_total(df: DataFrame, col: str) -> Column:
    """SUM(col) over all rows of an aggregated frame, as a window column."""
    return F.sum(col).over(Window.partitionBy())


def previous(col: str, order_by: str, partition_by: list[str] | None = None, offset: int = 1) -> Column:
    """LAG over an ordered series (aggregated rows: years, months)."""
    w = Window.partitionBy(*(partition_by or [])).orderBy(order_by)
    return F.lag(col, offset).over(w)


def rolling_mean(sum_expr: Column, order_by: str, n: int, partition_by: list[str] | None = None) -> tuple[Column, Column]:
    """(sum, count) over the trailing n rows incl. the current one
    (min_periods = 1); divide with ``ratio`` for the exact recipe."""
    w = Window.partitionBy(*(partition_by or [])).orderBy(order_by).rowsBetween(-(n - 1), 0)
    return F.sum(sum_expr).over(w), F.count(sum_expr).over(w)


def fill_month_gaps(df: DataFrame, month_col: str, partition_by: list[str] | None = None) -> DataFrame:
    """Add the months missing between consecutive rows (one row per month
    and series in ``df``): each row expands to itself plus the months before
    the next row, so the input is read once. Added months carry NULLs."""
    w = Window.partitionBy(*(partition_by or [])).orderBy(month_col)
    nxt = F.lead(month_col).over(w)
    last = F.coalesce(F.add_months(nxt, -1), F.col(month_col))
    cols = [c for c in df.columns if c != month_col]
    with_last = df.withColumn("_last", last)
    exp = with_last.select(*(partition_by or []), F.col(month_col).alias("_own"),
                           F.explode(F.sequence(F.col(month_col), F.col("_last"), F.expr("INTERVAL 1 MONTH")))
                           .alias(month_col),
                           *[c for c in cols if c not in (partition_by or [])])
    keep = F.col(month_col) == F.col("_own")
    return exp.select(*(partition_by or []), month_col,
                      *[F.when(keep, F.col(c)).alias(c) for c in cols if c not in (partition_by or [])])
