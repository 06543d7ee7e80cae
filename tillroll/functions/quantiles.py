"""Exact quantiles for measures on a bounded integer domain (scores 0-100).

The group's values are reduced to a histogram (value, count) by a partial
aggregate, so no group is ever collected into one task; the quantile with
linear interpolation (the usual box-plot definition, position p*(n-1)) is
then read from the cumulative counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_cnt"))


def quantiles_from_histogram(hist: DataFrame, group: list[str], value: str,
                             probs: dict[str, float]) -> DataFrame:
    """One row per group: n and one column per named probability."""
    w = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    wn = Window.partitionBy(*group)
    h = (hist.withColumn("_hi", F.sum("_cnt").over(w) - 1)
         .withColumn("_lo", F.col("_hi") - F.col("_cnt") + 1)
         .withColumn("_n", F.sum("_cnt").over(wn)))
    aggs = [F.first("_n").alias("n")]
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo_r, hi_r = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when(lo_r.between(F.col("_lo"), F.col("_hi")), F.col(value))).alias(f"_{name}_lo"),
            F.max(F.when(hi_r.between(F.col("_lo"), F.col("_hi")), F.col(value))).alias(f"_{name}_hi"),
            F.first(pos - lo_r).alias(f"_{name}_frac"),
        ]
    q = h.groupBy(*group).agg(*aggs)
    for name in probs:
        lo, hi, fr = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_frac")
        q = q.withColumn(name, lo.cast("double") + (hi - lo).cast("double") * fr)
        q = q.drop(f"_{name}_lo", f"_{name}_hi", f"_{name}_frac")
    return q
