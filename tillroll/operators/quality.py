"""Data-quality checks (Q1-Q6): profiles, null counts, orphan keys, value
bands, over-frequent keys, true duplicates, cross-column disagreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators._sales import measure, measures


def dq_table_profile(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count and date range per table: one single-pass aggregate each."""
    parts = [df.agg(measure(df, "_lines").alias("rows"), F.min(col).alias("earliest"), F.max(col).alias("latest"))
             .select(F.lit(name).alias("tbl"), "rows", "earliest", "latest")
             for name, (df, col) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def dq_null_counts(df: DataFrame, columns: list[str], prefix: str = "null_") -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(prefix + c) for c in columns])


def dq_orphan_keys(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Distinct fact keys with no dimension row (NULL keys count as orphans).
    The fact is reduced to distinct keys before the anti join."""
    keys = fact.select(fact_key).distinct()
    d = dim.select(F.col(dim_key).alias("_dk"))
    return keys.join(d, F.col(fact_key) == F.col("_dk"), "left_anti")


def dq_price_band(sales: DataFrame, low: float = 0, high: float = 500) -> DataFrame:
    a = sales.groupBy("category", "item").agg(*measures(sales, "_lo", "_hi"))
    a = a.filter((F.col("_lo") <= low) | (F.col("_hi") > high))
    return a.select("category", "item", F.col("_lo").cast("double").alias("min_price"),
                    F.col("_hi").cast("double").alias("max_price")).orderBy(F.desc("max_price"), "category", "item")


def dq_frequent_keys(df: DataFrame, key: str = "order_id", threshold: int = 50, limit: int = 20) -> DataFrame:
    """Keys with more than ``threshold`` rows, most frequent first."""
    a = df.groupBy(key).agg(measure(df, "_lines").alias("occurrences")).filter(F.col("occurrences") > threshold)
    return a.orderBy(F.desc("occurrences"), F.asc_nulls_last(key)).limit(limit)


def dq_duplicate_rows(df: DataFrame, keys: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Rows repeated on the full key (all columns by default). Nearly every
    row is a group of its own, so the groups of one task grow with the table
    where the number of tasks does not: ``tasks`` deals them over that many."""
    keys = keys or df.columns
    if tasks:
        df = df.repartition(tasks, *keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > 1)


def dq_category_mismatch(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per (a, b) pair with a flag where the two columns disagree."""
    g = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("rows"))
    return g.withColumn("mismatch", ~F.col(a).eqNullSafe(F.col(b))).orderBy(a, b)
