"""Ranking patterns.

``global_row_number`` numbers all rows of a frame in a total order without
funnelling them through one partition (a bare ``ROW_NUMBER() OVER (ORDER
BY ...)`` does): range-partition on the sort key (the sampler splits hot
values because the unique tie-break key is part of the range key), sort
inside each partition, tag rows with (partition, position), cut lineage with
a reliable checkpoint so the tags stay fixed even if executors are lost,
then add per-partition offsets. The offsets table has one row per
partition, so broadcasting it is bounded by the partition count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir


def global_row_number(df: DataFrame, order: list[Column], name: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """Exact 1-based ROW_NUMBER over ``order`` (must be a total order:
    end it with a unique key)."""
    ensure_checkpoint_dir(df.sparkSession)
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(parts, *order)
              .sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id()))
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_pos") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + local + 1)
            .drop("_pid", "_pos", "_off"))


def latest_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row per key in ``order`` (ROW_NUMBER() = 1). Catalyst plans a
    partial WindowGroupLimit before the shuffle, so a hot key is cut down
    map-side."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
