"""Incremental refresh of the date x service mart (M5) and the daily KPI
inputs as new sales files arrive.

Streaming aggregations cannot keep exact distinct counts (checks are
COUNT DISTINCT orders), so the stream carries no aggregation state: each
micro-batch only finds which months it touched, recomputes those months
from the source table (a raw date range reaches the scan and prunes row
groups, or files of a source partitioned by date; rows without a date form
a month of their own), and overwrites just those month
partitions of the mart. Replaying a batch rewrites the same partitions, so
the sink is idempotent, and late files simply trigger a recompute of their
month; no watermark or state store is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators.kpi import kpi_daily
from tillroll.operators.marts import mart_daily_service


def _touched(batch: DataFrame) -> tuple[DataFrame, list]:
    """Months of a batch (NULL for rows without a date) and its date span."""
    months = batch.select(F.trunc("date", "month").alias("_m")).distinct()
    span = batch.agg(F.trunc(F.min("date"), "month").alias("a"), F.last_day(F.max("date")).alias("b")).first()
    return months, [span["a"], span["b"]]


def _of_months(src: DataFrame, months: DataFrame, span: list) -> DataFrame:
    """Rows of the touched months. The span is a range on the raw date
    column, so it reaches the scan (row groups, or folders of a source that
    is partitioned by date); the semi join keeps exactly the months."""
    missing = F.col("date").isNull()
    inside = missing if span[0] is None else F.col("date").between(F.lit(span[0]), F.lit(span[1])) | missing
    src = src.filter(inside).withColumn("_m", F.trunc("date", "month"))
    m = F.broadcast(months.select(F.col("_m").alias("_t")))
    return src.join(m, F.col("_m").eqNullSafe(F.col("_t")), "left_semi").drop("_m")


def _recompute(spark: SparkSession, source_path: str, schema: T.StructType, mart_path: str,
               build: Callable[[DataFrame], DataFrame]):
    def upsert(batch: DataFrame, batch_id: int) -> None:
        months, span = _touched(batch)  # bounded by the calendar span of one batch
        out = build(_of_months(spark.read.schema(schema).parquet(source_path), months, span)).withColumn("mart_month", F.trunc("date", "month"))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("mart_month").parquet(mart_path))
    return upsert


def refresh_daily_service(spark: SparkSession, source_path: str, schema: T.StructType, mart_path: str,
                          checkpoint: str, build: Callable[[DataFrame], DataFrame] = mart_daily_service,
                          available_now: bool = True):
    """Start the refresh stream; with ``available_now`` it processes what is
    there and stops (schedule it like a batch job)."""
    stream = spark.readStream.schema(schema).parquet(source_path)
    w = (stream.writeStream.foreachBatch(_recompute(spark, source_path, schema, mart_path, build))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def _recompute_multi(spark: SparkSession, source_path: str, schema: T.StructType,
                     others: dict[str, tuple[str, T.StructType]], mart_path: str,
                     build: Callable[[dict[str, DataFrame]], DataFrame], stream_name: str):
    def upsert(batch: DataFrame, batch_id: int) -> None:
        months, span = _touched(batch)
        srcs = {stream_name: (source_path, schema), **others}
        frames = {}
        for name, (path, sch) in srcs.items():
            frames[name] = _of_months(spark.read.schema(sch).parquet(path), months, span)
        out = build(frames).withColumn("mart_month", F.trunc("date", "month"))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("mart_month").parquet(mart_path))
    return upsert


def refresh_kpi_daily(spark: SparkSession, sales: tuple[str, T.StructType], labor: tuple[str, T.StructType],
                      purchases: tuple[str, T.StructType], mart_path: str, checkpoint: str,
                      available_now: bool = True):
    """Keep the daily KPI mart current as files of any of its three facts
    land: the dates of all three streams are unioned, each batch recomputes
    the months it touched from all facts (each pruned to those months) and
    overwrites those months."""
    path, schema = sales
    build = lambda t: kpi_daily(t["sales"], t["labor"], t["purchases"])
    dates = [spark.readStream.schema(s).parquet(p).select("date") for p, s in (sales, labor, purchases)]
    stream = dates[0].unionByName(dates[1]).unionByName(dates[2])
    w = (stream.writeStream.foreachBatch(
        _recompute_multi(spark, path, schema, {"labor": labor, "purchases": purchases}, mart_path, build, "sales"))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
