"""Keep a fixed, ordered label list in a result (pandas ``reindex``):
labels without rows stay, with NULL measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def label_table(spark: SparkSession, column: str, labels: list[str], order_col: str) -> DataFrame:
    schema = T.StructType([T.StructField(column, T.StringType(), False),
                           T.StructField(order_col, T.IntegerType(), False)])
    return spark.createDataFrame([(lab, i + 1) for i, lab in enumerate(labels)], schema)


def reindex(df: DataFrame, column: str, labels: list[str], order_col: str = "sort_order") -> DataFrame:
    """Left join a literal label table (a handful of rows) onto ``df``."""
    lt = label_table(df.sparkSession, column, labels, order_col)
    return lt.join(df, column, "left").orderBy(order_col)
