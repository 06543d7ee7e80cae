"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll import session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Default place of a public vocabulary file (a parameter everywhere)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new sub-folder of the shared checkpoint folder."""
    return session.shared_dir(spark, f"{what}-{uuid.uuid4().hex}")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    so that a lost executor costs a reread and not a recomputation. Spark
    removes the shuffle files of the write when it has ended."""
    path = fresh_folder(df.sparkSession, what)
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(id_col: str, parts: int):
    """crc32(id as text) mod ``parts``; NULL for a NULL id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ARROW_BYTES = 8 << 20  # most bytes of a batch handed to a Python worker (Spark's default is 64 MB)


def with_package(df: DataFrame) -> DataFrame:
    """Make sure that Python workers can import this package and get rows
    in batches that bound their memory, however long the texts are."""
    spark = df.sparkSession
    session.ship_package(spark)
    if byte_size(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df


def byte_size(text: str) -> int:
    """Bytes of a size as Spark's settings spell it: 8388608, 8m, 64MB, 1g."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", str(text).lower()).groups()
    return int(number) << (10 * " kmgtp".index(unit or " "))


def renamed(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the given new names: ``renamed(df,
    _id="doc_id")``. Extra columns of the input, whatever their names,
    cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in cols.items()])
