"""Build-once marts: a mart is written the first time it is asked for and
read by everyone who asks again, as long as its inputs are the same.

A mart's key is a digest of its name, its parameters, the library's version
and a snapshot of the input folders (path, length and modification time of
every file, summed up by one Spark job, so nothing is listed through the
driver). It is published under the shared folder (``io.publish_mart``): two
sessions that build it at once each write a whole version and the last swap
wins; a build that fails leaves nothing that a reader would take.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tillroll
from tillroll.session import shared_dir
from tillroll.sources import io


def snapshot(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the files below the paths; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    one = F.xxhash64("path", "length", F.col("modificationTime").cast("string")).cast("decimal(38,0)")
    r = files.agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("h"), F.sum("length").alias("b")).first()
    return f"{r['n']}-{r['b']}-{r['h']}"


class MartStore:
    """Marts over one set of input folders."""

    def __init__(self, spark: SparkSession, inputs: list[str], root: str | None = None):
        self.spark, self.inputs = spark, sorted(inputs)
        self.root = root or shared_dir(spark, "mart-store")

    def path(self, name: str, **params) -> str:
        state = [name, sorted(params.items()), tillroll.__version__, self.inputs, snapshot(self.spark, self.inputs)]
        return f"{self.root}/{name}-{hashlib.sha256(repr(state).encode()).hexdigest()[:24]}"

    def get(self, name: str, build: Callable[[], DataFrame], **params) -> DataFrame:
        """The mart, built by ``build()`` where it isn't there yet."""
        at = self.path(name, **params)
        version = io.current_version(self.spark, at) or io.publish_mart(build(), at)
        return self.spark.read.parquet(version)
