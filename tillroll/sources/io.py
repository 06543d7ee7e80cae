"""Reads and writes: typed CSV landing, namespaces, views, mart extracts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool = True) -> DataFrame:
    """Header CSV with a declared schema, PERMISSIVE: malformed rows keep
    their text in ``_corrupt_record`` instead of failing the load. Quotes
    inside quoted fields are doubled, as exports have them."""
    s = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)]) if keep_corrupt else schema
    r = (spark.read.schema(s).option("header", True).option("mode", "PERMISSIVE")
         .option("encoding", "UTF-8").option("multiLine", False).option("escape", '"'))
    if keep_corrupt:
        r = r.option("columnNameOfCorruptRecord", CORRUPT)
    return r.csv(path).select(*[f.name for f in s.fields])  # without columns of a partitioned folder


def corrupt_rows(df: DataFrame) -> DataFrame:
    """Rows of a PERMISSIVE landing read that did not parse (to look at;
    count them with ``landing_counts``)."""
    return df.filter(F.col(CORRUPT).isNotNull()).select(*df.columns)


def landing_counts(df: DataFrame) -> DataFrame:
    """One row: rows read, rows that did not parse, and NULLs per column.
    Every column is referenced on purpose: the CSV reader parses (and so
    validates) only the columns a query needs, and rejects a query whose
    only referenced column is the corrupt-record one."""
    cols = [c for c in df.columns if c != CORRUPT]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(CORRUPT).isNotNull()).alias("corrupt_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])


def create_table(spark: SparkSession, name: str, schema: T.StructType, path: str,
                 partition_by: list[str] | None = None) -> DataFrame:
    """CREATE TABLE IF NOT EXISTS ... USING parquet from a declared schema
    (the reference's typed RAW tables), stored at ``path``."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    part = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet{part} LOCATION '{path}'")
    return spark.table(name)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Save as a catalog table bucketed and sorted by ``keys``; joins and
    aggregations on those keys between tables with the same bucket count
    then read co-located data and skip the shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def bulk_load(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    """Land a typed frame as Parquet (append by default)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def create_namespaces(spark: SparkSession, names=("raw", "staging", "marts"), location: str | None = None) -> None:
    """Schemas of the layers; with ``location`` each has its folder there
    (a shared one), not in the session's warehouse."""
    for n in names:
        at = f" LOCATION '{location}/{n}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {n}{at}")


def register_view(df: DataFrame, name: str) -> DataFrame:
    """CREATE OR REPLACE (temp) VIEW: a named lazy plan."""
    df.createOrReplaceTempView(name)
    return df


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def read_mart(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A mart by catalog name or Parquet path, lazily, names lower-cased. A
    published path is read at its current version, and stays at it."""
    if "/" in name_or_path:
        df = spark.read.parquet(current_version(spark, name_or_path) or name_or_path)
    else:
        df = spark.table(name_or_path)
    return lower_columns(df)


def write_mart(df: DataFrame, path: str, partition_by: list[str] | None = None,
               small_csv: bool = False) -> None:
    """Materialise a mart. Parquet, optionally partitioned (e.g. by year)
    for pruning; ``small_csv`` writes one CSV file for small extracts (the
    work before it keeps its tasks; only the result meets in one)."""
    if small_csv:
        df.repartition(1).write.mode("overwrite").option("header", True).csv(path)
        return
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


# versions: a mart's folder holds one folder per version and a pointer

POINTER = "_current"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that ``path`` points at; None where nothing was
    published."""
    fs, pointer = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()
    return f"{path}/{name}"


def publish_mart(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> str:
    """Write a new version of a mart beside the current one, then swap the
    pointer in one rename; returns the version's folder. Readers see the old
    version or the new one, never half of one: a write that fails, or whose
    driver is lost, leaves the pointer as it was. ``keep`` versions stay for
    readers that have begun; older ones, and what failed writes left before
    the last success, are deleted."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    name = f"v{jvm.System.currentTimeMillis():015d}-{uuid.uuid4().hex[:8]}"
    bulk_load(df, f"{path}/{name}", partition_by, mode="errorifexists")
    fs, pointer = _fs(spark, f"{path}/{POINTER}")
    part = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}-{uuid.uuid4().hex[:8]}")
    out = fs.create(part, True)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark._sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    context.rename(fs.makeQualified(part), fs.makeQualified(pointer), how)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(pointer.getParent()) if s.isDirectory())
    current = versions.index(name)
    for old in versions[:max(0, current + 1 - keep)]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)
    return f"{path}/{name}"
