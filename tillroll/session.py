"""Spark session settings used by tests, bench and the pipelines."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins (runtime broadcast only
# when the measured side is under the threshold, sort-merge otherwise),
# coalesces small shuffle partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def cluster_conf(input_tb: float = 100.0, executors: int = 1000, cores_per_executor: int = 8) -> dict:
    """Settings for a large cluster run, sized from the input volume.

    Shuffle partitions start high and AQE coalesces them to ~256 MB each, so
    one setting serves both the line-level shuffles (tens of TB) and the
    small month/day aggregates; file splits of 256 MB give ~400k scan tasks
    at 100 TB; a partition 5x the median and over 1 GB is split by the skew
    join rule."""
    slots = executors * cores_per_executor
    initial = max(slots * 3, int(input_tb * 1024 * 1024 / 256 / 4))  # ~1/4 of input shuffled, 256 MB each
    return {
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * 1024 * 1024),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    }


def get_spark(master: str | None = None, app: str = "tillroll", shuffle_partitions: int | None = None,
              extra: dict | None = None, input_tb: float | None = None, executors: int = 1000) -> SparkSession:
    """Build (or reuse) a session. ``master`` is only set when given, so a
    cluster submit keeps its own master. ``input_tb`` adds the settings of a
    cluster run over so much input (``cluster_conf``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if input_tb:
        for k, v in cluster_conf(input_tb, executors).items():
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; asked for where a
    checkpoint or a shared table is made. Only a local-mode session (one
    process, as in tests) may fall back to a fresh scratch folder; on a cluster a
    machine-local folder would not survive a lost executor, so it is an
    error to leave the setting unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for cluster runs")
        d = tempfile.mkdtemp(prefix="tillroll-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once per application), so that
    functions run in Python workers can import it wherever the driver was
    started from."""
    sc = spark.sparkContext
    if getattr(sc, "_tillroll_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tillroll-ship-"), "tillroll.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("tillroll", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._tillroll_shipped = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)
