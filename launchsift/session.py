"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings that can be changed on a running session.  The number of tasks follows the
# cluster: the shuffle width is left alone so that its owner can scale it.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# What one task reads, unless the owner has set it.  Packed numbers grow tenfold as rows with
# addresses that are hashed and sorted, so Spark's own 128 and 64 MB may need gigabytes in a task.
SHARES = {
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SHARES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def _own_folder() -> str:
    """A temporary folder that goes when the process ends."""
    folder = tempfile.mkdtemp(prefix="launchsift-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def local_session(cores: int | str = 8, name: str = "launchsift") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.checkpoint.dir", _own_folder())
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
