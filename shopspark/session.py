"""Session settings the library relies on."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import shopspark

# Runtime settings. Adaptive execution joins or splits shuffle partitions from
# their measured size.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Whole texts and packed vectors go to Python in batches limited by size, not only by row count;
    # a worker holds a batch several times, and a task has a worker for each Python step.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
}


# What results depend on; the rest is a default that a caller's own setting overrides.
NEEDED = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled")
PARTITION_BYTES = 128 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere, without overriding the caller's.

    Task functions travel by value, so workers need not have the package installed.
    """
    cloudpickle.register_pickle_by_value(shopspark)
    given = spark.conf.getAll
    for key, value in RUNTIME.items():
        if key in NEEDED or key not in given:
            spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, *paths: str) -> int:
    """Raise the number of shuffle partitions to one for each 128 MB of input, never lower it."""
    context = spark.sparkContext
    total = 0
    for name in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


def local_session(cores: str = "*", app: str = "shopspark", **extra: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**RUNTIME, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
