"""Shared scratch space: where a job parks a result it will read more than once.

Scratch tables are plain Parquet under the folder named by
``spark.checkpoint.dir``, so they outlive a lost executor and later passes read
only the columns they need.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
#: Folder, below the application's, of the step that runs.
_step: ContextVar[str] = ContextVar("step", default="")
#: Without the first, shuffle files stay until the driver happens to collect its garbage.
SPARING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="shopspark-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses, below this application's scratch folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{_step.get()}{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it, if it is there."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@contextmanager
def step_scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Scratch tables made inside go when the block ends; nothing may read them later."""
    outer = _step.set(f"{_step.get()}{name}-{uuid.uuid4().hex}/")
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{_step.get()}"
    try:
        yield
    finally:
        _step.reset(outer)
        remove(spark, path)


@contextmanager
def sparing_disk(spark: SparkSession) -> Iterator[None]:
    """Jobs inside leave little on disk: shuffle files go when their job ends, Parquet is packed tighter. A caller's own settings stay."""
    wanted = {key: value for key, value in SPARING.items() if key not in spark.conf.getAll}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in wanted:
            spark.conf.unset(key)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to scratch and return a reader over the written files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SPLIT_BYTES = 128 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores before costly work on each row.

    A file with one row group is read by one task. Inputs whose estimated size
    already gives every core a split are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores * 4) if size < cores * SPLIT_BYTES else df


def drop_scratch(spark: SparkSession) -> None:
    """Remove this application's scratch tables; call it when the job is over."""
    remove(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
