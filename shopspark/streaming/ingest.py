"""Streams of new raw files: ingest, de-duplicate, check, quarantine, merge.

Every function starts a query that works off the files present and stops
(``availableNow``); run again with the same checkpoint it picks up new files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopspark.operators.contracts import Contract, failed_rules
from shopspark.operators.integrity import ForeignKey, mark_drops
from shopspark.operators.merge import MergeSpec
from shopspark.operators.transforms import clean
from shopspark.plans.load import upsert
from shopspark.plans.monthly import merge_months
from shopspark.schemas import TABLES
from shopspark.sources.monthly import MonthlyTable
from shopspark.sources.versioned import VersionedTable
from shopspark.storage import materialize


def stream_raw(spark: SparkSession, folder: str, table: str, **options: str) -> DataFrame:
    """New Parquet files of a raw table, cleaned row by row."""
    spec = TABLES[table]
    fields = [f for f in spec.schema.fields if f.name not in spec.derived]
    files = spark.readStream.schema(T.StructType(fields)).options(**options).parquet(folder)
    return clean(files, table)


def _work_off(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def append_to(stream: DataFrame, path: str, checkpoint: str) -> list:
    """Append finished rows to Parquet files, exactly once; returns the progress of the batches."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return list(query.recentProgress)


def latest_per_key(batch: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """The newest row of every key; a batch of files may hold several versions."""
    # The order is a struct, so a row without a time loses but is not dropped.
    row = F.max_by(F.struct(*batch.columns), F.struct(newest)).alias("_row")
    return batch.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(row).select("_row.*")


def upsert_stream(
    stream: DataFrame,
    table: VersionedTable | MonthlyTable,
    spec: MergeSpec,
    checkpoint: str,
    newest: str | None = None,
    mode: str = "append",
) -> None:
    """Merge every micro-batch into the table.

    A table kept by month has only the months rewritten that a batch changes. Of the
    versions of another one only the last before stays, for open readers.

    A batch repeated after a failure merges to the same rows, so nothing is
    counted twice.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Checks and merge read the staged rows, so the batch is worked out once.
        batch = materialize(batch, "merge-batch")
        if batch.isEmpty():
            return
        rows = latest_per_key(batch, spec.keys, newest) if newest else batch
        checked = newest is not None or mode == "update"
        if isinstance(table, MonthlyTable):
            merge_months(table, rows, spec, checked)
        else:
            upsert(table, rows, spec, checked)
            table.remove_unused()

    _work_off(stream, checkpoint, handle, mode)


def quarantine_stream(
    stream: DataFrame,
    contract: Contract,
    fks: Sequence[ForeignKey],
    good_path: str,
    bad_path: str,
    checkpoint: str,
) -> None:
    """Rows with valid references that keep the contract to one place, the others to quarantine.

    A stream cannot stop for one bad row. A quarantined row carries the rules it
    breaks; a reference that is missing comes first, as ``missing <column>``. A batch
    is worked out once, into a folder of its own that a repeated batch replaces, and
    both places are cut from it.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        marked = mark_drops(batch, fks).withColumn("failed_rules", failed_rules(batch, contract))
        lost = F.when(F.col("dropped_by").isNotNull(), F.array(F.concat(F.lit("missing "), "dropped_by")))
        empty = F.array().cast("array<string>")
        marked = marked.withColumn("failed_rules", F.concat(F.coalesce(lost, empty), F.coalesce("failed_rules", empty)))
        staged = materialize(marked.drop("dropped_by"), "quarantine-batch")
        good = staged.where(F.size("failed_rules") == 0).drop("failed_rules")
        good.write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        staged.where(F.size("failed_rules") > 0).write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")

    _work_off(stream, checkpoint, handle)


def merge_stream(
    stream: DataFrame, table: VersionedTable, fold: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str
) -> None:
    """Replace the table by ``fold(stored rows, new rows)`` for every micro-batch; the version before stays for open readers."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch, "fold-batch")
        if not batch.isEmpty():
            table.replace(fold(table.read(), batch))
            table.remove_unused()

    _work_off(stream, checkpoint, handle)


def without_repeats(stream: DataFrame, keys: Sequence[str], time: str, late_by: str = "1 day") -> DataFrame:
    """Drop repeated keys; a key is remembered until the watermark passes its time."""
    return stream.withWatermark(time, late_by).dropDuplicatesWithinWatermark(list(keys))
