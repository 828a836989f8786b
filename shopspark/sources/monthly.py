"""Tables kept by month: plain Parquet in ``month=`` folders, written by Spark's dynamic partition overwrite.

A write replaces the months it has rows for and leaves the others alone. The rows of
a month are written beside it and take its place when the job commits; a job that fails
before that changes nothing. While several months are put in place a reader may see some
new and some old; a merge that stopped there is repaired by running it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTH = "month"
#: Folder of the rows without a time.
TIMELESS = "none"
ID_FILTER = "parquet.bloom.filter.enabled#"


def month_of(time: Column) -> Column:
    """First day of the month as text, or ``TIMELESS``."""
    return F.coalesce(F.date_format(F.date_trunc("month", time), "yyyy-MM-dd"), F.lit(TIMELESS))


class MonthlyTable:
    """``sort`` orders the rows within a file; ``lookup`` names columns that get a bloom filter in each row group."""

    def __init__(
        self, spark: SparkSession, root: str, name: str, schema: T.StructType, time: str = "created_at",
        sort: Sequence[str] = (), lookup: Sequence[str] = (),
    ):
        self.spark, self.name, self.schema, self.time = spark, name, schema, time
        self.sort, self.lookup = tuple(sort), tuple(lookup)
        self.path = f"{root.rstrip('/')}/{name}"

    def _fs(self, path: str):
        hadoop_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path

    def months(self) -> list[str]:
        """The months that have rows: one folder each."""
        fs, path = self._fs(self.path)
        if not fs.exists(path):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(path)]
        return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{MONTH}="))

    def exists(self) -> bool:
        return bool(self.months())

    def rows(self) -> DataFrame:
        """All rows with their ``month``; conditions on it leave whole folders out."""
        fields = T.StructType([*self.schema.fields, T.StructField(MONTH, T.StringType())])
        if not self.exists():
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).parquet(self.path)

    def read(self, months: Sequence[str] | None = None) -> DataFrame:
        rows = self.rows() if months is None else self.rows().where(F.col(MONTH).isin(list(months)))
        return rows.select(*self.schema.names)

    def read_between(self, low, high) -> DataFrame:
        """Rows with ``low <= time < high``; only the months that meet the bound are read."""
        month, time = F.col(MONTH), F.col(self.time)
        near = (month >= f"{str(low)[:7]}-01") & (month <= f"{str(high)[:7]}-31") & (month != TIMELESS)
        return self.rows().where(near & (time >= F.lit(low)) & (time < F.lit(high))).select(*self.schema.names)

    def aligned(self, rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """``rows`` with the table's columns and their ``month``; what they lack, or ``columns`` leaves out, is null."""
        given = rows.columns if columns is None else columns
        fields = [(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        return rows.select(*fields).withColumn(MONTH, month_of(F.col(self.time)))

    def overwrite(self, rows: DataFrame) -> int:
        """Replace the months that ``rows`` (with a ``month`` column) has; returns the number of rows written.

        Rebalancing splits a large month over tasks by its measured size and joins small ones.
        """
        return self._write(rows, self.path)

    def _write(self, rows: DataFrame, path: str) -> int:
        seen = Observation()
        laid = rows.observe(seen, F.count(F.lit(1)).alias("n")).hint("rebalance", F.col(MONTH))
        writer = laid.sortWithinPartitions(MONTH, *self.sort).write.mode("overwrite")
        # The filters take the size that their row group needs.
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        for column in self.lookup:
            writer = writer.option(f"{ID_FILTER}{column}", "true")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
        return seen.get["n"]

    def waiting_place(self) -> str:
        """A folder beside the table, on its file system, for months that are checked before they are published."""
        return f"{self.path.rpartition('/')[0]}/_waiting-{self.name}-{uuid.uuid4().hex}"

    def lay_out(self, rows: DataFrame, place: str) -> int:
        """Write ``rows`` (with a ``month`` column) to a waiting place as they will stand in the table."""
        return self._write(rows, place)

    def publish(self, place: str) -> None:
        """Put the months of a waiting place into a table that has none, without writing them again.

        The oldest come first, so a load by watermark goes on where this stopped.
        """
        if self.exists():
            raise ValueError(f"{self.name}: the table has rows already")
        fs, home = self._fs(self.path)
        fs.mkdirs(home)
        names = [status.getPath().getName() for status in fs.listStatus(self._fs(place)[1])]
        months = [name for name in names if name.startswith(f"{MONTH}=")]
        for name in sorted(months, key=lambda name: (name != f"{MONTH}={TIMELESS}", name)):
            # Under its own name: a folder renamed to an empty one would take its place.
            if not fs.rename(self._fs(f"{place}/{name}")[1], self._fs(f"{self.path}/{name}")[1]):
                raise OSError(f"{self.name}: cannot put {name} into the table")

    def remove(self, months: Sequence[str]) -> None:
        """Delete whole months."""
        for month in months:
            fs, path = self._fs(f"{self.path}/{MONTH}={month}")
            fs.delete(path, True)
