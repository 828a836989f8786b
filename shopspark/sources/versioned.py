"""Tables that are replaced as a whole, without touching files in use.

Every write goes to a new folder. A small pointer file says which folder is
current. Readers that opened the old folder are not disturbed, and a failed job
leaves the pointer as it was. Tables with a history are kept by month instead
(``shopspark.sources.monthly``).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

WHOLE = ""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, name: str, schema: T.StructType):
        self.spark, self.name, self.schema = spark, name, schema
        self.path = f"{root.rstrip('/')}/{name}"

    # --- pointer: one small JSON file {part: version} ---

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path

    def parts(self) -> dict[str, int]:
        fs, path = self._fs(f"{self.path}/_CURRENT")
        if not fs.exists(path):
            return {}
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, parts: dict[str, int]) -> None:
        """Publish ``parts``: written beside the pointer, then renamed over it."""
        fs, fresh = self._fs(f"{self.path}/_CURRENT.new")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self.spark.sparkContext._jsc.hadoopConfiguration()
        )
        overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context.rename(fresh, self._fs(f"{self.path}/_CURRENT")[1], options)

    # --- reading and writing ---

    def exists(self) -> bool:
        return bool(self.parts())

    def create(self) -> None:
        """Set up an empty table; an existing one is left alone."""
        if not self.exists():
            self.replace(self.spark.createDataFrame([], self.schema))

    def folder(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def read(self) -> DataFrame:
        """The current rows."""
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.folder(self.parts()[WHOLE]))

    def versions(self) -> list[int]:
        """Numbers of all version folders, current or not."""
        fs, path = self._fs(self.path)
        if not fs.exists(path):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(path)]
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def next_version(self) -> int:
        """A version no folder uses yet, also not one left by a failed job."""
        return max(self.versions(), default=0) + 1

    def remove_unused(self, keep: int = 1) -> list[int]:
        """Delete versions no part points to, but for the newest ``keep`` that open readers may use.

        Run it while nothing writes to the table.
        """
        current = set(self.parts().values())
        unused = [v for v in self.versions() if v not in current]
        gone = unused[: len(unused) - keep] if keep else unused
        for version in gone:
            fs, path = self._fs(f"{self.path}/v={version}")
            fs.delete(path, True)
        return gone

    def replace(self, df: DataFrame) -> int:
        """Make ``df`` the whole table."""
        version = self.next_version()
        df.write.parquet(self.folder(version))
        self._point({WHOLE: version})
        return version

    def append(self, df: DataFrame) -> None:
        """Plain append to the current version of an unpartitioned table."""
        self.create()
        df.select(*self.schema.names).write.mode("append").parquet(self.folder(self.parts()[WHOLE]))
