"""Run log: what each load step did and how long it took."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

SCHEMA = (
    "table_name string, status string, rows_in bigint, rows_out bigint, rows_dropped bigint, "
    "inserted bigint, updated bigint, unchanged bigint, seconds double, slow boolean"
)


@dataclass
class Step:
    table: str
    status: str = "running"
    rows_in: int = 0
    rows_out: int = 0
    losses: dict[str, int] = field(default_factory=dict)
    actions: dict[str, int] = field(default_factory=dict)
    seconds: float = 0.0


class RunLog:
    """Collects steps; use ``with log.step(table) as step``."""

    def __init__(self, slow_after: float = 3600.0):
        self.slow_after = slow_after
        self.steps: list[Step] = []

    def step(self, table: str) -> _Timed:
        return _Timed(self, Step(table))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (
                s.table,
                s.status,
                s.rows_in,
                s.rows_out,
                s.rows_in - s.rows_out,
                s.actions.get("insert", 0),
                s.actions.get("update", 0),
                s.actions.get("unchanged", 0),
                s.seconds,
                s.seconds > self.slow_after,
            )
            for s in self.steps
        ]
        return spark.createDataFrame(rows, SCHEMA)


class _Timed:
    def __init__(self, run: RunLog, step: Step):
        self.run, self.record = run, step

    def __enter__(self) -> Step:
        self.started = time.monotonic()
        log.info("loading %s", self.record.table)
        return self.record

    def __exit__(self, kind, error, trace) -> None:
        self.record.seconds = time.monotonic() - self.started
        if error is not None:
            self.record.status = "failed"
            log.error("%s failed after %.2f s: %s", self.record.table, self.record.seconds, error)
        elif self.record.status == "running":
            self.record.status = "loaded"
        if self.record.seconds > self.run.slow_after:
            log.warning("%s took %.2f s", self.record.table, self.record.seconds)
        self.run.steps.append(self.record)
