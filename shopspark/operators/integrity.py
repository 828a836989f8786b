"""Foreign keys: keep rows whose references exist, report the others."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopspark.storage import materialize

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class ForeignKey:
    """``column`` must appear in ``target[target_column]``.

    Only the key column of the target is read. Spark broadcasts it when its
    measured size allows, else joins by shuffle with skew handling.
    """

    column: str
    target: DataFrame
    target_column: str = "id"
    name: str = ""

    @property
    def label(self) -> str:
        return self.name or self.column

    def ids(self) -> DataFrame:
        return self.target.select(F.col(self.target_column).alias("_ref"))


def _joined(df: DataFrame, fk: ForeignKey, how: str) -> DataFrame:
    ids = fk.ids()
    return df.join(ids, df[fk.column] == ids["_ref"], how)


def keep_valid(df: DataFrame, fks: Sequence[ForeignKey]) -> DataFrame:
    """Rows that satisfy every foreign key (a null reference does not)."""
    return reduce(lambda rows, fk: _joined(rows, fk, "left_semi"), fks, df)


def orphans(df: DataFrame, fk: ForeignKey) -> DataFrame:
    """Rows whose reference is missing."""
    return _joined(df, fk, "left_anti")


def orphan_report(df: DataFrame, fks: Sequence[ForeignKey]) -> DataFrame:
    """(foreign_key, missing_id, orphan_rows) for every reference that is missing."""
    parts = [
        orphans(df.select(fk.column), fk)
        .groupBy(F.col(fk.column).cast("bigint").alias("missing_id"))
        .agg(F.count(F.lit(1)).alias("orphan_rows"))
        .select(F.lit(fk.label).alias("foreign_key"), "missing_id", "orphan_rows")
        for fk in fks
    ]
    return reduce(DataFrame.unionByName, parts)


def mark_drops(df: DataFrame, fks: Sequence[ForeignKey]) -> DataFrame:
    """Add ``dropped_by``: the first foreign key a row breaks, null if none.

    One pass over the rows attributes each loss; target keys must be unique.
    """
    rows, verdict = df, F.lit(None).cast("string")
    for position, fk in reversed(list(enumerate(fks))):
        flag = f"_ok{position}"
        ids = fk.ids().withColumn(flag, F.lit(True))
        rows = rows.join(ids, rows[fk.column] == ids["_ref"], "left").drop("_ref")
        verdict = F.when(F.col(flag).isNull(), fk.label).otherwise(verdict)
    return rows.withColumn("dropped_by", verdict).drop(*[f"_ok{i}" for i in range(len(fks))])


#: More missing ids than these are not broadcast: packed in Parquet they look smaller to the planner than they are in memory.
MOST_SENT = 2_000_000


@dataclass(frozen=True)
class Missing:
    """The ids of a foreign key that are referred to and not there, in scratch; None when there are none."""

    fk: ForeignKey
    ids: DataFrame | None


def missing_references(df: DataFrame, fks: Sequence[ForeignKey]) -> list[Missing]:
    """Of each key the missing ids among the rows that keep the keys before it.

    Only distinct ids are shuffled, never whole rows; ``df`` is read once for each key, of which Parquet
    sources read single columns.
    """
    found: list[Missing] = []
    for fk in fks:
        ref, ids = df[fk.column], fk.ids()
        kept = mark_missing(df, found).where(F.col("dropped_by").isNull() & ref.isNotNull())
        referred = kept.select(ref.alias("_id")).distinct()
        gone = materialize(referred.join(ids, F.col("_id") == F.col("_ref"), "left_anti"), f"missing-{fk.label}")
        number = gone.count()
        found.append(Missing(fk, None if not number else gone if number <= MOST_SENT else gone.hint("merge")))
    return found


def mark_missing(df: DataFrame, missing: Sequence[Missing]) -> DataFrame:
    """``mark_drops`` from the missing ids: whole rows meet only those, which are few in sound data."""
    rows, verdict = df, F.lit(None).cast("string")
    for position, (fk, ids) in reversed([(i, (m.fk, m.ids)) for i, m in enumerate(missing)]):
        broken = F.col(fk.column).isNull()
        if ids is not None:
            flag = f"_gone{position}"
            rows = rows.join(ids.select(F.col("_id").alias(f"_id{position}"), F.lit(True).alias(flag)), rows[fk.column] == F.col(f"_id{position}"), "left")
            rows = rows.drop(f"_id{position}")
            broken = broken | F.col(flag).isNotNull()
        verdict = F.when(broken, fk.label).otherwise(verdict)
    return rows.withColumn("dropped_by", verdict).drop(*[f"_gone{i}" for i in range(len(missing))])


def warn_orphans(
    df: DataFrame, fk: ForeignKey, show: str, sample: int = 50, count: int | None = None, lost: DataFrame | None = None
) -> int:
    """Log how many rows lose their reference and a few of them; the load goes on.

    ``count`` is their number and ``lost`` the rows, where they are known already.
    """
    lost = orphans(df, fk) if lost is None else lost
    count = lost.count() if count is None else count
    if count:
        examples = [row[0] for row in lost.select(show).limit(sample).collect()]
        log.warning("%s: %d rows without a match are left out, such as %s", fk.label, count, examples)
    return count
