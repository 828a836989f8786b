"""Merge into a table kept by month, rewriting only the months in which something changes.

The stored keys alone say in which months the batch's rows lie. Those months are
compared with the batch, and the rows that are new or differ, with the month they come
from and the month they go to, are written to scratch. The months they name are then
overwritten: what stayed in them and the changed rows. A batch that changes nothing
writes nothing. A row whose time changes leaves its month for another. The first batch of
a table has nothing to be compared with and is written straight to its months.

A merge can be repeated after a failure: changed rows that already stand in the table
are found unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shopspark.operators.merge import ACTION, INSERT, KEEP, UNCHANGED, UPDATE, MergeSpec, chosen_columns, merge, require_unique
from shopspark.sources.monthly import MONTH, MonthlyTable, month_of
from shopspark.storage import materialize

GOES_TO = "_goes_to"


@dataclass(frozen=True)
class MonthlyMerge:
    """What a merge did. ``keep`` counts the rows of the compared months that the batch does not have."""

    actions: dict[str, int]
    moved: int = 0
    months: tuple[str, ...] = ()
    rows_written: int = 0


NOTHING = {INSERT: 0, UPDATE: 0, UNCHANGED: 0, KEEP: 0}


def _months(rows: DataFrame, column: str = MONTH) -> list[str]:
    """Distinct months, one row each: as many as the calendar has."""
    return sorted(r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().collect())


def matched_months(table: MonthlyTable, batch: DataFrame, spec: MergeSpec) -> list[str]:
    """Months of the stored rows whose keys the batch has; reads keys only, and nothing where nothing is stored."""
    if not table.exists():
        return []
    if table.time in spec.keys:
        return _months(batch.select(month_of(F.col(table.time)).alias(MONTH)))
    keys = list(spec.keys)
    return _months(table.rows().select(*keys, MONTH).join(batch.select(*keys), keys, "left_semi"))


def observed_changes(merged: DataFrame, name: str) -> tuple[DataFrame, dict[str, int]]:
    """Of a merged table the rows to insert or update, written to scratch, and the rows per action."""
    seen = Observation()
    counters = [F.count(F.when(F.col(ACTION) == a, 1)).alias(a) for a in NOTHING]
    changed = merged.observe(seen, *counters).where(F.col(ACTION).isin(INSERT, UPDATE))
    return materialize(changed, f"changes-{name}"), dict(seen.get)


def changed_rows(table: MonthlyTable, batch: DataFrame, spec: MergeSpec) -> tuple[DataFrame, dict[str, int]]:
    """Rows to insert or update, with the month they come from (null: new) and go to, and the rows per action."""
    stored = table.rows().where(F.col(MONTH).isin(matched_months(table, batch, spec)))
    merged = merge(stored, batch.drop(MONTH), spec).withColumn(GOES_TO, month_of(F.col(table.time)))
    return observed_changes(merged, table.name)


def merge_months(table: MonthlyTable, batch: DataFrame, spec: MergeSpec, checked: bool = False) -> MonthlyMerge:
    """Merge ``batch``; ``checked`` says it has rows and its keys are known to be unique."""
    if not checked:
        if batch.isEmpty():
            return MonthlyMerge(dict(NOTHING))
        require_unique(batch, spec.keys)
    if not table.exists():
        return _first_load(table, batch, spec)
    changed, actions = changed_rows(table, batch, spec)
    if not actions[INSERT] + actions[UPDATE]:
        return MonthlyMerge(actions)
    return overwrite_changed(table, changed, actions, spec)


def _first_load(table: MonthlyTable, batch: DataFrame, spec: MergeSpec) -> MonthlyMerge:
    """Into a table without rows: all rows are inserted, so they are read once and go straight to their months."""
    written = table.overwrite(table.aligned(batch, chosen_columns(batch.drop(MONTH), spec)))
    return MonthlyMerge({**NOTHING, INSERT: written}, 0, tuple(table.months()), written)


def overwrite_changed(table: MonthlyTable, changed: DataFrame, actions: dict[str, int], spec: MergeSpec) -> MonthlyMerge:
    """Write the months that ``changed`` names: what stays in them and the changed rows."""
    left, met = _months(changed), _months(changed, GOES_TO)
    touched = sorted({*left, *met})
    names = table.schema.names
    replaced = changed.where(F.col(ACTION) == UPDATE).select(*spec.keys)
    kept = table.rows().where(F.col(MONTH).isin(touched)).join(replaced, list(spec.keys), "left_anti")
    fresh = changed.select(*names, F.col(GOES_TO).alias(MONTH))
    # A month that every row leaves has nothing to be overwritten with.
    alone = [month for month in left if month not in met]
    emptied = sorted({*alone} - {*_months(kept.where(F.col(MONTH).isin(alone)))}) if alone else []
    written = table.overwrite(kept.select(*names, MONTH).unionByName(fresh))
    table.remove(emptied)
    moved = changed.where(F.col(MONTH) != F.col(GOES_TO)).count() if alone or len(touched) > 1 else 0
    return MonthlyMerge(actions, moved, tuple(touched), written)
